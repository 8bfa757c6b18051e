"""The evaluation of candidates against references as one plan.

    Evaluation(spark).candidates("ocr").reference("gt").metrics("Cs,Ls").group("directory,type").run()

Every file is parsed once; all measures are columns over the same pair of texts; filters on metadata
stand before the parsing. A wrong specification fails before any file is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..operators.filters import Filter, apply_filters, filter_report
from ..operators.geometry import words_in_boxes, words_in_frame
from ..operators.grouping import Grouping, explode_directories, explode_keys, with_entry_columns
from ..operators.pairing import pair_by_prefix
from ..operators.statistics import summarise_cleared
from ..session import cut
from ..sources import layout, mets

#: Measures by short and long name, in the order of the reports.
METRICS = {
    "Cs": "Characters", "Ls": "Letters", "Ws": "Words", "BoWs": "BagOfWords", "IRPre": "Precision", "IRRec": "Recall", "IRF": "FMeasure",
    "DictLT": "DictionaryLangTool",
}
_ALIASES = {long: short for short, long in METRICS.items()} | {s: s for s in METRICS} | {"Pre": "IRPre", "Rec": "IRRec"}


def parse_metrics(spec: str) -> list[str]:
    """Short names of the measures in a comma list; a ValueError names unknown ones."""
    names = [n.strip() for n in spec.split(",") if n.strip()]
    unknown = [n for n in names if n not in _ALIASES]
    if unknown or not names:
        raise ValueError(f"unknown measures: {', '.join(unknown) or 'none given'}; known are {', '.join(METRICS)}")
    return list(dict.fromkeys(_ALIASES[n] for n in names))


#: Own measures: long name and a function (reference, candidate, stop words) -> (value, size of the reference).
_OWN: dict[str, Callable[[Column, Column, list[str]], tuple[Column, Column]]] = {}


def register_metric(short: str, long: str, make: Callable[[Column, Column, list[str]], tuple[Column, Column]]) -> None:
    """Adds a measure of one's own, chosen by either name; ``make`` gets the prepared texts as columns."""
    if short in METRICS and short not in _OWN:
        raise ValueError(f"{short} is a measure already")
    METRICS[short], _OWN[short] = long, make
    _ALIASES.update({short: short, long: short})


def metric_columns(names: Sequence[str], r: Column, c: Column, stop: list[str], made_terms: tuple[Column, Column] | None = None) -> dict[str, tuple[Column, Column]]:
    """(value, size of the reference) of each measure over prepared texts; sizes are characters, tokens or distinct tokens.

    ``made_terms`` are columns with the terms of both texts, where those have been made already.
    """
    d = sim.token_distances(r, c)  # one pass over the tokens for both measures that need it
    rt, ct = made_terms or (sim.terms(r, stop), sim.terms(c, stop))
    terms, p, q = F.size(rt), sim.term_precision(rt, ct), sim.term_recall(rt, ct)
    made: dict[str, Callable[[], tuple[Column, Column]]] = {
        "Cs": lambda: (sim.character_similarity(r, c, long=True), F.length(r)),
        "Ls": lambda: (sim.letter_similarity(r, c, long=True), F.length(tx.letters(r))),
        "Ws": lambda: (sim.word_similarity(r, c, d), d["n_r"]),
        "BoWs": lambda: (sim.bag_value(r, c, d), d["n_r"]),
        "IRPre": lambda: (p, terms),
        "IRRec": lambda: (q, terms),
        "IRF": lambda: (sim.f_measure(p, q), terms),
    }
    return {n: _OWN[n](r, c, stop) if n in _OWN else made[n]() for n in names}


def score(pairs: DataFrame, names: Sequence[str], stop: list[str], form: str = "NFC", reference: str = "text_reference", candidate: str = "text_candidate") -> DataFrame:
    """One row per pair and measure: metric, metric_idx, value (two decimals, halves to even) and n_ref; pairs without a value fall out."""
    own = pairs.columns
    pairs = pairs.withColumns({"_r": tx.prepared(F.col(reference), form), "_c": tx.prepared(F.col(candidate), form)})
    made = None
    if any(n.startswith("IR") for n in names):  # all three measures read the same terms
        pairs = pairs.withColumns({"_rt": sim.terms(F.col("_r"), stop), "_ct": sim.terms(F.col("_c"), stop)})
        made = F.col("_rt"), F.col("_ct")
    cols = metric_columns(names, F.col("_r"), F.col("_c"), stop, made)
    listed = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit(i).alias("metric_idx"), F.bround(v.cast("double"), 2).alias("value"), s.cast("bigint").alias("n_ref"))
        for i, (n, (v, s)) in enumerate(cols.items())
    ])
    keep = [c for c in own if c not in (reference, candidate)]
    return pairs.select(*keep, F.inline(listed)).filter("value IS NOT NULL")


class Evaluation:
    """Builder of an evaluation; every method returns the builder, ``run`` the summary per key.

    Of a candidate only words inside the printed area of its reference count (``layout.bounding_boxes``);
    ``options(ignore_geometry=True)`` turns that off, a ``frame`` takes its place. A pair whose reference has
    no readable area is left out; ``problems`` lists it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._metrics, self._filters, self._grouping = spark, ["Cs", "Ls"], [], None
        self._weighted = self._strict = self._ignore_geometry = False
        self._form, self._stop, self._frame, self._mets = "NFC", None, None, None
        self._candidates = self._reference = None
        self._checker: Callable[[], Callable[[str], int]] | None = None

    def candidates(self, folder: str) -> Evaluation:
        """A folder, or one file."""
        self._candidates = folder.rstrip("/")
        return self

    def reference(self, folder: str) -> Evaluation:
        """A folder, or one file, which then belongs to the one candidate file."""
        self._reference = folder.rstrip("/")
        return self

    def metrics(self, spec: str) -> Evaluation:
        self._metrics = parse_metrics(spec)
        return self

    def where(self, *specs: str) -> Evaluation:
        self._filters += [(s, Filter.parse(s)) for s in specs]
        return self

    def group(self, spec: str | None) -> Evaluation:
        self._grouping = (spec, Grouping.parse(spec)) if spec else None
        return self

    def mets(self, path: str) -> Evaluation:
        self._mets = path
        return self

    def frame(self, polygon: Sequence[tuple[float, float]]) -> Evaluation:
        """Only the candidates' words inside the polygon count, whatever the references' areas are."""
        self._frame = polygon
        return self

    def spell_checker(self, make: Callable[[], Callable[[str], int]]) -> Evaluation:
        """Makes the client of the measure ``DictLT``, once per task: a function from a text to its number of findings."""
        self._checker = make
        return self

    def options(self, weighted: bool = False, strict: bool = False, form: str = "NFC", stop: list[str] | None = None, ignore_geometry: bool = False) -> Evaluation:
        self._weighted, self._strict, self._form, self._stop, self._ignore_geometry = weighted, strict, form, stop, ignore_geometry
        return self

    def _is_file(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            raise ValueError(f"{path} is no file or folder")
        return fs.getFileStatus(p).isFile()

    def pairs(self) -> DataFrame:
        """(path, path_groundtruth) of all candidates; null where there is no reference."""
        if not self._candidates or not self._reference:
            raise ValueError("candidates and reference must be set")
        single, given = self._is_file(self._candidates), self._is_file(self._reference)
        if given and not single:
            raise ValueError("a reference file requires a single candidate file")
        c = layout.files(self.spark, self._candidates, "*" if single else "*.{xml,txt}").select("path")
        if given:
            return c.join(layout.files(self.spark, self._reference, "*").select(F.col("path").alias("path_groundtruth")))  # one row each
        return pair_by_prefix(c, layout.files(self.spark, self._reference, "*.{xml,txt}").select("path"))

    def unpaired(self) -> DataFrame:
        """(path): candidates that have no reference and are left out."""
        return self.pairs().filter("path_groundtruth IS NULL").select("path")

    def entries(self) -> DataFrame:
        """Pairs of candidate and reference, with all group keys' columns, before the filters."""
        e = self.pairs().withColumnRenamed("path", "path_candidate").filter("path_groundtruth IS NOT NULL")
        root = PurePath(self._candidates)
        e = with_entry_columns(e.withColumn("root", F.lit(root.parent.name if self._is_file(self._candidates) else root.name)))
        if self._mets:
            specs = [s.partition("=")[0] for s, _ in self._filters] + ([p.strip() for p in self._grouping[0].replace("+", ",").split(",")] if self._grouping else [])
            e = mets.with_metadata(e, self._read_mets(specs), specs)
        return e

    def _read_mets(self, specs: Sequence[str] = ()) -> mets.Mets:
        return mets.read_mets(layout.files(self.spark, self._mets, "*", recursive=False), {s[5:]: s[5:] for s in specs if s.startswith("mods:.//")})

    def mets_coverage(self) -> DataFrame:
        """How the pairs and the METS files' full-text references meet; see ``mets.coverage``."""
        return mets.coverage(self.pairs(), self._read_mets())

    def report_filters(self) -> dict[str, DataFrame]:
        """What each filter leaves out of what the ones before it keep."""
        e, out = self.entries(), {}
        for spec, f in self._filters:
            out[spec] = filter_report(e, f)
            e = apply_filters(e, [f])
        return out

    def _files(self, folder: str, wanted: DataFrame) -> DataFrame:
        return layout.files(self.spark, folder, "*" if self._is_file(folder) else "*.{xml,txt}").join(wanted, "path", "left_semi")

    def problems(self) -> DataFrame:
        """(path_candidate, path_groundtruth, problem): pairs of which the page sizes differ, and references without a readable area."""
        e = self.entries().select("path_candidate", "path_groundtruth")
        rows = {side: self._files(folder, e.select(F.col(side).alias("path"))) for side, folder in (("path_candidate", self._candidates), ("path_groundtruth", self._reference))}
        size = {side: layout.page_dimensions(r).select(F.col("path").alias(side), F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height")).alias(f"size_{side}")) for side, r in rows.items()}
        both = e.join(size["path_candidate"], "path_candidate").join(size["path_groundtruth"], "path_groundtruth")
        differ = both.filter("size_path_candidate <> size_path_groundtruth").select(
            "path_candidate", "path_groundtruth", F.concat(F.lit("page dimensions differ: candidate "), "size_path_candidate", F.lit(", reference "), "size_path_groundtruth").alias("problem"))
        if self._ignore_geometry or self._frame:
            return differ
        bad = layout.bounding_boxes(rows["path_groundtruth"]).filter("error IS NOT NULL").select(F.col("path").alias("path_groundtruth"), "error")
        return differ.unionByName(e.join(bad, "path_groundtruth").select("path_candidate", "path_groundtruth", F.concat(F.lit("no printed area: "), "error").alias("problem")))

    def texts(self) -> DataFrame:
        """The filtered entries with ``text_candidate`` and ``text_reference``; each file is parsed once."""
        e = cut(apply_filters(self.entries(), [f for _, f in self._filters]))
        c = self._files(self._candidates, e.select(F.col("path_candidate").alias("path")))
        r = self._files(self._reference, e.select(F.col("path_groundtruth").alias("path")))
        pieces = cut(layout.read_pieces(c))
        if self._frame:
            pieces = words_in_frame(pieces, self._frame)
        elif not self._ignore_geometry:
            areas = cut(layout.bounding_boxes(r))
            e = e.join(areas.filter("error IS NOT NULL").select(F.col("path").alias("path_groundtruth")), "path_groundtruth", "left_anti")
            own = e.select(F.col("path_candidate").alias("path"), "path_groundtruth").join(areas.select(F.col("path").alias("path_groundtruth"), "box"), "path_groundtruth")
            pieces = words_in_boxes(pieces, own.select("path", "box"))
        side = lambda t, name: t.select(F.col("path").alias("path_candidate" if name == "candidate" else "path_groundtruth"), F.col("text").alias(f"text_{name}"))
        return e.join(side(layout.texts_of(c, pieces), "candidate"), "path_candidate").join(side(layout.texts_of(r, cut(layout.read_pieces(r))), "reference"), "path_groundtruth")

    def scores(self) -> DataFrame:
        """One row per pair and measure."""
        stop = tx.default_stop_words(self.spark) if self._stop is None else self._stop
        texts = self.texts()
        plain = [m for m in self._metrics if m != "DictLT"]
        if "DictLT" not in self._metrics:
            return score(texts, plain, stop, self._form)
        if self._checker is None:
            raise ValueError("the measure DictLT needs a spell checker")
        texts = cut(texts)
        checked = sim.dictionary_similarity(texts.withColumn("_t", tx.prepared(F.col("text_candidate"), self._form)), "path_candidate", "_t", self._checker)
        checked = checked.select("path_candidate", F.lit("DictLT").alias("metric"), F.lit(len(plain)).alias("metric_idx"), F.bround("value", 2).alias("value"), "n_ref")
        checked = texts.drop("text_candidate", "text_reference").join(checked, "path_candidate")
        return score(texts, plain, stop, self._form).unionByName(checked) if plain else checked

    def traces(self) -> DataFrame:
        """(path, line): what each step of the preparation found and left, for both texts of every pair."""
        t = self.texts()
        sides = [t.select(F.col(f"path_{p}").alias("path"), F.col(f"text_{n}").alias("x")) for p, n in (("candidate", "candidate"), ("groundtruth", "reference"))]
        x = sides[0].unionByName(sides[1]).select("path", "x", tx.normalized_whitespace(F.col("x")).alias("w")).withColumn("e", tx.normalized_encoding(F.col("w"), self._form))
        x = x.withColumns({"l": tx.letters(F.col("e")), "t": tx.tokens(F.col("e"))})
        steps = F.array(
            tx.step_report("normalize_whitespace", F.col("x"), F.col("w")), tx.step_report(f"normalize_encoding {self._form}", F.col("w"), F.col("e")),
            tx.step_report("letters", F.col("e"), F.col("l")), tx.step_report("distinct tokens", F.col("t"), F.array_distinct("t"), "tokens"),
        )
        return x.select("path", F.posexplode(steps).alias("at", "step")).select("path", "at", tx.step_line(F.col("step")).alias("line"))

    def run(self, scores: DataFrame | None = None) -> DataFrame:
        """Summary per key, sorted by key. Without a grouping the keys are directories and types."""
        s = self.scores() if scores is None else scores
        keyed = explode_keys(s, self._grouping[1]) if self._grouping else explode_directories(s, by_type=True)
        return summarise_cleared(keyed, ["eval_key"], self._weighted, self._strict).orderBy("eval_key")
