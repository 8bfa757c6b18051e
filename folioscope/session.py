"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Name of this process's tables in the checkpoint folder, and the folders it has written to.
_RUN = uuid.uuid4().hex[:12]
_FOLDERS: dict[str, SparkSession] = {}


def local_session(cores: int | str = 8, app: str = "folioscope") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_folioscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="folioscope-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(f.name)
    atexit.register(Path(f.name).unlink, missing_ok=True)
    sc._folioscope_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``.

    Only where the setting is absent and no folder was set by hand (tests, local runs) a local
    folder is made: on a cluster the folder must be one that all executors share.
    """
    sc = spark.sparkContext
    already = sc.getCheckpointDir()
    if already:
        return already
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"folioscope-{os.getpid()}")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as a compressed table: later stages read the columns
    they need of it, so a lost executor neither recomputes the lineage nor changes values that depend on
    row order. ``clear_cuts`` takes the tables away; where the process ends first, it does so then."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/folioscope-{_RUN}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = spark
        atexit.register(clear_cuts, folder)
    at = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def clear_cuts(folder: str | None = None) -> None:
    """Deletes the tables that ``cut`` wrote (below ``folder``, or all). Results that still read them must be done."""
    for f in [folder] if folder else list(_FOLDERS):
        spark = _FOLDERS.pop(f, None)
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone already: a folder of this machine goes without it
            shutil.rmtree(re.sub(r"\Afile:/*(?=/)", "", f), ignore_errors=True)


def bounded_collect(df: DataFrame, bound: int, what: str) -> list:
    """Rows of a small reference table; raises beyond ``bound`` instead of overloading the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows")
    return rows


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has the name (any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
