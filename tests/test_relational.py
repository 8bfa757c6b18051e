import math

import pytest
from pyspark.sql import functions as F

from folioscope.operators import filters, geometry as g, grouping, pairing, reports, statistics as s

SCORES = "k string, value double, n_ref long"


def cleared(spark, rows, **options):
    out = s.summarise_cleared(spark.createDataFrame(rows, SCORES), ["k"], **options)
    return {r.k: r for r in out.collect()}


def test_statistics(spark):
    ger = [("ger", v, n) for v, n in ((96.53, 675), (94.91, 1395), (94.40, 1466), (86.44, 1520), (93.44, 1520))]
    r = cleared(spark, [*ger, ("eng", 95.7, 810)])
    assert round(r["ger"]["std"], 3) == 3.498 and r["ger"].cleared is None and r["eng"].n_total == 1 and r["eng"]["std"] == 0
    w = cleared(spark, [("a", 90.0, 10), ("a", 50.0, 1000), ("z", 1.0, 0), ("z", 3.0, 0)], weighted=True)
    assert round(w["a"]["mean"], 3) == 50.396 and w["z"]["mean"] == 2.0


def test_outliers(spark):
    r = cleared(spark, [("a", v, 1) for v in (90.0, 91.0, 92.0, 93.0, 94.0, 10.0)])["a"]
    assert r.n_total == 6 and r.cleared.n_total == 5 and r.cleared["mean"] == 92.0
    half = cleared(spark, [("a", v, 1) for v in (90.0, 90.0, 90.0, 95.0)])["a"]
    assert half.cleared.n_total == 0 and half.cleared["mean"] is None and half.cleared.n_chars == 0
    assert cleared(spark, [("a", v, 1) for v in (90.0, 90.0, 90.0, 95.0)], weighted=True)["a"].cleared["mean"] == 0.0
    assert cleared(spark, [("a", v, 1) for v in (90.0, 91.0, 10.0, 92.0)], strict=True)["a"].cleared is None
    assert cleared(spark, []) == {}


def test_groups(spark):
    e = spark.createDataFrame([("/x/ocr/1/GT-PAGE/p.xml", "ocr", "/gt/p.art.gt.xml", {"lang": "ger"}), ("/x/y.xml", "none", "/gt/y.gt.xml", {})],
                              "path_candidate string, root string, path_groundtruth string, tags map<string,string>")
    e = grouping.with_entry_columns(e).withColumns({"metric": F.lit("Cs"), "mods_dateIssued": F.lit("1801"), "mets_div_type": F.lit("issue")})
    keys = lambda spec: sorted((r.path_candidate[-5:], r.eval_key) for r in grouping.explode_keys(e, grouping.Grouping.parse(spec)).collect())
    assert keys("directory") == [("p.xml", "Cs@directory:1"), ("p.xml", "Cs@directory:ocr"), ("y.xml", "Cs@directory:x")]
    assert keys("directory:-1,directory:0") == [("p.xml", "Cs@directory_-1:1"), ("p.xml", "Cs@directory_0:ocr"), ("y.xml", "Cs@directory_-1:x"), ("y.xml", "Cs@directory_0:x")]
    assert keys("type+metadata:lang")[:2] == [("p.xml", "Cs@metadata_lang:ger"), ("p.xml", "Cs@type:article")] and ("p.xml", "Cs@type:article/metadata_lang:ger") in keys("type+metadata:lang")
    assert ("y.xml", "Cs@mods_dateIssued_century:19th") in keys("mods:dateIssued:century,mets:TYPE") and ("y.xml", "Cs@mets_div_type:issue") in keys("mets:TYPE")
    assert keys(r"pattern:(\w)\.xml:1") == [("p.xml", r"Cs@pattern_(\w)\.xml:p"), ("y.xml", r"Cs@pattern_(\w)\.xml:y")]
    assert sorted(r.eval_key for r in grouping.explode_directories(e, by_type=True).collect()) == ["Cs@1", "Cs@ocr", "Cs@ocr@article", "Cs@x"]
    assert [tuple(r) for r in grouping.coverage(e, grouping.Grouping.parse("metadata:lang")).collect()] == [("metadata_lang", 1, 1)]
    for bad in ("", "what", "mods:nothing", "type,size:3", "mods:title:year", "pattern:("):
        with pytest.raises(ValueError):
            grouping.Grouping.parse(bad)


def test_filters(spark):
    df = spark.createDataFrame([("fre+ger+lat",), ("ger",), ("ger+fre",), (" ",), (None,)], "x string")
    hit = lambda e: [bool(r.v) for r in df.select(filters.value_matches(F.col("x"), F.lit(e)).alias("v")).collect()]
    assert hit("ger+fre") == [True, False, True, False, False] and hit("ger") == [False, True, False, False, False] and not any(hit("+"))
    e = df.withColumn("tags", F.create_map(F.lit("x"), F.col("x")))
    assert tuple(filters.filter_report(e, filters.Filter.parse("metadata:x=ger")).collect()[0]) == (5, 1, 2, 2, 80.0)
    assert tuple(filters.filter_report(e.limit(0), filters.Filter.parse("metadata:x=ger")).collect()[0]) == (0, 0, 0, 0, 0.0)
    for bad in ("x", "metadata:x=", "=ger", "no:x=1"):
        with pytest.raises(ValueError):
            filters.Filter.parse(bad)


def test_pairs(spark):
    c = spark.createDataFrame([("/c/p1.xml",), ("/c/p10.xml",), ("/c/q.xml",)], "path string")
    r = spark.createDataFrame([("/g/p10.gt.xml",), ("/g/p1.gt.xml",), ("/g/p1.art.gt.xml",), ("/g/q.jpg",)], "path string")
    assert {(x.path[3:], x.path_groundtruth) for x in pairing.pair_by_prefix(c, r).collect()} == {("p1.xml", "/g/p1.gt.xml"), ("p10.xml", "/g/p10.gt.xml"), ("q.xml", None)}
    h = spark.createDataFrame([("FULL/a.xml", 2), ("x/a.xml.bak", 1), ("sub/b.xml", 3)], "href string, ord int")
    e = spark.createDataFrame([("/g/a.xml",), ("/g/sub/b.xml",), ("/g/c.xml",), (None,)], "path_groundtruth string")
    m = {x.path_groundtruth: x.href for x in pairing.match_hrefs(e, h).collect()}
    assert m == {"/g/a.xml": "x/a.xml.bak", "/g/sub/b.xml": "sub/b.xml", "/g/c.xml": None, None: None}
    i = spark.createDataFrame([("/i/0001.jpg",), ("/i/2.tif",), ("/i/02.png",), ("/i/x.txt",)], "path string")
    p = spark.createDataFrame([("/o/a_0001.xml",), ("/o/page02.xml",), ("/o/none.xml",)], "path string")
    assert {x.path[3:]: x.n_images for x in pairing.match_images(p, i).collect()} == {"a_0001.xml": 1, "page02.xml": 2, "none.xml": 0}


def test_geometry(spark):
    df = spark.createDataFrame([("0,0 4,2",), ("0,0 4,0 4,4",), ("a,b",), (None,)], "t string").withColumn("p", g.polygon(F.col("t")))
    got = df.select(g.point_list(F.col("p")).alias("l"), g.centroid(F.col("p")).alias("c"), g.vertex_mean(F.col("p")).alias("m")).collect()
    assert got[0].l == "0,0 4,0 4,2 0,2" and tuple(got[0].c) == (2.0, 1.0) and got[2].l is None and got[3].c is None
    assert tuple(round(v, 6) for v in got[1].c) == (2.666667, 1.333333) and tuple(round(v, 3) for v in got[1].m) == (2.667, 1.333)
    with pytest.raises(ValueError):
        g.parse_polygon("1,2")


def test_points_in_hull_against_brute_force(spark):
    frame = [(0.0, 0.0), (10.0, 1.0), (12.0, 8.0), (5.0, 3.0), (3.0, 11.0)]
    hull = g.convex_hull(frame)
    assert (5.0, 3.0) not in hull
    pts = [(float(x), float(y)) for x in range(-1, 14) for y in range(-1, 13)]

    def inside(p):
        turn = 0.0
        for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
            if abs((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)) < 1e-12 and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
                return False
            turn += math.remainder(math.atan2(by - p[1], bx - p[0]) - math.atan2(ay - p[1], ax - p[0]), 2 * math.pi)
        return abs(turn) > 3

    df = spark.createDataFrame([(p,) for p in pts], "p struct<x:double,y:double>")
    got = [bool(r.v) for r in df.select(g.in_frame(F.col("p"), frame).alias("v")).collect()]
    assert got == [inside(p) for p in pts] and any(got)


def test_frame_cut(spark):
    box = lambda x, y, w, h: [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]
    rows = [("f", "page", "p", None, None, box(0, 0, 100, 100)), ("f", "region", "r1", "r1", None, box(0, 0, 50, 50)), ("f", "line", "l1", "r1", "l1", box(0, 0, 50, 10)),
            ("f", "word", "w1", "r1", "l1", box(0, 0, 10, 10)), ("f", "word", "w2", "r1", "l1", box(20, 0, 10, 10)), ("f", "region", "r2", "r2", None, box(60, 60, 9, 9)), ("f", "line", "l2", "r2", "l2", box(60, 60, 9, 9)),
            ("f", "word", "w3", "r2", "l2", box(60, 60, 9, 9))]
    p = spark.createDataFrame(rows, f"path string, level string, piece_id string, region_id string, line_id string, poly {g.POLYGON}")
    cut = g.cut_to_frame(p, [(15, -1), (40, -1), (40, 20), (15, 20)])
    assert {(r.piece_id, r.t) for r in cut.select("piece_id", g.point_list(F.col("poly")).alias("t")).collect()} == {
        ("p", "0,0 100,0 100,100 0,100"), ("w2", "20,0 30,0 30,10 20,10"), ("l1", "20,0 30,0 30,10 20,10"), ("r1", "20,0 30,0 30,10 20,10")}
    assert {tuple(r) for r in g.change_log(p, cut).collect()} == {("word", "removed", 2), ("line", "removed", 1), ("region", "removed", 1), ("line", "resized", 1), ("region", "resized", 1)}


def test_reports(spark):
    sc = spark.createDataFrame([("/o/a+b_1.xml", "article", "Cs", 0, 39.2, 5308), ("/o/a+b_1.xml", "article", "Ls", 1, 38.54, 12383)], "path_candidate string, gt_type string, metric string, metric_idx int, value double, n_ref long")
    assert reports.pair_lines(sc).collect()[0].line == "[a:b_1](art) [Cs:39.20(5308), Ls:38.54(12K+)(- 0.66)]"
    lines = [r.line for r in reports.summary_lines(s.summarise_cleared(spark.createDataFrame([("Cs@x", v, 1000) for v in (90.0, 91.0, 92.0, 93.0, 94.0, 10.0)], SCORES), ["k"]).withColumnRenamed("k", "eval_key")).orderBy("part").collect()]
    assert lines == ["Cs@x\t  6 items 6_000 refs\t∅:78.33 M:91.50 σ:30.59", "Cs@x(-1)\t  5 items 5_000 refs\t∅:92.00 M:92.00 σ: 1.41"]
    b = spark.createDataFrame([(1, "éa", 9, 5), (2, " ", 9, 5)], "k int, t string, w int, h int")
    assert [r.line for r in reports.box_lines(b, "k", "t", "w", "h").orderBy("ord").collect()] == ["é 0 0 9 5 0", "a 0 0 9 5 0", "\t 0 0 9 5 0"]
    assert reports.right_to_left_lines(spark.createDataFrame([(1, "אב 12", 9, 5)], "k int, t string, w int, h int"), "k", "t", "w", "h").collect()[0].line == "WordStr 0 0 9 5 0 #12 בא"
