import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import cli
from folioscope.operators import images as im, training_pairs as tp
from folioscope.operators.geometry import point_list
from folioscope.sources import layout, mets, writers
from folioscope.streaming import live

ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Tags><OtherTag ID="ulb_groundtruth_type" VALUE="art"/></Tags><Layout><Page ID="p" WIDTH="200" HEIGHT="100"><PrintSpace>
<TextBlock ID="b1" HPOS="0" VPOS="0" WIDTH="100" HEIGHT="40">
<TextLine ID="l1" HPOS="0" VPOS="0" WIDTH="100" HEIGHT="20"><String ID="s1" CONTENT="Ha" HPOS="0" VPOS="0" WIDTH="10" HEIGHT="20"/><String ID="s2" CONTENT="us" HPOS="10" VPOS="0" WIDTH="10" HEIGHT="20"/><SP/><String ID="s3" CONTENT="am" HPOS="30" VPOS="0" WIDTH="10" HEIGHT="20"/></TextLine>
<TextLine ID="l2" HPOS="0" VPOS="20" WIDTH="100" HEIGHT="20"><String ID="s4" CONTENT="See" HPOS="0" VPOS="20" WIDTH="10" HEIGHT="20"/><String ID="s5" CONTENT=" " HPOS="20" VPOS="20" WIDTH="10" HEIGHT="20"/><String ID="s6" CONTENT="gut" HPOS="60" VPOS="20" WIDTH="10" HEIGHT="20"/></TextLine>
<TextLine ID="l3" HPOS="0" VPOS="30" WIDTH="100" HEIGHT="20"/></TextBlock><TextBlock ID="b2" HPOS="0" VPOS="60" WIDTH="9" HEIGHT="9"/></PrintSpace></Page><Page ID="p2" WIDTH="1" HEIGHT="1"/></Layout></alto>"""
PAGE = """<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Page imageFilename="i.tif" imageWidth="200" imageHeight="100">
<ReadingOrder><OrderedGroup><RegionRefIndexed index="0" regionRef="r2"/><RegionRefIndexed index="x" regionRef="r1"/></OrderedGroup></ReadingOrder>
<TextRegion id="r1"><Coords points="0,0 50,0 50,20 0,20 "/><TextEquiv><Unicode>old</Unicode></TextEquiv><TextLine id="a"><Coords points="0,0 50,0 50,20 0,20"/><TextEquiv index="10"><Unicode>ten</Unicode></TextEquiv><TextEquiv index="2"><Unicode>two</Unicode></TextEquiv><Word id="w0"><Coords points="0,0 9,0 9,9"/><TextEquiv><Unicode>w</Unicode></TextEquiv></Word></TextLine></TextRegion>
<TextRegion id="r2"><Coords points="0,50 50,50 50,70 0,70"/><TextLine id="b"><Coords points="0,50 50,50 50,70 0,70"/><TextEquiv><Unicode>line</Unicode></TextEquiv><Word id="w1"><Coords points="0,50 9,50 9,59"/><TextEquiv><Unicode>one</Unicode></TextEquiv></Word><Word id="w2"><Coords points="10,50 19,50 19,59"/><TextEquiv><Unicode>two
more</Unicode></TextEquiv></Word></TextLine></TextRegion><TextRegion id="r3"><Coords points="0,90 5,90 5,95"/></TextRegion></Page></PcGts>"""
METS = """<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink">
<mets:dmdSec ID="D1"><mets:mdWrap><mets:xmlData><mods:mods><mods:language><mods:languageTerm type="code">ara</mods:languageTerm><mods:languageTerm type="code">eng</mods:languageTerm><mods:languageTerm type="text">Arabic</mods:languageTerm></mods:language><mods:originInfo><mods:dateIssued>1867</mods:dateIssued></mods:originInfo><mods:relatedItem><mods:dateIssued>1999</mods:dateIssued></mods:relatedItem></mods:mods></mets:xmlData></mets:mdWrap></mets:dmdSec>
<mets:dmdSec ID="D2"><mets:mdWrap><mets:xmlData><mods:mods><mods:language><mods:languageTerm type="code">ger</mods:languageTerm><mods:languageTerm type="text">German</mods:languageTerm></mods:language></mods:mods></mets:xmlData></mets:mdWrap></mets:dmdSec>
<mets:fileSec><mets:fileGrp USE="fulltext" DMDID="D2"><mets:file ID="F1"><mets:FLocat xlink:href="p1.gt.xml"/></mets:file><mets:file ID="F2" DMDID="D9 D1"><mets:FLocat xlink:href="p2.gt.xml"/></mets:file><mets:file ID="F3"><mets:FLocat xlink:href="p3.gt.xml"/></mets:file></mets:fileGrp><mets:fileGrp USE="IMAGE"><mets:file ID="I1"><mets:FLocat xlink:href="p1.jpg"/></mets:file></mets:fileGrp></mets:fileSec>
<mets:structMap TYPE="LOGICAL"><mets:div ID="L0" TYPE="volume" DMDID="D2"><mets:div ID="L1" TYPE="issue" DMDID="D1"/><mets:div ID="L2" LABEL="x" DMDID="D2"/></mets:div></mets:structMap>
<mets:structMap TYPE="PHYSICAL"><mets:div ID="P0"><mets:div ID="P1"><mets:fptr FILEID="F1"/></mets:div></mets:div></mets:structMap>
<mets:structLink><mets:smLink xlink:from="L2" xlink:to="P1"/><mets:smLink xlink:from="L1" xlink:to="P1"/></mets:structLink></mets:mets>"""


def files(spark, **content):
    return spark.createDataFrame([(f"/d/{k.replace('__', '.')}", bytearray(v.encode())) for k, v in content.items()], "path string, content binary")


def test_alto(spark):
    p = layout.read_pieces(files(spark, a__xml=ALTO)).cache()
    assert [(r.piece_id, r.text) for r in p.filter("level = 'word'").orderBy("line_ord", "word_ord").collect()] == [("s1", "Haus"), ("s3", "am"), ("s4", "See"), ("s6", "gut")]
    assert layout.page_texts(p).collect()[0].text == "Haus am See gut" and p.filter("level = 'region'").count() == 1
    assert p.filter("level = 'page'").select("subject", point_list(F.col("poly")).alias("t")).collect()[0] == ("art", "0,0 200,0 200,100 0,100")


def test_page_reading_order_and_texts(spark):
    p = layout.read_pieces(files(spark, a__xml=PAGE)).cache()
    assert layout.page_texts(p).collect()[0].text == "one two more ten" and p.filter("piece_id = 'r3'").count() == 0
    assert p.filter("level = 'page'").select(point_list(F.col("poly")).alias("t")).collect()[0].t.startswith("0,50 50,50")


def test_broken_files_and_plain_text(spark):
    rows = files(spark, a__xml=PAGE.replace('points="0,0 9,0 9,9"', 'points="0,0 9,0"').replace('<TextEquiv index="10"><Unicode>ten</Unicode></TextEquiv>', "").replace('<TextEquiv index="2"><Unicode>two</Unicode></TextEquiv>', ""), b__txt=" one \n two\n", c__xml="<x/>", d__xml="", e__xml=ALTO)
    errors = {r.path: r.error for r in layout.read_pieces(rows).filter("error IS NOT NULL").collect()}
    assert set(errors) == {"/d/a.xml", "/d/b.txt", "/d/c.xml", "/d/d.xml"} and "Word@ID=w0" in errors["/d/a.xml"]
    assert {r.path: r.text for r in layout.texts_of(rows).collect()}["/d/b.txt"] == "one two"
    assert layout.read_pieces(rows.limit(0)).count() == 0


def test_boxes(spark):
    rows = files(spark, a__xml=ALTO, b__xml=PAGE, x_100x200_300x400__xml=ALTO, c__txt="plain")
    box = {r.path: r.box and tuple(r.box) for r in layout.bounding_boxes(rows).collect()}
    assert box == {"/d/a.xml": (0.0, 0.0, 70.0, 40.0), "/d/b.xml": (0.0, 0.0, 50.0, 70.0), "/d/x_100x200_300x400.xml": (100.0, 200.0, 300.0, 400.0), "/d/c.txt": None}
    assert {r.path: r.width for r in layout.page_dimensions(rows).collect()} == {"/d/a.xml": 200, "/d/b.xml": 200, "/d/x_100x200_300x400.xml": 200, "/d/c.txt": None}


@pytest.mark.parametrize("source", [ALTO, PAGE])
def test_write_and_read_again(spark, source):
    p = layout.read_pieces(files(spark, a__xml=source))
    again = layout.read_pieces(writers.to_xml(p).select("path", F.encode("xml", "UTF-8").alias("content")))
    words = lambda d: [(r.piece_id, r.text, r.t) for r in d.filter("level = 'word'").orderBy("line_ord", "word_ord").select("piece_id", "text", point_list(F.col("poly")).alias("t")).collect()]
    assert words(again) == words(p) and layout.page_texts(again).collect() == layout.page_texts(p).collect()


def test_mets(spark):
    m = mets.read_mets(files(spark, m__xml=METS))
    assert {r.href: r.dmdids for r in mets.file_dmdids(m).collect()} == {"p1.gt.xml": ["D1"], "p2.gt.xml": ["D9", "D1"], "p3.gt.xml": ["D2"]}
    assert {r.href: r.value for r in mets.mods_values(m, "language").collect()} == {"p1.gt.xml": "ara+eng", "p2.gt.xml": "ara+eng", "p3.gt.xml": "ger"}
    assert {r.href: r.value for r in mets.div_values(m, "type").collect()} == {"p1.gt.xml": "issue", "p2.gt.xml": "issue", "p3.gt.xml": "volume"}
    assert [r.href for r in mets.select_hrefs(m, ["mods:language=eng+ara", "mets:TYPE=issue"]).collect()] == ["p1.gt.xml", "p2.gt.xml"]


def test_mets_values_stand_where_they_should(spark):
    m = mets.read_mets(files(spark, m__xml=METS))
    assert {r.href: r.value for r in mets.mods_values(m, "dateIssued").collect()} == {"p1.gt.xml": "1867", "p2.gt.xml": "1867"}
    assert {r.href: r.value for r in mets.mods_values(m, "languageTerm").collect()}["p3.gt.xml"] == "ger+German"


def test_several_mets_files_are_not_mixed(spark):
    other = METS.replace('"code">ger<', '"code">rus<')
    m = mets.read_mets(files(spark, m__xml=METS, n__xml=other))
    assert [(r.mets, r.href) for r in mets.select_hrefs(m, ["mods:language=ger"]).collect()] == [("/d/m.xml", "p3.gt.xml")]
    assert [(r.mets, r.href) for r in mets.select_hrefs(m, ["mods:language=rus"]).collect()] == [("/d/n.xml", "p3.gt.xml")]
    e = spark.createDataFrame([("/x/p3.gt.xml",), ("/x/none.xml",)], "path_groundtruth string")
    assert {r.path_groundtruth: r.mods_language for r in mets.with_metadata(e, m, ["mods:language"]).collect()} == {"/x/p3.gt.xml": "ger", "/x/none.xml": None}
    report = mets.coverage(e, m)
    assert {(r.kind, r.name) for r in report.collect()} == {("mapped", "/x/p3.gt.xml"), ("missing", "/x/none.xml"), ("represented", "p3.gt.xml"), ("unused", "p1.gt.xml"), ("unused", "p2.gt.xml")}
    assert mets.coverage_lines(report)[0].startswith("METS coverage: 1/2 evaluation items map to 2/6")


def test_first_matching_href_in_document_order(spark):
    hrefs = spark.createDataFrame([("m", "old_p1.xml", 1), ("m", "p1.xml", 2), ("m", "x/p2.xml", 3), ("m", "p3", 4), ("m", "", 0)], "mets string, href string, ord int")
    e = spark.createDataFrame([("/a/p1.xml",), ("/a/x/p2.xml",), ("/a/p3/q.xml",), ("/a/q.xml",), (None,)], "path_groundtruth string")
    from folioscope.operators.pairing import match_hrefs

    assert {r.path_groundtruth: (r.href, r.ord) for r in match_hrefs(e, hrefs).collect()} == {
        "/a/p1.xml": ("old_p1.xml", 1), "/a/x/p2.xml": ("x/p2.xml", 3), "/a/p3/q.xml": ("p3", 4), "/a/q.xml": (None, None), None: (None, None)}


def test_printed_area_of_the_reference_frames_the_candidate(spark, tmp_path):
    from folioscope.plans.evaluation import Evaluation, register_metric

    for d in ("ocr", "gt"):
        os.makedirs(tmp_path / d)
    noise = '<TextLine ID="l0" HPOS="0" VPOS="80" WIDTH="10" HEIGHT="10"><String ID="n1" CONTENT="margin" HPOS="150" VPOS="90" WIDTH="20" HEIGHT="9"/></TextLine>'
    (tmp_path / "ocr/p1.xml").write_text(ALTO.replace('<TextLine ID="l1"', noise + '<TextLine ID="l1"', 1).replace('WIDTH="200"', 'WIDTH="300"'))
    (tmp_path / "gt/p1.gt.xml").write_text(ALTO)
    (tmp_path / "ocr/p2.txt").write_text("Haus am\nSee")
    (tmp_path / "gt/p2.gt.txt").write_text("Haus am\nSee\n")
    (tmp_path / "ocr/p3.xml").write_text(ALTO)
    (tmp_path / "ocr/p4.xml").write_text(ALTO)
    (tmp_path / "gt/p4.gt.xml").write_text(ALTO.replace('HPOS="60"', 'HPOS="x"'))

    def values(ev):
        return {r.path_candidate.rsplit("/", 1)[1]: r.value for r in ev.metrics("Ws").scores().collect()}

    new = lambda: Evaluation(spark).candidates(f"{tmp_path}/ocr").reference(f"{tmp_path}/gt")
    assert values(new()) == {"p1.xml": 100.0, "p2.txt": 100.0}
    assert values(new().options(ignore_geometry=True)) == {"p1.xml": 80.0, "p2.txt": 100.0}
    assert {(r.path_candidate.rsplit("/", 1)[1], r.problem.split(":")[0]) for r in new().problems().collect()} == {("p1.xml", "page dimensions differ"), ("p4.xml", "no printed area")}
    assert [r.path.rsplit("/", 1)[1] for r in new().unpaired().collect()] == ["p3.xml"]
    pair = Evaluation(spark).candidates(f"{tmp_path}/ocr/p1.xml").reference(f"{tmp_path}/gt/p1.gt.xml")
    assert values(pair) == {"p1.xml": 100.0} and [r.eval_key for r in pair.run().collect()] == ["Ws@ocr"]
    with pytest.raises(ValueError, match="single candidate"):
        Evaluation(spark).candidates(f"{tmp_path}/ocr").reference(f"{tmp_path}/gt/p1.gt.xml").scores()
    checked = new().metrics("DictLT,Cs").spell_checker(lambda: lambda t: t.count("am")).scores().filter("metric = 'DictLT'").collect()
    assert {r.value for r in checked} == {75.0, 66.67}
    register_metric("Len", "Length", lambda r, c, stop: (F.length(c) * 1.0, F.length(r)))
    assert {r.metric for r in pair.metrics("Length,Cs").scores().collect()} == {"Len", "Cs"}
    lines = cli.run(["eval", f"{tmp_path}/ocr", "-r", f"{tmp_path}/gt", "-vv"], spark)
    assert "1 candidates have no reference" in lines and any("normalize_whitespace: 11 characters -> 11 characters" in x for x in lines)


def test_commands(spark, tmp_path):
    for d in ("ocr/a", "gt/a", "img", "cut"):
        os.makedirs(tmp_path / d)
    (tmp_path / "ocr/a/p1.xml").write_text(ALTO)
    (tmp_path / "gt/a/p1.art.gt.xml").write_text(ALTO.replace("gut", "gur"))
    (tmp_path / "mets.xml").write_text(METS.replace("p1.gt.xml", "p1.art.gt.xml"))
    base = ["eval", f"{tmp_path}/ocr", "-r", f"{tmp_path}/gt"]
    out = cli.run([*base, "-v", "--metrics", "Cs,Ls,Ws"], spark)
    assert out[0] == "[p1](art) [Cs:93.33(  15), Ls:91.67(  12)(- 1.66), Ws:75.00(   4)]" and "Cs@a\t  1 items 15 refs\t∅:93.33" in out and any(x.startswith("Ws@ocr@article") for x in out)
    with pytest.raises(ValueError):
        cli.run([*base, "--metrics", "Nope"], spark)
    assert cli.run(["frame", "-i", f"{tmp_path}/ocr", "-o", f"{tmp_path}/cut", "-p", "0,0 25,30"], spark)
    cut = (tmp_path / "cut/p1.xml").read_text()
    assert 'CONTENT="Ha"' in cut and 'CONTENT="us"' in cut and "gut" not in cut and 'ID="p2"' in cut and "OtherTag" in cut
    page = np.full((100, 200), 200, dtype=np.uint8)
    page[5:15, 5:60] = 20
    (tmp_path / "img/p1.pgm").write_bytes(im.write_image(page))
    made = cli.run(["slice", f"{tmp_path}/ocr/a", "-i", f"{tmp_path}/img", "-o", f"{tmp_path}/pairs", "-s", "--padding", "2"], spark)
    assert made == ["p1_l1: written", "p1_l2: written", "Haus am", "See gut"]
    assert (tmp_path / "pairs/p1/p1_l1.gt.txt").read_text() == "Haus am" and im.read_grey((tmp_path / "pairs/p1/p1_l1.tif").read_bytes()).shape == (24, 104)
    assert (tmp_path / "pairs/p1_summary.gt.txt").read_text() == "Haus am\nSee gut\n" and im.dots_per_inch((tmp_path / "pairs/p1/p1_l1.tif").read_bytes()) == (300, 300)
    shown = cli.run(["show", "-d", f"{tmp_path}/ocr/a", "-i", f"{tmp_path}/img", "-o", f"{tmp_path}/shown"], spark)
    assert [x.split(" ")[1] for x in shown] == ["region:", "line:", "word:"] and os.path.exists(tmp_path / "shown/p1_sgm_wrd.png")
    assert cli.run(["corpus", f"{tmp_path}/mets.xml", "--filter-by", "mods:language=ger"], spark) == ["p3.gt.xml"]


def test_training_lines(spark):
    p = layout.read_pieces(files(spark, a__xml=PAGE))
    assert {r.line_id: r.text for r in tp.training_lines(p).collect()} == {"a": "ten", "b": "one two more"}
    assert {r.line_id: r.text for r in tp.training_lines(p, 4, right_to_left=True).collect()} == {"b": "two more one"}
    assert tp.polygon_data(p).filter("text = ''").count() > 0


def test_image_kernels():
    assert im.is_rectangular([(0, 0), (4, 0), (4, 2), (0, 2)]) and not im.is_rectangular([(0, 0), (4, 1), (4, 2), (0, 2)])
    mask = im.polygon_mask([(0, 0), (6, 0), (0, 6)], 6, 6)
    assert mask.sum() // 255 == 15 and mask[0, 0] == 255 and mask[5, 5] == 0
    two = np.concatenate([np.full(50, 40), np.full(50, 210)]).astype(np.uint8).reshape(10, 10)
    assert 40 <= im.otsu_threshold(two) < 210 and im.grey_reference(two) == 210 and im.grey_range(two) == (194, 226, 210)
    assert np.isnan(im.grey_reference(np.zeros((2, 2), np.uint8))) and im.grey_range() == (168, 200, 184)
    page = np.full((60, 80), 220, dtype=np.uint8)
    page[0:4, 10:20], page[56:60, 50:60], page[25:35, 10:70] = 10, 10, 10
    clean, top, bottom = im.cleared_edges(page, 0.1)
    assert (top, bottom) == (1, 1) and clean[1, 15] > 150 and clean[58, 55] > 150 and clean[30, 30] == 10
    assert im.edge_bands(100, [0.1, 0.2]) == (10, 80)
    line = np.full((81, 201), 230, dtype=np.uint8)
    for x in range(20, 180):
        y = round(40 + (x - 100) * np.tan(np.radians(4)))
        line[y - 2 : y + 3, x] = 0
    assert abs(im.skew_angle(line) - 4) <= 0.3 and abs(im.skew_angle(im.rotated(line, 4.0, 230))) <= 0.3
    assert len(im.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))) == 2
    assert im.padded(two, 3).shape == (16, 16) and (im.read_grey(im.write_image(two)) == two).all()
    assert im.centre_of_mass(np.zeros((2, 2))) == (0.0, 0.0) and im.centre_of_mass(np.eye(3)) == (1.0, 1.0)
    assert (im.fit_to_shape(two, [(0, 0), (10, 0), (0, 10)], seed=1) == im.fit_to_shape(two, [(0, 0), (10, 0), (0, 10)], seed=1)).all()
    with pytest.raises(ValueError):
        im.crop(two, [(50, 50), (60, 50), (60, 60)])
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x09pHYs" + (11811).to_bytes(4, "big") * 2 + b"\x01"
    assert im.dots_per_inch(png) == (300, 300) and im.dots_per_inch(b"") == (300, 300)
    assert im.dots_per_inch(b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\1" + (150).to_bytes(2, "big") + (75).to_bytes(2, "big")) == (150, 75)


def test_stream(spark, tmp_path):
    schema = "k string, value double, n_ref long"
    rows = [("a", 90.0, 1), ("b", 50.0, 2)], [("a", 92.0, 3)]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = s.writeStream.foreachBatch(live.refresh(f"{tmp_path}/t", f"{tmp_path}/r", ["k"])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        assert i < 2
    assert {r.k: (r.n_total, r.median) for r in live.latest(spark, f"{tmp_path}/r", ["k"]).collect()} == {"a": (2, 91.0), "b": (1, 50.0)}
    assert {r.k: r.n_chars for r in live.running_moments(spark.read.parquet(f"{tmp_path}/in"), ["k"]).collect()} == {"a": 4, "b": 2}


def test_slicing_leaves_out_a_broken_line_only(spark):
    bad = PAGE.replace('<TextRegion id="r1">', '<TextRegion id="r0"><Coords points="0,0 9,0 9,9"/><TextLine id="z"><TextEquiv><Unicode>lost</Unicode></TextEquiv></TextLine></TextRegion><TextRegion id="r1">')
    assert layout.read_pieces(files(spark, a__xml=bad)).filter("error IS NULL").count() == 0
    p = layout.read_pieces(files(spark, a__xml=bad), skip_lines=True)
    assert {r.line_id for r in tp.training_lines(p).collect()} == {"a", "b"}
    broken_word = bad.replace('points="10,50 19,50 19,59"', 'points=""')
    assert layout.read_pieces(files(spark, a__xml=broken_word), skip_lines=True).filter("error IS NOT NULL").count() == 1


def test_a_frame_keeps_all_else_of_a_file(spark):
    composed = ALTO.replace('<TextBlock ID="b1"', '<ComposedBlock ID="c1" HPOS="0" VPOS="0" WIDTH="150" HEIGHT="90"><TextBlock ID="b1"').replace("</TextBlock><TextBlock", "</TextBlock></ComposedBlock><Illustration ID='i1'/><TextBlock", 1)
    composed = composed.replace('CONTENT="am"', 'CONTENT="am" WC="0.7" STYLEREFS="S1"').replace("<Tags>", "<!-- kept --><Tags>")
    page = PAGE.replace("<TextRegion id=\"r2\">", "<TableRegion id=\"t\"><Coords points=\"0,0 99,0 99,99 0,99\"/><TextRegion id=\"r2\">").replace("</TextRegion><TextRegion id=\"r3\">", "</TextRegion></TableRegion><TextRegion id=\"r3\">")
    out = {r.path: r for r in writers.framed_files(files(spark, a__xml=composed, b__xml=page, c__xml="<x/>", d__txt="no"), [(0, 0), (36, 0), (36, 58), (0, 58)]).collect()}
    a = out["/d/a.xml"].xml
    assert all(x in a for x in ("<!-- kept -->", 'WC="0.7"', 'STYLEREFS="S1"', 'ID="i1"', 'ID="p2"')) and 'CONTENT="gut"' not in a and 'CONTENT="See"' in a
    assert '<ComposedBlock ID="c1" HPOS="0" VPOS="0" WIDTH="40" HEIGHT="40">' in a and out["/d/a.xml"].removed["String"] == 1
    b = out["/d/b.xml"].xml
    assert 'imageFilename="i.tif"' in b and "RegionRefIndexed" in b and 'id="w1"' in b and '<TableRegion id="t"><Coords points="0,50 19,50 19,59 0,59"/>' in b and 'id="w0"' in b
    assert out["/d/c.xml"].error and out["/d/d.txt"].error and out["/d/c.xml"].xml is None
    assert writers.framed_files(files(spark, a__xml=composed), [(900, 900), (901, 900), (901, 901)]).collect()[0].removed["TextLine"] == 3  # also the line that had no words


def test_image_files():
    rng = np.random.default_rng(2)
    for image in (rng.integers(0, 256, (7, 5), dtype=np.uint8), rng.integers(0, 256, (4, 9, 3), dtype=np.uint8)):
        grey = im.read_grey(im.write_image(image))
        for kind in ("tif", "png"):
            data = im.write_image(image, kind, (150, 75))
            assert (im.read_grey(data) == grey).all() and im.dots_per_inch(data) == (150, 75)
    with pytest.raises(ValueError):
        im.write_image(image, "bmp")


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (5, 6), dtype=np.uint8).astype(int)
    rows = []
    for y in range(5):
        up, left = (image[y - 1] if y else np.zeros(6, int)), np.concatenate([[0], image[y, :-1]])
        corner = np.concatenate([[0], up[:-1]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * up, left, up, (left + up) // 2, paeth][y]
        rows.append(bytes([y]) + bytes(((image[y] - guess) % 256).astype(np.uint8)))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (im.read_grey(data) == image).all()
