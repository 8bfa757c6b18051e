from folioscope import queries_eval as q

ELEM = "struct<tag:string,content:string>"
TB = f"struct<text_lines:array<struct<elems:array<{ELEM}>>>>"
SPACE = f"struct<composed_blocks:array<struct<composed_blocks:array<struct<text_blocks:array<{TB}>>>,text_blocks:array<{TB}>>>,text_blocks:array<{TB}>>"


def block(*lines):
    """A TextBlock; '_' in a line is an SP, anything else a String."""
    return ([([("SP", None) if t == "_" else ("String", t) for t in line],) for line in lines],)


def test_sp_gap_island_reads_blocks_at_any_depth(spark, tmp_path):
    inner = ([block(["deep", "er", "_", "still"]), None],)
    outer = ([None, inner], [block(["in", "side"], []), block(["b", "_", "c"])])
    pages = [(1, ([outer, ([], None), None], [block(["to", "p"], ["x", "_", "y"])])), (2, (None, [block(["only"])])), (3, (None, None)), (4, None)]
    pages.append(pages[0])
    spark.createDataFrame(pages, f"page_id long, print_space {SPACE}").write.parquet(str(tmp_path / "alto_page.parquet"))
    got = sorted(tuple(r) for r in q.sp_gap_island(spark, str(tmp_path)).collect())
    assert got == [(1, "cb:0/cb:1/tb:0/tl:0", "deeper still"), (1, "cb:0/tb:0/tl:0", "in side"), (1, "cb:0/tb:1/tl:0", "b c"),
                   (1, "tb:0/tl:0", "to p"), (1, "tb:0/tl:1", "x y"), (2, "tb:0/tl:0", "only")]


def test_first_by_index_takes_a_missing_index_as_empty(spark, tmp_path):
    lines = [(1, 1, 1, "0", "zero"), (3, 1, 1, None, "later"), (2, 1, 1, None, "none"), (4, 1, 1, None, " "), (5, 1, 2, "10", "ten"), (6, 1, 2, "2", "two"), (7, 1, 3, None, "alone"), (8, 1, 4, None, None)]
    spark.createDataFrame(lines, "line_rid long, mets_id long, page_no int, equiv_index string, text_equiv string").write.parquet(str(tmp_path / "page_line.parquet"))
    assert sorted(tuple(r) for r in q.first_by_index(spark, str(tmp_path)).collect()) == [(1, 1, "none"), (1, 2, "ten"), (1, 3, "alone")]
