from pyspark.sql import types as T

from folioscope.operators.nested import ALTO_CODES, alto_table, flat_table, inlined_root, schema_graph

EL = "struct<tag:string,id:string,content:string,points:string>"
TL = f"struct<id:string,points:string,elems:array<{EL}>>"
TB = f"struct<id:string,points:string,text_lines:array<{TL}>>"
CB = f"struct<id:string,points:string,composed_blocks:array<struct<id:string,points:string,text_blocks:array<{TB}>>>,text_blocks:array<{TB}>>"
PAGE = f"page_id long, print_space struct<hpos:int,composed_blocks:array<{CB}>,text_blocks:array<{TB}>>, extra int"


def page(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE)


LINE = ("l", "1,2 3,4 5,6", [("String", "s", "a", None), ("SP", None, None, None), ("String", "s", None, " 7,8  9,9 ")])


def test_links_and_places(spark):
    p = page(spark, (1, (5, [("c", None, [("d", "", None)], [("b", None, [None, LINE])]), None], [("t", None, None), ("u", None, [])]), 3))
    got = {(r.parent_path, r.path) for r in alto_table(p).collect()}
    assert got == {
        ("page", "cb:0"), ("cb:0", "cb:0/cb:0"), ("cb:0", "cb:0/tb:0"), ("cb:0/tb:0", "cb:0/tb:0/tl:1"), ("cb:0/tb:0/tl:1", "cb:0/tb:0/tl:1/st:0"), ("cb:0/tb:0/tl:1", "cb:0/tb:0/tl:1/st:2"),
        ("cb:0/tb:0/tl:1", "cb:0/tb:0/tl:1/pt:0"), ("cb:0/tb:0/tl:1", "cb:0/tb:0/tl:1/pt:1"), ("cb:0/tb:0/tl:1", "cb:0/tb:0/tl:1/pt:2"),
        ("cb:0/tb:0/tl:1/st:2", "cb:0/tb:0/tl:1/st:2/pt:0"), ("cb:0/tb:0/tl:1/st:2", "cb:0/tb:0/tl:1/st:2/pt:1"), ("page", "tb:0"), ("page", "tb:1"),
    }
    assert [r.value for r in alto_table(p, "pt").filter("parent_path = 'cb:0/tb:0/tl:1/st:2'").orderBy("path").collect()] == ["7,8", "9,9"]
    assert [(r.page_id, r.hpos) for r in inlined_root(p, "page_id", "print_space").collect()] == [(1, 5)]


def test_repeats_nulls_and_empty(spark):
    row = (1, (5, None, [("t", None, [LINE])]), 3)
    p = page(spark, row, row, (2, None, 1), (3, (None, [], []), None))
    assert alto_table(p).count() == 9 and alto_table(page(spark)).count() == 0
    assert alto_table(p, "st").select("content").distinct().count() == 2


def test_schema_graph_shares_tables(spark):
    g = schema_graph(page(spark).schema["print_space"].dataType, ALTO_CODES)
    assert set(g) == {"cb", "tb", "tl", "st"} and g["tb"].parents == {"", "cb"} and g["cb"].parents == {"", "cb"}


def test_inlining_and_clashing_names(spark):
    s = T.StructType([T.StructField("k", T.LongType()), T.StructField("r", T.StructType([T.StructField("xs", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("one", T.StructType([T.StructField("a", T.IntegerType())]))])))]))])
    df = spark.createDataFrame([(1, ([("p", 9, (7,)), ("q", 8, None)],))], s)
    out = flat_table(df, "k", "r", {}, "xs")
    assert out.columns == ["k", "parent_path", "path", "kind", "path_", "k_", "one_a"]
    assert [tuple(r) for r in out.orderBy("path").collect()] == [(1, "root", "xs:0", "xs", "p", 9, 7), (1, "root", "xs:1", "xs", "q", 8, None)]
