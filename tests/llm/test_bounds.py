import pytest

pytest.importorskip("folioscope.llm")

from folioscope.llm import packing  # noqa: E402


def test_more_kinds_than_the_bound_raise(spark):
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    kinds = spark.range(packing.MAX_KINDS + 1).selectExpr("concat('k', id) AS container_kind", "10 AS capacity_tokens")
    with pytest.raises(ValueError, match="container_kind"):
        packing.pack(sizes, kinds)
