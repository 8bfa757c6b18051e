import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioscope.operators.orphans import _packed, _unpacked, mets_references, mets_targets, orphan_counts, orphan_references, references, targets

REF = "mets_id long, row_key string, ids string, recorded_at timestamp_ntz"
TGT = "mets_id long, id string, f timestamp_ntz, deleted_at timestamp_ntz"
D = datetime


def found(spark, refs, tgts):
    r = references(spark.createDataFrame(refs, REF), "t", "ids", "k")
    return {(x.scope, x.row_key, x.target_id, x.ref_month) for x in orphan_references(r, targets(spark.createDataFrame(tgts, TGT), "k", "id", "f")).collect()}


def test_borders_of_spans(spark):
    tgts = [(1, "a", D(2024, 1, 10), D(2024, 3, 5)), (1, "a", D(2024, 4, 1), None), (1, "b", D(2024, 1, 1), D(2024, 2, 1)), (1, "b", D(2024, 2, 1), D(2024, 3, 1)), (1, "z", D(2024, 5, 1), D(2024, 4, 1))]
    refs = [
        (1, "before", "a", D(2024, 1, 9)), (1, "first", "a", D(2024, 1, 10)), (1, "inside", "a", D(2024, 2, 2)), (1, "last", "a", D(2024, 3, 4, 23)), (1, "gone", "a", D(2024, 3, 5)),
        (1, "again", "a", D(2024, 4, 1)), (2, "other", "a", D(2024, 2, 2)), (1, "seam", "b c", D(2024, 2, 1)), (1, "end", "b", D(2024, 3, 1)), (1, "case", "A", D(2024, 2, 2)), (1, "never", "z", D(2024, 4, 15)),
    ]
    assert {(k, t) for _, k, t, _ in found(spark, refs, tgts)} == {("before", "a"), ("gone", "a"), ("other", "a"), ("seam", "c"), ("end", "b"), ("case", "A"), ("never", "z")}


def test_nulls_blanks_repeats_and_empty_tables(spark):
    refs = [(1, "x", None, D(2024, 1, 1)), (1, "x", " \n ", D(2024, 1, 1)), (1, "y", " p \n q\t", D(2024, 1, 1)), (1, "y", "q p p", D(2024, 1, 1)), (1, "n", "p", None), (None, "m", "p", D(2024, 1, 1))]
    got = found(spark, refs, [])
    assert got == {(1, "y", "p", "2024-01"), (1, "y", "q", "2024-01"), (1, "n", "p", None), (None, "m", "p", "2024-01")}
    assert found(spark, [], [(1, "a", D(2024, 1, 1), None)]) == set()
    assert found(spark, [(1, "k", "a", D(2024, 1, 1))], [(1, "a", None, None)]) == {(1, "k", "a", "2024-01")}


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    day = lambda: D(2024, 1, 1) + timedelta(hours=rnd.randrange(24 * 500))
    tgts = []
    for _ in range(400):
        a = day()
        tgts.append((rnd.randrange(3), f"i{rnd.randrange(40)}", a, rnd.choice([None, a + timedelta(days=rnd.randrange(90))])))
    refs = [(rnd.randrange(3), f"r{i}", " ".join(f"i{rnd.randrange(60)}" for _ in range(rnd.randrange(4))), day()) for i in range(1500)]
    alive = lambda m, t, at: any(x[0] == m and x[1] == t and x[2] <= at and (x[3] is None or at < x[3]) for x in tgts)
    want = {(m, k, t, at.strftime("%Y-%m")) for m, k, ids, at in refs for t in ids.split() if not alive(m, t, at)}
    assert found(spark, refs, tgts) == want and want


def test_bitmaps_round_trip():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    for n in (0, 1, 500, 30000):
        bits = np.zeros(32768, dtype=bool)
        bits[rng.choice(32768, n, replace=False)] = True
        raw = np.packbits(bits, bitorder="little").tobytes()
        packed = _packed(pd.Series([raw]))[0]
        assert _unpacked(packed).tobytes() == raw and len(packed) <= 4097


def test_mets_tables(spark):
    t = "timestamp_ntz"
    files = spark.createDataFrame([(1, "F1", "d1 d9", "d1", D(2024, 2, 1), None)], f"mets_id long, file_id string, file_dmdid string, grp_dmdid string, recorded_at {t}, deleted_at {t}")
    divs = spark.createDataFrame([(1, "L1", "d1", D(2023, 1, 1))], f"mets_id long, div_id string, dmdid string, recorded_at {t}")
    fptr = spark.createDataFrame([(1, "P1", "F1", D(2024, 1, 1)), (1, "P2", " F1", D(2024, 3, 1))], f"mets_id long, div_id string, file_id string, recorded_at {t}")
    dmds = spark.createDataFrame([(1, "d1", D(2024, 1, 1), None)], f"mets_id long, dmdid string, received_at {t}, deleted_at {t}")
    out = orphan_references(mets_references(files, divs, fptr), mets_targets(dmds, files))
    got = {(r.ref_table, r.ref_field, r.row_key, r.target_id) for r in out.collect()}
    assert got == {("mets_file", "file_dmdid", "F1", "d9"), ("mets_div", "dmdid", "L1", "d1"), ("mets_fptr", "file_id", "P1", "F1"), ("mets_fptr", "file_id", "P2", " F1")}
    assert orphan_counts(out).agg(F.sum("orphans")).collect()[0][0] == 4
