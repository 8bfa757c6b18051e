"""Compares queries with their SQL on DuckDB: python tests/verify.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    """A value as both engines can give it."""
    if v is None or isinstance(v, bool | str | bytes):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def compare(df, sql: str, folder: str) -> str:
    """Empty if both give the same rows, else what differs."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(folder).iterdir():
        if p.suffix == ".parquet":
            at = f"{p}/*.parquet" if p.is_dir() else str(p)
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if got == want:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"rows {len(got)} and {len(want)}; only here {sorted(a, key=repr)[:3]}, only in SQL {sorted(b, key=repr)[:3]}"


def main() -> int:
    import __spark_entry__ as entry

    from folioscope.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, bad = local_session(), 0
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            df = query(spark, folder)
            said = compare(df, sql[name], folder) if name in sql else f"{df.count()} rows, no SQL"
            bad += bool(said) and name in sql
        except Exception as e:  # noqa: BLE001
            said, bad = f"{type(e).__name__}: {str(e)[:600]}", bad + 1
        print(f"{'ok  ' if not said else 'ROWS' if 'no SQL' in said else 'BAD '} {name} {time.time() - t:.1f}s {said}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
