"""Run registered queries against their reference SQL on DuckDB: ``python tests/oracle_check.py DIR [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "<null>" if math.isnan(v) else repr(v)
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def canon(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: pdf[c].dtype.kind for c in sorted(pdf.columns)}


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    t = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - t
    if sql is None:
        return f"rows {len(got):>7} {took:6.1f}s {name} (no SQL)"
    t = time.time()
    want = con.sql(sql).df()
    dtook = time.time() - t
    if sorted(got.columns) != sorted(want.columns):
        return f"COLS {name}: {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return f"DIFF {name}: {len(a)} / {len(b)} rows\n   spark {str(only_a)[:700]}\n   duck  {str(only_b)[:700]}"
    ka, kb = kinds(got), kinds(want)
    note = "" if ka == kb else f" KINDS {[(c, ka[c], kb[c]) for c in ka if ka[c] != kb[c]]}"
    return f"ok   {len(a):>7} {took:6.1f}s {dtook:5.1f}s {name}{note}" + (" EMPTY" if not a else "")


def main() -> None:
    import __spark_entry__ as entry
    from corpusmill import get_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) or entry.module_of(name) == o for o in only):
            continue
        try:
            print(compare(spark, con, sf_dir, name, fn, oracles.get(name)), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:900]}", flush=True)


if __name__ == "__main__":
    main()
