"""Run registered queries and their SQL side by side.

    python tests/compare.py [scale folder] [query name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (pd.Timestamp, np.datetime64)):
        return str(pd.Timestamp(v))
    if isinstance(v, (np.ndarray, list, tuple)):
        return "[" + ",".join(text(x) for x in v) + "]"
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    return str(v)


def canonical(pdf: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(pdf.columns)
    columns = []
    for c in cols:
        s = pdf[c]
        if isinstance(s.dtype, pd.Int64Dtype) and s.hasnans:
            s = s.astype(float)  # as the other side gives integers among which there are nulls
        if s.dtype.kind == "f":
            s = s.astype(object)
        columns.append([text(v) for v in s.tolist()])
    return sorted(zip(*columns)) if columns else []


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    names = {c: str(pdf[c].dtype) for c in sorted(pdf.columns)}
    return {c: "datetime" if k.startswith("datetime64") else "float64" if k == "Int64" else k for c, k in names.items()}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"
    return None


def main() -> int:
    from chronoloom.session import local_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    failed = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            note = "rows only" if name not in sqls else None
            if name in sqls:
                want = con.execute(sqls[name]).fetchdf()
                note = difference(got, want)
                if note is None and kinds(got) != kinds(want):
                    k, w = kinds(got), kinds(want)
                    note = "types " + str({c: (k[c], w[c]) for c in k if k[c] != w[c]})
        except Exception as exc:  # noqa: BLE001 - report and go on
            took, note, got = time.time() - started, f"ERROR {str(exc)[:600]}", []
        good = note in (None, "rows only")
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:28s} {len(got):7d} rows {took:6.2f}s {note or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
