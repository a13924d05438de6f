"""Run registered queries next to their SQL and report differences.

``python -m catalog.check FOLDER [name-part ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from gaugeline.functions.session import local_session

from . import all_oracles, all_queries


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text form with columns and rows in a fixed order."""
    out = pd.DataFrame(
        {c: [_text(v) for v in pdf[c].tolist()] for c in sorted(pdf.columns)}, dtype=object
    )
    return out.sort_values(list(out.columns), ignore_index=True) if len(out.columns) else out


def _text(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
        return str(v)[:10]
    if isinstance(v, float):
        return repr(v)
    return str(v)


def main(folder: str, parts: list[str]) -> int:
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    queries, oracles, bad = all_queries(), all_oracles(), 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
        except Exception as err:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"ERROR {name}: {type(err).__name__} {str(err)[:600]}", flush=True)
            continue
        took, start = time.time() - start, time.time()
        if name not in oracles:
            print(f"rows  {name} {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            # A timezone-free, row-wise fetch keeps NULLs and integers as they are.
            cur = duck.execute(oracles[name])
            names = [d[0] for d in cur.description]
            want = pd.DataFrame(cur.fetchall(), columns=names, dtype=object)
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(err)[:600]}", flush=True)
            continue
        a, b = normal(got.astype(object)), normal(want)
        same = list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)
        mark = "ok   " if same else "DIFF "
        print(f"{mark} {name} {len(a)}/{len(b)} rows {took:.1f}s sql {time.time() - start:.1f}s", flush=True)
        if not same:
            bad += 1
            print(" ", list(a.columns), list(b.columns), got.dtypes.to_dict())
            if list(a.columns) == list(b.columns) and len(a) == len(b):
                for c in a.columns:
                    d = a[c] != b[c]
                    if d.any():
                        print("  ", c, int(d.sum()), list(zip(a[c][d][:3], b[c][d][:3])))
            else:
                print(a.head(3), b.head(3))
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
