"""Run registered queries against their DuckDB oracles (like the driver does).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skimdex.sources.tables import TABLES  # noqa: E402


def canon(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer():
            return str(int(v))
        return repr(round(v, 9))
    if isinstance(v, bool):
        return "true" if v else "false"
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, (list, tuple)):
        return json.dumps([canon(x) for x in v])
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def digest(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(x) for x in r) for r in df[cols].itertuples(index=False, name=None))
    return cols, rows


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(QUERIES):
        t0 = time.time()
        rec = {"oracle": name in ORACLES}
        try:
            sdf = QUERIES[name](spark, sf_dir).toPandas()
            rec["rows"] = len(sdf)
            rec["spark_sec"] = round(time.time() - t0, 2)
            if name in ORACLES:
                ddf = con.execute(ORACLES[name]).df()
                sc, sr = digest(sdf)
                dc, dr = digest(ddf)
                rec["oracle_rows"] = len(ddf)
                rec["cols_match"] = sc == dc
                rec["match"] = sc == dc and sr == dr
                if not rec["match"] and verbose:
                    print(f"--- {name}: spark cols {sc} oracle cols {dc}; rows {len(sr)} vs {len(dr)}")
                    a, b = set(sr), set(dr)
                    for r in list(a - b)[:3]:
                        print("  spark only :", [x[:160] for x in r])
                    for r in list(b - a)[:3]:
                        print("  oracle only:", [x[:160] for x in r])
        except Exception as e:  # noqa: BLE001
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out


if __name__ == "__main__":
    from skimdex.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v.get("error") or (v.get("oracle") and not v.get("match"))]
    print("FAILED:", bad)
    print(f"{sum(1 for v in res.values() if v.get('match'))} matched / {len(res)} queries")
