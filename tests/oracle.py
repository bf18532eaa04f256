"""Run registered queries beside their DuckDB SQL.  python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str, sql: str):
    import duckdb

    from tessera.session import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple") or isinstance(v, int):
        return f"{float(v):.9g}" if not isinstance(v, int) else f"{v}" if abs(v) > 1e15 else f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def differences(spark, name: str, sf_dir: str) -> str:
    """Empty if the query and its SQL agree."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = duck(sf_dir, e.oracle_sql()[name])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want = rows_of(columns, rows)
    if got == want:
        return ""
    return f"{sum(got.values())} against {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tessera.session import session

    s = session("oracle", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:] or list(e.oracle_sql()):
        print(n, differences(s, n, sys.argv[1]) or "equal", flush=True)
