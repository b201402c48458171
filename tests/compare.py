"""Run a query and its SQL over one directory and compare the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
from collections import Counter
from decimal import Decimal

DATA = os.environ.get("GRAPHLOAM_DATA", "/root/testdata/sf0.01")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None) if v.tzinfo is None else v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def duck(data: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(data):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{data}/{f}'")
    return con


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, data: str = DATA) -> str:
    df = query(spark, data)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if got == want:
        return ""
    extra, short = got - want, want - got
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {sum(extra.values())}: {list(extra)[:3]}; only SQL {sum(short.values())}: {list(short)[:3]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from graphloam.session import local_session

    spark, con, sqls = local_session(), duck(DATA), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[1:] and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        began = time.time()
        try:
            said = differences(spark, con, query, sqls[name]) or "same" if name in sqls else f"{query(spark, DATA).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
