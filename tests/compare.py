"""Run queries and their SQL side by side: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else float(f"{value:.10g}")
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return _plain(float(value))
    return str(value)


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    theirs_names = [item[0] for item in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    order = [theirs_names.index(name) for name in names]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    ours = Counter(tuple(_plain(row[name]) for name in names) for row in df.toLocalIterator())
    if ours == theirs:
        return None
    return f"{sum(ours.values())} vs {sum(theirs.values())} rows; ours only {list((ours - theirs).items())[:3]}; theirs only {list((theirs - ours).items())[:3]}"


def main() -> None:
    import __spark_entry__ as entry
    from shorepix.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            problem = difference(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
