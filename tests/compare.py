"""Run named queries in Spark and their oracle in DuckDB, and compare values.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

STAR = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in STAR:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if hasattr(value, "quantize"):
        return round(float(value), 6) + 0.0
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if got != want:
        return (f"{sum(got.values())} rows against {sum(want.values())}; only ours "
                f"{list((got - want).items())[:2]}; only oracle {list((want - got).items())[:2]}")
    kinds = dict(zip(names, [str(d[1]) for d in result.description]))
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in df.dtypes if not _alike(t, kinds[n])]
    return f"TYPES {odd}" if odd else None


def _alike(spark: str, duck: str) -> bool:
    table = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",),
             "boolean": ("BOOLEAN",), "date": ("DATE",)}
    return duck.upper() in table.get(spark, (duck.upper(),))


def main() -> int:
    import __spark_entry__ as e
    from loanward.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad, empty = e.oracle_sql(), [], []
    for name, query in e.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                message = difference(df, con, oracles[name])
            else:
                message = f"no oracle; {df.count()} rows"
            if name in oracles and not con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0]:
                empty.append(name)
        except Exception as error:  # report and go on
            message = f"ERROR {type(error).__name__} {str(error)[:400]}"
        took = time.time() - start
        if message:
            bad.append(name)
        if message or took > 4:
            print(f"{name}: {message} ({took:.1f}s)", flush=True)
    print("unmatched", len(bad), bad)
    print("empty", empty)
    print("oracles without query", sorted(set(oracles) - set(e.queries())))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
