"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return canon(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = multiset(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    only_got, only_want = got - want, want - got
    assert not only_got and not only_want, (
        f"spark {sum(got.values())} rows, sql {sum(want.values())}; "
        f"only spark {list(only_got.items())[:3]}; only sql {list(only_want.items())[:3]}"
    )
    return sum(got.values())


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from tallyloom.plans.registry import oracle_sql, queries
    from tallyloom.session import build_session

    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    todo, sql = queries(), oracle_sql()
    for name in todo:
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                n = compare(spark, con, folder, todo[name], sql[name])
                print(f"ok    {name:36s} {n:8d} rows {time.time() - start:6.2f}s", flush=True)
            else:
                n = todo[name](spark, folder).count()
                print(f"rows  {name:36s} {n:8d} rows {time.time() - start:6.2f}s", flush=True)
        except Exception as exc:  # keep going, report all
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
