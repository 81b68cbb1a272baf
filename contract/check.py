"""Run queries on both engines and compare rows, names, types and values.

    python -m contract.check [key=value ...] [sf_dir] [query ...]

Settings such as spark.sql.autoBroadcastJoinThreshold=-1 force the ways that large tables take.
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from contract.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both give the same result, else what differs."""
    names = df.columns
    mine = normal([tuple(r) for r in df.collect()], names)
    cursor = con.execute(sql)
    their_names = [c[0] for c in cursor.description]
    theirs = normal(cursor.fetchall(), their_names)
    if sorted(names) != sorted(their_names):
        return f"columns {sorted(names)} != {sorted(their_names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; {sorted(set(mine) ^ set(theirs))[:4]}"
    if not mine:
        return "no rows on either side"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, {sorted(names)}: {wrong[:2]}"
    return ""


def main(argv: list[str]) -> int:
    from contract.oracle import ORACLE
    from contract.queries import QUERIES
    from tillroll.session import local_session

    settings = [a.split("=", 1) for a in argv if "=" in a]
    argv = [a for a in argv if "=" not in a]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark: SparkSession = local_session("check")
    for key, value in settings:
        spark.conf.set(key, value)
    con, failed = connect(sf_dir), 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                result = compare(df, con, ORACLE[name]) or "same"
            else:
                result = f"no check SQL, {len(df.collect())} rows"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result != "same" and not result.startswith("no check SQL")
        print(f"{name:32s} {time.time() - start:6.2f}s  {result}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
