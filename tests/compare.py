"""Run queries against their SQL checks: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(r) for r in rows), key=repr)


def difference(spark, db, name: str, query, sql: str | None, sf_dir: str) -> str:
    """Empty where the query equals its check."""
    df = query(spark, sf_dir)
    got_frame = df.toPandas()
    if sql is None:
        return "" if len(got_frame) else "no rows"
    relation = db.sql(sql)
    want_frame = relation.df()
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    got_types = {f.name: kinds[f.dataType.simpleString()] for f in df.schema.fields}
    want_types = dict(zip(relation.columns, map(str, relation.types)))
    if got_types != want_types:
        return f"types {got_types} != {want_types}"
    got, want = normal(got_frame), normal(want_frame)
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} != {len(want)}; only here {extra}; only in check {missing}"
    return "" if len(want) else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from codeloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(spark, db, name, query, checks.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed", bad)


if __name__ == "__main__":
    main()
