"""Run a query on Spark and its SQL on DuckDB over the same parquet files."""

from __future__ import annotations

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def oracle_rows(sf_dir: str, sql: str) -> tuple[dict[str, str], list[tuple]]:
    """Column types by name, and rows sorted, with columns in name order."""
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        out = con.execute(sql)
        names = [c[0] for c in out.description]
        types = {c[0]: str(c[1]) for c in out.description}
        return types, _sorted(names, out.fetchall())


def spark_rows(df) -> tuple[dict[str, str], list[tuple]]:
    types = {f.name: KINDS[f.dataType.simpleString()] for f in df.schema}
    return types, _sorted(df.columns, [tuple(r) for r in df.collect()])


def _sorted(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark: SparkSession, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    want_types, want = oracle_rows(sf_dir, sql)
    have_types, have = spark_rows(query(spark, sf_dir))
    if want_types != have_types:
        return f"types: SQL {want_types}, Spark {have_types}"
    if len(want) != len(have):
        return f"rows: SQL {len(want)}, Spark {len(have)}"
    bad = [(w, h) for w, h in zip(want, have, strict=True) if repr(w) != repr(h)]
    return f"{len(bad)} of {len(want)} rows differ, first SQL {bad[0][0]}, Spark {bad[0][1]}" if bad else None
