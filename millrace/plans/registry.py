"""The table of queries: name, function of (spark, folder of tables), and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Tables whose texts take long to work on.
TEXTS = ("documents", "pages", "conversations")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Texts in fewer splits than there are cores, as in a small file of one row group, are spread over all;
    large tables have more splits and are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in TEXTS and df.rdd.getNumPartitions() < cores else df
