"""Relational helpers that aren't a single DataFrame call: seeded sampling, splits, folds, salted joins, top-k, running sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import small, written


def hash_unit(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone, not on partitions: the first 52 bits of an MD5
    of their texts, so that any engine can work it out."""
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_by_label(df: DataFrame, probability: Column | dict, id: str = "id", label: str = "label", seed: int = 0) -> DataFrame:
    """Keeps a row with the probability that its label has (a Column, or {label: p}, 1 for others)."""
    if isinstance(probability, dict):
        out = F.lit(1.0)
        for k, p in probability.items():
            out = F.when(F.col(label) == k, float(p)).otherwise(out)
        probability = out
    return df.where(hash_unit(id, seed=seed) < probability)


def binary_sample(df: DataFrame, zero: float = 1.0, one: float = 1.0, **options) -> DataFrame:
    return sample_by_label(df, F.when(F.col(options.get("label", "label")) < 0.5, zero).otherwise(one), **options)


def parse_class_probabilities(text: str) -> dict[str, float]:
    """``a:0.5,b:1``."""
    return {k: float(v) for k, v in (x.rsplit(":", 1) for x in text.split(",") if x.strip())}


def split(df: DataFrame, id: str = "id", train_tenths: int = 8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the id."""
    inside = hash_unit(id, seed=seed) < train_tenths / 10
    return df.where(inside), df.where(~inside)


def folds(id: Column | str, n: int, salt: int = 0) -> Column:
    return F.floor(hash_unit(id, seed=salt) * n).cast("int")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, id: str) -> DataFrame:
    """Inner join on ``key`` where a hot key of ``left`` is spread over ``salts`` tasks and ``right`` is replicated."""
    a = left.withColumn("salt", F.pmod(F.xxhash64(id), F.lit(salts)))
    b = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "salt"]).drop("salt")


def cross_tiny(df: DataFrame, tiny: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row with each of ``tiny``, which is broadcast; ValueError if it has more than ``most`` rows."""
    if tiny.limit(most + 1).count() > most:
        raise ValueError(f"a table of more than {most} rows isn't crossed")
    return df.crossJoin(F.broadcast(tiny))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps at most k rows of a group in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def multiset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def running_sums(df: DataFrame, group: list[str], order: Column, values: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``cum_<value>``: sums of ``values`` within the group up to the row, in ``order`` (unique in a group).

    Rows are range-partitioned by group and order; sums run within partitions and are shifted by the totals of
    the partitions before, so no task holds a whole group.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("rs_order", order)
    placed = written(keyed.repartitionByRange(n, *group, "rs_order").withColumn("rs_part", F.spark_partition_id()))
    totals = placed.groupBy(*group, "rs_part").agg(*[F.sum(v).alias(f"rs_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("rs_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*group, "rs_part", *[F.coalesce(F.sum(f"rs_{v}").over(earlier), F.lit(0)).alias(f"rs_{v}") for v in values])
    within = Window.partitionBy(*group, "rs_part").orderBy("rs_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(small(shift), [*group, "rs_part"]).withColumns({f"cum_{v}": F.sum(v).over(within) + F.col(f"rs_{v}") for v in values})
    return out.drop("rs_order", "rs_part", *[f"rs_{v}" for v in values])
