"""Exact deduplication with static binary-fuse filters.

Batches of documents arrive one after another. All earlier batches form an immutable snapshot, of whose text digests
binary-fuse filters are built, one per shard of digests. Incoming digests are screened shard by shard; positives go to
the exact bucket of their digest, where texts are compared byte by byte. Duplicates inside the new batch are found
separately, by grouping its digests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix, pick, position, small, written

SHARD_KEYS = 100_000


class BinaryFuse:
    """Static 3-wise binary-fuse filter over distinct uint64 keys, 16-bit fingerprints (false positives about 1 in 65,536)."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U64(seed))
        span = U64(segment * segments)
        # high 32 bits scaled to the span: the first slot; the others lie in the next two segments
        first = ((h >> U64(32)) * span) >> U64(32)
        mask = U64(segment - 1)
        slots = np.stack([first, (first + U64(segment)) ^ ((h >> U64(18)) & mask), (first + U64(2 * segment)) ^ (h & mask)])
        return slots.astype(np.int64), ((mix(h) >> U64(48)).astype(np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
        factor = 0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        size = (segments + 2) * segment
        for seed in range(1, 200):
            slots, prints = cls._slots(keys, mix(np.array([seed], np.uint64))[0].item(), segment, segments)
            order = cls._peel(slots, size)
            if order is None:
                continue
            table = np.zeros(size, np.uint16)
            for who, where in reversed(order):
                table[where] = 0
                table[where] = prints[who] ^ table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]]
            return cls(mix(np.array([seed], np.uint64))[0].item(), segment, segments, table)
        raise RuntimeError("no seed peels these keys")

    @staticmethod
    def _peel(slots: np.ndarray, size: int):
        """Rounds of (keys, their single slots), or None if a core is left. All keys of a round are independent."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        ids = np.arange(n)
        for row in slots:
            np.add.at(total, row, ids)
        rounds, left, ready = [], n, np.flatnonzero(count == 1)
        while len(ready):
            who, at = np.unique(total[ready], return_index=True)
            where = ready[at]
            rounds.append((who, where))
            left -= len(who)
            touched = slots[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.tile(who, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        return rounds if left == 0 else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == prints


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """Filters of a snapshot's distinct ``digest`` column, one for each shard, written once: (shard, seed, segment, segments, prints)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(pdf["digest"].to_numpy().view(np.uint64))
        seed = np.array([f.seed], np.uint64).view(np.int64)[0]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    rows = digests.select("digest", F.pmod("digest", F.lit(shards)).cast("int").alias("shard"))
    return written(rows.groupBy("shard").applyInPandas(build, "shard int, seed long, segment int, segments int, prints binary"))


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Incoming digests that a snapshot's filters don't rule out."""

    def probe(pdf: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(pdf):
            return pdf[["digest"]].iloc[:0]
        r = f.iloc[0]
        fuse = BinaryFuse(int(np.array([r["seed"]], np.int64).view(np.uint64)[0]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["prints"], np.uint16))
        keys = pdf["digest"].to_numpy()
        return pd.DataFrame({"digest": keys[fuse.contains(keys.view(np.uint64))]})

    rows = incoming.select("digest", F.pmod("digest", F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "digest long")


def suspect_digests(batches: list[DataFrame], shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Digests that may occur twice: in two batches by the filters, or twice within one batch. Batches have ``digest``.

    There are as many shards as the larger of snapshot and batch needs at ``shard_keys`` distinct digests each.
    """
    found, older, held = None, None, 0
    for batch in batches:
        counted = written(batch.groupBy("digest").agg(F.count("*").alias("n")))
        size = counted.count()
        twice = counted.where("n > 1").select("digest")
        found = twice if found is None else found.unionByName(twice)
        if older is not None:
            shards = max(1, math.ceil(max(held, size) / shard_keys))
            found = found.unionByName(screen(counted, build_filters(older, shards), shards))
        distinct = counted.select("digest")
        older, held = distinct if older is None else older.unionByName(distinct), held + size
    return written(found.distinct())


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """``n`` batches by equal ranges of ids, in the order in which ids were given; null ids come last."""
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return [rows]
    edges = [low + (high - low) * k // n for k in range(1, n)]
    out = []
    for k in range(n):
        inside = F.lit(True)
        if k:
            inside = inside & (F.col("id") > edges[k - 1])
        if k < n - 1:
            inside = inside & (F.col("id") <= edges[k])
        out.append(rows.where(inside if k < n - 1 else inside | F.col("id").isNull()))
    return out


def _suspects(rows: DataFrame, batches: int, shard_keys: int) -> DataFrame:
    """Of ``rows`` (id, text); texts are read once for their digests."""
    keyed = written(rows.where("text IS NOT NULL").select("id", F.xxhash64("text").alias("digest")))
    return suspect_digests([b.select("digest") for b in _batches(keyed, batches)], shard_keys)


def exact_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 2, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """(doc_id, duplicate_of): each document whose text an earlier one has, byte for byte, with the first such one.

    Batches are ranges of ids, so the first of a group is the one with the smallest id. Null texts have no duplicates;
    empty texts equal each other. Rows with a null id are in no pair, and rows that share both id and text are one
    document here, so that repeated rows give no pair. An empty table gives an empty result; other columns are dropped.

    Texts of a bucket are compared by grouping them, of which each task sends one a text. Members then find their first by
    the digest alone, without their texts; only where a digest has several texts are texts joined.
    """
    rows = pick(docs, id=id, text=text)
    suspects = small(_suspects(rows, batches, shard_keys))
    held = rows.where("text IS NOT NULL AND id IS NOT NULL").withColumn("digest", F.xxhash64("text")).join(suspects, "digest", "left_semi")
    firsts = written(held.groupBy("digest", "text").agg(F.min("id").alias("first")))
    return _members(held, firsts, written(firsts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")))


def _members(held: DataFrame, firsts: DataFrame, mixed: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of) of ``held`` (digest, id, text) by the ``firsts`` (digest, text, first) of all
    suspect texts; ``mixed`` has the digests of several texts."""
    plain = firsts.join(mixed, "digest", "left_anti").select("digest", "first")
    found = held.select("digest", "id").join(small(plain), "digest")
    if not mixed.isEmpty():
        found = found.unionByName(held.join(mixed, "digest", "left_semi").join(firsts, ["digest", "text"]).select("digest", "id", "first"))
    return found.where("id > first").select(F.col("id").alias("doc_id"), F.col("first").alias("duplicate_of")).distinct()


def drop_exact_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 2, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """``docs`` with one row of each text, that of the smallest id (a null id last; among equal rows any), all columns.

    Rows with a null text stay. Only rows whose digest is suspect are shuffled with their texts, of each text one a task.
    An empty table gives an empty result.
    """
    suspects = small(_suspects(pick(docs, id=id, text=text), batches, shard_keys))
    i_id, i_text = position(docs, id), position(docs, text)
    names = docs.columns
    plain = docs.toDF(*[f"in{i}" for i in range(len(names))]).withColumn("digest", F.when(F.col(f"in{i_text}").isNotNull(), F.xxhash64(f"in{i_text}")))
    alone = plain.join(suspects, "digest", "left_anti")
    order = Window.partitionBy("digest", f"in{i_text}").orderBy(F.col(f"in{i_id}").asc_nulls_last())
    first = plain.join(suspects, "digest", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    out = [f"in{i}" for i in range(len(names))]
    return alone.select(*out).unionByName(first.select(*out)).toDF(*names)


SQL = """
SELECT DISTINCT doc_id, first AS duplicate_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL)
WHERE doc_id > first
"""
