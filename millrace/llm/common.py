"""Shared helpers of the training-data operators: column picking, checked broadcasts, Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import written  # noqa: F401

U64 = np.uint64
#: Rows up to which a table of narrow rows (ids, digests) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, id="doc_id")``: exactly these columns under these names, whatever else ``df`` holds.

    Other columns can't clash with internal names, as they are gone before any internal name is made. A column is
    found by its exact name, else by its name in another case; a missing one raises ``KeyError``. What is picked as
    ``id`` or ``doc_id`` must be whole numbers and comes as bigint; another type raises ``TypeError``.
    """
    plain = df.toDF(*[f"in{i}" for i in range(len(df.columns))])
    out = []
    for new, old in columns.items():
        at = position(df, old)
        column = plain[f"in{at}"]
        if new in ("id", "doc_id"):
            kind = df.schema.fields[at].dataType
            if not isinstance(kind, (T.IntegralType, T.NullType)):
                raise TypeError(f"ids must be whole numbers, but {old} is {kind.simpleString()}")
            column = column.cast("bigint")
        out.append(column.alias(new))
    return plain.select(*out)


def position(df: DataFrame, name: str) -> int:
    """Place of a column, by its exact name or else by its name in another case."""
    have = df.columns
    if name in have:
        return have.index(name)
    fold = [c.lower() for c in have]
    if name.lower() in fold:
        return fold.index(name.lower())
    raise KeyError(name)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows; ``df`` must be cheap to count."""
    return F.broadcast(df) if (df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS else df


def bounded_sample(rows: DataFrame, by: str, keys: list[str], most: int, seed: int) -> DataFrame:
    """Of each value of ``by``, the ``most`` rows that come first by a hash of ``keys``, all if there are fewer.

    The values must be few: their numbers go to the driver. A draw by the hash leaves about twice as many rows, so that
    few are shuffled; where repeated rows make it leave too few, all rows of that value are ordered. At most ``most`` rows
    of each value are written and returned, however often a row is repeated.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for value, n in counts.items():
        part = F.when(F.col(by) == value, min(1.0, (2 * most + 50) / n)).otherwise(part)
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_003)))
    order = Window.partitionBy(by).orderBy("draw", *keys)
    first = lambda df: written(df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select(*rows.columns))
    got = first(drawn.where(F.col("draw") / 1_000_003.0 < part))
    have = {r[by]: r["n"] for r in got.groupBy(by).agg(F.count("*").alias("n")).collect()}
    short = [value for value, n in counts.items() if have.get(value, 0) < min(n, most)]
    if short:
        got = got.where(~F.col(by).isin(short)).unionByName(first(drawn.where(F.col(by).isin(short))))
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator, elementwise on uint64 (a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def slices(offsets: np.ndarray, most: int):
    """Ranges (i, j) of rows holding about ``most`` bytes each, a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


GOLD = 0x9E3779B97F4A7C15


def _byte_classes() -> np.ndarray:
    """0 for ASCII that isn't a letter or digit, lower case of ASCII letters, other bytes as they are."""
    out = np.arange(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() else 0
    return out


BYTE_CLASS = _byte_classes()
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(GOLD))
_PLACE = mix(np.arange(1, 129, dtype=np.uint64) * U64(0xD1342543DE82EF95)) | U64(1)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with case folded for ASCII and Latin-1, and 0 for ASCII that isn't a letter or digit."""
    low = BYTE_CLASS[data]
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[upper] += 0x20
    return low


class Words:
    """Words of texts (bytes and row offsets): runs of letters and digits, all beyond ASCII counted as letters.

    ``start`` and ``stop`` are byte positions in the data, ``row`` the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = folded(data)
        word = low != 0
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        bounds = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[1:] > offsets[:-1])]
        starts[bounds] = word[bounds]
        self.start = np.flatnonzero(starts)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        inside = np.flatnonzero(word)
        self.first = np.searchsorted(inside, self.start)
        self.size = np.diff(np.append(self.first, len(inside)))
        self.stop = self.start + self.size
        place = np.arange(len(inside)) - np.repeat(self.first, self.size)
        self._terms = _BYTE[low[inside]] * _PLACE[place & 127] + place.astype(np.uint64)

    def hashes(self) -> np.ndarray:
        """Hash of each word; case is ignored for ASCII and Latin-1."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(self._terms, self.first))

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word, of the whole word if it is shorter."""
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(self._terms))
        return mix(sums[self.first + np.minimum(self.size, n)] - sums[self.first])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and the row of each."""
    words = Words(data, offsets)
    return words.hashes(), words.row


def hashed_words(texts: list[str]) -> np.ndarray:
    """The hashes of texts that are one word each."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    return word_hashes(data, offsets)[0]
