"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes decides where a chunk ends, so equal passages are cut alike wherever they
stand, and an insertion moves only the chunks around it. Chunks are deduplicated by digest; runs of repeated chunks are
joined into repeated spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import mix, pick, position, slices, small, utf8, written

MEAN = 16
LEAST, MOST = 8, 256
MIN_SPAN = 100
#: Places sampled, one in so many, and of a chunk that is hot at least so many of these.
EVERY, LEAST_SEEN = 1024, 64

#: Random 32 bits of each byte; 0xFF, which UTF-8 never has, separates texts and adds nothing.
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_GEAR[0xFF] = 0


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] (32 bits) after each byte, by doubling the window: 1, 2, 4, ... 32 bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each text, as byte positions in it.

    A chunk ends after the first byte, ``least`` or more from its start, where the hash is small, but at ``most`` bytes at the
    latest, and never inside a character. The hash doesn't look beyond the start of the text.
    """
    n, gap = len(offsets) - 1, 32
    starts = offsets[:-1] + gap * np.arange(1, n + 1)
    padded = np.full(len(data) + gap * (n + 1), 0xFF, np.uint8)
    to = np.arange(len(data)) + np.repeat(gap * np.arange(1, n + 1), np.diff(offsets))
    padded[to] = data
    small = gear_hashes(padded) < np.uint32((1 << 32) // mean)
    small[:-1] &= (padded[1:] & 0xC0) != 0x80
    small &= padded != 0xFF
    at = np.flatnonzero(small) + 1
    edges = np.searchsorted(at, starts)
    tail = np.searchsorted(at, starts + np.diff(offsets), "right")
    out = []
    for k in range(n):
        size = int(offsets[k + 1] - offsets[k])
        base = int(offsets[k])
        cuts, last = [], 0
        for p in (at[edges[k] : tail[k]] - starts[k]).tolist() + [size]:
            while p - last > most:
                end = last + most
                while data[base + end] & 0xC0 == 0x80:
                    end -= 1
                if end <= last:
                    break
                cuts.append(end)
                last = end
            if p - last >= least or (p == size and p > last):
                cuts.append(p)
                last = p
        out.append(cuts)
    return out


def chunk_texts(docs: DataFrame, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, start, size, digest) of each chunk of (id, text), in bytes of UTF-8."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 21):
                part = offsets[i : j + 1] - offsets[i]
                raw = data[offsets[i] : offsets[j]]
                cuts = cut_points(raw, part, mean, least, most)
                view = memoryview(raw) if len(raw) else memoryview(b"")
                starts, sizes, digests, counts = [], [], [], np.zeros(j - i, np.int64)
                for k, ends in enumerate(cuts):
                    counts[k] = len(ends)
                    begins = [0, *ends[:-1]] if ends else []
                    base = int(part[k])
                    starts += begins
                    sizes += [e - b for b, e in zip(begins, ends)]
                    digests += [digest(view[base + b : base + e]) for b, e in zip(begins, ends)]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(i, j), counts)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.array(digests, np.uint64).view(np.int64))],
                    ["id", "start", "size", "digest"],
                )

    return docs.mapInArrow(run, "id long, start int, size int, digest long")


def hot_chunks(chunks: DataFrame, every: int = EVERY, least: int = LEAST_SEEN) -> DataFrame:
    """(d, s): digests and sizes of chunks of which a sample of one place in ``every`` has at least ``least`` places, and a
    100,000th of all its places; so at most 100,000 chunks, whatever the input."""
    seen = chunks.where(F.pmod(F.xxhash64("id", "start"), F.lit(every)) == 0).groupBy("digest", "size").agg(F.count("*").alias("n"))
    seen = written(seen.where(F.col("n") >= least))
    total = seen.agg(F.sum("n")).first()[0] or 0
    return seen.where(F.col("n") >= total / 100_000).select(F.col("digest").alias("d"), F.col("size").alias("s"))


def _later(chunks: DataFrame, every: int, least: int) -> DataFrame:
    """(id, start, stop, first_id) of the places of repeated chunks but the first.

    How places are shuffled doesn't matter to the result: those of hot chunks stay where they are, as their firsts are few
    and broadcast; the others are shuffled once by chunk, for finding the first and for comparing with it.
    """
    hot = F.broadcast(hot_chunks(chunks, every, least))
    same = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    found = []
    for places, broadcast in ((chunks.join(hot, same, "left_anti").repartition("digest", "size"), False), (chunks.join(hot, same, "left_semi"), True)):
        first = places.groupBy("digest", "size").agg(F.min(F.struct("id", "start")).alias("at"), F.count("*").alias("n")).where("n > 1")
        first = first.select(F.col("digest").alias("d"), F.col("size").alias("s"), F.col("at.id").alias("first_id"), F.col("at.start").alias("first_start"))
        later = places.join(F.broadcast(first) if broadcast else first, same).where("id <> first_id OR start <> first_start")
        found.append(later.select("id", "start", (F.col("start") + F.col("size")).alias("stop"), "first_id"))
    return found[0].unionByName(found[1])


def repeated_spans(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN,
    mean: int = MEAN, least: int = LEAST, most: int = MOST, every: int = EVERY, least_seen: int = LEAST_SEEN,
) -> DataFrame:
    """(doc_id, start, stop, first_doc_id, n_chunks): spans of repeated chunks, ``min_span`` bytes or more.

    A chunk is repeated if an equal one (by 64-bit digest and size) comes first, in the order of (doc_id, start); spans
    are maximal runs of such chunks, in bytes of UTF-8, and first_doc_id is the smallest document that holds the first of
    any of its chunks. So one copy of each passage is outside all spans. A span is shorter than the passage by up to the
    hash's 32 bytes and a chunk at its head and a chunk at its tail (23 bytes on average); of passages of 51 words set
    into two documents 98.7 % had a span. Rows with a null id or text are left out; an empty text has no
    chunk. Rows that share an id and text are one; an id with several texts has the spans of each. An empty table gives an
    empty result; other columns are dropped.
    """
    rows = pick(docs, id=id, text=text).where("id IS NOT NULL AND text IS NOT NULL")
    chunks = written(chunk_texts(rows, mean, least, most))
    later = _later(chunks, every, least_seen).groupBy("id", "start", "stop").agg(F.min("first_id").alias("first_id"))
    along = Window.partitionBy("id").orderBy("start", "stop")
    joins = F.coalesce(F.lag("stop").over(along) >= F.col("start"), F.lit(False))
    runs = later.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    return (
        runs.groupBy(F.col("id").alias("doc_id"), "run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_id").alias("first_doc_id"), F.count("*").cast("int").alias("n_chunks"))
        .where(F.col("stop") - F.col("start") >= min_span)
        .select("doc_id", "start", "stop", "first_doc_id", "n_chunks")
    )


def drop_repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the spans that ``repeated_spans`` reports cut from their texts, all columns; so one copy of each
    passage stays. Rows with a null id or text, and those whose id has several texts, stay as they are."""
    names, i_id, i_text = docs.columns, position(docs, id), position(docs, text)
    several = pick(docs, id=id, text=text).where("text IS NOT NULL").groupBy("id").agg(F.countDistinct(F.xxhash64("text")).alias("n")).where("n > 1")
    spans = repeated_spans(docs, id, text, **options).join(several, F.col("doc_id") == F.col("id"), "left_anti")
    spans = written(spans.groupBy(F.col("doc_id").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")))
    plain = docs.toDF(*[f"in{i}" for i in range(len(names))]).join(small(spans), F.col(f"in{i_id}") == F.col("owner"), "left")
    # what stays: from the end of each span, or the text's start, to the next span
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["stop"]))
    ends = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.octet_length(f"in{i_text}")))
    raw = F.encode(F.col(f"in{i_text}"), "UTF-8")
    piece = lambda whole: lambda x: F.decode(F.substring(whole, x["a"] + 1, x["b"] - x["a"]), "UTF-8")
    kept = let(raw, lambda whole: F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), piece(whole)), ""))
    cut = F.when(F.col("owner").isNotNull(), kept).otherwise(F.col(f"in{i_text}"))
    return plain.select(*[cut.alias(f"in{i}") if i == i_text else F.col(f"in{i}") for i in range(len(names))]).toDF(*names)
