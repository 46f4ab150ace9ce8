"""Near-duplicates by ProbMinHash.

Each distinct shingle of a document, weighted by how often it occurs, is a Poisson process whose rate is its weight and
whose arrivals fall on the registers of the signature at random; a register keeps the shingle that arrives first. Two
documents agree in a register with the probability Jaccard similarity of their weighted shingles. Arrivals later than
the last register's first arrival can't matter, so each process stops there. Bands of registers give candidate groups,
which the whole signatures verify; the verified pairs' connected components are the groups of near-duplicates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLD as _GOLD
from .common import U64, mix, pick, position, slices, small, utf8, word_hashes, written

SHINGLE = 3
BANDS, ROWS = 50, 4
REGISTERS = BANDS * ROWS
THRESHOLD = 0.5
#: Members up to which one task holds a bucket; larger ones are compared part by part.
PART = 2048


def weighted_shingles(words: np.ndarray, rows: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``n`` words: (row, 48-bit hash, count). A row of fewer words is one shingle."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    m = len(words)
    h = np.zeros(m, np.uint64)
    same = np.ones(m, bool)
    for k in range(n):
        shifted, where = np.zeros(m, np.uint64), np.full(m, -1)
        shifted[: m - k], where[: m - k] = words[k:], rows[k:]
        match = where == rows
        h += np.where(match, shifted, 0) * U64(2 * k * 0x5851F42D4C957F2D + 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF | 1)
        same &= match
    first = np.ones(m, bool)
    first[1:] = rows[1:] != rows[:-1]
    keep = same | (first & ~same)
    key = np.sort((rows[keep].astype(np.uint64) << U64(48)) | (mix(h[keep]) >> U64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1), np.diff(np.append(at, m and len(new))).astype(float)


def signatures(rows: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (n x m, uint32) of ``n`` documents; all zero where a document has no shingle.

    Arrivals are made in blocks for all documents at once; an element whose latest arrival is beyond the largest of its
    document's registers is dropped.
    """
    best = np.full(n * m, np.inf)
    sign = np.zeros(n * m, np.uint32)
    seed = mix(shingles * U64(2) + U64(1))
    now, step, block = np.zeros(len(rows)), 0, 1
    limit = np.full(n, np.inf)
    while len(rows):
        steps = (np.arange(step, step + block, dtype=np.uint64) + U64(1)) * U64(_GOLD)
        draws = mix(seed[:, None] + steps[None, :])
        gaps = -np.log1p(-(draws >> U64(11)).astype(float) * 2.0**-53) / weights[:, None]
        times = now[:, None] + np.cumsum(gaps, axis=1)
        slot = rows[:, None] * m + (mix(draws ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(m)).astype(np.int64)
        ok = times < limit[rows][:, None]
        t, s = times[ok], slot[ok]
        who = np.broadcast_to((seed & U64(0xFFFFFFFF)).astype(np.uint32)[:, None], ok.shape)[ok]
        np.minimum.at(best, s, t)
        won = t == best[s]
        sign[s[won]] = who[won]
        limit = best.reshape(n, m).max(axis=1)
        now = times[:, -1]
        live = now < limit[rows]
        rows, seed, weights, now = rows[live], seed[live], weights[live], now[live]
        step += block
        block = int(min(64, max(1, 60_000 // max(1, len(rows)))))
    return sign.reshape(n, m)


def band_keys(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    out = np.zeros((len(sign), bands), np.uint64) + (np.arange(bands, dtype=np.uint64) + U64(1)) * U64(_GOLD)
    for k in range(rows):
        out = mix(out ^ sign[:, k : bands * rows : rows].astype(np.uint64)) + U64(k)
    return out.view(np.int64)


def sign_texts(docs: DataFrame) -> DataFrame:
    """(id, sign, bands) of (id, text): 16 bits of each register, and the keys of the bands. Texts without words go."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 21):
                n = j - i
                part = offsets[i : j + 1] - offsets[i]
                words, rows = word_hashes(data[offsets[i] : offsets[j]], part)
                signs = signatures(*weighted_shingles(words, rows), n)
                has = np.zeros(n, bool)
                has[rows] = True
                at = np.flatnonzero(has)
                signs = signs[at]
                keys = band_keys(signs)
                flat = np.ascontiguousarray((signs >> np.uint32(16)).astype("<u2"))
                ids = batch.column(0).slice(i, n).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array([r.tobytes() for r in flat], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                    ],
                    ["id", "sign", "bands"],
                )

    return docs.mapInArrow(run, "id long, sign binary, bands array<long>")


def _verify(buckets: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (a, b) inside buckets of bounded size: rows (bucket, id, sign), in any order.

    In each bucket the first document that is left takes all that are similar to it, and each taken one those that are
    left, until none is similar to any taken one; so the pairs connect what all verified pairs of the bucket connect.
    Buckets are streamed in sorted partitions.
    """

    def pairs(ids: np.ndarray, signs: list[bytes], out_a: list, out_b: list) -> None:
        sign = np.frombuffer(b"".join(signs), "<u2").reshape(len(signs), -1)
        left, rest = np.arange(1, len(ids)), sign[1:]
        reached = [0]
        while len(left):
            if not reached:
                reached, left, rest = [left[0]], left[1:], rest[1:]
                continue
            lead = reached.pop()
            like = (rest == sign[lead]).mean(axis=1) >= threshold
            if like.any():
                hit = left[like]
                out_a.append(np.full(len(hit), ids[lead]))
                out_b.append(ids[hit])
                reached += hit.tolist()
                left, rest = left[~like], rest[~like]

    def run(batches):
        held_bucket, held_ids, held_signs = None, [], []  # of one bucket, which has PART members at most
        for batch in batches:
            bucket = np.asarray(batch.column(0))
            if not len(bucket):
                continue
            ids, signs = np.asarray(batch.column(1)), batch.column(2).to_pylist()
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            a, b = [], []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if bucket[i] != held_bucket:
                    if len(held_ids) and len(held_signs) > 1:
                        pairs(np.concatenate(held_ids), held_signs, a, b)
                    held_bucket, held_ids, held_signs = bucket[i], [], []
                held_ids.append(ids[i:j])
                held_signs += signs[i:j]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        if len(held_signs) > 1:
            a, b = [], []
            pairs(np.concatenate(held_ids), held_signs, a, b)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    ordered = buckets.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("id", "bucket"))
    return ordered.select("bucket", "id", "sign").mapInArrow(run, "a long, b long")


def _verify_large(buckets: DataFrame, threshold: float, part: int = PART) -> DataFrame:
    """As ``_verify``, for buckets (bucket, n, id, sign) of any size, none of which any task holds whole.

    Each bucket's leader, the member that comes first by hash, is compared with all members where they are. Those that
    it doesn't take are compared with all members in blocks of about ``part`` by ``part``; what the leader took is
    connected already, so that a block links a document to it once. All comparisons are made that can connect anything.
    """

    def against_leader(batches):
        for batch in batches:
            mine, first = batch.column("sign"), batch.column("lead_sign")
            if batch.num_rows:
                a = np.frombuffer(b"".join(mine.to_pylist()), "<u2").reshape(batch.num_rows, -1)
                b = np.frombuffer(b"".join(first.to_pylist()), "<u2").reshape(batch.num_rows, -1)
                like = pa.array((a == b).mean(axis=1) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("bucket", "n", "id", "sign", "lead")] + [like], ["bucket", "n", "id", "sign", "lead", "taken"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        sign = np.frombuffer(b"".join(pdf["sign"]), "<u2").reshape(len(pdf), -1)
        mine, all_ids = pdf["mine"].to_numpy(), pdf["id"].to_numpy()
        ids, others = all_ids[~mine], sign[~mine]
        group = np.where(pdf["taken"].to_numpy()[~mine], -1, np.arange(len(ids)))  # what is connected so far
        out = []
        for one, row in zip(all_ids[mine].tolist(), sign[mine]):
            hit = np.flatnonzero((others == row).mean(axis=1) >= threshold)
            if len(hit):
                groups, at = np.unique(group[hit], return_index=True)
                out += [(one, int(ids[k])) for k in hit[at]]
                group[np.isin(group, groups)] = groups[0]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    leads = written(buckets.groupBy("bucket").agg(F.min_by(F.struct("id", "sign"), F.xxhash64("id", "bucket")).alias("l")))
    led = buckets.join(small(leads.select("bucket", F.col("l.id").alias("lead"), F.col("l.sign").alias("lead_sign"))), "bucket")
    done = written(led.mapInArrow(against_leader, "bucket long, n long, id long, sign binary, lead long, taken boolean"))
    found = done.where("taken AND id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    rest = written(done.where("NOT taken").groupBy("bucket").agg(F.count("*").alias("n_rest")))
    sized = done.join(small(rest), "bucket").select(
        "bucket", "id", "sign", "taken", F.ceil(F.col("n_rest") / part).cast("int").alias("rows"), F.ceil(F.col("n") / part).cast("int").alias("columns")
    )
    own, every = (F.pmod(F.xxhash64("id", F.lit(3)), c).cast("int") for c in ("rows", "columns"))
    left = sized.where("NOT taken").select("bucket", "id", "sign", "taken", F.lit(True).alias("mine"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    right = sized.select("bucket", "id", "sign", "taken", F.lit(False).alias("mine"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), every.alias("j"))
    blocks = left.unionByName(right).groupBy("bucket", "i", "j").applyInPandas(block, "a long, b long")
    return found.unionByName(blocks.where("a <> b"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, first): each node of the undirected pairs (a, b) with the smallest node of its component.

    Every round links the neighbours of a node to the smallest of them, first the larger ones and then the smaller, so
    that the depth shrinks geometrically; rounds end when nothing changes. Each is written to the shared folder.
    """
    edges = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        edges = written(
            star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(star.select("u", F.col("m").alias("v"))).distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("first"))
        seen = state


def _buckets(keyed: DataFrame) -> DataFrame:
    """(bucket, n, id): members of the keys of (id, key) that several ids have, of keys with the same members only one.

    Keys with equal numbers, smallest and largest ids and sums of two 28-bit hashes have the same members; no task holds
    a key's members to find that out.
    """
    hashed = F.xxhash64("id")
    part = lambda shift: F.sum(F.shiftright(hashed, shift).bitwiseAND((1 << 28) - 1))
    sets = ["n", "low", "high", "one", "two"]
    keys = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), part(0).alias("one"), part(28).alias("two"))
    kept = written(keys.where("low < high").groupBy(*sets).agg(F.min("key").alias("bucket")).select("bucket", "n"))
    return keyed.join(small(kept), F.col("key") == F.col("bucket")).select("bucket", "n", "id")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, part: int = PART
) -> DataFrame:
    """(doc_id, duplicate_of, n_group): documents of groups of near-duplicates but the first, with the first of each.

    Similarity is the probability Jaccard of word 3-shingles weighted by their counts, estimated by 200 registers
    (standard error at most 0.036) and compared with ``threshold``; 50 bands of 4 find a pair at 0.5 with probability
    0.96, at 0.55 with 0.99. So a pair within the error of the threshold is judged by its estimate, not by its true value.
    Exact copies are near-duplicates, too. Case and punctuation don't count. Null texts and texts without a word are in no
    group, nor are rows with a null id; rows that share an id are one document, similar to whatever any of them is similar
    to. An empty table gives an empty result; other columns are dropped. Buckets have no cap: those of more than ``part``
    members are compared part by part.
    """
    rows = pick(docs, id=id, text=text).where("id IS NOT NULL AND text IS NOT NULL")
    signed = written(sign_texts(rows))
    keyed = signed.select("id", F.explode("bands").alias("key"))
    members = written(_buckets(keyed))
    buckets = members.join(signed.select("id", "sign"), "id")
    pairs = _verify(buckets.where(F.col("n") <= part), threshold)
    if not members.where(F.col("n") > part).isEmpty():
        pairs = pairs.unionByName(_verify_large(buckets.where(F.col("n") > part), threshold, part))
    found = components(pairs)
    size = F.count("*").over(Window.partitionBy("first")) + 1
    return found.select(F.col("id").alias("doc_id"), F.col("first").alias("duplicate_of"), size.cast("int").alias("n_group"))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` reports, all columns; so the smallest id of each group
    stays, and rows with null ids or texts do."""
    losers = written(near_duplicates(docs, id, text, threshold).select(F.col("doc_id").alias("loser")))
    names, at = docs.columns, position(docs, id)
    plain = docs.toDF(*[f"in{i}" for i in range(len(names))])
    return plain.join(small(losers), F.col(f"in{at}") == F.col("loser"), "left_anti").toDF(*names)


def exact_similarity(a: str, b: str) -> float:
    """Probability Jaccard of two texts by its definition, for tests: over shared shingles d, the sum of
    1 / sum over e of max(w_a(e) / w_a(d), w_b(e) / w_b(d))."""
    sets = []
    for t in (a, b):
        data, offsets = utf8(pa.array([t]))
        _, s, w = weighted_shingles(*word_hashes(data, offsets))
        sets.append(dict(zip(s.tolist(), w.tolist())))
    x, y = sets
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))
