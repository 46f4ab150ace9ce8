"""Nearest neighbours of dense vectors: rows (id, vec array<double>); results (id, neighbor_id, rank, distance)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dense_distance
from ..sources.staging import small, written
from .relational import hash_unit

#: Rows that are put into their bins at a time, as each is copied to many.
ROWS = 256
NEIGHBOURS = "id long, neighbor_id long, distance double"


def _clean(rows: DataFrame, id: str = "id", vec: str = "vec") -> DataFrame:
    return rows.where(F.col(id).isNotNull() & F.col(vec).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-300)
    return 1 - a @ b.T / n


def nearest(ids: np.ndarray, vecs: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int, distance: Callable = euclidean, chunk: int = 256, block: int = 2048) -> pd.DataFrame:
    """The ``k`` nearest others of each row, itself (by id) aside, ties by id. Matrices are ``chunk`` by ``block``; of each
    block, what is no farther than its row's k-th is kept until the row's blocks are over."""
    out = []
    for at in range(0, len(ids), chunk):
        own, found = ids[at : at + chunk], []
        for j in range(0, len(other_ids), block):
            names = other_ids[j : j + block]
            d = distance(vecs[at : at + chunk], others[j : j + block])
            d[own[:, None] == names[None, :]] = np.inf
            most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
            r, c = np.nonzero((d <= most) & np.isfinite(d))
            found.append((r, names[c], d[r, c]))
        if not found:
            continue
        r, other, d = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((other, d, r))
        r, other, d = r[order], other[order], d[order]
        first = np.searchsorted(r, np.arange(len(own)))
        keep = np.arange(len(r)) - first[r] < k
        out.append(pd.DataFrame({"id": own[r[keep]], "neighbor_id": other[keep], "distance": d[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbor_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype=float)})


def merge(found: DataFrame, k: int) -> DataFrame:
    """(id, neighbor_id, rank, distance): of all that bins found, each neighbour once with its least distance, the first k."""
    once = found.groupBy("id", "neighbor_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbor_id", "rank", "distance")


def as_lists(neighbours: DataFrame) -> DataFrame:
    """(id, neighbors array<struct<id, distance>>), nearest first."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("neighbor_id").alias("id"), "distance")))
    return neighbours.groupBy("id").agg(F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["distance"].alias("distance"))).alias("neighbors"))


def exact(targets: DataFrame, candidates: DataFrame, k: int, id: str = "id", vec: str = "vec", part: int = 8192) -> DataFrame:
    """Exact neighbours of a set of queries: blocks of ``part`` targets against blocks of ``part`` candidates, of which each
    gives its k nearest; what is shuffled is a block's vectors and k rows a target, never all pairs."""
    t, c = written(_clean(targets, id, vec).withColumn("bin", F.lit(0))), written(_clean(candidates, id, vec).withColumn("bin", F.lit(0)))
    shape = _parts(t, part, "rows").join(_parts(c, part, "columns"), "bin")
    found = _grid(t, c, shape, k + 4, euclidean)
    # distances of matrices lose digits by cancelling; the few that are left are worked out again
    own, other = t.select("id", "vec"), c.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("other"))
    again = found.select("id", "neighbor_id").join(own, "id").join(other, "neighbor_id")
    return merge(again.select("id", "neighbor_id", dense_distance("vec", "other").alias("distance")), k)


def planes(dims: int, hashes: int, bits: int, seed: int = 0) -> np.ndarray:
    return np.stack([np.random.default_rng(seed + 1 + 1000 * h).standard_normal((bits, dims)) for h in range(hashes)])


def _few(batches):
    """Batches of at most ROWS rows."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def lsh_codes(rows: DataFrame, hashes: int = 50, bits: int = 12, seed: int = 0, id: str = "id", vec: str = "vec") -> DataFrame:
    """(bin, id, vec): a row for each table; the bin's low bits are the signs of projections, the high ones the table."""

    def run(batches):
        held = None
        for b in _few(batches):
            x = np.array(b.column(1).to_pylist(), float)
            if held is None:
                held = planes(x.shape[1], hashes, bits, seed).reshape(hashes * bits, -1)
            sign = (x @ held.T > 0).reshape(len(x), hashes, bits)
            codes = (sign << np.arange(bits)).sum(2) + (np.arange(hashes) << bits)
            at = pa.array(np.repeat(np.arange(len(x)), hashes))
            yield pa.RecordBatch.from_arrays([pa.array(codes.ravel().astype(np.int64)), b.column(0).take(at), b.column(1).take(at)], ["bin", "id", "vec"])

    return _clean(rows, id, vec).mapInArrow(run, "bin long, id long, vec array<double>")


def _within(bins: DataFrame, k: int, distance: Callable = euclidean) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return nearest(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        pdf = pdf.drop_duplicates("id").sort_values("id")
        ids, vecs = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy())
        return nearest(ids, vecs, ids, vecs, k, distance)

    return bins.groupBy("bin").applyInPandas(run, NEIGHBOURS)


def _between(targets: DataFrame, candidates: DataFrame, keys: list[str], k: int, distance: Callable) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return nearest(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
        b = b.drop_duplicates("id").sort_values("id")
        return nearest(a["id"].to_numpy(), np.stack(a["vec"].to_numpy()), b["id"].to_numpy(), np.stack(b["vec"].to_numpy()), k, distance)

    return targets.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(run, NEIGHBOURS)


def _parts(bins: DataFrame, most: int, name: str) -> DataFrame:
    """(bin, name): the number of parts of about ``most`` points of each bin."""
    return bins.groupBy("bin").agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def _grid(targets: DataFrame, candidates: DataFrame, shape: DataFrame, k: int, distance: Callable) -> DataFrame:
    """Each part of a bin's targets against each part of its candidates: ``shape`` has (bin, rows, columns) of each."""
    shape = small(written(shape))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = targets.join(shape, "bin").select("bin", "id", "vec", part("rows").alias("row"), every("columns").alias("column"))
    own = [F.col(c).alias(c) for c in ("bin", "id", "vec")]  # both sides may be the same table
    b = candidates.join(shape, "bin").select(*own, every("rows").alias("row"), part("columns").alias("column"))
    return _between(a, b, ["bin", "row", "column"], k, distance)


def _whole(bins: DataFrame, most: int | None, k: int, distance: Callable = euclidean) -> DataFrame:
    """Neighbours within bins; those of more than ``most`` points are compared part by part."""
    if most is None:
        return _within(bins, k, distance)
    crowded = written(_parts(bins, most, "rows").where("rows > 1"))
    if crowded.isEmpty():
        return _within(bins, k, distance)
    rest = bins.join(crowded, "bin", "left_anti")
    return _within(rest, k, distance).unionByName(_grid(bins, bins, crowded.withColumn("columns", F.col("rows")), k, distance))


def lsh_knn(rows: DataFrame, k: int, hashes: int = 50, bits: int = 12, max_bin: int | None = 10_000, seed: int = 0, id: str = "id", vec: str = "vec") -> DataFrame:
    """Approximate neighbours within a table: exact ones of each bin of sign projections, merged over the tables. Bins of more
    than ``max_bin`` points are compared part by part (None: none is cut), which is quadratic in their points."""
    return merge(_whole(written(lsh_codes(rows, hashes, bits, seed, id, vec)), max_bin, k), k)


def lsh_knn2(targets: DataFrame, candidates: DataFrame, k: int, hashes: int = 50, bits: int = 12, max_bin: int | None = 10_000, seed: int = 0, id: str = "id", vec: str = "vec") -> DataFrame:
    """Neighbours of targets among candidates; targets that share no bin with any have none. Parts of about ``max_bin``
    targets and candidates of a bin are compared at a time (None: none is cut)."""
    t, c = written(lsh_codes(targets, hashes, bits, seed, id, vec)), written(lsh_codes(candidates, hashes, bits, seed, id, vec))
    if max_bin is None:
        return merge(_between(t, c, ["bin"], k, euclidean), k)
    return merge(_grid(t, c, _parts(t, max_bin, "rows").join(_parts(c, max_bin, "columns"), "bin"), k, euclidean), k)


def choose_centers(rows: DataFrame, n: int, seed: int = 0) -> list[tuple[int, list[float]]]:
    """``n`` pivots by the order of a seeded hash."""
    return [(r["id"], r["vec"]) for r in rows.orderBy(hash_unit("id", seed=seed), "id").limit(n).collect()]


def assign_bins(rows: DataFrame, centers: list[tuple[int, list[float]]], per_point: int, distance: Callable = euclidean) -> DataFrame:
    """(bin, id, vec): each point in the bins of its ``per_point`` nearest pivots."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([c for c, _ in centers], np.int64), np.array([v for _, v in centers], float)))

    def run(batches):
        names, pivots = shared.value
        m = min(per_point, len(names))
        for b in _few(batches) if m else ():
            d = distance(np.array(b.column(1).to_pylist(), float), pivots)
            order = np.argsort(d, axis=1, kind="stable")[:, :m]
            at = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([pa.array(names[order].ravel()), b.column(0).take(at), b.column(1).take(at)], ["bin", "id", "vec"])

    return rows.mapInArrow(run, "bin long, id long, vec array<double>")


def initialize_bins(rows: DataFrame, centers: int, per_point: int, max_bin: int, distance: Callable = euclidean, seed: int = 0) -> list[tuple[int, list[float]]]:
    """Pivots, and further ones out of the bins that would hold more than ``max_bin`` points."""
    pivots = choose_centers(rows, centers, seed)
    bins = written(assign_bins(rows, pivots, per_point, distance))
    crowded = bins.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > max_bin).withColumn("extra", F.ceil(F.col("n") / max_bin).cast("int"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(hash_unit("id", seed=seed + 1), "id"))
    more = bins.join(small(written(crowded)), "bin").withColumn("r", rank).where("r <= extra").select("id", "vec").dropDuplicates(["id"])
    known = {c for c, _ in pivots}
    # at most as many again as there were: the bins stay whole whatever the pivots are
    chosen = more.orderBy(hash_unit("id", seed=seed + 1), "id").limit(max(centers, 1)).collect()
    return pivots + sorted((r["id"], r["vec"]) for r in chosen if r["id"] not in known)


def pivot_knn(
    rows: DataFrame, k: int, distance: Callable = euclidean, centers: int | None = None, per_point: int = 5, max_bin: int = 20_000, seed: int = 0,
    id: str = "id", vec: str = "vec",
) -> DataFrame:
    """Neighbours by any distance of matrices: exact ones in the bins of pivots (the square root of the rows, 10,000 at
    most), merged. Bins that stay larger than ``max_bin`` are compared part by part."""
    held = written(_clean(rows, id, vec))
    n = centers or max(1, min(10_000, math.isqrt(held.count())))
    pivots = initialize_bins(held, n, per_point, max_bin, distance, seed)
    return merge(_whole(written(assign_bins(held, pivots, per_point, distance)), max_bin, k, distance), k)


def pivot_knn2(
    targets: DataFrame, candidates: DataFrame, k: int, distance: Callable = euclidean, centers: int | None = None, per_point: int = 5,
    max_bin: int = 20_000, seed: int = 0, id: str = "id", vec: str = "vec",
) -> DataFrame:
    """Neighbours of targets among candidates. Parts of about ``max_bin`` targets and candidates of a bin are compared at a
    time, so a crowded bin takes several tasks, none of which holds it all."""
    t, c = written(_clean(targets, id, vec)), written(_clean(candidates, id, vec))
    n = centers or max(1, min(10_000, math.isqrt(c.count())))
    pivots = initialize_bins(c, n, per_point, max_bin, distance, seed)
    a, b = written(assign_bins(t, pivots, per_point, distance)), assign_bins(c, pivots, per_point, distance)
    b = written(b)
    return merge(_grid(a, b, _parts(a, max_bin, "rows").join(_parts(b, max_bin, "columns"), "bin"), k, distance), k)
