"""Clustering of sparse vectors: rows (id, features); centers (cluster, feature, weight)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.staging import small, splits, written
from .features import long_form
from .relational import folds, hash_unit
from .trainers import TrainConfig, _run, _shards


def initial_centers(rows: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """A seeded uniform sample of ``n`` points as centers named by their ids."""
    chosen = rows.orderBy(hash_unit("id", seed=seed), "id").limit(n)
    return chosen.select(F.col("id").cast("string").alias("cluster"), F.explode("features").alias("feature", "weight"))


def distances(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster, distance): cosine distance of each point to each center; null for a zero vector."""
    norms = centers.groupBy("cluster").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("cn"))
    hit = long_form(rows).join(small(centers), "feature").groupBy("id", "cluster").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    grid = rows.select("id", V.norm("features").alias("n")).crossJoin(small(written(norms)))
    got = grid.join(hit, ["id", "cluster"], "left")
    return got.select("id", "cluster", (1 - F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("n") * F.col("cn"))).alias("distance"))


def assign(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, cluster, distance): the closest center, of equals the first by name; zero vectors go to the first."""
    first = F.min(F.struct(F.coalesce("distance", F.lit(2.0)).alias("d"), F.col("cluster").alias("c")))
    return distances(rows, centers).groupBy("id").agg(first.alias("m")).select("id", F.col("m.c").alias("cluster"), F.col("m.d").alias("distance"))


def centroids(rows: DataFrame, assigned: DataFrame, sparsity: float | None = None) -> DataFrame:
    """(cluster, feature, weight): means of the clusters' points, projected on an L1 ball of radius ``sparsity`` if given."""
    placed = rows.join(assigned.select("id", "cluster"), "id")
    n = placed.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = long_form(placed, "cluster").groupBy("cluster", "feature").agg(F.sum("value").alias("s"))
    out = sums.join(small(n), "cluster").select("cluster", "feature", (F.col("s") / F.col("n")).alias("weight")).where(f"abs(weight) >= {V.SMALL}")
    return out if sparsity is None else project_centers(out, sparsity)


def project_centers(centers: DataFrame, radius: float) -> DataFrame:
    """Each center's Euclidean projection on the L1 ball."""
    by = Window.partitionBy("cluster")
    order = by.orderBy(F.desc(F.abs("weight")), "feature").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = centers.withColumn("level", (F.sum(F.abs("weight")).over(order) - radius) / F.row_number().over(by.orderBy(F.desc(F.abs("weight")), "feature")))
    theta = F.greatest(F.max(F.when(F.abs("weight") > F.col("level"), F.col("level"))).over(by), F.lit(0.0))
    new = F.signum("weight") * F.greatest(F.abs("weight") - theta, F.lit(0.0))
    return rows.select("cluster", "feature", new.alias("weight")).where(f"abs(weight) >= {V.SMALL}")


def lloyd_step(rows: DataFrame, centers: DataFrame, sparsity: float | None = None) -> DataFrame:
    """New centers; a cluster without points vanishes."""
    return centroids(rows, assign(rows, centers), sparsity)


def oversample_round(rows: DataFrame, centers: DataFrame, k: int, factor: float = 0.5) -> DataFrame:
    """``centers`` and the floor(k * factor) points that are farthest from them."""
    far = assign(rows, centers).orderBy(F.desc("distance"), "id").limit(int(k * factor)).select("id")
    new = rows.join(F.broadcast(far), "id", "left_semi").select(F.col("id").cast("string").alias("cluster"), F.explode("features").alias("feature", "weight"))
    known = centers.select("cluster").distinct()
    return centers.unionByName(new.join(F.broadcast(known), "cluster", "left_anti"))


def _held(centers: DataFrame, most: int = 5_000_000) -> dict[str, dict[str, float]]:
    """Centers as dictionaries on the driver; ValueError beyond ``most`` weights."""
    rows = centers.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"centers of more than {most} weights aren't held on the driver; set a sparsity")
    held: dict[str, dict[str, float]] = {}
    for r in rows:
        held.setdefault(r["cluster"], {})[r["feature"]] = r["weight"]
    return held


def farthest_first(centers: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` of the centers: a seeded first, then each time the one farthest from all chosen. A few hundred centers: on the
    driver."""
    held = _held(centers)
    names = sorted(held)
    if len(names) <= k:
        return centers
    features = {f: i for i, f in enumerate(sorted({f for v in held.values() for f in v}))}
    m = np.zeros((len(names), len(features)))
    for i, n in enumerate(names):
        for f, w in held[n].items():
            m[i, features[f]] = w
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    chosen = [int(np.random.default_rng(seed).integers(len(names)))]
    near = 1 - m @ m[chosen[0]]
    while len(chosen) < k:
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        near = np.minimum(near, 1 - m @ m[chosen[-1]])
    return centers.where(F.col("cluster").isin([names[i] for i in chosen]))


def kmeans(
    rows: DataFrame, k: int = 100, init_iters: int = 5, finish_iters: int = 5, iters: int = 5, start: int = 10, factor: float = 0.5,
    sparsity: float | None = None, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(centers, assignments): rounds of oversampling, clustering of the oversampled points, then of all points. Every
    round's centers are written to the shared folder."""
    held = rows.where("features IS NOT NULL AND id IS NOT NULL").select("id", "features")
    centers = written(initial_centers(held, min(start, k), seed))
    for _ in range(init_iters):
        centers = written(oversample_round(held, centers, k, factor))
    pool = written(centers.groupBy(F.col("cluster").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("features")))
    centers = written(farthest_first(centers, k, seed))
    for _ in range(finish_iters):
        centers = written(lloyd_step(pool, centers, sparsity))
    for _ in range(iters):
        centers = written(lloyd_step(held, centers, sparsity))
    return centers, assign(held, centers)


def top_terms(centers: DataFrame, n: int = 100) -> DataFrame:
    """(cluster, rank, feature, weight): the largest weights of each center."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "feature"))
    return centers.withColumn("rank", rank).where(F.col("rank") <= n).select("cluster", "rank", "feature", "weight")


def _project(center: dict[str, float], radius: float) -> dict[str, float]:
    mags = sorted(map(abs, center.values()), reverse=True)
    if sum(mags) <= radius:
        return center
    total, theta = 0.0, 0.0
    for i, u in enumerate(mags, 1):
        total += u
        if u > (total - radius) / i:
            theta = (total - radius) / i
    return {f: math.copysign(abs(w) - theta, w) for f, w in center.items() if abs(w) > theta}


class OnlineKMeans:
    """Centers that move toward each point they win by 1 / (points won); a point's center has the largest dot product."""

    def __init__(self, centers: dict[str, dict[str, float]], radius: float = 1.0):
        self.centers, self.radius = {k: dict(v) for k, v in centers.items()}, radius
        self.count = dict.fromkeys(centers, 0)

    def scores(self, x: dict[str, float]) -> dict[str, float]:
        return {k: sum(c.get(f, 0.0) * v for f, v in x.items()) for k, c in self.centers.items()}

    def predict(self, x: dict[str, float]) -> str:
        s = self.scores(x)
        return min(s, key=lambda k: (-s[k], k))

    def update(self, x: dict[str, float]) -> str:
        k = self.predict(x)
        self.count[k] += 1
        rate = 1.0 / self.count[k]
        c = {f: w * (1 - rate) for f, w in self.centers[k].items()}
        for f, v in x.items():
            c[f] = c.get(f, 0.0) + rate * v
        self.centers[k] = _project({f: w for f, w in c.items() if abs(w) >= V.SMALL}, self.radius)
        return k


def online_kmeans(rows: DataFrame, centers: DataFrame, radius: float = 1.0, iters: int = 1, shard_rows: int = 50_000, shards: int | None = None) -> DataFrame:
    """(cluster, feature, weight): one sequential pass in each hash shard, shards' centers averaged, ``iters`` times."""
    held = rows.where("features IS NOT NULL AND id IS NOT NULL").select(
        "id", F.map_keys("features").alias("names"), F.map_values("features").alias("values")
    )
    held = written(held, copies=1)
    n = _shards(TrainConfig(shard_rows=shard_rows, shards=shards), held.count())
    placed = held.select(
        folds("id", n).alias("shard"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"), "names", "values"
    )
    for _ in range(iters):
        shared = rows.sparkSession.sparkContext.broadcast(_held(centers))

        def learn(_, points, shared=shared):
            model = OnlineKMeans(shared.value, radius)
            for p in points:
                model.update(dict(zip(p.names, map(float, p.values))))
            for k, c in model.centers.items():
                yield pd.DataFrame({"cluster": [k] * len(c), "feature": list(c), "weight": list(c.values())})

        with splits(rows.sparkSession):
            parts = _run(placed, n, learn, "cluster string, feature string, weight double")
            centers = written(parts.groupBy("cluster", "feature").agg((F.sum("weight") / n).alias("weight")).where(f"abs(weight) >= {V.SMALL}"))
    return centers


def merge_centers(*models: DataFrame) -> DataFrame:
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return out.groupBy("cluster", "feature").agg((F.sum("weight") / len(models)).alias("weight"))
