"""Distributed online learners: each shard of instances is learned in order by one sequential kernel, the shards'
models are averaged, and further passes start from the average.

A shard is a hash of the id, never a physical partition, and is streamed in the order of ids; so results don't depend
on the cluster. ``TrainConfig.shard_rows`` bounds a shard, and with it a task, as data grow.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import BROADCAST_ROWS, splits, written
from . import kernels as K
from .relational import hash_unit, parse_class_probabilities

SMALL = 1e-10
LOSSES = ("logistic_regression", "perceptron", "linear_svm", "mira", "least_squares")
OPTIMIZERS = ("elastic_net", "adagrad", "passive_aggressive", "ftrl", "mira", "control")


@dataclass
class TrainConfig:
    """Options of training; invalid ones raise ValueError."""

    model: str = "logistic_regression"
    optimizer: str = "elastic_net"
    iters: int = 1
    rate: float = 0.1
    exponential_base: float | None = None
    examples_per_epoch: float = 10_000.0
    laplace: float = 0.0
    gauss: float = 0.0
    aggressiveness: float = 2.0
    ftrl_alpha: float = 1.0
    ftrl_beta: float = 1.0
    period: int | None = None
    truncation_update: float = 0.0
    truncation_threshold: float = 0.0
    mini_batch_size: int = 1
    final_thresholding: float = 0.0
    zero_class_prob: float = 1.0
    one_class_prob: float = 1.0
    class_probs: dict = field(default_factory=dict)
    frozen: bool = False
    shard_rows: int = 50_000
    shards: int | None = None
    drop_partial_batch: bool = False
    whole_batch: bool = False
    broadcast_rows: int = BROADCAST_ROWS
    seed: int = 0

    def __post_init__(self):
        if self.model == "mira":
            self.optimizer = "mira"
        checks = {
            "model": self.model in LOSSES, "optimizer": self.optimizer in OPTIMIZERS, "iters": self.iters >= 1, "rate": self.rate > 0,
            "exponential_base": self.exponential_base is None or 0 < self.exponential_base <= 1, "examples_per_epoch": self.examples_per_epoch > 0,
            "laplace": self.laplace >= 0, "gauss": self.gauss >= 0, "aggressiveness": self.aggressiveness > 0, "ftrl_alpha": self.ftrl_alpha > 0,
            "whole_batch": not self.whole_batch or (self.optimizer in ("elastic_net", "passive_aggressive", "mira") and not self.period),
            "ftrl_beta": self.ftrl_beta > 0, "mini_batch_size": self.mini_batch_size >= 1, "shard_rows": self.shard_rows >= 1,
        }
        bad = [k for k, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"invalid: {', '.join(bad)}")

    @classmethod
    def parse(cls, args: dict) -> "TrainConfig":
        """From strings by name, as a command line gives them; unknown names raise ValueError."""
        kinds = {f.name: f for f in fields(cls)}
        unknown = set(args) - set(kinds)
        if unknown:
            raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
        out = {}
        for k, v in args.items():
            kind = str(kinds[k].type).split(" ")[0]
            if kind == "dict" and isinstance(v, str):
                v = parse_class_probabilities(v)
            out[k] = v if not isinstance(v, str) else v.lower() in ("1", "true", "yes") if kind == "bool" else {"int": int, "float": float}.get(kind, str)(v)
        return cls(**out)

    def unparse(self) -> dict[str, str]:
        """As ``parse`` takes them; options that are unset or empty are left out."""
        out = {f.name: str(getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None and f.name != "class_probs"}
        return out | ({"class_probs": ",".join(f"{k}:{v}" for k, v in self.class_probs.items())} if self.class_probs else {})


class Learner:
    """One linear model and its optimizer's state. Penalties are lazy: a weight catches up when it is next read.

    The plain form, an instance and a feature at a time, which ``kernels.ArrayLearner`` is tested against; training uses that.
    """

    def __init__(self, config: TrainConfig, weights: dict[str, float] | None = None, epoch: int = 0):
        self.c = config
        self.w: dict[str, float] = dict(weights or {})
        self.last: dict[str, int] = {}
        self.tick, self.epoch = 0, epoch
        self.g2: dict[str, float] = {}
        self.z: dict[str, float] = {}
        self.n: dict[str, float] = {}
        self.lazy = (config.laplace > 0 or config.gauss > 0) and config.optimizer != "ftrl"

    def rate(self, t: int) -> float:
        f = max(1.0, (t + 1) / self.c.examples_per_epoch)
        return max(0.0, self.c.rate / f if self.c.exponential_base is None else self.c.rate * self.c.exponential_base**f)

    def weight(self, feature: str) -> float:
        w = self.w.get(feature, 0.0)
        if self.lazy and w:
            w = self._caught_up(feature, w)
            self.last[feature] = self.tick
            if abs(w) < SMALL:
                self.w.pop(feature, None)
                return 0.0
            self.w[feature] = w
        return w

    def _caught_up(self, feature: str, w: float) -> float:
        for t in range(self.last.get(feature, 0), self.tick):
            rate = self.rate(t)
            if self.c.optimizer == "adagrad":
                rate = self.c.rate / math.sqrt(1.0 + self.g2.get(feature, 0.0))
            w -= rate * self.c.gauss * w
            w = math.copysign(max(0.0, abs(w) - rate * self.c.laplace), w)
            if abs(w) < SMALL:
                return 0.0
        return w

    def margin(self, x: dict[str, float]) -> float:
        return sum(self.weight(f) * v for f, v in x.items())

    def predict(self, x: dict[str, float]) -> float:
        m = self.margin(x)
        if self.c.model == "least_squares":
            return m
        return 1 / (1 + math.exp(-m)) if m > -700 else 0.0

    def _slope(self, y: float, x: dict[str, float], m: float) -> float:
        """What the features are multiplied with in the gradient."""
        s = 2 * (y - 0.5)
        kind = self.c.model
        if kind == "logistic_regression":
            t = s * m
            return -s / (math.exp(t) + 1) if t < 700 else 0.0
        if kind in ("perceptron", "linear_svm"):
            return -s if s * m <= (1.0 if kind == "linear_svm" else 0.0) else 0.0
        if kind == "mira":
            norm2 = sum(v * v for v in x.values())
            return -s * max(0.0, 1 - s * m) / norm2 if norm2 else 0.0
        return 2 * (m - y)

    def _ftrl_weights(self, x: dict[str, float]) -> None:
        c = self.c
        for f in x:
            z = self.z.get(f, 0.0)
            if abs(z) <= c.laplace:
                self.w.pop(f, None)
            else:
                w = -(z - math.copysign(c.laplace, z)) / ((c.ftrl_beta + math.sqrt(self.n.get(f, 0.0))) / c.ftrl_alpha + c.gauss)
                self.w[f] = w

    def step(self, y: float, x: dict[str, float]) -> dict[str, float]:
        """The change of the weights that an instance asks for."""
        c = self.c
        if c.optimizer == "ftrl":
            if c.frozen:
                x = {f: v for f, v in x.items() if f in self.w}
            self._ftrl_weights(x)
            k = self._slope(y, x, self.margin(x))
            for f, v in x.items():
                g, n = k * v, self.n.get(f, 0.0)
                sigma = (math.sqrt(n + g * g) - math.sqrt(n)) / c.ftrl_alpha
                self.z[f] = self.z.get(f, 0.0) + g - sigma * self.w.get(f, 0.0)
                self.n[f] = n + g * g
            return {}
        m = self.margin(x)
        if c.optimizer == "passive_aggressive":
            norm2 = sum(v * v for v in x.values())
            if c.model == "least_squares":
                k = math.copysign(abs(y - m), y - m) / (norm2 + 0.5 / c.aggressiveness)
            else:
                s = 2 * (y - 0.5)
                k = s * max(0.0, 1 - s * m) / (norm2 + 0.5 / c.aggressiveness)
            return {f: k * v for f, v in x.items()} if k else {}
        k = self._slope(y, x, m)
        if c.optimizer == "mira" and c.model == "mira":
            return {f: -k * v for f, v in x.items()} if k else {}
        if c.optimizer in ("adagrad", "control"):
            out = {}
            for f, v in x.items():
                g = k * v
                self.g2[f] = self.g2.get(f, 0.0) + g * g
                out[f] = -c.rate * g / math.sqrt(1.0 + self.g2[f])
            return out
        r = self.rate(self.epoch)
        return {f: -r * k * v for f, v in x.items()}

    def update(self, batch: list[tuple[float, dict[str, float]]]) -> None:
        """One step by the mean of a batch's updates, all made at the same weights."""
        if not batch:
            return
        if self.epoch > 0:
            self.tick += 1
        total: dict[str, float] = {}
        for y, x in batch:
            for f, d in self.step(y, x).items():
                total[f] = total.get(f, 0.0) + d
            self._truncate()
            self.epoch += 1
        for f, d in total.items():
            if self.c.frozen and f not in self.w:
                continue
            w = self.weight(f) + d / len(batch)
            self.last[f] = self.tick
            if abs(w) < SMALL and not self.c.frozen:
                self.w.pop(f, None)
            else:
                self.w[f] = w

    def _truncate(self) -> None:
        c = self.c
        if not c.period or self.epoch == 0 or self.epoch % c.period:
            return
        shrink = self.rate(self.epoch) * c.truncation_update
        for f, w in list(self.w.items()):
            if 0 < abs(w) < c.truncation_threshold:
                w = math.copysign(max(0.0, abs(w) - shrink), w)
                if abs(w) < SMALL:
                    del self.w[f]
                else:
                    self.w[f] = w

    def finish(self) -> dict[str, float]:
        """All weights caught up; optimizer state is dropped."""
        if self.c.optimizer == "ftrl":
            self._ftrl_weights(dict.fromkeys(self.z, 0.0))
        if self.lazy:
            for f in list(self.w):
                self.weight(f)
        self.g2, self.z, self.n, self.last = {}, {}, {}, {}
        return {f: w for f, w in self.w.items() if abs(w) >= SMALL}


def _shards(config: TrainConfig, rows: int) -> int:
    return config.shards or max(1, math.ceil(rows / config.shard_rows))


def _streams(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator]]:
    """(shard, its rows) of batches sorted by shard."""

    class Feed:
        def __init__(self):
            self.rows = (r for p in parts for r in p.itertuples(index=False))
            self.head = next(self.rows, None)

        def of(self, shard):
            while self.head is not None and self.head.shard == shard:
                row, self.head = self.head, next(self.rows, None)
                yield row

    feed = Feed()
    while feed.head is not None:
        shard = feed.head.shard
        own = feed.of(shard)
        yield shard, own
        for _ in own:
            pass


def _ordered(placed: DataFrame) -> DataFrame:
    """Rows of a shard by id; those that share an id by their contents, else splits and the network would order them."""
    first = ["shard", "kind", "id"]
    return placed.sortWithinPartitions(*first, *[k for k in placed.columns if k not in first])


def _run(placed: DataFrame, n: int, learn: Callable, schema: str) -> DataFrame:
    """``learn(shard, rows)`` yields data frames, over rows streamed in the order of (shard, id). As for ``run_shards``, ``placed`` is read under ``splits``."""
    cores = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(parts):
        for shard, rows in _streams(parts):
            yield from learn(shard, rows)

    return _ordered(placed.repartition(min(n, max(cores, n)), "shard")).mapInPandas(kernel, schema)


def run_shards(placed: DataFrame, n: int, learn: Callable, schema: str) -> DataFrame:
    """``learn(shard, slices)`` yields record batches, over (kind, rows) in the order of (kind, id); shard i is partition i of ``n``.

    With more than 200 shards a task holds all rows that it sends to them, so ``placed`` is to be read under ``splits``."""

    def kernel(batches):
        ahead = K.slices(batches)
        for shard, group in itertools.groupby(ahead, lambda x: x[0]):
            yield from learn(shard, ((kind, rows) for _, kind, rows in group))

    return _ordered(placed.repartitionById(n, F.col("shard"))).mapInArrow(kernel, schema)


def _whole_step(sums: DataFrame, model: DataFrame | None, c: TrainConfig, rows: int, epochs: dict) -> DataFrame:
    """The model after one step by the mean of all rows' changes, whose sums by (class, feature) are given; penalties are caught up before."""
    change = sums.groupBy("class", "feature").agg((F.sum("weight") / rows).alias("d"))
    ends = F.lit(rows).cast("long")
    if model is None:
        return change.select("class", "feature", F.col("d").alias("weight"), ends.alias("epoch"))
    rate = Learner(c).rate(0)
    shrunk = F.col("weight") * (1 - rate * c.gauss)
    shrunk = F.signum(shrunk) * F.greatest(F.abs(shrunk) - rate * c.laplace, F.lit(0.0))
    late = (F.col("epoch") > 0) & F.lit(c.gauss > 0 or c.laplace > 0)
    old = model.select("class", "feature", F.when(late, F.when(F.abs(shrunk) >= SMALL, shrunk).otherwise(0.0)).otherwise(F.col("weight")).alias("weight"))
    start = F.lit(0)
    for k, e in epochs.items():
        start = F.when(F.col("class") == k, e).otherwise(start)
    both = old.join(change, ["class", "feature"], "left" if c.frozen else "full_outer")
    return both.select("class", "feature", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("weight"), (ends + start).cast("long").alias("epoch"))


def train(instances: DataFrame, config: TrainConfig | None = None, model: DataFrame | None = None, classes: list[str] | None = None) -> DataFrame:
    """(class, feature, weight, epoch) learned from instances (id, label, features).

    Without ``classes``, the label is a number and class is ''; with them, a binary model is learned for each (its own
    optimizer state). ``model`` is where learning starts. Rows with a null label, null features or (with classes) another label are
    left out. While the model is small, it is broadcast; a larger one is cut up by the features that each shard has. With
    ``whole_batch`` a pass is one step by the mean over all rows, whatever the number of shards.
    """
    c = config or TrainConfig()
    rows = instances.where("label IS NOT NULL")
    if classes is None:
        if c.zero_class_prob < 1 or c.one_class_prob < 1:
            rows = rows.where(hash_unit("id", seed=c.seed) < F.when(F.col("label") < 0.5, c.zero_class_prob).otherwise(c.one_class_prob))
    else:
        rows = rows.where(F.col("label").isin(classes))
        for k, p in c.class_probs.items():
            rows = rows.where((F.col("label") != k) | (hash_unit("id", seed=c.seed) < float(p)))
    kinds = [""] if classes is None else list(classes)
    # the features are worked out once, for the count and all passes
    flat = written(rows.select(
        hash_unit("id").alias("h"), F.col("id").cast("string").alias("id"),
        (F.lit("") if classes is None else F.col("label").cast("string")).alias("class"),
        (F.col("label").cast("double") if classes is None else F.lit(None).cast("double")).alias("y"),
        F.map_keys("features").alias("names"), F.map_values("features").cast("array<double>").alias("values"),
    ), copies=1).where("names IS NOT NULL")
    count = flat.count()
    n = _shards(c, count)
    held = flat.select(F.floor(F.col("h") * n).cast("int").alias("shard"), F.lit(1).alias("kind"), "id", "class", "y", "names", "values")
    spark = instances.sparkSession
    kernel_config = replace(c, mini_batch_size=1 << 62, exponential_base=None, examples_per_epoch=1e300) if c.whole_batch else c
    needed = None
    for _ in range(c.iters):
        start, table, epochs = None, None, {}
        if model is not None:
            epochs = {r["class"]: int(r["e"] or 0) for r in model.groupBy("class").agg(F.max("epoch").alias("e")).collect()}
            if model.limit(c.broadcast_rows + 1).count() <= c.broadcast_rows:
                start: dict = {}
                for r in model.select("class", "feature", "weight").collect():
                    start.setdefault(r["class"], {})[r["feature"]] = r["weight"]
            else:
                # the same in all passes
                if needed is None:
                    with splits(spark):
                        needed = written(held.select("shard", F.explode("names").alias("feature")).distinct())
                table = needed.join(model, "feature").select(
                    "shard", F.lit(0).alias("kind"), F.lit("").alias("id"), "class", F.lit(None).cast("double").alias("y"),
                    F.array("feature").alias("names"), F.array("weight").alias("values"),
                )
        shared = spark.sparkContext.broadcast(start)

        def learn(shard, parts, shared=shared, epochs=epochs, c=kernel_config):
            vocabulary = K.Vocabulary()
            learners = {k: K.ArrayLearner(c, epochs.get(k, 0)) for k in kinds}
            for k, one in learners.items():
                own = (shared.value or {}).get(k, {})
                at = np.fromiter((vocabulary.ids.setdefault(f, len(vocabulary.ids)) for f in own), np.int64, len(own))
                one.grow(len(vocabulary.ids))
                one.load(at, np.fromiter(own.values(), np.float64, len(own)))
            for kind, rows in parts:
                (K.rows_into if kind else K.model_into)(learners, rows, vocabulary)
            names = list(vocabulary.ids)
            for k, one in learners.items():
                if c.whole_batch:
                    at = np.flatnonzero(one.touched)
                    w = one.total[at]
                else:
                    if not c.drop_partial_batch:
                        one.flush()
                    at, w = one.finish()
                yield from K.table(names, at, w, {"class": (k, pa.string()), "epoch": (one.epoch, pa.int64())})

        with splits(spark):
            parts = run_shards(held if table is None else held.unionByName(table), n, learn, "class string, feature string, weight double, epoch long")
            if c.whole_batch:
                averaged = _whole_step(parts, model, c, count, epochs)
            else:
                averaged = parts.groupBy("class", "feature").agg((F.sum("weight") / n).alias("weight"), F.round(F.avg("epoch")).cast("long").alias("epoch"))
            if table is not None and not c.whole_batch:
                # features that a shard doesn't have kept their old weight there
                old = model.select("class", "feature", F.col("weight").alias("old"), F.col("epoch").alias("e0"))
                seen = needed.groupBy("feature").agg(F.count("*").alias("seen"))
                averaged = averaged.join(old, ["class", "feature"], "full_outer").join(seen, "feature", "left").select(
                    "class", "feature", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("old", F.lit(0.0)) * (n - F.coalesce("seen", F.lit(0))) / n).alias("weight"),
                    F.coalesce("epoch", "e0").alias("epoch"),
                )
            model = written(averaged.where(f"abs(weight) >= {SMALL}"))
        shared.unpersist()
    return model.where(F.abs("weight") >= c.final_thresholding) if c.final_thresholding else model


def retrain(instances: DataFrame, model: DataFrame, config: TrainConfig | None = None, classes: list[str] | None = None) -> DataFrame:
    """Training that starts from a model."""
    return train(instances, config, model, classes)
