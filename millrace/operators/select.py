"""Model selection: cross-validation and random search of settings."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import BROADCAST_ROWS, small, splits, written
from . import evaluate, linear
from . import kernels as K
from .features import long_form
from .relational import folds, split, union_all
from .trainers import TrainConfig, _shards, run_shards, train


def predictions(instances: DataFrame, model: DataFrame, config: TrainConfig, classes: list[str] | None = None) -> DataFrame:
    """(id, label, prediction), with ``classes`` (id, label, class, score); instances without a feature have margin 0."""
    long = long_form(instances)
    if classes is None:
        got = linear.score(long, model, config.model)
        out = instances.select("id", F.col("label").cast("double").alias("label")).join(got, "id", "left")
        return out.select("id", "label", F.coalesce("prediction", linear.response(config.model, F.lit(0.0))).alias("prediction"))
    scores = linear.score_multiclass(long, model)
    return instances.select("id", "label").join(scores, "id")


def cross_validate(
    instances: DataFrame, config: TrainConfig | None = None, n: int = 5, salt: int = 0, classes: list[str] | None = None, kind: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(statistics over folds, predictions with ``fold``): each fold is predicted by a model of the others. ``kind`` is
    binary, multiclass or regression."""
    c = config or TrainConfig()
    kind = kind or ("multiclass" if classes else "regression" if c.model == "least_squares" else "binary")
    held = written(instances.where("label IS NOT NULL").withColumn("fold", folds("id", n, salt)))
    preds, stats = [], []
    for k in range(n):
        model = train(held.where(F.col("fold") != k), c, classes=classes)
        got = written(predictions(held.where(F.col("fold") == k), model, c, classes))
        preds.append(got.withColumn("fold", F.lit(k)))
        stats.append(evaluate.STATISTICS[kind](got).withColumn("fold", F.lit(k)))
    return evaluate.aggregate_folds(written(union_all(*stats))), union_all(*preds)


@dataclass
class Choice:
    """One of a list."""

    values: list

    def sample(self, rng: random.Random):
        return rng.choice(self.values)

    def bucket(self, value):
        return str(value)


@dataclass
class Uniform:
    low: float
    high: float
    buckets: int = 10

    def sample(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)

    def bucket(self, value: float) -> str:
        return str(min(self.buckets - 1, int((value - self.low) / (self.high - self.low) * self.buckets)))


@dataclass
class LogUniform:
    low: float
    high: float
    buckets: int = 10

    def sample(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))

    def bucket(self, value: float) -> str:
        part = (math.log(value) - math.log(self.low)) / (math.log(self.high) - math.log(self.low))
        return str(min(self.buckets - 1, int(part * self.buckets)))


def trial_settings(space: dict, trials: int = 10, seed: int = 0) -> list[dict]:
    rng = random.Random(seed)
    return [{k: s.sample(rng) for k, s in space.items()} for _ in range(trials)]


def random_search(
    instances: DataFrame, space: dict, trials: int = 10, base: TrainConfig | None = None, classes: list[str] | None = None,
    metric: str | None = None, seed: int = 0, kind: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trial, param, setting, bucket, metric) of all trials, and the report by bucket.

    All trials learn in one job: instances go once to each trial and shard, whose kernel learns with the trial's settings.
    The metric is 'Acc (avg)', or of regressions the negative MSE; larger is better.
    """
    base = base or TrainConfig()
    kind = kind or ("multiclass" if classes else "regression" if base.model == "least_squares" else "binary")
    settings = trial_settings(space, trials, seed)
    configs = [replace(base, **s) for s in settings]
    # what is missing is told after the features are written, else they are worked out once more for it
    fit, test = split(written(instances.where("label IS NOT NULL"), copies=trials).where("features IS NOT NULL"))
    kinds = [""] if classes is None else list(classes)
    fit = fit if classes is None else fit.where(F.col("label").isin(classes))
    n = _shards(base, fit.count())
    models = []
    model = None
    for i in range(max(c.iters for c in configs)):
        live = [t for t, c in enumerate(configs) if c.iters > i]
        start: dict = {}
        if model is not None:
            if model.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
                models = None  # too large for the driver: each trial is trained by itself
                break
            for r in model.collect():
                start.setdefault((r["trial"], r["class"]), ({}, r["epoch"]))[0][r["feature"]] = r["weight"]
        shared = instances.sparkSession.sparkContext.broadcast((configs, start))
        placed = fit.select(
            F.posexplode(F.array(*[F.lit(t) for t in live])).alias("nth", "trial"), folds("id", n).alias("part"),
            F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"), (F.lit("") if classes is None else F.col("label")).cast("string").alias("class"),
            (F.col("label").cast("double") if classes is None else F.lit(None).cast("double")).alias("y"),
            F.map_keys("features").alias("names"), F.map_values("features").cast("array<double>").alias("values"),
        ).withColumn("shard", F.col("nth") * n + F.col("part"))

        def learn(shard, parts, shared=shared, live=live):
            configs, start = shared.value
            t = live[shard // n]
            vocabulary = K.Vocabulary()
            learners = {}
            for k in kinds:
                held, epoch = start.get((t, k), ({}, 0))
                at = np.fromiter((vocabulary.ids.setdefault(f, len(vocabulary.ids)) for f in held), np.int64, len(held))
                learners[k] = K.ArrayLearner(configs[t], epoch)
                learners[k].grow(len(vocabulary.ids))
                learners[k].load(at, np.fromiter(held.values(), np.float64, len(held)))
            for _, rows in parts:
                K.rows_into(learners, rows, vocabulary)
            names = list(vocabulary.ids)
            for k, one in learners.items():
                one.flush()
                yield from K.table(names, *one.finish(), {"trial": (t, pa.int32()), "class": (k, pa.string()), "epoch": (one.epoch, pa.int64())})

        with splits(instances.sparkSession, len(live)):
            parts = run_shards(placed, n * len(live), learn, "trial int, class string, feature string, weight double, epoch long")
            model = written(parts.groupBy("trial", "class", "feature").agg((F.sum("weight") / n).alias("weight"), F.round(F.avg("epoch")).cast("long").alias("epoch")))
        models.append((live, model))
    name = metric or ("MSE" if kind == "regression" else "Acc (avg)")
    sign = -1.0 if name in ("MSE", "MAE", "Brier") else 1.0
    if models is None:
        final = [train(fit, c, classes=classes).withColumn("trial", F.lit(t)) for t, c in enumerate(configs)]
    else:
        final = [m.where(F.col("trial").isin([t for t in live if configs[t].iters == i + 1])) for i, (live, m) in enumerate(models)]
    if name in ("Acc (avg)", "MSE", "MAE"):
        values = _trial_metrics(test, union_all(*final), configs, name, classes)
    else:
        values = {}
        for t, c in enumerate(configs):
            own = union_all(*final).where(F.col("trial") == t).drop("trial")
            found = evaluate.STATISTICS[kind](predictions(test, own, c, classes)).where(F.col("stat") == name).first()
            values[t] = None if found is None else found["value"]
    rows = []
    for t in range(len(configs)):
        value = None if values.get(t) is None else sign * values[t]
        rows += [(t, k, str(v), space[k].bucket(v), value) for k, v in settings[t].items()]
    out = instances.sparkSession.createDataFrame(rows, "trial int, param string, setting string, bucket string, metric double")
    return out, search_report(out)


def _trial_metrics(test: DataFrame, models: DataFrame, configs: list[TrainConfig], name: str, classes: list[str] | None) -> dict[int, float]:
    """Metric of each trial, all trials in one job."""
    keys = test.sparkSession.createDataFrame([(t, k) for t in range(len(configs)) for k in (classes or [""])], "trial int, class string")
    hit = long_form(test).join(small(models), "feature").groupBy("id", "trial", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))
    grid = test.select("id", "label").crossJoin(F.broadcast(keys)).join(hit, ["id", "trial", "class"], "left").withColumn("margin", F.coalesce("margin", F.lit(0.0)))
    if classes is not None:
        best = grid.groupBy("id", "trial", "label").agg(F.min(F.struct((-F.col("margin")).alias("m"), "class"))["class"].alias("predicted"))
        got = best.groupBy("trial").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("v"))
    else:
        plain = [t for t, c in enumerate(configs) if c.model == "least_squares"]
        p = F.when(F.col("trial").isin(plain), F.col("margin")).otherwise(linear.response("logistic_regression", "margin"))
        y = F.col("label").cast("double")
        value = {"MSE": (p - y) * (p - y), "MAE": F.abs(p - y)}.get(name, (evaluate.hard_class(p) == F.floor(y)).cast("double"))
        got = grid.groupBy("trial").agg(F.avg(value).alias("v"))
    return {r["trial"]: r["v"] for r in got.collect()}


def search_report(trials: DataFrame) -> DataFrame:
    """(param, bucket, mean, std, best, n) of trials: population deviation, largest metric."""
    return trials.groupBy("param", "bucket").agg(
        F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("std"), F.max("metric").alias("best"), F.count("*").alias("n")
    )


def format_trials(trials: DataFrame) -> list[str]:
    """Lines ``metric<tab>settings``, the best first; there are as many as trials."""
    by: dict = {}
    for r in trials.collect():
        by.setdefault((r["trial"], r["metric"]), []).append(f"{r['param']}={r['setting']}")
    order = sorted(by.items(), key=lambda x: (-(x[0][1] if x[0][1] is not None else -math.inf), x[0][0]))
    return [f"{m}\t{' '.join(sorted(s))}" for (_, m), s in order]

