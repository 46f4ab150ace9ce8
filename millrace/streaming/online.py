"""Streams: scoring, online updates of a model, and windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import sigmoid
from ..operators.trainers import TrainConfig, train
from ..sources.staging import BROADCAST_ROWS, written


def score_stream(instances: DataFrame, model: DataFrame, model_type: str = "logistic_regression", *keep: str) -> DataFrame:
    """(id, keep..., margin, prediction) of a (streaming) frame of instances. A model (feature, weight) of at most
    BROADCAST_ROWS rows is a table that each task looks rows up in, statelessly. A larger one is joined: a plain frame and
    a micro-batch (``foreachBatch``) take any; a streaming frame, whose rows can't be put together again without state, doesn't."""
    if model.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        if instances.isStreaming:
            raise ValueError("the model is too large to score a stream without state; score its micro-batches with foreachBatch")
        return _score_joined(instances, model, model_type, *keep)
    held = instances.sparkSession.sparkContext.broadcast({r["feature"]: r["weight"] for r in model.select("feature", "weight").collect()})
    rows = instances.select("id", *keep, F.map_keys("features").alias("names"), F.map_values("features").alias("values"))

    def run(parts):
        weights = held.value
        for p in parts:
            out = p[["id", *keep]].copy()
            out["margin"] = [0.0 if n is None else float(sum(weights.get(f, 0.0) * v for f, v in zip(n, vs))) for n, vs in zip(p["names"], p["values"])]
            yield out

    schema = T.StructType([*[rows.schema[c] for c in ("id", *keep)], T.StructField("margin", T.DoubleType())])
    out = rows.mapInPandas(run, schema)
    return out.withColumn("prediction", F.col("margin") if model_type == "least_squares" else sigmoid(F.col("margin")))


def _score_joined(instances: DataFrame, model: DataFrame, model_type: str, *keep: str) -> DataFrame:
    """As ``score_stream``, a row for each instance even where ids repeat: rows are numbered, and only numbers and products shuffle."""
    # written, as numbers made again by a retried task could name other rows
    held = written(instances.select("id", *keep, "features").withColumn("nth", F.monotonically_increasing_id()))
    hit = held.select("nth", F.explode("features").alias("feature", "value")).join(model.select("feature", "weight"), "feature")
    margins = hit.groupBy("nth").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))
    out = held.select("nth", "id", *keep).join(margins, "nth", "left").select("id", *keep, F.coalesce("margin", F.lit(0.0)).alias("margin"))
    return out.withColumn("prediction", F.col("margin") if model_type == "least_squares" else sigmoid(F.col("margin")))


class OnlineModel:
    """A model that micro-batches update: ``stream.writeStream.foreachBatch(OnlineModel(config)).start()``."""

    def __init__(self, config: TrainConfig | None = None, model: DataFrame | None = None, classes: list[str] | None = None, after: Callable | None = None):
        self.config, self.model, self.classes, self.after = config or TrainConfig(), model, classes, after
        self.batches = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        self.model = train(batch, self.config, self.model, self.classes)
        self.batches += 1
        if self.after:
            self.after(self.model, batch_id)


def windowed(events: DataFrame, time: str, window: str, late: str, *keys: str, slide: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) in tumbling or sliding windows; rows later than ``late`` are dropped."""
    held = events.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    by = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    sums = [F.sum(value).alias("total")] if value else []
    return held.groupBy(by.alias("w"), *keys).agg(F.count("*").alias("n"), *sums).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Counts in sessions that a pause of ``gap`` ends."""
    held = events.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    return held.groupBy(F.session_window("event_time", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
