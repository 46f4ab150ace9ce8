"""Linear models as tables (class, feature, weight): losses, full-batch steps, scores, explanations, model algebra.

Everything here is joins and aggregates; the sequential learners are in ``trainers``. Instances come in long form
(id, label, feature, value), which ``features.long_form`` makes. The model algebra (merge, rescale, threshold, set, freeze)
works on centers of clusters (cluster, feature, weight), too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import sigmoid
from ..sources.staging import small

MODELS = ("logistic_regression", "perceptron", "linear_svm", "mira", "least_squares")


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _sign(label: Column) -> Column:
    return 2 * (label - 0.5)


def loss(model: str, margin: Column | str, label: Column | str) -> Column:
    m, y = _c(margin), _c(label)
    z = _sign(y) * m
    if model == "logistic_regression":
        return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    if model == "perceptron":
        return F.greatest(F.lit(0.0), -z)
    if model in ("linear_svm", "mira"):
        return F.greatest(F.lit(0.0), 1 - z)
    if model == "least_squares":
        return 0.5 * (m - y) * (m - y)
    raise ValueError(model)


def slope(model: str, margin: Column | str, label: Column | str, squared_norm: Column | float | None = None) -> Column:
    """What the features are multiplied with to give the gradient; of mira, the negative of its update."""
    m, y = _c(margin), _c(label)
    s = _sign(y)
    if model == "logistic_regression":
        return -s * sigmoid(-s * m)
    if model in ("perceptron", "linear_svm"):
        return F.when(s * m <= (1.0 if model == "linear_svm" else 0.0), -s).otherwise(0.0)
    if model == "mira":
        return -s * F.coalesce(F.try_divide(loss(model, m, y), _c(squared_norm)), F.lit(0.0))
    if model == "least_squares":
        return 2 * (m - y)
    raise ValueError(model)


def response(model: str, margin: Column | str) -> Column:
    """The prediction that a margin stands for."""
    return _c(margin) if model == "least_squares" else sigmoid(_c(margin))


def margins(long: DataFrame, model: DataFrame | None, *keep: str) -> DataFrame:
    """(id, keep..., margin, norm2) of long-form rows under a model (feature, weight), 0 where it lacks a feature. A
    small model is broadcast, so that rows are shuffled once, by id, after partial sums."""
    rows = long.withColumn("weight", F.lit(0.0)) if model is None else long.join(small(model.select("feature", "weight")), "feature", "left")
    return rows.groupBy("id", *keep).agg(
        F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("margin"), F.sum(F.col("value") * F.col("value")).alias("norm2")
    )


def passive_aggressive_rate(margin: Column, label: Column, norm2: Column, c: float = 2.0, hinge: bool = True) -> Column:
    """Factor of the features in a passive-aggressive update (II), signed."""
    if hinge:
        return _sign(label) * F.greatest(F.lit(0.0), 1 - _sign(label) * margin) / (norm2 + 0.5 / c)
    return F.signum(label - margin) * F.abs(label - margin) / (norm2 + 0.5 / c)


def batch_step(
    long: DataFrame, model_type: str = "logistic_regression", optimizer: str = "elastic_net", model: DataFrame | None = None,
    rate: float = 0.1, aggressiveness: float = 2.0, l1: float = 0.0, l2: float = 0.0, alpha: float = 1.0, beta: float = 1.0,
    sums: DataFrame | None = None,
) -> DataFrame:
    """One step over all instances as one batch: (feature, weight); a step of pure joins and sums.

    The step adds the mean of all instances' updates. ``sums`` is the state (feature, g2) of adagrad, which starts at 1;
    ftrl is the proximal step from z and n of this batch's mean gradient. Elastic-net penalties (l1, l2) are applied to the
    weights before the step.
    """
    if model is None and optimizer != "passive_aggressive" and model_type != "mira":
        # at zero weights only the label counts: nothing is joined
        per = long.groupBy("id").agg(F.lit(0.0).alias("margin"))
        rows = long.withColumn("factor", slope(model_type, F.lit(0.0), F.col("label").cast("double")))
        step = 1.0 if optimizer == "mira" else rate
    else:
        rows, per = None, margins(long, model, "label").withColumn("label", F.col("label").cast("double"))
    if rows is None and optimizer == "passive_aggressive":
        factor = -passive_aggressive_rate(F.col("margin"), F.col("label"), F.col("norm2"), aggressiveness, model_type != "least_squares")
        step = 1.0
    elif rows is None:
        factor = slope(model_type, "margin", "label", F.col("norm2"))
        step = 1.0 if model_type == "mira" or optimizer == "mira" else rate
    total = per.groupBy().agg(F.count("*").cast("double").alias("n"))
    if rows is None:
        rows = long.drop("label").join(per.select("id", factor.alias("factor")), "id")
    grad = rows.groupBy("feature").agg(F.sum(F.col("value") * F.col("factor")).alias("g"))
    grad = grad.crossJoin(F.broadcast(total)).select("feature", (F.col("g") / F.col("n")).alias("g"))
    if optimizer == "adagrad":
        base = grad if sums is None else grad.join(sums, "feature", "left")
        before = F.lit(1.0) if sums is None else F.coalesce("g2", F.lit(1.0))
        grad = base.select("feature", (rate * F.col("g") / F.sqrt(before + F.col("g") * F.col("g"))).alias("d"))
    elif optimizer == "ftrl":
        z, n = F.col("g"), F.abs(F.col("g"))
        w = F.when(F.abs(z) <= l1, 0.0).otherwise(-(z - F.signum(z) * l1) / ((beta + n) / alpha + l2))
        return grad.select("feature", w.alias("weight")).where("abs(weight) >= 1e-10")
    else:
        grad = grad.select("feature", (step * F.col("g")).alias("d"))
    if model is None:
        out = grad.select("feature", (-F.col("d")).alias("weight"))
    else:
        shrunk = F.col("weight") - rate * l2 * F.col("weight")
        shrunk = F.signum(shrunk) * F.greatest(F.abs(shrunk) - rate * l1, F.lit(0.0))
        old = model.select("feature", shrunk.alias("weight"))
        out = old.join(grad, "feature", "full_outer").select("feature", (F.coalesce("weight", F.lit(0.0)) - F.coalesce("d", F.lit(0.0))).alias("weight"))
    return out.where("abs(weight) >= 1e-10")


def score(long: DataFrame, model: DataFrame, model_type: str = "logistic_regression", *keep: str) -> DataFrame:
    """(id, keep..., margin, prediction)."""
    m = margins(long, model, *keep)
    return m.select("id", *keep, "margin", response(model_type, "margin").alias("prediction"))


def score_multiclass(long: DataFrame, model: DataFrame, kind: str = "one_vs_rest", model_type: str = "logistic_regression") -> DataFrame:
    """(id, class, score) for each class of the model (class, feature, weight), scores of an id summing to 1.

    ``one_vs_rest``: responses, normalised; ``softmax`` of the margins; ``raw``: margins, normalised by their sum.
    """
    classes = small(model.select("class").distinct())
    hit = long.join(small(model), "feature").groupBy("id", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("m"))
    grid = long.select("id").distinct().crossJoin(classes).join(hit, ["id", "class"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    by = Window.partitionBy("id")
    if kind == "softmax":
        raw = F.exp(F.col("m") - F.max("m").over(by))
    elif kind == "raw":
        raw = F.col("m")
    else:
        raw = response(model_type, "m")
    out = grid.withColumn("raw", raw)
    return out.select("id", "class", F.try_divide("raw", F.sum("raw").over(by)).alias("score"))


def predict_class(scores: DataFrame) -> DataFrame:
    """(id, predicted, score): the class with the largest score, of equals the first by name."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), "class")
    return scores.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", F.col("class").alias("predicted"), "score")


def predict_sorted(long: DataFrame, model: DataFrame, model_type: str = "logistic_regression", skip_final_sort: bool = False, *keep: str) -> DataFrame:
    """(id, keep..., prediction), largest first unless ``skip_final_sort``."""
    out = score(long, model, model_type, *keep).drop("margin")
    return out if skip_final_sort else out.orderBy(F.desc("prediction"), "id")


def explain(long: DataFrame, model: DataFrame, n: int = 10, by: str = "contribution") -> DataFrame:
    """(id, rank, feature, value, weight, text): of each id the ``n`` features that count most, by |value * weight| or,
    with ``by="weight"``, by |weight|."""
    size = F.abs(F.col("value") * F.col("weight")) if by == "contribution" else F.abs("weight")
    rows = long.select("id", "feature", "value").join(small(model.select("feature", "weight")), "feature").where("weight <> 0")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(size), "feature"))
    text = F.format_string("%s:%.2f->%.2f", "feature", "value", "weight") if by == "contribution" else F.format_string("%s(%.2f)", "feature", "weight")
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("id", "rank", "feature", "value", "weight", text.alias("text"))


def explain_text(explained: DataFrame) -> DataFrame:
    """(id, text): the parts of an explanation in one line."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return explained.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def _keys(model: DataFrame) -> list[str]:
    return [c for c in ("class", "cluster") if c in model.columns] + ["feature"]


def merge(*models: tuple[DataFrame, float]) -> DataFrame:
    """Sum of models, each scaled by its factor; ``epoch`` adds up if all have it."""
    keys = _keys(models[0][0])
    epochs = all("epoch" in m.columns for m, _ in models)
    parts = [m.select(*keys, (F.col("weight") * f).alias("weight"), *(["epoch"] if epochs else [])) for m, f in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("weight").alias("weight"), *([F.sum("epoch").alias("epoch")] if epochs else [])).where("abs(weight) >= 1e-10")


def rescale(model: DataFrame, factor: float) -> DataFrame:
    return model.withColumn("weight", F.col("weight") * factor)


def threshold(model: DataFrame, least: float) -> DataFrame:
    """Without the parameters of magnitude below ``least``."""
    return model.where(F.abs("weight") >= least)


def set_parameters(model: DataFrame, values: DataFrame) -> DataFrame:
    """Parameters replaced by those of ``values`` (same columns)."""
    keys = _keys(model)
    return model.join(values.select(*keys), keys, "left_anti").unionByName(values.select(*model.columns))


def freeze(update: DataFrame, model: DataFrame) -> DataFrame:
    """Of a later state of a model only what the keys of ``model`` allow."""
    return update.join(model.select(*_keys(model)), _keys(model), "left_semi")


def parameters(model: DataFrame) -> DataFrame:
    """Parameters, the largest magnitudes first."""
    return model.orderBy(F.desc(F.abs("weight")), *_keys(model))


def model_norm(model: DataFrame) -> DataFrame:
    """(norm): by which models are compared."""
    return model.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def diff(a: DataFrame, b: DataFrame, least: float = 0.01) -> DataFrame:
    """(feature, a, b, delta) of the parameters that differ by more than ``least``, the largest first."""
    keys = _keys(a)
    zero = F.lit(0.0)
    both = a.select(*keys, F.col("weight").alias("a")).join(b.select(*keys, F.col("weight").alias("b")), keys, "full_outer")
    both = both.select(*keys, F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    return both.withColumn("delta", F.col("b") - F.col("a")).where(F.abs("delta") > least).orderBy(F.desc(F.abs("delta")), *keys)
