"""Evaluation: confusion matrices, ROC, Brier scores, regression errors, fold summaries.

Predictions are rows (label, prediction), of multiclass models (id, label, class, score) with a row for each class. Ratios
with a zero denominator are null, and count as 0 in weighted averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import small, written
from .relational import running_sums, union_all


def _ratio(a, b) -> Column:
    return F.try_divide(a, b)


def hard_class(prediction: Column | str) -> Column:
    """1 if a probability is above one half, else 0."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.when(p > 0.5, 1).otherwise(0)


def binary_pairs(preds: DataFrame) -> DataFrame:
    """(actual, predicted) as strings, of rows (label, prediction)."""
    return preds.select(F.floor("label").cast("int").cast("string").alias("actual"), hard_class("prediction").cast("string").alias("predicted"))


def multiclass_pairs(preds: DataFrame) -> DataFrame:
    """(actual, predicted) of rows (id, label, class, score): the class of the largest score, of equals the first."""
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("class").alias("c")))
    return preds.groupBy("id", "label").agg(first["c"].alias("predicted")).select(F.col("label").alias("actual"), "predicted")


def confusion(pairs: DataFrame, classes: list[str] | None = None, freq: str | None = None) -> DataFrame:
    """(actual, predicted, n); with ``classes`` all cells of their grid. ``freq`` is a column of counts."""
    n = F.count("*").cast("double") if freq is None else F.sum(freq).cast("double")
    cells = pairs.groupBy("actual", "predicted").agg(n.alias("n"))
    if classes is None:
        return cells
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "actual string, predicted string")
    return F.broadcast(grid).join(cells, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))


def soft_confusion(preds: DataFrame, label: str = "label", guess: str = "guess", freq: Column | float = 1.0) -> DataFrame:
    """(actual, predicted, n): sums of outer products of soft labels and guesses (arrays of doubles, classes by index)."""
    f = freq if isinstance(freq, Column) else F.lit(float(freq))
    cells = preds.select(f.alias("f"), F.col(guess).alias("g"), F.posexplode(label).alias("actual", "l"))
    cells = cells.select("f", "l", "actual", F.posexplode("g").alias("predicted", "p"))
    return cells.groupBy(F.col("actual").cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted")).agg(F.sum(F.col("l") * F.col("p") * F.col("f")).alias("n"))


def merge_confusion(*matrices: DataFrame) -> DataFrame:
    return union_all(*matrices).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def normalize_confusion(matrix: DataFrame, by: str = "actual") -> DataFrame:
    """``n`` as parts of the row sums (by actual) or the column sums (by predicted)."""
    return matrix.withColumn("n", _ratio(F.col("n"), F.sum("n").over(Window.partitionBy(by))))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(class, actual, predicted, share, accuracy, precision, recall, f1) of each class of a matrix."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0.0))
    rows = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("actual_n"), hit.alias("tp"))
    cols = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    total = matrix.agg(F.sum("n").alias("total"))
    both = rows.join(cols, "class", "full_outer").crossJoin(F.broadcast(total)).na.fill(0.0, ["actual_n", "predicted_n", "tp"])
    a, p, tp, n = (F.col(x) for x in ("actual_n", "predicted_n", "tp", "total"))
    return both.select(
        "class", a.alias("actual"), p.alias("predicted"), _ratio(a, n).alias("share"), _ratio(n - a - p + 2 * tp, n).alias("accuracy"),
        _ratio(tp, p).alias("precision"), _ratio(tp, a).alias("recall"), _ratio(2 * tp, a + p).alias("f1"),
    )


def accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.agg(_ratio(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0.0)), F.sum("n")).alias("accuracy"))


def average_metrics(metrics: DataFrame) -> DataFrame:
    """(precision, recall, f1): averages of class metrics, weighted by how many rows each class has."""
    zero = F.lit(0.0)
    w = F.sum("actual")
    return metrics.agg(*[_ratio(F.sum(F.col("actual") * F.coalesce(c, zero)), w).alias(c) for c in ("precision", "recall", "f1")])


def format_confusion(matrix: DataFrame, digits: int = 0) -> str:
    """A matrix (as many cells as classes squared) as text."""
    cells = {(r["actual"], r["predicted"]): r["n"] or 0.0 for r in matrix.collect()}
    names = sorted({x for k in cells for x in k})
    lines = ["\t".join(["", *names])]
    return "\n".join(lines + ["\t".join([a, *[f"{cells.get((a, b), 0.0):.{digits}f}" for b in names]]) for a in names])


def pair_accuracy(preds: DataFrame) -> DataFrame:
    """Soft accuracy of rows (label, prediction): mean of y p + (1 - y)(1 - p)."""
    y, p = F.col("label"), F.col("prediction")
    return preds.agg(F.avg(y * p + (1 - y) * (1 - p)).alias("accuracy"))


def roc_counts(preds: DataFrame, *group: str) -> DataFrame:
    """(group..., prediction, pos, neg): counts at each distinct prediction; a label above one half is positive. Such
    tables merge by adding counts."""
    pos = F.sum(F.when(F.col("label") > 0.5, 1).otherwise(0))
    return preds.groupBy(*group, "prediction").agg(pos.alias("pos"), (F.count("*") - pos).alias("neg"))


def merge_roc(*counts: DataFrame) -> DataFrame:
    keys = [c for c in counts[0].columns if c not in ("pos", "neg")]
    return union_all(*counts).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def roc_curve(counts: DataFrame, *group: str) -> DataFrame:
    """(group..., prediction, tpr, fpr) after each distinct prediction, largest first; the point (0, 0) is left out. Null
    rates where a class is missing."""
    run = running_sums(counts, list(group), -F.col("prediction"), ["pos", "neg"])
    total = counts.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    run = run.join(small(written(total)), list(group)) if group else run.crossJoin(F.broadcast(total))
    return run.select(*group, "prediction", _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"), _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"))


def auc(counts: DataFrame, *group: str) -> DataFrame:
    """(group..., auc): area under the ROC curve, ties counting one half; null where a class is missing."""
    run = running_sums(counts, list(group), -F.col("prediction"), ["pos", "neg"])
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + 0.5 * F.col("pos")))
    return run.groupBy(*group).agg(_ratio(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def brier(preds: DataFrame, *group: str) -> DataFrame:
    """(group..., brier): mean square of the hard label's distance from the prediction."""
    hard = F.when(F.col("label") > 0.5, 1.0).otherwise(0.0)
    return preds.groupBy(*group).agg(F.avg((hard - F.col("prediction")) * (hard - F.col("prediction"))).alias("brier"))


def binned_brier(preds: DataFrame, bins: int = 25) -> DataFrame:
    """(brier): over bins of equal width, the square of the bin's middle less its mean label, summed over the bins with
    rows and divided by the number of bins; there are no more bins than rows."""
    n = preds.agg(F.greatest(F.least(F.count("*"), F.lit(bins)), F.lit(1)).cast("int").alias("bins"))
    hard = F.when(F.col("label") > 0.5, 1.0).otherwise(0.0)
    at = F.least(F.greatest(F.floor(F.col("prediction") * F.col("bins")), F.lit(0)), F.col("bins") - 1)
    by = preds.crossJoin(F.broadcast(n)).groupBy("bins", at.alias("bin")).agg(F.avg(hard).alias("mean"))
    gap = (F.col("bin") + 0.5) / F.col("bins") - F.col("mean")
    return by.agg(_ratio(F.sum(gap * gap), F.max("bins")).alias("brier"))


def multiclass_roc_counts(preds: DataFrame) -> DataFrame:
    """(class, prediction, pos, neg) one against the rest, of rows (id, label, class, score)."""
    ovr = preds.select("class", (F.col("label") == F.col("class")).cast("double").alias("label"), F.col("score").alias("prediction"))
    return roc_counts(ovr, "class")


def multiclass_roc(preds: DataFrame) -> DataFrame:
    """(class, share, auc, brier) one against the rest, of each class of rows (id, label, class, score)."""
    counts = multiclass_roc_counts(preds)
    share = counts.groupBy("class").agg(_ratio(F.sum("pos"), F.sum("pos") + F.sum("neg")).alias("share"))
    ovr = preds.select("class", (F.col("label") == F.col("class")).cast("double").alias("label"), F.col("score").alias("prediction"))
    return share.join(auc(counts, "class"), "class").join(brier(ovr, "class"), "class")


def multiclass_auc(per_class: DataFrame) -> DataFrame:
    """(auc, brier): AUC weighted by the classes' shares, mean Brier score."""
    return per_class.agg(F.sum(F.col("share") * F.coalesce("auc", F.lit(0.0))).alias("auc"), F.avg("brier").alias("brier"))


def _stats(one_row: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(label).alias("stat"), F.col(c).cast("double").alias("value")) for c, label in names.items()])
    return one_row.select(F.inline(pairs))


def binary_statistics(preds: DataFrame) -> DataFrame:
    """(stat, value) of rows (label, prediction): Brier, averages, both classes and the AUC."""
    metrics = class_metrics(confusion(binary_pairs(preds), ["0", "1"]))
    per = metrics.select(F.inline(F.array(*[
        F.struct(F.concat("class", F.lit(f"-class {t}")).alias("stat"), F.col(c).alias("value"))
        for c, t in (("accuracy", "Acc"), ("f1", "F1"), ("precision", "Prc"), ("recall", "Rec"))
    ])))
    return union_all(
        _stats(brier(preds), {"brier": "Brier"}),
        _stats(accuracy(confusion(binary_pairs(preds))), {"accuracy": "Acc (avg)"}),
        _stats(average_metrics(metrics), {"f1": "F1 (avg)", "precision": "Prc (avg)", "recall": "Rec (avg)"}),
        per, _stats(auc(roc_counts(preds)), {"auc": "1-class AUC"}),
    )


def multiclass_statistics(preds: DataFrame) -> DataFrame:
    """(stat, value) of rows (id, label, class, score)."""
    matrix = confusion(multiclass_pairs(preds))
    metrics = class_metrics(matrix)
    roc = multiclass_roc(preds)
    per = metrics.join(roc.select("class", "auc"), "class", "left").select(F.inline(F.array(*[
        F.struct(F.concat("class", F.lit(f" {t}")).alias("stat"), F.col(c).alias("value"))
        for c, t in (("share", "Pct"), ("auc", "AUC"), ("accuracy", "Acc"), ("f1", "F1"), ("precision", "Prc"), ("recall", "Rec"))
    ])))
    return union_all(
        _stats(multiclass_auc(roc), {"auc": "AUC", "brier": "Brier"}), _stats(accuracy(matrix), {"accuracy": "Acc (avg)"}),
        _stats(average_metrics(metrics), {"f1": "F1 (avg)", "precision": "Prc (avg)", "recall": "Rec (avg)"}), per,
    )


def regression_statistics(preds: DataFrame) -> DataFrame:
    """(stat, value): MSE and MAE, 0 without rows."""
    e = F.col("prediction") - F.col("label")
    one = preds.agg(F.coalesce(F.avg(e * e), F.lit(0.0)).alias("mse"), F.coalesce(F.avg(F.abs(e)), F.lit(0.0)).alias("mae"))
    return _stats(one, {"mse": "MSE", "mae": "MAE"})


STATISTICS = {"binary": binary_statistics, "multiclass": multiclass_statistics, "regression": regression_statistics}


def aggregate_folds(stats: DataFrame) -> DataFrame:
    """(stat, mean, std, median, folds) of rows (fold, stat, value); the deviation of one fold is 0."""
    return stats.groupBy("stat").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.median("value").alias("median"), F.count("*").alias("folds")
    )


def format_statistics(aggregated: DataFrame) -> str:
    rows = aggregated.orderBy("stat").collect()
    f = lambda x: "-" if x is None else f"{x:.4f}"
    return "\n".join(["stat\tmean\tstd\tmedian"] + [f"{r['stat']}\t{f(r['mean'])}\t{f(r['std'])}\t{f(r['median'])}" for r in rows])


class Evaluation:
    """A running evaluation of one kind: predictions are added, evaluations of other parts merged, and statistics are of all."""

    def __init__(self, kind: str = "binary", predictions: DataFrame | None = None):
        if kind not in STATISTICS:
            raise ValueError(kind)
        self.kind, self.predictions = kind, predictions

    def add(self, predictions: DataFrame) -> "Evaluation":
        return Evaluation(self.kind, predictions if self.predictions is None else self.predictions.unionByName(predictions))

    def merge(self, other: "Evaluation") -> "Evaluation":
        if other.kind != self.kind:
            raise ValueError(f"{other.kind} isn't {self.kind}")
        return self if other.predictions is None else self.add(other.predictions)

    def statistics(self) -> DataFrame:
        if self.predictions is None:
            raise ValueError("nothing was added")
        return STATISTICS[self.kind](self.predictions)
