"""Queries of the linear models, trainers, evaluation and selection, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as TK
from ..operators import evaluate as E
from ..operators import features as FT
from ..operators import linear as L
from ..operators import select as S
from ..operators import trainers as TR
from ..sources.staging import small, written
from .registry import load, query
from .text_queries import _TOK

# instances: documents with a label, as term counts; the label is toxicity
_D = f"""d AS (SELECT d.doc_id AS id, toxic::DOUBLE AS label, t AS feature, count(*)::DOUBLE AS value FROM
  (SELECT doc_id, unnest({_TOK}) AS t FROM documents) d JOIN labels USING (doc_id) GROUP BY ALL)"""
# rows: line items as a regression of the price
_R = """d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 10000 AS label, unnest(['qty', 'disc', 'tax', 'flag' || l_returnflag]) AS feature,
  unnest([l_quantity / 50, l_discount, l_tax, 1.0]) AS value FROM lineitem)"""


def _docs(spark, sf_dir):
    tokens = F.split(X.standard_filter(F.lower("text")), " ")
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return FT.instances(rows, "doc_id", F.col("toxic").cast("double"), TK.counts(tokens))


def _long(spark, sf_dir):
    """Written once, as a step and its scores read it several times."""
    return written(FT.long_form(_docs(spark, sf_dir), "label"))


def _prices(spark, sf_dir):
    b = F.create_map(F.lit("qty"), F.col("l_quantity") / 50, F.lit("disc"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"), F.concat(F.lit("flag"), "l_returnflag"), F.lit(1.0))
    return FT.instances(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_extendedprice") / 10000, b)


def _points(spark, sf_dir):
    return FT.instances(load(spark, sf_dir, "embeddings"), "vec_id", F.col("label").cast("string"), FT.FeatureBuilder().numbers("embedding"))


def _out(model):
    return model.select("feature", F.round("weight", 6).alias("weight")).where("weight <> 0")


def _step_sql(factor: str, scale: str = "1.0", source: str = _D, wrap: str = "{g}") -> str:
    """One batch step from zero weights: ``factor`` multiplies the features in the gradient at margin 0."""
    g = wrap.format(g=f"({scale}) * sum(value * k) / any_value(n)")
    return f"""WITH {source}, i AS (SELECT id, label, sum(value * value) AS norm2 FROM d GROUP BY ALL), c AS (SELECT count(*) AS n FROM i),
k AS (SELECT id, {factor} AS k, n FROM i, c) SELECT feature, round(w, 6) AS weight FROM (SELECT feature, -({g}) AS w FROM d JOIN k USING (id) GROUP BY feature)
WHERE abs(w) >= 1e-10 AND round(w, 6) <> 0"""


def _step(name: str, sql: str, model: str, optimizer: str = "elastic_net", source=_long, **options) -> None:
    def f(spark, sf_dir):
        return _out(L.batch_step(source(spark, sf_dir), model, optimizer, **options))

    f.__name__ = name
    query(sql)(f)


_s = "(2 * (label - 0.5))"
_step("lr_batch_step", _step_sql(f"-{_s} * 0.5", "0.1"), "logistic_regression")
_step("hinge_batch_step", _step_sql(f"-{_s}", "0.1"), "perceptron")
_step("svm_batch_step", _step_sql(f"-{_s}", "0.1"), "linear_svm")
_step("mira_batch_step", _step_sql(f"-{_s} / norm2"), "mira", "mira")
_step("pa_batch_step", _step_sql(f"-{_s} / (norm2 + 0.25)"), "linear_svm", "passive_aggressive")
_step("adagrad_batch_step", _step_sql(f"-{_s} * 0.5", "1.0", wrap="0.1 * {g} / sqrt(1 + power({g}, 2))"), "logistic_regression", "adagrad")
_step(
    "ftrl_batch_step", _step_sql(f"-{_s} * 0.5", "1.0", wrap="CASE WHEN abs({g}) <= 0.001 THEN 0 ELSE ({g} - sign({g}) * 0.001) / ((1 + abs({g})) / 1 + 0.1) END"),
    "logistic_regression", "ftrl", l1=0.001, l2=0.1,
)
_step("lsq_batch_step", _step_sql("2 * (0 - label)", "0.1", source=_R), "least_squares", source=lambda s, d: FT.long_form(_prices(s, d), "label"))


_W = "w AS (SELECT feature, round(0.1 * sum(value * (label - 0.5)) / any_value(n), 12) AS weight FROM d, (SELECT count(DISTINCT id) AS n FROM d) GROUP BY feature)"


def _model(spark, sf_dir, long=None):
    m = L.batch_step(long or _long(spark, sf_dir), "logistic_regression")
    return written(m.select("feature", F.round("weight", 12).alias("weight")))


_SCORED = f"WITH {_D}, {_W}, s AS (SELECT id, label, sum(value * weight) AS m FROM d JOIN w USING (feature) GROUP BY ALL)"


@query(f"""WITH {_D}, {_W}, m AS (SELECT id, label, sum(value * weight) AS m FROM d JOIN w USING (feature) GROUP BY ALL), c AS (SELECT count(*) AS n FROM m),
g AS (SELECT feature, 0.1 * sum(value * -(2 * (label - 0.5)) / (1 + exp(2 * (label - 0.5) * m))) / any_value(n) AS g FROM d JOIN m USING (id, label), c GROUP BY feature),
o AS (SELECT feature, sign(weight * 0.998) * greatest(abs(weight * 0.998) - 0.0001, 0) AS w FROM w)
SELECT feature, round(coalesce(w, 0) - coalesce(g, 0), 6) AS weight FROM o FULL JOIN g USING (feature) WHERE round(coalesce(w, 0) - coalesce(g, 0), 6) <> 0""")
def lr_batch_step_l1l2(spark, sf_dir):
    long = _long(spark, sf_dir)
    return _out(L.batch_step(long, "logistic_regression", model=_model(spark, sf_dir, long), rate=0.1, l1=0.001, l2=0.02))


@query(f"{_SCORED} SELECT id, label, round(m, 6) AS margin, round(1 / (1 + exp(-m)), 6) AS prediction FROM s")
def score_binary(spark, sf_dir):
    long = _long(spark, sf_dir)
    s = L.score(long, _model(spark, sf_dir, long), "logistic_regression", "label")
    return s.select("id", "label", F.round("margin", 6).alias("margin"), F.round("prediction", 6).alias("prediction"))


_AUC = """p AS (SELECT round(1 / (1 + exp(-m)), 6) AS p, sum((label > 0.5)::INT) AS pos, sum((label <= 0.5)::INT) AS neg FROM s GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM p)"""


@query(f"{_SCORED}, {_AUC} SELECT round(sum(neg * (cp - pos + 0.5 * pos)) / (sum(pos) * sum(neg)), 6) AS auc FROM r")
def lr_batch_auc(spark, sf_dir):
    """Text filter, term counts, one full-batch step of logistic regression, scores and the area under their ROC curve."""
    return E.auc(E.roc_counts(score_binary(spark, sf_dir))).select(F.round("auc", 6).alias("auc"))


@query(f"{_SCORED}, {_AUC} SELECT p AS prediction, round(cp / (SELECT sum(pos) FROM p), 6) AS tpr, round(cn / (SELECT sum(neg) FROM p), 6) AS fpr FROM r")
def eval_roc_curve(spark, sf_dir):
    c = E.roc_curve(E.roc_counts(score_binary(spark, sf_dir)))
    return c.select("prediction", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""WITH {_D}, {_W}, e AS (SELECT id, feature, value, weight, row_number() OVER (PARTITION BY id ORDER BY round(abs(value * weight), 9) DESC, feature)::INT AS rank
FROM d JOIN w USING (feature) WHERE weight <> 0) SELECT id, rank, feature, value, round(weight, 6) AS weight FROM e WHERE rank <= 5""")
def explain_topk(spark, sf_dir):
    long = _long(spark, sf_dir)
    m = _model(spark, sf_dir, long)
    return L.explain(long, m, 5).select("id", "rank", "feature", "value", F.round("weight", 6).alias("weight"))


@query()
def explain_predictions(spark, sf_dir):
    long = _long(spark, sf_dir)
    return L.explain_text(L.explain(long, _model(spark, sf_dir, long), 5))


@query(f"WITH {_D}, {_W} SELECT feature, round(weight, 6) AS weight FROM w WHERE abs(weight) >= 0.001")
def model_threshold(spark, sf_dir):
    return L.threshold(_model(spark, sf_dir), 0.001).select("feature", F.round("weight", 6).alias("weight"))


@query(f"WITH {_D}, {_W} SELECT feature, round(1.5 * weight, 6) AS weight FROM w WHERE abs(1.5 * weight) >= 1e-10")
def model_merge(spark, sf_dir):
    m = _model(spark, sf_dir)
    return L.merge((m, 1.0), (m, 0.5)).select("feature", F.round("weight", 6).alias("weight"))


@query(f"WITH {_D}, {_W} SELECT feature, round(weight, 6) AS a, round(CASE WHEN abs(weight) >= 0.002 THEN 0 ELSE weight END, 6) AS b, round(-weight, 6) AS delta FROM w WHERE abs(weight) >= 0.002 AND abs(weight) > 0.0001")
def model_diff(spark, sf_dir):
    m = _model(spark, sf_dir)
    d = L.diff(m, m.where(F.abs("weight") < 0.002), 0.0001)
    return d.select("feature", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("delta", 6).alias("delta"))


@query(f"WITH {_D}, {_W} SELECT round(sqrt(sum(weight * weight)), 6) AS norm FROM w WHERE abs(weight) >= 1e-10")
def model_norm(spark, sf_dir):
    return L.model_norm(_model(spark, sf_dir)).select(F.round("norm", 6).alias("norm"))


# multiclass: centroids of the embeddings' labels serve as the model
_P = """p AS (SELECT vec_id AS id, label::VARCHAR AS label, (i - 1)::VARCHAR AS feature, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
w AS (SELECT label AS class, feature, round(avg(value), 9) AS weight FROM p GROUP BY ALL),
m AS (SELECT id, p.label, class, sum(value * weight) AS m FROM p JOIN w USING (feature) GROUP BY ALL)"""


def _centroid_model(spark, sf_dir):
    long = FT.long_form(_points(spark, sf_dir), "label")
    n = long.groupBy("label").agg(F.count_distinct("id").alias("n"))
    sums = long.groupBy("label", "feature").agg(F.sum("value").alias("s")).join(small(written(n)), "label")
    return written(sums.select(F.col("label").alias("class"), "feature", F.round(F.col("s") / F.col("n"), 9).alias("weight")))


def _scores(spark, sf_dir, kind):
    pts = _points(spark, sf_dir)
    s = L.score_multiclass(FT.long_form(pts), _centroid_model(spark, sf_dir), kind)
    return written(pts.select("id", "label").join(s, "id").withColumn("score", F.round("score", 6)))


def _scored_sql(kind: str) -> str:
    raw = {"one_vs_rest": "1 / (1 + exp(-m))", "softmax": "exp(m - max(m) OVER (PARTITION BY id))", "raw": "m"}[kind]
    return f"WITH {_P}, x AS (SELECT *, {raw} AS raw FROM m), s AS (SELECT id, label, class, round(raw / nullif(sum(raw) OVER (PARTITION BY id), 0), 6) AS score FROM x)"


@query(f"{_scored_sql('one_vs_rest')} SELECT id, label, class, score FROM s")
def score_multiclass(spark, sf_dir):
    return _scores(spark, sf_dir, "one_vs_rest")


@query(f"{_scored_sql('softmax')} SELECT id, label, class, score FROM s")
def score_softmax(spark, sf_dir):
    return _scores(spark, sf_dir, "softmax")


@query(f"{_scored_sql('one_vs_rest')} SELECT id, class AS predicted, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1")
def predict_multiclass(spark, sf_dir):
    return L.predict_class(_scores(spark, sf_dir, "one_vs_rest").drop("label"))


_PRED = "WITH s AS (SELECT event_id AS id, (event_type IN ('click', 'purchase'))::INT::DOUBLE AS label, round(1 / (1 + exp(-(value - 50) / 40)), 3) AS p FROM events)"


def _event_preds(spark, sf_dir):
    p = F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 40)), 3)
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").isin("click", "purchase").cast("double").alias("label"), p.alias("prediction"))


@query(f"{_PRED} SELECT label::INT::VARCHAR AS actual, (p > 0.5)::INT::VARCHAR AS predicted, count(*)::DOUBLE AS n FROM s GROUP BY ALL")
def eval_confusion(spark, sf_dir):
    return E.confusion(E.binary_pairs(_event_preds(spark, sf_dir)))


_BIN = f"""{_PRED}, c AS (SELECT sum(((p > 0.5) AND label = 1)::INT)::DOUBLE AS tp, sum(((p > 0.5) AND label = 0)::INT)::DOUBLE AS fp,
 sum(((p <= 0.5) AND label = 1)::INT)::DOUBLE AS fn, sum(((p <= 0.5) AND label = 0)::INT)::DOUBLE AS tn, count(*)::DOUBLE AS n, avg(power(label - p, 2)) AS brier FROM s),
q AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY p), r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp FROM q),
a AS (SELECT sum(neg * (cp - 0.5 * pos)) / (sum(pos) * sum(neg)) AS auc FROM r),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS p1, tp / nullif(tp + fn, 0) AS r1, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
  tn / nullif(tn + fn, 0) AS p0, tn / nullif(tn + fp, 0) AS r0, 2 * tn / nullif(2 * tn + fp + fn, 0) AS f0 FROM c)"""


@query(f"""{_BIN} SELECT stat, round(value, 6) AS value FROM (
SELECT unnest(['Brier', 'Acc (avg)', 'F1 (avg)', 'Prc (avg)', 'Rec (avg)', '0-class Acc', '0-class F1', '0-class Prc', '0-class Rec', '1-class Acc', '1-class F1', '1-class Prc', '1-class Rec', '1-class AUC']) AS stat,
unnest([brier, (tp + tn) / n, ((tp + fn) * coalesce(f1, 0) + (tn + fp) * coalesce(f0, 0)) / n, ((tp + fn) * coalesce(p1, 0) + (tn + fp) * coalesce(p0, 0)) / n,
((tp + fn) * coalesce(r1, 0) + (tn + fp) * coalesce(r0, 0)) / n, (tp + tn) / n, f0, p0, r0, (tp + tn) / n, f1, p1, r1, (SELECT auc FROM a)]) AS value FROM m)""")
def eval_binary_stats(spark, sf_dir):
    return E.binary_statistics(_event_preds(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"{_PRED} SELECT round(avg(power(label - p, 2)), 6) AS brier, round(avg(label * p + (1 - label) * (1 - p)), 6) AS accuracy FROM s")
def eval_brier(spark, sf_dir):
    p = _event_preds(spark, sf_dir)
    return E.brier(p).crossJoin(E.pair_accuracy(p)).select(F.round("brier", 6).alias("brier"), F.round("accuracy", 6).alias("accuracy"))


@query(f"{_PRED}, b AS (SELECT least(floor(p * 25), 24) AS bin, avg(label) AS mean FROM s GROUP BY 1) SELECT round(sum(power((bin + 0.5) / 25 - mean, 2)) / 25, 6) AS brier FROM b")
def eval_brier_binned(spark, sf_dir):
    return E.binned_brier(_event_preds(spark, sf_dir)).select(F.round("brier", 6).alias("brier"))


@query(f"""{_PRED} SELECT a::VARCHAR AS actual, b::VARCHAR AS predicted, round(sum(l * g), 6) AS n FROM
(SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b, unnest([1 - label, 1 - label, label, label]) AS l, unnest([1 - p, p, 1 - p, p]) AS g FROM s) GROUP BY ALL""")
def eval_soft_confusion(spark, sf_dir):
    y, p = F.col("label"), F.col("prediction")
    soft = _event_preds(spark, sf_dir).select(F.array(1 - y, y).alias("label"), F.array(1 - p, p).alias("guess"))
    return E.soft_confusion(soft).withColumn("n", F.round("n", 6))


_MC = f"""{_scored_sql('one_vs_rest')}, b AS (SELECT id, label AS actual, class AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, class) = 1),
c AS (SELECT class, (SELECT count(*) FROM b WHERE actual = class)::DOUBLE AS a, (SELECT count(*) FROM b WHERE predicted = class)::DOUBLE AS p,
 (SELECT count(*) FROM b WHERE predicted = class AND actual = class)::DOUBLE AS tp, (SELECT count(*) FROM b)::DOUBLE AS n FROM (SELECT DISTINCT class FROM s)),
o AS (SELECT class, score, sum((label = class)::INT) AS pos, sum((label <> class)::INT) AS neg FROM s GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC) AS cp FROM o),
u AS (SELECT class, sum(pos) / (sum(pos) + sum(neg)) AS share, sum(neg * (cp - 0.5 * pos)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM r GROUP BY class)"""


@query(f"{_MC} SELECT class, a AS actual, p AS predicted, round(a / n, 6) AS share, round((n - a - p + 2 * tp) / n, 6) AS accuracy, round(tp / nullif(p, 0), 6) AS precision, round(tp / nullif(a, 0), 6) AS recall, round(2 * tp / nullif(a + p, 0), 6) AS f1 FROM c")
def eval_multiclass_conf(spark, sf_dir):
    m = E.class_metrics(E.confusion(E.multiclass_pairs(_scores(spark, sf_dir, "one_vs_rest"))))
    return m.select("class", "actual", "predicted", *[F.round(c, 6).alias(c) for c in ("share", "accuracy", "precision", "recall", "f1")])


@query(f"{_MC} SELECT class, round(share, 6) AS share, round(auc, 6) AS auc, round((SELECT avg(power((label = u.class)::INT - score, 2)) FROM s WHERE s.class = u.class), 6) AS brier FROM u")
def eval_multiclass_auc(spark, sf_dir):
    return E.multiclass_roc(_scores(spark, sf_dir, "one_vs_rest")).select("class", *[F.round(c, 6).alias(c) for c in ("share", "auc", "brier")])


@query(f"""{_MC}, k AS (SELECT c.class, a, n, tp, a / n AS share, (n - a - p + 2 * tp) / n AS acc, tp / nullif(p, 0) AS prc, tp / nullif(a, 0) AS rec, 2 * tp / nullif(a + p, 0) AS f1, auc
  FROM c JOIN u USING (class)), bs AS (SELECT class, avg(power((label = class)::INT - score, 2)) AS brier FROM s GROUP BY class)
SELECT stat, round(value, 6) AS value FROM (
  SELECT unnest([class || ' Pct', class || ' AUC', class || ' Acc', class || ' F1', class || ' Prc', class || ' Rec']) AS stat, unnest([share, auc, acc, f1, prc, rec]) AS value FROM k
  UNION ALL SELECT unnest(['AUC', 'Acc (avg)', 'F1 (avg)', 'Prc (avg)', 'Rec (avg)']), unnest([(SELECT sum(share * coalesce(auc, 0)) FROM u), sum(tp) / any_value(n),
    sum(a * coalesce(f1, 0)) / sum(a), sum(a * coalesce(prc, 0)) / sum(a), sum(a * coalesce(rec, 0)) / sum(a)]) FROM k
  UNION ALL SELECT 'Brier', avg(brier) FROM bs)""")
def eval_multiclass_stats(spark, sf_dir):
    return E.multiclass_statistics(_scores(spark, sf_dir, "one_vs_rest")).withColumn("value", F.round("value", 6))


@query("""SELECT stat, round(value, 6) AS value FROM (SELECT unnest(['MSE', 'MAE']) AS stat,
unnest([avg(power(l_quantity * 1000 - l_extendedprice, 2)), avg(abs(l_quantity * 1000 - l_extendedprice))]) AS value FROM lineitem)""")
def eval_regression(spark, sf_dir):
    preds = load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000).alias("prediction"))
    return E.regression_statistics(preds).withColumn("value", F.round("value", 6))


@query("""WITH f AS (SELECT user_id % 5 AS fold, event_type AS stat, avg(value) AS value FROM events GROUP BY ALL)
SELECT stat, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, count(*) AS folds FROM f GROUP BY stat""")
def eval_fold_aggregate(spark, sf_dir):
    f = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("fold"), F.col("event_type").alias("stat")).agg(F.avg("value").alias("value"))
    return E.aggregate_folds(f).select("stat", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")], "folds")


@query("""SELECT param, bucket, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std, max(metric) AS best, count(*) AS n
FROM (SELECT event_type AS param, floor(value / 25)::INT::VARCHAR AS bucket, value AS metric FROM events) GROUP BY ALL""")
def trial_report(spark, sf_dir):
    t = load(spark, sf_dir, "events").select(F.col("event_type").alias("param"), F.floor(F.col("value") / 25).cast("int").cast("string").alias("bucket"), F.col("value").alias("metric"))
    return S.search_report(t).select("param", "bucket", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "best", "n")


def _trained(name: str, **options) -> None:
    def f(spark, sf_dir):
        return TR.train(_docs(spark, sf_dir), TR.TrainConfig(**options)).select("feature", "weight", "epoch")

    f.__name__ = name
    query()(f)


_trained("train_sgd_logistic", iters=2, laplace=1e-6, gauss=1e-6)
_trained("train_adagrad", optimizer="adagrad")
_trained("train_ftrl", optimizer="ftrl", laplace=0.01, gauss=0.01)
_trained("train_svm_pa", model="linear_svm", optimizer="passive_aggressive")
_trained("train_mira", model="mira")
_trained("train_perceptron_minibatch", model="perceptron", mini_batch_size=8)


@query()
def train_regression(spark, sf_dir):
    return TR.train(_prices(spark, sf_dir), TR.TrainConfig(model="least_squares", rate=0.05)).select("feature", "weight", "epoch")


@query()
def train_multiclass(spark, sf_dir):
    return TR.train(_points(spark, sf_dir), TR.TrainConfig(rate=0.1, iters=2), classes=[str(i) for i in range(10)])


@query()
def cross_validation(spark, sf_dir):
    stats, _ = S.cross_validate(_docs(spark, sf_dir), TR.TrainConfig(optimizer="adagrad"), n=3)
    return stats


@query()
def random_search(spark, sf_dir):
    space = {"rate": S.LogUniform(0.01, 1.0), "optimizer": S.Choice(["elastic_net", "adagrad"])}
    return S.random_search(_docs(spark, sf_dir), space, trials=4)[1]


@query()
def stream_score(spark, sf_dir):
    from ..streaming.online import score_stream

    rows = written(_docs(spark, sf_dir))
    return score_stream(rows, _model(spark, sf_dir, FT.long_form(rows, "label")), "logistic_regression", "label")
