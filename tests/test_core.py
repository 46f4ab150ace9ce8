"""Golden values, properties and brute force of the engine's own operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import maths as M
from millrace.functions import sqlfuncs
from millrace.functions import text as X
from millrace.functions import tokens as TK
from millrace.functions import vectors as V
from millrace.operators import cluster, evaluate, factor, features, knn, linear, relational, select, topics
from millrace.operators.trainers import Learner, TrainConfig, retrain, train
from millrace.sources import readers
from millrace.streaming.online import OnlineModel, score_stream, sessions, windowed

POSITIVE, NEGATIVE = {"foo": 1.0, "bar": 2.0}, {"foo": 1.0, "baz": -1.0}


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        c = F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast("map<string,double>") if isinstance(v, dict) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
        df = df.withColumn(k, c)
    return df.select(column.alias("out")).first()["out"]


def test_vector_goldens(spark):
    v = {"foo": 1.0, "bar": -2.0}
    assert one(spark, V.dot("v", "v"), v=v) == 5
    big = {"foo": 1.0, "bar": -2.0, "baz": -10.0}
    assert one(spark, V.dot("v", "u"), v=v, u=big) == 5 and one(spark, V.dot("u", "u"), u=big) == 105
    assert one(spark, V.add_scaled("v", "v", 1.0), v=v) == {"foo": 2.0, "bar": -4.0}
    assert one(spark, V.subtract("v", "v"), v=v) == {}
    assert one(spark, V.size(V.add_to_coordinate("v", "new", 3.0, frozen=True)), v=v) == 2 and one(spark, V.size(V.add_to_coordinate("v", "new", 3.0)), v=v) == 3
    assert one(spark, V.set_coordinate("v", "bar", 0.0), v=v) == {"foo": 1.0}
    assert one(spark, V.multiply_pointwise("v", "u"), v=v, u=big) == {"foo": 1.0, "bar": 4.0, "baz": 0.0}
    assert one(spark, V.project("u", "v"), v=v, u=big) == v
    assert one(spark, V.norm("v", 1), v=v) == 3 and one(spark, V.maximum("v"), v={"a": -1.0}) == 0
    assert one(spark, V.keys_by_value("v"), v=big) == ["foo", "bar", "baz"]
    assert one(spark, V.inner_product("v", "t"), v=v, t=["foo", "foo", "no", "bar"]) == 0
    assert one(spark, V.values("v"), v={"a": 1.0, "b": 1.0}) == [1.0, 1.0]
    decayed = one(spark, V.decay("v", "t", 2, lambda x, a, b: x * F.pow(F.lit(0.9), b - a)), v=v, t={"foo": 0.0, "bar": 1.0})
    assert abs(decayed["foo"] - 0.81) < 1e-12 and abs(decayed["bar"] + 1.8) < 1e-12
    p = one(spark, V.l1_project("v", 1.0), v={"a": 3.0, "b": -2.5, "c": 0.1})
    assert abs(sum(map(abs, p.values())) - 1) < 1e-12 and set(p) == {"a", "b"} and one(spark, V.l1_project("v", 9.0), v=v) == v
    assert one(spark, V.dot("v", F.lit(None).cast("map<string,double>")), v=v) is None


def test_text_and_tokens(spark):
    assert one(spark, X.standard_filter("s"), s="<b>Hi</b> 12 34 &amp; a---b __ c!") == "Hi _num_ a--b __ c"
    assert one(spark, X.shingles(F.col("s"), 2, 3), s="abcd") == ["ab", "bc", "cd", "abc", "bcd"] and one(spark, X.shingles(F.col("s"), 3), s="a") == ["a"]
    assert one(spark, X.tokens("s"), s=" a  b  ") == ["", "a", "", "b"]
    assert one(spark, X.clean_line_robust("s", "|", True), s="foo--bar, -x a1 ok- the/end") == "foo-bar|ok|the|end"
    assert one(spark, X.clean_text("s", 4), s="one three22 fo-ur a") == "one fo ur "
    assert one(spark, X.sort_terms("s"), s="b  a c") == "a b c"
    t = ["a", "b", "c"]
    assert one(spark, TK.ngrams("t", 2), t=t) == ["a b", "b c"] and one(spark, TK.ngrams("t", 5), t=t) == ["a b c"]
    assert one(spark, TK.grams("t", [1, 2], "-"), t=t) == ["a", "b", "a-b", "c", "b-c"]
    assert one(spark, TK.ngrams_up_to("s", 2, "p:"), s="First last") == ["p:first", "p:last", "p:::first", "p:first::last", "p:last::"]
    assert one(spark, TK.intersect("t", "u"), t=["a", "a", "b", "a"], u=["a", "c", "a"]) == ["a", "a"]
    assert one(spark, TK.counts("t", 2.0), t=["b", "a", "b"]) == {"a": 2.0, "b": 4.0}
    assert one(spark, TK.counts(F.array().cast("array<string>"))) == {}
    assert one(spark, TK.without_blank("t"), t=["", "x"]) == ["x"] and one(spark, TK.unigrams_and_bigrams("t"), t=t) == [*t, "a b", "b c"]
    with pytest.raises(Exception, match="blank"):
        one(spark, X.check_not_blank("s"), s="  ")


def test_maths(spark):
    euler = 0.57721566490153286
    assert abs(one(spark, M.digamma("x"), x=1.0) + euler) < 1e-8 and abs(topics.digamma(np.array([1.0]))[0] + euler) < 1e-8
    assert abs(one(spark, M.log_sum_exp("x", 1.0), x=2.0) - math.log(math.e**2 + math.e)) < 1e-12
    assert one(spark, M.sigmoid("x"), x=-1000.0) == 0
    names = sqlfuncs.register(spark)
    assert len(names) == len(sqlfuncs.FUNCTIONS)
    assert spark.sql("SELECT vec_dot(map('a', 2D), map('a', 3D, 'b', 1D)) AS x").first()["x"] == 6


def test_updates_goldens():
    eta = 0.01

    def learner(**o):
        return Learner(TrainConfig(rate=eta, **o))

    m = learner()
    m.update([(1.0, POSITIVE)])
    assert abs(m.w["foo"] - 0.5 * eta) < 1e-12 and abs(m.w["bar"] - eta) < 1e-12
    m.update([(0.0, NEGATIVE)])
    assert m.predict(POSITIVE) > 0.5 > m.predict(NEGATIVE)
    m = learner(laplace=0.1)
    m.update([(1.0, POSITIVE)])
    m.update([(0.0, NEGATIVE)])
    assert abs(m.weight("bar") - (eta - eta * 0.1)) < 1e-9
    for _ in range(10):
        m.update([(0.0, NEGATIVE)])
    assert set(m.finish()) == {"foo", "baz"}
    m = learner(gauss=0.2)
    m.update([(1.0, POSITIVE)])
    m.update([(0.0, NEGATIVE)])
    assert abs(m.weight("bar") - eta * (1 - eta * 0.2)) < 1e-9
    m = learner(model="perceptron")
    m.update([(1.0, POSITIVE)])
    assert m.w == {"foo": eta, "bar": 2 * eta}
    assert POSITIVE == {"foo": 1.0, "bar": 2.0}
    for o in ({"optimizer": "adagrad"}, {"optimizer": "ftrl"}, {"model": "mira"}, {"model": "linear_svm", "optimizer": "passive_aggressive"}, {"optimizer": "control"}):
        m = learner(**o)
        for _ in range(20):
            m.update([(1.0, POSITIVE)])
            m.update([(0.0, NEGATIVE)])
        m.w = m.finish()
        m.lazy = False
        assert m.predict(POSITIVE) > 0.5 > m.predict(NEGATIVE), o
    for bad in ({"rate": 0}, {"exponential_base": 2}, {"laplace": -1}, {"model": "no"}):
        with pytest.raises(ValueError):
            TrainConfig(**bad)
    assert TrainConfig.parse({"rate": "0.5", "iters": "3", "frozen": "true"}) == TrainConfig(rate=0.5, iters=3, frozen=True)


LABELS = [1, 0, 1, 0, 0, 0, 1, 1, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0]
SCORES = [0.80962, 0.48458, 0.65812, 0.16117, 0.47375, 0.26587, 0.71517, 0.63866, 0.36296, 0.89639, 0.35936, 0.22413, 0.36402, 0.41459, 0.83148, 0.23271, 0.23271, 0.23271]


def test_auc_golden_and_merge(spark):
    preds = spark.createDataFrame(list(zip(map(float, LABELS), SCORES)), "label double, prediction double")
    assert abs(evaluate.auc(evaluate.roc_counts(preds)).first()["auc"] - 0.97402597402597402) < 1e-7
    parts = preds.where("label = 1"), preds.where("label = 0")
    merged = evaluate.merge_roc(*map(evaluate.roc_counts, parts))
    assert abs(evaluate.auc(merged).first()["auc"] - 0.97402597402597402) < 1e-7
    assert evaluate.auc(evaluate.roc_counts(preds.where("label = 1"))).first()["auc"] is None
    stats = {r["stat"]: r["value"] for r in evaluate.binary_statistics(preds).collect()}
    assert abs(stats["Acc (avg)"] - 17 / 18) < 1e-9 and abs(stats["1-class Rec"] - 6 / 7) < 1e-9


def _toy(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((i, float(y), {("up" if y else "down"): 1.0, f"noise{rng.randint(0, 20)}": 1.0}))
    return spark.createDataFrame(rows, "id long, label double, features map<string,double>")


def test_training_is_independent_of_partitions(spark):
    rows = _toy(spark)
    c = TrainConfig(iters=2, shards=3)
    a = {(r["class"], r["feature"]): r["weight"] for r in train(rows, c).collect()}
    b = {(r["class"], r["feature"]): r["weight"] for r in train(rows.repartition(7), c).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a) and a["", "up"] > 0.1 > -0.1 > a["", "down"]
    warm = retrain(rows, train(rows, c), c)
    assert warm.where("feature = 'up'").first()["weight"] > a["", "up"]


def test_selection_and_scores(spark):
    rows = _toy(spark)
    stats, preds = select.cross_validate(rows, TrainConfig(), n=3)
    got = {r["stat"]: r for r in stats.collect()}
    assert got["1-class AUC"]["mean"] > 0.99 and got["1-class AUC"]["folds"] == 3 and preds.count() == 400
    trials, report = select.random_search(rows, {"rate": select.LogUniform(0.01, 1.0)}, trials=3)
    assert trials.count() == 3 and report.agg(F.sum("n")).first()[0] == 3 and len(select.format_trials(trials)) == 3
    model = train(rows, TrainConfig())
    long = features.long_form(rows, "label")
    assert linear.explain(long, model, 1).where("feature IN ('up', 'down')").count() == 400
    stream = {r["id"]: r["prediction"] for r in score_stream(rows, model).collect()}
    batch = {r["id"]: r["prediction"] for r in linear.score(long, model).collect()}
    assert all(abs(stream[k] - batch[k]) < 1e-9 for k in batch)
    multi = rows.withColumn("label", F.when(F.col("label") > 0, "u").otherwise("d"))
    mm = train(multi, TrainConfig(), classes=["u", "d"])
    best = {r["id"]: r["predicted"] for r in linear.predict_class(linear.score_multiclass(features.long_form(multi), mm)).collect()}
    assert all(best[i] == "du"[i % 2] for i in range(400))
    assert linear.diff(model, linear.rescale(model, 1.0)).count() == 0
    frozen = linear.freeze(linear.merge((model, 1.0), (mm.drop("class", "epoch").withColumn("class", F.lit("")).withColumn("epoch", F.lit(0).cast("long")), 1.0)), model)
    assert frozen.count() <= model.count()


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)) + 3 * rng.standard_normal((12, 16))[rng.integers(0, 12, 300)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    pairs = lambda df: {(r["id"], r["neighbor_id"]) for r in df.collect()}
    d = knn.euclidean(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i])[:5]}
    assert pairs(knn.exact(rows, rows, 5)) == want
    assert len(pairs(knn.lsh_knn(rows, 5, hashes=40, bits=4)) & want) >= 0.9 * len(want)
    assert len(pairs(knn.pivot_knn(rows, 5, per_point=8)) & want) >= 0.9 * len(want)
    a, b = rows.where("id < 50"), rows.where("id >= 50")
    assert len(pairs(knn.pivot_knn2(a, b, 3, per_point=8, max_bin=20)) & pairs(knn.exact(a, b, 3))) >= 0.85 * 150
    assert knn.as_lists(knn.exact(a, b, 3)).count() == 50


def test_crowded_bins_are_compared_whole(spark):
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.standard_normal((60, 4)), np.ones((60, 4))])  # half of them equal
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    pairs = lambda df: sorted((r["id"], r["rank"], r["neighbor_id"]) for r in df.collect())
    whole = pairs(knn.lsh_knn(rows, 5, hashes=6, bits=2, max_bin=None))
    assert len(whole) == 600 and pairs(knn.lsh_knn(rows, 5, hashes=6, bits=2, max_bin=7)) == whole
    assert pairs(knn.lsh_knn2(rows, rows, 5, hashes=6, bits=2, max_bin=7)) == whole
    got = pairs(knn.pivot_knn(rows, 5, centers=2, per_point=8, max_bin=7))
    assert {i for i, _, _ in got} == set(range(120))


@pytest.mark.parametrize("name", ["knn_lsh_two_set", "knn_pivot_two_set"])
def test_two_set_searches_compare_the_query_set_with_the_whole_table(spark, name):
    from millrace.plans import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert {r["id"] for r in found} == set(range(0, 2000, 100)) and {r["neighbor_id"] % 2 for r in found} == {0, 1}
    assert all(min((r["distance"], r["neighbor_id"] == -r["id"] - 1) for r in found if r["id"] == i)[0] < 1e-6 for i in range(0, 2000, 100))


@pytest.mark.parametrize("name", ["knn_lsh", "knn_pivot_cosine"])
def test_searches_recall_with_production_parameters(spark, name):
    from millrace.plans import QUERIES

    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)], float)
    d = (knn.cosine if "cosine" in name else knn.euclidean)(x[ids % 100 == 0], x)
    d[ids[ids % 100 == 0][:, None] == ids[None, :]] = np.inf
    want = {(int(q), int(ids[j])) for q, row in zip(ids[ids % 100 == 0], d) for j in np.argsort(row)[:5]}
    got = {(r["id"], r["neighbor_id"]) for r in QUERIES[name](spark, "/root/testdata/sf0.1").collect()}
    print(name, len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)


def test_factorizations(spark):
    rng = np.random.default_rng(3)
    a = rng.random((30, 4)) @ rng.random((4, 20))
    m = spark.createDataFrame([(i, 100 + j, float(a[i, j])) for i in range(30) for j in range(20)], "row long, col long, value double")
    u, e, v = factor.svd(m, 4)
    assert np.allclose(e, np.linalg.svd(a)[1][:4], rtol=1e-6)
    uu = np.array([r["vec"] for r in u.orderBy("id").collect()])
    vv = np.array([r["vec"] for r in v.orderBy("id").collect()])
    assert np.allclose(uu.T @ uu, np.eye(4), atol=1e-6) and np.allclose(uu * e @ vv.T, a, atol=1e-6)
    w, h = factor.nnmf_init(m, 3)
    before = factor.nnmf_error(m, w, h, 3).first()["error"]
    w, h = factor.nnmf(m, 3, iters=5)
    assert factor.nnmf_error(m, w, h, 3).first()["error"] < 0.5 * before
    left, right = factor.als(m, d=5, iters=3, row_ridge=0.1, col_ridge=0.1)
    fit = factor.fitted(m, left, right).collect()
    assert np.mean([(r["fit"] - r["value"]) ** 2 for r in fit]) < 0.05
    big = factor.als_half_step(m, left.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), 25))), "row", "col", 30, 0.1).collect()
    small = {r["id"]: r["vec"] for r in factor.als_half_step(m, left, "row", "col", 5, 0.1).collect()}
    assert all(np.allclose(r["vec"][:5], small[r["id"]], atol=1e-8) for r in big)
    xx = np.diag([1.0, 2.0, 5.0])
    lam = factor.constrained_ridge(xx, np.array([3.0, 1.0, 2.0]))
    assert abs(np.linalg.norm(np.linalg.solve(xx + lam * np.eye(3), [3.0, 1.0, 2.0])) - 1) < 1e-6


def test_clusters_and_topics(spark):
    rows = spark.createDataFrame([(i, {f"{'abc'[i % 3]}{k}": 1.0 + (i * k) % 5 for k in range(4)}) for i in range(60)], "id long, features map<string,double>")
    _, assigned = cluster.kmeans(rows, k=3, init_iters=2, finish_iters=2, iters=2, start=2, factor=3.0)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"] % 3)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert cluster.online_kmeans(rows, cluster.initial_centers(rows, 3)).count() > 0
    words = spark.createDataFrame([(d, f"{'xy'[d % 2]}{k}", 3) for d in range(20) for k in range(6)], "doc long, word string, n long")
    t = topics.fit(words, 2, iters=15, seed=3)
    assert all(abs(r["s"] - 1) < 1e-9 for r in t.groupBy("topic").agg(F.sum("p").alias("s")).collect())
    heavy = t.groupBy("topic", F.substring("word", 1, 1).alias("k")).agg(F.sum("p").alias("s")).where("s > 0.9").count()
    assert heavy == 2
    e = topics.e_step(words, t)
    assert abs(topics.statistics(e, 1).agg(F.sum("n")).first()[0] - 360) < 1e-6
    assert topics.dictionary(words).agg(F.max("idx")).first()[0] == 11


def test_sources_and_sinks(spark, tmp_path):
    line = readers.parse_feature_line("value")
    got = spark.createDataFrame([("1 2.5 tag|ns a:2 b a:1 bad:x |c d",), ("lab |  e:1.5",)], "value string").select(line.alias("p")).select("p.*").collect()
    assert got[0].asDict() == {"label": "1", "importance": 2.5, "id": "tag", "features": {"ns___a": 3.0, "ns___b": 1.0, "c___d": 1.0}}
    assert got[1]["features"] == {"e": 1.5}
    mail = spark.createDataFrame([(json.dumps([{"type": "text/html", "body": "h"}, {"type": "text/plain", "body": "p"}, {"type": "text/plain", "body": "q"}]),), ("broken",)], "j string")
    assert [tuple(r["m"]) for r in mail.select(readers.parse_mail_parts("j").alias("m")).collect()] == [("p q", "plain"), (None, "filter")]
    model = spark.createDataFrame([("", "a", 1.5), ("", "b", -2.0)], "class string, feature string, weight double")
    back = readers.model_from_json(readers.model_to_json(model, "logistic_regression", 7)).collect()
    assert {(r["feature"], r["weight"], r["epoch"]) for r in back} == {("a", 1.5, 7), ("b", -2.0, 7)}
    readers.write_tsv(model.drop("class"), f"{tmp_path}/m")
    assert readers.read_tsv(spark, f"{tmp_path}/m", "feature string, weight double").count() == 2
    flowers = spark.createDataFrame([("5.1\t3.5\tsetosa",), ("x\t1\tbad",), ("1\t2",)], "value string")
    assert [tuple(r) for r in readers.labelled_lines(flowers, ["w", "h"]).collect()] == [("setosa", {"w": 5.1, "h": 3.5})]
    preds = spark.createDataFrame([(1.0, 0.9, "<x>"), (0.0, None, None)], "label double, prediction double, supporting_data string")
    assert readers.write_prediction_report(preds, f"{tmp_path}/r.html") == 2 and "&lt;x&gt;" in (tmp_path / "r.html").read_text()


def test_relational(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("n", F.lit(1))
    got = relational.running_sums(df, ["g"], F.col("id"), ["n"], partitions=7)
    assert got.where("cum_n <> floor(id / 3) + 1").count() == 0
    fit, test = relational.split(df)
    assert fit.count() + test.count() == 1000 and 700 < fit.count() < 900
    assert relational.salted_join(df, df.select("g").distinct().withColumn("x", F.col("g") * 2), "g", 4, "id").where("x = g * 2").count() == 1000
    rows = features.instances(df.limit(10), "id", None, features.FeatureBuilder().id("g", ns="g").put("one", 1.0).update("one", 2.0))
    assert rows.first()["features"]["one"] == 3.0
    kept = features.keep_frequent_features(rows, 3)
    assert kept.count() == 10 and {k for r in kept.collect() for k in r["features"]} == {"one", "g___0"}


def test_streams(spark, tmp_path):
    rows = _toy(spark, 100)
    rows.write.parquet(f"{tmp_path}/in")
    online = OnlineModel(TrainConfig())
    q = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(online).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert online.batches >= 1 and online.model.where("feature = 'up'").first()["weight"] > 0
    events = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:59", "a", 2.0), ("2024-01-01 00:05:00", "b", 3.0)], "ts string, k string, v double")
    assert windowed(events, "ts", "1 minute", "1 minute", "k", value="v").where("n = 2 AND total = 3").count() == 1
    assert sessions(events, "ts", "2 minutes", "1 minute", "k").count() == 2


def test_truncation_shrinks_small_weights():
    c = TrainConfig(rate=0.5, examples_per_epoch=1e9, period=2, truncation_update=0.1, truncation_threshold=0.3)
    model = Learner(c, {"small": 0.2, "tiny": -0.04, "large": 0.9})
    for _ in range(3):  # at the third row, of epoch 2, weights below 0.3 shrink by 0.5 * 0.1
        model.update([(1.0, {})])
    assert abs(model.w["small"] - 0.15) < 1e-12 and "tiny" not in model.w and model.w["large"] == 0.9


def test_large_models_learn_as_small_ones_do(spark):
    rows = _toy(spark)
    multi = rows.withColumn("label", F.when(F.col("label") > 0, "u").otherwise("d"))
    for data, classes in ((rows, None), (multi, ["u", "d"])):
        small, large = (train(data, TrainConfig(iters=3, shards=4, laplace=0.001, broadcast_rows=n), classes=classes) for n in (10**6, 0))
        a, b = ({(r["class"], r["feature"]): r["weight"] for r in m.collect()} for m in (small, large))
        seen = {k for k in a if abs(a[k]) > 0.02}
        assert seen and all(abs(a[k] - b[k]) < 0.01 for k in seen)


def test_options_round_trip():
    c = TrainConfig(rate=0.25, optimizer="ftrl", class_probs={"a": 0.5, "b": 1.0}, iters=3, frozen=True, exponential_base=0.9)
    assert TrainConfig.parse(c.unparse()) == c
    with pytest.raises(ValueError):
        TrainConfig.parse({"nothing": "1"})


def test_jobs_end_to_end(spark, tmp_path):
    from millrace import jobs

    rows = _toy(spark).withColumn("supporting_data", F.concat(F.lit("row "), "id"))
    rows.write.parquet(f"{tmp_path}/rows")
    jobs.main(["train", "--input", f"{tmp_path}/rows", "--out_dir", f"{tmp_path}/out", "--folds", "2", "--iters", "2", "--rate", "0.2"])
    model = spark.read.parquet(f"{tmp_path}/out/model")
    assert model.where("feature = 'up'").first()["weight"] > 0
    again = readers.model_from_json(spark.read.json(f"{tmp_path}/out/model_json"))
    assert {(r["feature"], r["weight"]) for r in again.collect()} == {(r["feature"], r["weight"]) for r in model.collect()}
    stats = {r["stat"]: r["mean"] for r in readers.read_tsv(spark, f"{tmp_path}/out/statistics", "stat string, mean double, std double, median double, folds long").collect()}
    assert stats["1-class AUC"] > 0.99 and spark.read.parquet(f"{tmp_path}/out/predictions").count() == 400
    jobs.main(["predict", "--input", f"{tmp_path}/rows", "--model", f"{tmp_path}/out/model", "--out_dir", f"{tmp_path}/p"])
    found = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/p/predictions").collect()]
    assert len(found) == 400 and all(x[1] == f"row {x[0]}" and (float(x[2]) > 0.5) == (int(x[0]) % 2 == 1) for x in found)
    assert spark.read.parquet(f"{tmp_path}/p/explanations").count() == 400
    jobs.main(["search", "--input", f"{tmp_path}/rows", "--out_dir", f"{tmp_path}/s", "--space", "rate=log:0.01:1;optimizer=in:elastic_net|adagrad", "--trials", "3"])
    assert spark.read.text(f"{tmp_path}/s/trials").count() == 6
    spark.createDataFrame([(i, j, float(1 + (i * j) % 3)) for i in range(12) for j in range(6) if (i + j) % 2], "row long, col long, value double").write.parquet(f"{tmp_path}/m")
    for _ in range(2):
        jobs.main(["factorize", "--input", f"{tmp_path}/m", "--out_dir", f"{tmp_path}/f", "--steps", "2", "--dimension", "3", "--row_ridge", "0.1", "--col_ridge", "0.1"])
    whole, _ = factor.als(spark.read.parquet(f"{tmp_path}/m"), d=3, iters=4, row_ridge=0.1, col_ridge=0.1)
    a, b = ({r["id"]: r["vec"] for r in df.collect()} for df in (whole, spark.read.parquet(f"{tmp_path}/f/u-4")))
    assert a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))


def test_wide_factors_with_hot_keys_equal_narrow_sums(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = 26
    rows = spark.createDataFrame([(i, j, float(rng.integers(1, 5))) for i in range(60) for j in (0, 1 + i % 3)], "row long, col long, value double")
    fixed = {i: rng.standard_normal(d) for i in range(60)}
    u = spark.createDataFrame([(i, v.tolist()) for i, v in fixed.items()], "id long, vec array<double>")
    monkeypatch.setattr(factor, "PART", 7)
    got = {r["id"]: np.array(r["vec"]) for r in factor.als_half_step(rows, u, "row", "col", d, 0.1).collect()}
    held = rows.collect()
    base = 0.001 * sum(np.outer(v, v) for v in fixed.values()) + 0.1 * np.eye(d)
    for col in range(4):
        own = [(fixed[r["row"]], r["value"]) for r in held if r["col"] == col]
        want = np.linalg.solve(base + sum(np.outer(v, v) for v, _ in own), 1.001 * sum(x * v for v, x in own))
        assert np.allclose(got[col], want, atol=1e-8)


def test_evaluations_merge(spark):
    preds = spark.createDataFrame([(float(i % 2), (i % 7) / 7) for i in range(60)], "label double, prediction double")
    parts = [preds.where(F.col("prediction") < 0.4), preds.where(F.col("prediction") >= 0.4)]
    both = evaluate.Evaluation("binary").add(parts[0]).merge(evaluate.Evaluation("binary", parts[1]))
    whole = {r["stat"]: r["value"] for r in evaluate.binary_statistics(preds).collect()}
    assert all((v is None and whole[k] is None) or abs(v - whole[k]) < 1e-12 for k, v in ((r["stat"], r["value"]) for r in both.statistics().collect()))
    assert "mean" in evaluate.format_statistics(evaluate.aggregate_folds(both.statistics().withColumn("fold", F.lit(0))))


def test_large_tables_are_neither_crossed_nor_held(spark):
    with pytest.raises(ValueError):
        relational.cross_tiny(spark.range(3), spark.range(20), most=10)
    with pytest.raises(ValueError):
        cluster._held(spark.createDataFrame([("a", str(i), 1.0) for i in range(5)], "cluster string, feature string, weight double"), most=4)


def test_entry_runs_without_the_other_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'lr_batch_auc' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
