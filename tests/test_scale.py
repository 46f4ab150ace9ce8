"""The whole job with right results beyond the sizes of the small tables: kernels, whole batches, odd rows, large models."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import kernels
from millrace.operators import linear
from millrace.operators.features import long_form
from millrace.operators.trainers import Learner, TrainConfig, train


def _instances(n, seed=3):
    rng = random.Random(seed)
    return [(float(rng.random() < 0.5), {f"f{rng.randint(0, 60)}": rng.choice([1.0, 2.0, -0.5]) for _ in range(rng.randint(0, 12))}) for _ in range(n)]


def _batch(data):
    return pa.RecordBatch.from_arrays(
        [pa.array([y for y, _ in data]), pa.array([""] * len(data)), pa.array([list(x) for _, x in data], pa.list_(pa.string())), pa.array([list(x.values()) for _, x in data], pa.list_(pa.float64()))],
        ["y", "class", "names", "values"],
    )


def _kernel(config, data, cut=301):
    words, one = kernels.Vocabulary(), kernels.ArrayLearner(config)
    for part in (data[:cut], data[cut:]):
        kernels.rows_into({"": one}, _batch(part), words)
    one.flush()
    names = list(words.ids)
    return {names[i]: w for i, w in zip(*one.finish())}, one.epoch


@pytest.mark.parametrize("optimizer", ["elastic_net", "adagrad", "passive_aggressive", "ftrl", "control"])
def test_array_learner_equals_the_plain_one(optimizer):
    data = _instances(600)
    for model in ("logistic_regression", "perceptron", "linear_svm", "mira", "least_squares"):
        for penalties in ({}, {"laplace": 1e-3, "gauss": 1e-2}, {"gauss": 0.3}, {"rate": 5.0, "gauss": 0.3, "laplace": 0.01}):
            for size in (1, 8, 5000):
                c = TrainConfig(**{"model": model, "optimizer": optimizer, "mini_batch_size": size, "rate": 0.01, "examples_per_epoch": 200, **penalties})
                plain = Learner(c)
                for i in range(0, len(data), size):
                    plain.update(data[i : i + size])
                want, (got, epoch) = plain.finish(), _kernel(c, data)
                if max(map(abs, want.values()), default=0) < 1e6:  # some of these settings diverge
                    assert got.keys() == want.keys() and epoch == plain.epoch and all(abs(got[k] - want[k]) < 1e-9 for k in want), c


def test_penalties_catch_up_at_once():
    """A weight read again after long costs no more than one read at once; 300,000 steps were a loop of as many."""
    c = TrainConfig(laplace=1e-7, gauss=1e-3, examples_per_epoch=1e9)
    one = kernels.ArrayLearner(c)
    one.grow(2)
    seen, none = np.array([0]), np.zeros(0, np.int64)
    one.add(1.0, seen, np.ones(1))
    first = one.w[0]
    for _ in range(300_000):
        one.add(1.0, none, np.zeros(0))
    q = 1 - 1e-4
    assert one.base == 0 and abs(one._caught_up(seen)[0] - (first * q**300_000 - 1e-8 * (1 - q**300_000) / 1e-4 if first * q**300_000 > 1e-4 else 0.0)) < 1e-12


def _rows(spark, n=400):
    return spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(_instances(n)) if x], "id long, label double, features map<string,double>")


def _weights(model):
    return {(r["class"], r["feature"]): r["weight"] for r in model.collect()}


@pytest.mark.parametrize("classes", [None, ["u", "d"]])
def test_a_whole_batch_does_not_depend_on_shards(spark, classes):
    rows = _rows(spark) if classes is None else _rows(spark).withColumn("label", F.when(F.col("label") > 0, "u").otherwise("d"))
    options = {"iters": 2, "laplace": 0.01, "gauss": 0.02, "examples_per_epoch": 1e12}
    want = _weights(train(rows, TrainConfig(mini_batch_size=1_000_000, shards=1, **options), classes=classes))
    for most in (10**6, 0):  # broadcast, and cut up by shards
        got = _weights(train(rows, TrainConfig(whole_batch=True, shards=5, broadcast_rows=most, **options), classes=classes))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    with pytest.raises(ValueError):
        TrainConfig(whole_batch=True, optimizer="adagrad")


def test_a_model_beyond_the_broadcast_limit_scores_a_frame(spark, monkeypatch):
    from millrace.streaming import online

    rows = _rows(spark)
    model = linear.batch_step(long_form(rows, "label"))
    rows = rows.unionByName(spark.createDataFrame([(7000, 1.0, {}), (7000, 0.0, {"f1": 2.0})], rows.schema))
    got = []
    for most in (10**6, 3):
        monkeypatch.setattr(online, "BROADCAST_ROWS", most)
        got.append(sorted((r["id"], r["label"], round(r["margin"], 9), round(r["prediction"], 9)) for r in online.score_stream(rows, model, "logistic_regression", "label").collect()))
    assert got[0] == got[1] and len(got[0]) == rows.count()


def _agrees(spark, folder, name):
    """A query and its SQL over the tables in a folder."""
    import __spark_entry__ as entry

    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    frame = entry.queries()[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(key, map(tuple, frame.collect()))) == sorted(map(key, want))


def test_builders_of_odd_documents(spark, tmp_path):
    docs = [(1, "", "en", "s", 0), (2, "ab", None, "s", 2), (3, None, "fr", "s", None), (4, "x", "de", "s", 1), (4, "xyz", "de", "t", 3), (-7, "q", "", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    _agrees(spark, tmp_path, "feat_builders")


def test_a_step_from_nothing_joins_no_rows(spark):
    """Only the count of instances is joined, not each of their features."""
    long = long_form(_rows(spark), "label")
    for optimizer in ("elastic_net", "adagrad", "ftrl"):
        step = linear.batch_step(long, "logistic_regression", optimizer)
        assert step._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        zero = spark.createDataFrame([("none", 1.0)], "feature string, weight double")
        want = _pairs(linear.batch_step(long, "logistic_regression", optimizer, model=zero))
        got = _pairs(step)
        assert all(abs(got[k] - want[k]) < 1e-12 for k in got) and set(want) - set(got) <= {"none"}


def _pairs(model):
    return {r["feature"]: r["weight"] for r in model.collect()}


def test_documents_infer_together_as_they_do_alone():
    from millrace.operators import topics

    rng = np.random.default_rng(4)
    docs, k = [rng.integers(1, 9, rng.integers(1, 30)).astype(float) for _ in range(40)], 3
    probs = [rng.random((len(n), k)) for n in docs]
    words = [[{"word": f"w{i}", "n": x, "p": p.tolist()} for i, (x, p) in enumerate(zip(n, ps))] for n, ps in zip(docs, probs)]
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.float64()), ("p", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(words, kind)], ["doc", "words"])
    _, at, _, _, gammas, phis = next(topics._inferred([batch], k, 0.1, 1e-3, 100))
    for i, (n, p) in enumerate(zip(docs, probs)):
        gamma = np.full(k, 0.1 + n.sum() / k)
        for _ in range(100):
            phi = p * np.exp(topics.digamma(gamma))[None, :]
            phi /= phi.sum(1, keepdims=True)
            new = 0.1 + (n[:, None] * phi).sum(0)
            done, gamma = ((new - gamma) ** 2).sum() < 1e-3, new
            if done:
                break
        assert np.allclose(gammas[i], gamma, atol=1e-9) and np.allclose(phis[at == i], phi, atol=1e-9)


def test_neighbours_by_blocks_keep_ties_and_memory():
    from millrace.operators import knn

    rng = np.random.default_rng(5)
    ids, vecs = np.arange(300), rng.integers(0, 3, (300, 2)).astype(float)  # many equal distances
    d = knn.euclidean(vecs, vecs)
    shapes = []

    def distance(a, b):
        shapes.append((len(a), len(b)))
        return knn.euclidean(a, b)

    got = knn.nearest(ids, vecs, ids, vecs, 5, distance, chunk=64, block=32)
    want = [(i, j) for i in range(300) for j in sorted((x for x in range(300) if x != i), key=lambda x: (round(d[i, x], 9), x))[:5]]
    assert list(zip(got["id"], got["neighbor_id"])) == want and max(b for _, b in shapes) == 32 and max(a for a, _ in shapes) == 64


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_multiply_as_the_whole_matrix(spark, monkeypatch, kind):
    """In blocks of any size, with rows of several chunks and keys that have no vector; entries and vectors meet without moving entries."""
    from millrace.operators import factor

    rng = np.random.default_rng(6)
    a = np.where(rng.random((40, 25)) < 0.3, rng.random((40, 25)), 0.0)
    at = [(int(i) - 20, int(j) + 7, float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    matrix = spark.createDataFrame(at, "row long, col long, value double").select(F.col("row").cast(kind), F.col("col").cast(kind), "value")
    x = rng.random((25, 3))
    x[3] = 0
    vectors = spark.createDataFrame([(j + 7, x[j].tolist()) for j in range(25) if j != 3], "id long, vec array<double>").select(F.col("id").cast(kind), "vec")
    monkeypatch.setattr(factor, "CHUNK", 5)
    for entries in (10**6, 20):
        monkeypatch.setattr(factor, "BLOCK_ENTRIES", entries)
        blocks = factor.Blocks(matrix)
        assert blocks.n["row"] * blocks.n["col"] * entries >= len(at)
        got = blocks.multiply(vectors, "col", "row", 3)
        assert {int(r["id"]): r["vec"] for r in got.collect()} == {i - 20: pytest.approx((a[i] @ x).tolist(), abs=1e-12) for i in range(40) if (a[i] * (x.sum(1) > 0)).any()}
    wide = factor.als_half_step(matrix, vectors, "col", "row", 3, 0.1)
    cut = factor.als_half_step(blocks, vectors, "col", "row", 3, 0.1)
    want = {r["id"]: r["vec"] for r in wide.collect()}
    assert {r["id"]: r["vec"] for r in cut.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(cell") == 1 and "Bucketed: true" in plan


def test_fold_in_reads_its_matrix_once(spark, tmp_path, monkeypatch):
    """The purchases were worked out anew for each of the steps."""
    import __spark_entry__ as entry

    spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 5, 2.0), (1, 5, 1.0), (2, 6, 4.0), (3, 7, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("ls_foldin", "ls_foldin_binary"):
        assert "lineitem" not in str(entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan())
        _agrees(spark, tmp_path, name)


def test_features_are_worked_out_once(spark):
    """No filter that Spark infers of an exploded expression, or pushes below it, repeats the expression."""
    from millrace.functions import tokens
    from millrace.plans import QUERIES

    texts = spark.createDataFrame([(1, 1.0, "a b a"), (2, 0.0, ""), (3, 1.0, None)], "id long, label double, text string")
    rows = texts.select("id", "label", tokens.counts(F.split(F.lower("text"), " ")).alias("features"))
    frames = [long_form(rows, "label"), QUERIES["vw_parse"](spark, "/root/testdata/sf0.001"), QUERIES["seq_ngrams_topk"](spark, "/root/testdata/sf0.001")]
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and ("split(" in line or "aggregate(" in line)]
    assert {(r["id"], r["feature"], r["value"]) for r in frames[0].collect()} == {(1, "a", 2.0), (1, "b", 1.0), (2, "", 1.0)}
    assert {r["feature"] for r in train(rows, TrainConfig()).collect()} == {"a", "b", ""}


@pytest.mark.parametrize("job", ["train", "search", "means"])
def test_what_a_task_sends_to_the_shards_is_bounded(spark, monkeypatch, job):
    """A task held all rows of a split of 128 MB until they were sent."""
    from millrace.operators import cluster, select, trainers
    from millrace.sources import staging

    key, most = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    monkeypatch.setattr(staging, "SPLIT_BYTES", 1 << 14, raising=False)
    for module, name in ((trainers, "run_shards"), (select, "run_shards"), (cluster, "_run")):

        def watched(placed, n, learn, schema, run=getattr(module, name)):
            most.append(placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
            return run(placed, n, learn, schema)

        monkeypatch.setattr(module, name, watched)
    features = F.create_map(F.lit("a"), F.rand(1), F.lit("b"), F.rand(2))
    rows = spark.range(20_000).coalesce(1).select("id", (F.col("id") % 2).cast("double").alias("label"), features.alias("features"))
    if job == "train":
        train(rows, TrainConfig(iters=2))
    elif job == "search":
        select.random_search(rows, {"rate": select.Uniform(0.1, 1.0)}, trials=4)
    else:
        cluster.online_kmeans(rows, cluster.initial_centers(rows, 2))
    assert most and max(most) < 2_500 and spark.conf.get(key) == before


def test_rows_that_share_an_id_learn_in_one_order(spark):
    """Line items share ids; where rows of one id were ordered by how they came, the model depended on splits."""
    rng = random.Random(5)
    rows = [(i // 4, rng.random() * 5, {"a": rng.random(), "b": 1.0}) for i in range(800)]
    got = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "id long, label double, features map<string,double>").coalesce(1)
        got.append(_weights(train(frame, TrainConfig(model="least_squares", rate=0.05))))
    assert got[0] == got[1]
