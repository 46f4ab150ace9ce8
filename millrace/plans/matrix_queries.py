"""Queries of nearest neighbours, clustering, factorization and topics, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..operators import cluster as C
from ..operators import factor as FA
from ..operators import features as FT
from ..operators import knn as K
from ..operators import topics as T
from ..sources.staging import bucketed, written
from .registry import load, query


def _vecs(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _queries(v):
    """What the searches look up, of all rows: those whose id is divisible by 100."""
    return v.where("id % 100 = 0")


_E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"


@query(f"""WITH {_E} SELECT id, neighbor_id, rank, distance FROM (SELECT a.id, b.id AS neighbor_id, round(list_distance(a.vec, b.vec), 6) AS distance,
row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id)::INT AS rank FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id) WHERE rank <= 5""")
def knn_exact(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return K.exact(_queries(v), v, 5).withColumn("distance", F.round("distance", 6))


@query("""WITH q AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_custkey % 100 = 0),
c AS (SELECT -s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier)
SELECT id, neighbor_id, rank, distance FROM (SELECT q.id, c.id AS neighbor_id, round(sqrt(power(q.x - c.x, 2) + power(q.y - c.y, 2)), 6) AS distance,
row_number() OVER (PARTITION BY q.id ORDER BY sqrt(power(q.x - c.x, 2) + power(q.y - c.y, 2)), c.id)::INT AS rank FROM q CROSS JOIN c) WHERE rank <= 3""")
def knn_two_set(spark, sf_dir):
    """Customers, of whom those with an id divisible by 100 ask, and the suppliers nearest to them by balance and nation."""
    own = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("vec"))
    other = load(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("vec"))
    return K.exact(_queries(own), other, 3).withColumn("distance", F.round("distance", 6))


@query()
def knn_lsh(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return K.lsh_knn2(_queries(v), v, 5, hashes=50, bits=6)


@query()
def knn_lsh_two_set(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return K.lsh_knn2(_queries(v), v.select((-F.col("id") - 1).alias("id"), "vec"), 3, hashes=50, bits=6)


@query()
def knn_pivot_cosine(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return K.pivot_knn2(_queries(v), v, 5, K.cosine, per_point=10)


@query()
def knn_pivot_two_set(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return K.pivot_knn2(_queries(v), v.select((-F.col("id") - 1).alias("id"), "vec"), 3, per_point=10)


_M = "m AS (SELECT user_id AS row, event_type AS col, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"
_CP = "cp AS (SELECT o_custkey AS row, l_partkey AS col, sum(l_quantity) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("row"), F.col("event_type").alias("col")).agg(F.count("*").cast("double").alias("value"))


def _purchases(spark, sf_dir):
    j = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return _summed(j)


def _summed(j):
    return j.groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("value"))


def _purchases_by_part(spark, sf_dir):
    """The same, worked out once and written in buckets by part, where the parts' vectors are joined without moving an entry."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return bucketed(_summed(j.select("o_custkey", "l_partkey", "l_quantity").repartition(n, "l_partkey")), n, "col")


@query(f"WITH {_M} SELECT a.col AS a, b.col AS b, sum(a.value * b.value) AS value FROM m a JOIN m b USING (row) GROUP BY ALL")
def mat_gram(spark, sf_dir):
    """The Gram matrix of the rows' vectors over the five kinds of events."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    value = lambda k: F.coalesce(F.sum(F.when(F.col("col") == k, F.col("value"))), F.lit(0.0))
    vecs = _events(spark, sf_dir).groupBy("row").agg(F.array(*[value(k) for k in kinds]).alias("vec"))
    g = FA.gram(vecs, "vec", len(kinds))
    return spark.createDataFrame([(a, b, float(g[i, j])) for i, a in enumerate(kinds) for j, b in enumerate(kinds) if g[i, j]], "a string, b string, value double")


@query(f"WITH {_CP} SELECT row AS id, round(sum(value * (col % 7)), 4) AS x, round(sum(value), 4) AS y FROM cp GROUP BY row")
def mat_multiply(spark, sf_dir):
    m = _purchases(spark, sf_dir)
    vecs = m.select(F.col("col").alias("id")).distinct().withColumn("vec", F.array((F.col("id") % 7).cast("double"), F.lit(1.0)))
    out = FA.multiply(m, vecs, "col", "row", 2)
    return out.select("id", F.round(F.col("vec")[0], 4).alias("x"), F.round(F.col("vec")[1], 4).alias("y"))


_NN = f"""WITH {_M}, w AS (SELECT DISTINCT row, 1.0 + (row % 3)::DOUBLE AS w, 0.5::DOUBLE AS wb FROM m), h AS (SELECT DISTINCT col, 1.0 + length(col)::DOUBLE / 10 AS h, 0.25::DOUBLE AS hb FROM m),
g AS (SELECT sum(w * w) AS ww, sum(w) AS w1, sum(w * wb) AS wwb, count(*) AS n, sum(wb) AS wb1 FROM w),
t AS (SELECT col, sum(value * w) AS tw, sum(value) AS t1 FROM m JOIN w USING (row) GROUP BY col)"""


def _nn_start(m):
    w = m.select(F.col("row").alias("id")).distinct().select("id", F.array(1.0 + (F.col("id") % 3).cast("double")).alias("vec"), F.lit(0.5).alias("bias"))
    h = m.select(F.col("col").alias("id")).distinct().select("id", F.array(1.0 + F.length("id") / 10).alias("vec"), F.lit(0.25).alias("bias"))
    return w, h


@query(f"""{_NN} SELECT col AS id, round(h * tw / (h * ww + hb * w1 + wwb), 6) AS factor, round(hb * t1 / (h * w1 + hb * n + wb1), 6) AS bias FROM h JOIN t USING (col), g""")
def nnmf_step(spark, sf_dir):
    m = _events(spark, sf_dir)
    w, h = _nn_start(m)
    out = FA.nnmf_half_step(m, h, w, "col", "row", 1)
    return out.select("id", F.round(F.col("vec")[0], 6).alias("factor"), F.round("bias", 6).alias("bias"))


@query(f"{_NN} SELECT round(avg(power(coalesce(value, 0) - (w * h + wb + hb), 2)), 4) AS error FROM w CROSS JOIN h LEFT JOIN m USING (row, col)")
def nnmf_error(spark, sf_dir):
    m = _events(spark, sf_dir)
    return FA.nnmf_error(m, *_nn_start(m), 1).select(F.round("error", 4).alias("error"))


@query(f"""WITH {_CP}, r AS (SELECT DISTINCT col, 1.0 + (col % 5)::DOUBLE AS r FROM cp) SELECT row AS id, round(sum(value * r) / (SELECT sum(r * r) FROM r), 6) AS x FROM cp JOIN r USING (col) GROUP BY row""")
def ls_foldin(spark, sf_dir):
    m = _purchases_by_part(spark, sf_dir)
    right = m.select(F.col("col").alias("id")).distinct().withColumn("vec", F.array(1.0 + (F.col("id") % 5).cast("double")))
    return FA.fold_in(m, right).select("id", F.round(F.col("vec")[0], 6).alias("x"))


@query(f"""WITH {_M}, u AS (SELECT DISTINCT row, 1.0 + (row % 3)::DOUBLE AS u FROM m), g AS (SELECT 0.001 * sum(u * u) AS g FROM u)
SELECT col AS id, round(1.001 * sum(value * u) / (any_value(g) + sum(u * u) + 0.1), 6) AS x FROM m JOIN u USING (row), g GROUP BY col""")
def als_half_step(spark, sf_dir):
    m = _events(spark, sf_dir)
    u = m.select(F.col("row").alias("id")).distinct().withColumn("vec", F.array(1.0 + (F.col("id") % 3).cast("double")))
    return FA.als_half_step(m, u, "row", "col", 1, 0.1).select("id", F.round(F.col("vec")[0], 6).alias("x"))


@query()
def als_factors(spark, sf_dir):
    return FA.als(_purchases(spark, sf_dir), d=8, iters=2, row_ridge=0.1, col_ridge=0.1)[0]


@query()
def nnmf_factors(spark, sf_dir):
    return FA.nnmf(_events(spark, sf_dir), k=3, iters=3)[0]


@query()
def svd_factors(spark, sf_dir):
    u, e, _ = FA.svd(_purchases(spark, sf_dir), 5)
    return u.withColumn("values", F.array(*[F.lit(float(x)) for x in e]))


def _points(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), FT.FeatureBuilder().numbers("embedding").build().alias("features"))


_K = """p AS (SELECT vec_id AS id, i - 1 AS k, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
c AS (SELECT label::VARCHAR AS cluster, k, round(avg(embedding[k + 1]::DOUBLE), 9) AS y FROM (SELECT *, unnest(range(0, 64)) AS k FROM embeddings) GROUP BY ALL),
d AS (SELECT p.id, cluster, 1 - sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)) AS distance FROM p JOIN c USING (k) GROUP BY ALL),
a AS (SELECT id, cluster, distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"""


def _centers(spark, sf_dir):
    """The means of the labels' points."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("cluster"), F.posexplode("embedding").alias("k", "x"))
    means = rows.groupBy("cluster", F.col("k").cast("string").alias("feature")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("weight"))
    return written(means)


@query(f"WITH {_K} SELECT id, cluster, round(distance, 6) AS distance FROM a")
def kmeans_assign(spark, sf_dir):
    return C.assign(_points(spark, sf_dir), _centers(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_K} SELECT cluster, k::VARCHAR AS feature, round(avg(x), 6) AS weight FROM a JOIN p USING (id) GROUP BY ALL")
def kmeans_iter(spark, sf_dir):
    return C.lloyd_step(_points(spark, sf_dir), _centers(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_K} SELECT cluster FROM (SELECT DISTINCT cluster FROM c) UNION (SELECT id::VARCHAR FROM (SELECT id FROM a ORDER BY distance DESC, id LIMIT 10))")
def kmeans_oversample_round(spark, sf_dir):
    return C.oversample_round(_points(spark, sf_dir), _centers(spark, sf_dir), 20).select("cluster").distinct()


@query(f"""WITH {_K}, s AS (SELECT cluster, k, abs(y) AS a, sum(abs(y)) OVER (PARTITION BY cluster ORDER BY abs(y) DESC, k::VARCHAR) AS t, row_number() OVER (PARTITION BY cluster ORDER BY abs(y) DESC, k::VARCHAR) AS r FROM c),
h AS (SELECT cluster, greatest(0, max((t - 1) / r) FILTER (a > (t - 1) / r)) AS theta FROM s GROUP BY cluster)
SELECT cluster, round(sum(greatest(a - theta, 0)), 6) AS mass, count(*) FILTER (a - theta >= 1e-10) AS n FROM s JOIN h USING (cluster) GROUP BY cluster""")
def kmeans_l1_projection(spark, sf_dir):
    p = C.project_centers(_centers(spark, sf_dir), 1.0)
    return p.groupBy("cluster").agg(F.round(F.sum(F.abs("weight")), 6).alias("mass"), F.count("*").alias("n"))


@query()
def kmeans_full(spark, sf_dir):
    return C.kmeans(_points(spark, sf_dir), k=10, init_iters=2, finish_iters=2, iters=2, start=5)[1]


@query()
def kmeans_online(spark, sf_dir):
    p = _points(spark, sf_dir)
    return C.online_kmeans(p, C.initial_centers(p, 10), radius=10.0)


def _words(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.explode(TK.without_blank(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).groupBy("doc", "word").agg(F.count("*").alias("n"))


_LW = "w AS (SELECT doc, word, count(*) AS n FROM (SELECT conv_id AS doc, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM conversations) WHERE word <> '' GROUP BY ALL)"


@query(f"WITH {_LW} SELECT word, (row_number() OVER (ORDER BY word) - 1)::BIGINT AS idx FROM (SELECT DISTINCT word FROM w)")
def lda_dict(spark, sf_dir):
    return T.dictionary(_words(spark, sf_dir))


@query(f"WITH {_LW}, i AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT word FROM w)) SELECT doc, count(*) AS kinds, sum(n)::BIGINT AS total, min(idx)::BIGINT AS first, max(idx)::BIGINT AS last FROM w JOIN i USING (word) GROUP BY doc")
def lda_documents(spark, sf_dir):
    w = _words(spark, sf_dir)
    d = T.index_documents(w, T.dictionary(w))
    return d.select("doc", F.size("idxs").cast("long").alias("kinds"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.col("idxs")[0].alias("first"), F.element_at("idxs", -1).alias("last"))


@query(f"WITH {_LW}, s AS (SELECT (doc % 3)::INT AS topic, word, sum(n)::DOUBLE AS n FROM w GROUP BY ALL) SELECT topic, word, round(n / sum(n) OVER (PARTITION BY topic), 9) AS p FROM s")
def lda_mstep(spark, sf_dir):
    s = _words(spark, sf_dir).groupBy((F.col("doc") % 3).cast("int").alias("topic"), "word").agg(F.sum("n").cast("double").alias("n"))
    return T.normalize(s).withColumn("p", F.round("p", 9))


@query()
def lda_estep(spark, sf_dir):
    w = _words(spark, sf_dir)
    return T.topic_proportions(T.e_step(w, T.random_topics(w.select("word").distinct(), 4)))


@query()
def lda_topics(spark, sf_dir):
    return T.fit(_words(spark, sf_dir), 4, iters=2)


