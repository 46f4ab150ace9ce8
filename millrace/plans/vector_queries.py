"""Queries of vector algebra, mathematics and the relational helpers, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import vectors as V
from ..operators import features as FT
from ..operators import relational as R
from .registry import load, query


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", FT.FeatureBuilder().numbers("embedding").build().alias("v"))


def _pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.map_filter("v", lambda k, x: x > 0).alias("u")), "vec_id")


_LONG = "l AS (SELECT vec_id, i - 1 AS k, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), u AS (SELECT vec_id - 1 AS vec_id, k, x AS y FROM l WHERE x > 0)"


@query(f"""WITH {_LONG},
p AS (SELECT coalesce(l.vec_id, u.vec_id) AS vec_id, coalesce(l.k, u.k) AS k, coalesce(x, 0) AS x, y, coalesce(y, 0) AS y0 FROM l FULL JOIN u ON l.vec_id = u.vec_id AND l.k = u.k)
SELECT vec_id, round(sum(x * y0), 6) AS dot, round(1 - sum(x * y0) / sqrt(sum(x * x)) / sqrt(sum(y0 * y0)), 6) AS cosine,
  round(sum(abs(x)), 6) AS norm1, round(sqrt(sum(x * x)), 6) AS norm2, round(greatest(0, max(x)), 6) AS top,
  round(sum(x + 0.5 * y0), 6) AS added, round(sum(x * y0), 6) AS hadamard, round(sum(CASE WHEN y IS NOT NULL THEN x ELSE 0 END), 6) AS projected,
  round(sum(x - y0), 6) AS subtracted, round(sum(3 * x), 6) AS scaled
FROM p WHERE vec_id IN (SELECT vec_id FROM l) AND vec_id IN (SELECT vec_id FROM u) GROUP BY vec_id""")
def vec_algebra(spark, sf_dir):
    total = lambda m: F.round(F.aggregate(F.array_sort(F.map_entries(m)), F.lit(0.0), lambda s, e: s + e["value"]), 6)
    r = lambda c: F.round(c, 6)
    return _pairs(spark, sf_dir).select(
        "vec_id", r(V.dot("v", "u")).alias("dot"), r(V.cosine_distance("v", "u")).alias("cosine"), r(V.norm("v", 1)).alias("norm1"), r(V.norm("v")).alias("norm2"),
        r(V.maximum("v")).alias("top"), total(V.add_scaled("v", "u", 0.5)).alias("added"), total(V.multiply_pointwise("v", "u")).alias("hadamard"),
        total(V.project("v", "u")).alias("projected"), total(V.subtract("v", "u")).alias("subtracted"), total(V.scale("v", 3.0)).alias("scaled"),
    )


@query(f"""WITH {_LONG}
SELECT vec_id, count(*) FILTER (abs(x) >= 1e-10)::INT AS size, count(*) FILTER (k = 3 AND abs(x) >= 1e-10) > 0 AS has3,
  round(sum(x) FILTER (k = 3), 6) AS at3, arg_max(k::VARCHAR, x) AS first, round(sum(CASE WHEN k = 3 THEN 7 ELSE x END), 6) AS replaced,
  round(sum(CASE WHEN k = 3 THEN 0 ELSE x END), 6) AS deleted, round(sum(x) + 1.5, 6) AS bumped FROM l GROUP BY vec_id""")
def vec_coordinates(spark, sf_dir):
    total = lambda m: F.round(F.aggregate(F.array_sort(F.map_entries(m)), F.lit(0.0), lambda s, e: s + e["value"]), 6)
    v = "v"
    return _vectors(spark, sf_dir).select(
        "vec_id", V.size(V.prune(v)).alias("size"), V.contains(v, "3").alias("has3"), F.round(V.get(v, "3"), 6).alias("at3"), V.keys_by_value(v, 1)[0].alias("first"),
        total(V.set_coordinate(v, "3", 7.0)).alias("replaced"), total(V.delete_coordinate(v, "3")).alias("deleted"), total(V.add_to_coordinate(v, "5", 1.5)).alias("bumped"),
    )


@query(f"""WITH {_LONG},
s AS (SELECT vec_id, abs(x) AS a, sum(abs(x)) OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, k) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, k) AS r FROM l),
t AS (SELECT vec_id, greatest(0, max((c - 1) / r) FILTER (a > (c - 1) / r)) AS theta FROM s GROUP BY vec_id)
SELECT vec_id, round(sum(greatest(a - theta, 0)), 6) AS mass, count(*) FILTER (a - theta >= 1e-10)::INT AS size FROM s JOIN t USING (vec_id) GROUP BY vec_id""")
def l1_projection(spark, sf_dir):
    p = _vectors(spark, sf_dir).select("vec_id", V.l1_project("v", 1.0).alias("p"))
    return p.select("vec_id", F.round(V.norm("p", 1), 6).alias("mass"), V.size("p").alias("size"))


@query("""SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, round(exp(-value / 100) / power(1 + exp(-value / 100), 2), 6) AS dsigmoid,
  round(ln(exp(value / 100) + exp(1)), 6) AS lse, round(0.1 / greatest(1, (event_id + 1) / 1000.0), 6) AS rate,
  round(0.1 * power(0.99, greatest(1, (event_id + 1) / 1000.0)), 6) AS rate_exp, abs(value - round(value)) < 1e-10 AS whole FROM events""")
def math_functions(spark, sf_dir):
    v = F.col("value") / 100
    r = lambda c: F.round(c, 6)
    return load(spark, sf_dir, "events").select(
        "event_id", r(M.sigmoid(v)).alias("sigmoid"), r(M.dsigmoid(v)).alias("dsigmoid"), r(M.log_sum_exp(v, 1.0)).alias("lse"),
        r(M.learning_rate("event_id", 0.1, 1000.0)).alias("rate"), r(M.learning_rate("event_id", 0.1, 1000.0, 0.99)).alias("rate_exp"),
        M.near("value", F.round("value")).alias("whole"),
    )


@query("""SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def rel_joins(spark, sf_dir):
    j = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, r_name, c_acctbal FROM customer CROSS JOIN region WHERE c_acctbal > 0")
def rel_cross_tiny(spark, sf_dir):
    return R.cross_tiny(load(spark, sf_dir, "customer"), load(spark, sf_dir, "region")).where("c_acctbal > 0").select("c_custkey", "r_name", "c_acctbal")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT user_id AS k, count(*) AS m FROM events GROUP BY ALL)
SELECT coalesce(o.k, e.k) AS k, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM o FULL JOIN e ON o.k = e.k""")
def rel_full_outer(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    e = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("m"))
    return o.join(e, "k", "full_outer").na.fill(0, ["n", "m"])


@query("SELECT s_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def rel_salted_join(spark, sf_dir):
    sup = load(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    j = R.salted_join(load(spark, sf_dir, "lineitem"), sup, "l_suppkey", 8, "l_orderkey")
    return j.groupBy("s_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders)
WHERE rank <= 3""")
def rel_group_topk(spark, sf_dir):
    return R.top_k(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def rel_topk(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY ALL""")
def rel_union_all(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return R.union_all(a, load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))).groupBy("nationkey").agg(F.count("*").alias("n"))


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)")
def rel_multiset_intersect(spark, sf_dir):
    return R.multiset_intersect(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT user_id, list_aggregate(list_sort(list(event_type)), 'string_agg', ',') AS kinds, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def rel_collect(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("kinds"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT o_orderkey, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::BIGINT AS cum FROM (SELECT o_orderkey, o_orderstatus, 1 AS n FROM orders)""")
def rel_running_sums(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).cast("long").alias("n"))
    return R.running_sums(rows, ["o_orderstatus"], F.col("o_orderkey"), ["n"]).select("o_orderkey", F.col("cum_n").alias("cum"))


def hash_sql(*columns: str, seed: int = 0) -> str:
    """DuckDB's ``relational.hash_unit``."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f"{c}::VARCHAR" for c in columns)})), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"""SELECT event_id, event_type FROM events WHERE {hash_sql('event_id')} < CASE event_type WHEN 'click' THEN 0.5 WHEN 'error' THEN 0.1 ELSE 1 END""")
def rel_sample_by_label(spark, sf_dir):
    return R.sample_by_label(load(spark, sf_dir, "events"), {"click": 0.5, "error": 0.1}, "event_id", "event_type").select("event_id", "event_type")


@query(f"SELECT doc_id, toxic FROM labels WHERE {hash_sql('doc_id', seed=3)} < CASE WHEN toxic < 0.5 THEN 0.25 ELSE 0.9 END")
def rel_binary_sample(spark, sf_dir):
    return R.binary_sample(load(spark, sf_dir, "labels"), 0.25, 0.9, id="doc_id", label="toxic", seed=3).select("doc_id", "toxic")


@query(f"SELECT floor({hash_sql('doc_id')} * 5)::INT AS fold, count(*) AS n FROM documents GROUP BY ALL")
def xval_fold_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(R.folds("doc_id", 5).alias("fold")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, {hash_sql('o_orderkey', seed=1)} < 0.8 AS training FROM orders")
def rel_split(spark, sf_dir):
    a, b = R.split(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8, 1)
    return a.withColumn("training", F.lit(True)).unionByName(b.withColumn("training", F.lit(False)))
