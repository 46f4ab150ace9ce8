"""Mixing sources to target weights by hierarchical budgets.

The token budget flows down a tree domain - language - source by the weights of its nodes. A node never gets more than
its leaves can give (their tokens times the number of epochs allowed): what it can't use goes to its siblings first, by
their weights, and only what no sibling can use goes up to be shared among the siblings of the parent. Each leaf then
yields whole epochs and a token-prefix of one more, whose order is a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, position, small, written

#: Weights of the tree's nodes; a node that isn't named weighs 1. Domains are the source's number modulo 4.
DOMAIN_WEIGHTS = {"0": 4.0, "1": 3.0, "2": 2.0, "3": 1.0}
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
SOURCE_WEIGHTS = {"src0": 2.0}
BUDGET = 1.0  # of all tokens there are
MAX_EPOCHS = 4
SEED = 17
LEVELS = ("domain", "lang", "source")


def words(text: Column) -> Column:
    """Number of runs of characters other than blanks and line ends, which are said as ranges: quicker than a negated class."""
    return F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f!-\\x{10FFFF}]+")).cast("bigint")


def source_domain(source: Column) -> Column:
    """Domain of a source by the number in its name: 'other' if there is none."""
    number = F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    return F.coalesce((number % 4).cast("int").cast("string"), F.lit("other"))


def _weight(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, float(w)).otherwise(out)
    return out


def share(nodes: DataFrame, parents: list[str], key: str, weight: Column, budget: str, cap: str, out: str) -> DataFrame:
    """Adds ``out``: each node's part of its parent's ``budget``, in proportion to weights but at most ``cap``.

    The level up to which all siblings are filled is the largest of (budget less the caps of those that fill up sooner)
    over (weights of the rest), in the order of cap over weight; nodes with the same ratio fill up together, whatever
    their order. Nodes of weight 0 get nothing.
    """
    w = weight.cast("double")
    by = Window.partitionBy(*parents).orderBy(F.col("ratio").asc_nulls_last(), key)
    rows = nodes.withColumn("w", F.greatest(w, F.lit(0.0))).withColumn("ratio", F.try_divide(cap, "w"))
    rows = rows.withColumn("c", F.when(F.col("w") > 0, F.col(cap)).otherwise(0.0))
    before = F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.try_divide(F.col(budget) - before, rest))
    level = F.max("level").over(Window.partitionBy(*parents))
    rows = rows.withColumn(out, F.coalesce(F.least(F.col("c"), level * F.col("w")), F.lit(0.0)))
    return rows.drop("w", "ratio", "c", "level")


def leaf_budgets(
    leaves: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
    domain_weights: dict = DOMAIN_WEIGHTS, language_weights: dict = LANGUAGE_WEIGHTS, source_weights: dict = SOURCE_WEIGHTS,
) -> DataFrame:
    """(domain, lang, source, tokens, epochs, rest) of ``leaves`` (domain, lang, source, tokens): whole epochs and the
    tokens of the partial one. Its size is that of the tree; the windows hold one row for each leaf. What a node of
    weight 0 or less holds counts for none of its ancestors' caps, so its share goes to siblings that can use it."""
    open_to = lambda column, weights, cap: F.when(_weight(column, weights) > 0, cap).otherwise(0.0)
    leaf = leaves.withColumn("cap", open_to("source", source_weights, F.col("tokens").cast("double") * max_epochs))
    lcap = open_to("lang", language_weights, F.sum("cap").over(Window.partitionBy("domain", "lang")))
    leaf = leaf.withColumn("lcap", lcap)
    langs = leaf.groupBy("domain", "lang").agg(F.first("lcap").alias("lcap"), F.sum("tokens").alias("ltokens"))
    domains = langs.groupBy("domain").agg(F.sum("lcap").alias("dcap"), F.sum("ltokens").alias("dtokens"))
    domains = domains.withColumn("dcap", open_to("domain", domain_weights, F.col("dcap")))
    total = Window.partitionBy(F.lit(1))
    domains = domains.withColumn("want", F.least(F.sum("dcap").over(total), F.sum("dtokens").over(total) * float(budget)))
    domains = share(domains.withColumn("root", F.lit(1)), ["root"], "domain", _weight("domain", domain_weights), "want", "dcap", "dget")
    langs = langs.join(domains.select("domain", "dget"), "domain")
    langs = share(langs, ["domain"], "lang", _weight("lang", language_weights), "dget", "lcap", "lget")
    leaf = leaf.join(langs.select("domain", "lang", "lget"), ["domain", "lang"])
    leaf = share(leaf, ["domain", "lang"], "source", _weight("source", source_weights), "lget", "cap", "get")
    get = F.floor(F.col("get") + 1e-6)
    return leaf.select(
        *LEVELS, "tokens", F.floor(get / F.col("tokens")).cast("int").alias("epochs"), (get % F.col("tokens")).cast("bigint").alias("rest")
    )


def _order(id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit("null"))))


def plan(rows: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """For each leaf of ``rows`` (id, domain, lang, source, tokens): (leaf, epochs, last, last_take).

    Of the partial epoch, documents are taken up to the key ``last``, of that one ``last_take`` tokens. The prefix is
    found among buckets of keys first (4096 for each leaf), then inside the one bucket where it ends, so no window
    holds more than a 4096th of a leaf.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    budgets = written(leaf_budgets(leaves, **options))
    keyed = rows.join(small(budgets.drop("tokens")), list(LEVELS)).where("rest > 0")
    keyed = keyed.withColumn("key", _order(F.col("id"), F.col("epochs"), seed)).withColumn("bucket", F.substring("key", 1, 3))
    buckets = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    along = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("start", F.sum("held").over(along) - F.col("held"))
    edge = written(buckets.where("start < rest AND start + held >= rest").select(*LEVELS, "bucket", "start"))
    inside = keyed.join(small(edge), [*LEVELS, "bucket"]).groupBy(*LEVELS, "key").agg(
        F.sum("tokens").alias("held"), F.first("rest").alias("rest"), F.first("start").alias("start")
    )
    along = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("before", F.col("start") + F.sum("held").over(along) - F.col("held")).where("before < rest")
    last = inside.groupBy(*LEVELS).agg(
        F.max("key").alias("last"), F.max_by(F.col("rest") - F.col("before"), "key").alias("last_take")
    )
    return written(budgets.select(*LEVELS, "epochs").join(last, list(LEVELS), "left"))


def _leaf_columns(docs: DataFrame, text: str, id: str, lang: str, source: str) -> DataFrame:
    rows = pick(docs, id=id, text=text, lang=lang, source=source)
    none = F.lit("(null)")
    return rows.select(
        "id", source_domain(F.col("source")).alias("domain"), F.coalesce("lang", none).alias("lang"),
        F.coalesce("source", none).alias("source"), F.coalesce(words(F.col("text")), F.lit(0)).alias("tokens"),
    ).where("tokens > 0")


def mixture(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", seed: int = SEED, **options
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, take): the documents of the mixture, once for each epoch.

    ``take`` is less than ``tokens`` only where the prefix of a leaf's last epoch ends. A null language or source is the
    name "(null)". Documents without a token (null or blank texts) are never selected. Rows with the same id share a
    place in the order: all of them are taken or none (null ids count as one). An empty table gives an empty result.
    """
    rows = written(_leaf_columns(docs, text, id, lang, source))
    steps = plan(rows, seed, **options)
    rows = rows.join(small(steps), list(LEVELS))
    rows = rows.withColumn("key", _order(F.col("id"), F.col("epochs"), seed))
    whole = rows.where("epochs > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), F.col("tokens").alias("take")
    )
    part = rows.where("key <= last").select(
        "*", F.col("epochs").alias("epoch"),
        F.when(F.col("key") < F.col("last"), F.col("tokens")).otherwise(F.least("tokens", "last_take")).alias("take"),
    )
    return whole.unionByName(part).select(F.col("id").alias("doc_id"), *LEVELS, "epoch", "tokens", "take")


def mix_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", seed: int = SEED, **options
) -> DataFrame:
    """``docs`` as the mixture has them: all columns, a row for each epoch that takes it.

    Where the prefix of a leaf's last epoch ends inside a document, its text ends after as many words as the budget has
    left. Texts aren't shuffled: each row is compared with the plan of its leaf. Rows with the same id share a place in
    the order, and a cut at that place cuts each of them; documents without a word (null or blank texts) never appear.
    A null language or source is a leaf of its own, and stays null in the result. An empty table gives an empty result.
    """
    steps = plan(written(_leaf_columns(docs, text, id, lang, source)), seed, **options)
    names = docs.columns
    at = {k: F.col(f"in{position(docs, c)}") for k, c in (("id", id), ("text", text), ("lang", lang), ("source", source))}
    plain = docs.toDF(*[f"in{i}" for i in range(len(names))])
    plain = plain.withColumn("domain", source_domain(at["source"])).withColumn("lang", F.coalesce(at["lang"], F.lit("(null)")))
    plain = plain.withColumn("source", F.coalesce(at["source"], F.lit("(null)"))).where(at["text"].rlike("[^ \\t\\r\\n]"))
    taken = plain.join(small(steps), list(LEVELS)).withColumn("key", _order(at["id"].cast("bigint"), F.col("epochs"), seed))
    part = F.coalesce(F.col("key") <= F.col("last"), F.lit(False))
    taken = taken.withColumn("n", F.col("epochs") + part.cast("int")).where("n > 0").withColumn(
        "cut", F.when(part & (F.col("key") == F.col("last")), F.col("last_take"))
    )
    taken = taken.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    ends = F.col("cut").isNotNull() & (F.col("copy") == F.col("n"))
    cut = F.when(ends, first_words(at["text"], F.col("cut"))).otherwise(at["text"])
    place = position(docs, text)
    return taken.select(*[cut.alias(f"in{i}") if i == place else F.col(f"in{i}") for i in range(len(names))]).toDF(*names)


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word, whole if it has no more words."""
    lead = text.rlike("^[ \\t\\r\\n]").cast("bigint")
    parts = F.split(text, "[ \\t\\r\\n]+", (F.least(n, F.lit(1 << 30)) + lead + 1).cast("int"))
    more = F.size(parts) > n + lead
    kept = F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, -1)))
    return F.when(more, F.regexp_replace(kept, "[ \\t\\r\\n]+$", "")).otherwise(text)


def _sql_weight(column: str, weights: dict[str, float]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in weights.items())} ELSE 1.0::DOUBLE END"


def _sql_share(nodes: str, parent: str, key: str, weight: str, budget: str, cap: str, out: str) -> str:
    return f"""(SELECT * EXCLUDE (w, lv), coalesce(least({cap}, max(lv) OVER (PARTITION BY {parent}) * w), 0) AS {out} FROM (
      SELECT *, ({budget} - (sum({cap}) OVER up - {cap})) / nullif(sum(w) OVER down, 0) AS lv
      FROM (SELECT *, greatest({weight}, 0) AS w FROM {nodes})
      WINDOW up AS (PARTITION BY {parent} ORDER BY {cap} / nullif(w, 0) NULLS LAST, {key} ROWS UNBOUNDED PRECEDING),
        down AS (PARTITION BY {parent} ORDER BY {cap} / nullif(w, 0) NULLS LAST, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


def sql(docs: str = "documents") -> str:
    """DuckDB's SQL of ``mixture`` over the table or CTE ``docs``, without its last SELECT: CTE ``mixed``."""
    return f"""
t AS (SELECT doc_id, coalesce((nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '')::BIGINT % 4)::VARCHAR, 'other') AS domain,
    coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
    len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS tokens
  FROM {docs} WHERE len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > 0),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens,
    CASE WHEN {_sql_weight("source", SOURCE_WEIGHTS)} > 0 THEN sum(tokens)::DOUBLE * {MAX_EPOCHS} ELSE 0 END AS cap FROM t GROUP BY domain, lang, source),
lcaps AS (SELECT domain, lang, CASE WHEN {_sql_weight("lang", LANGUAGE_WEIGHTS)} > 0 THEN sum(cap) ELSE 0 END AS lcap, sum(tokens) AS ltokens FROM leaf GROUP BY domain, lang),
dom AS (SELECT *, 1 AS root, least(sum(dcap) OVER (), sum(dtokens) OVER () * {BUDGET}::DOUBLE) AS want
  FROM (SELECT domain, CASE WHEN {_sql_weight("domain", DOMAIN_WEIGHTS)} > 0 THEN sum(lcap) ELSE 0 END AS dcap, sum(ltokens) AS dtokens FROM lcaps GROUP BY domain)),
dom2 AS {_sql_share("dom", "root", "domain", _sql_weight("domain", DOMAIN_WEIGHTS), "want", "dcap", "dget")},
lng AS (SELECT domain, lang, lcap, dget FROM lcaps JOIN dom2 USING (domain)),
lng2 AS {_sql_share("lng", "domain", "lang", _sql_weight("lang", LANGUAGE_WEIGHTS), "dget", "lcap", "lget")},
lf AS (SELECT leaf.*, lget FROM leaf JOIN lng2 USING (domain, lang)),
lf2 AS {_sql_share("lf", "domain, lang", "source", _sql_weight("source", SOURCE_WEIGHTS), "lget", "cap", "got")},
budget AS (SELECT domain, lang, source, floor(floor(got + 1e-6) / tokens)::INT AS epochs, (floor(got + 1e-6) % tokens)::BIGINT AS rest FROM lf2),
keyed AS (SELECT t.*, epochs, rest, md5(concat('{SEED}', ':', epochs::VARCHAR, ':', coalesce(doc_id::VARCHAR, 'null'))) AS key
  FROM t JOIN budget USING (domain, lang, source)),
runs AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM keyed),
mixed AS (
  SELECT * EXCLUDE (epochs), unnest(range(0, epochs))::INT AS epoch, tokens AS take FROM runs
  UNION ALL SELECT * EXCLUDE (epochs), epochs AS epoch, least(tokens, rest - before) AS take FROM runs WHERE before < rest)"""


SQL = f"""WITH {sql()}
SELECT doc_id, domain, lang, source, epoch, tokens::BIGINT AS tokens, take::BIGINT AS take FROM mixed"""
