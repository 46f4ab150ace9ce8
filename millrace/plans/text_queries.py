"""Queries of the text and token functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as TK
from ..operators import features as FT
from ..sources.staging import written
from .registry import load, query

W = "[ \\t\\n\\x0B\\f\\r]"


def _re(s: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({s}, '{pattern}', '{to}', 'g')"


def _numbers(s: str) -> str:
    return _re(_re(s, "[0-9]+", "_num_"), f"_num_{W}+_num_", "_num_")


def _wsclean(s: str) -> str:
    return _re(_re(s, "^[\\x00-\\x20]+|[\\x00-\\x20]+$"), f"{W}+", " ")


def _standard(s: str) -> str:
    s = _numbers(_re(_re(s, "<.*?>", " "), "&[^;]+;", " "))
    s = _re(s, "[^a-zA-Z0-9. \\t\\n\\x0B\\f\\r\\-_]+", " ")
    return _wsclean(_re(_re(s, "--+", "--"), "__+", "__"))


def _docs(name: str, column, sql: str) -> None:
    def f(spark, sf_dir):
        return load(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias("out"))

    f.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM documents")(f)


def _pages(name: str, column, sql: str) -> None:
    def f(spark, sf_dir):
        return load(spark, sf_dir, "pages").select("page_id", column(F.col("html")).alias("out"))

    f.__name__ = name
    query(f"SELECT page_id, {sql} AS out FROM pages")(f)


_docs("text_standard_filter", X.standard_filter, _standard("text"))
_docs("text_replace_numbers", X.replace_numbers, _numbers("text"))
_pages("text_html_strip", X.remove_html_tags, _re("html", "<.*?>", " "))
_pages("text_html_tags", X.replace_html_tags, _re("html", "<[^>]+>", " "))
_pages("text_html_escapes", X.replace_html_escapes, _re("html", "&[^;]+;", " "))
_docs("text_non_alpha", X.replace_non_alpha, _re("text", "[^a-zA-Z]+", " "))
_docs("text_non_alnum", X.replace_non_alphanumeric, _re("text", "[^a-zA-Z0-9. \\t\\n\\x0B\\f\\r\\-]+", " "))
_docs("text_non_alnum_underscore", X.replace_non_alphanumeric_underscore, _re("text", "[^a-zA-Z0-9. \\t\\n\\x0B\\f\\r\\-_]+", " "))
_docs("text_collapse_runs", lambda s: X.collapse_periods(X.collapse_underscores(X.collapse_hyphens(s))), _re(_re(_re("text", "--+", "--"), "__+", "__"), "[.][.]+", ".."))
_docs("text_case", lambda s: F.concat(X.upper("lang"), X.lower(s)), "upper(lang) || lower(text)")
_docs("text_strip_punct", X.strip_punctuation, _re(_re("text", "^[^A-Za-z0-9]+"), "[^A-Za-z0-9]+$"))
_docs("text_wsclean", X.wsclean, _wsclean("text"))
_docs("text_strips", lambda s: X.rstrip(X.lstrip(X.collapse(s))), _re(_re(_re("text", f"{W}+", " "), f"^{W}+"), f"{W}+$"))
_docs("text_unprintables", X.remove_unprintables, _re("text", "[^\\x20-\\x7E]"))
_docs("text_collapse_punct", X.collapse_whitespace_and_punctuation, _re(_re(_re("text", f"{W}+", " "), "-+", "-"), "[.]+", "."))
_docs("text_clean_line", X.clean_line, f"lower({_re('text', '[^A-Za-z]', ' ')})")
_MARKS = " +.,~<>$?!:;(){}|\\x08\\t\\n\\f\\r\"''\\\\/=&%_"
_docs(
    "text_clean_line_robust", X.clean_line_robust,
    "array_to_string([w FOR w IN [regexp_replace(regexp_replace(regexp_replace(t, '-{2,}', '-', 'g'), '^-', ''), '-$', '') "
    f"FOR t IN regexp_split_to_array(text, '[{_MARKS}]+')] IF length(w) >= 2], ' ')",
)
_docs(
    "text_clean_text", lambda s: X.clean_text(s, 12),
    f"array_to_string([w || ' ' FOR w IN regexp_split_to_array(text, '[{_MARKS}0-9\\-]+') IF length(w) BETWEEN 2 AND 12], '')",
)
_docs("text_sort_terms", X.sort_terms, f"array_to_string(list_sort(regexp_split_to_array({_re('text', f'{W}+$')}, '{W}+')), ' ')")

_TOK = f"string_split({_standard('lower(text)')}, ' ')"


def _tokens():
    return F.split(X.standard_filter(F.lower("text")), " ")


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


_RAW = "string_split(text, ' ')"


@query(f"""
SELECT doc_id, len(t)::INT AS n, len([x FOR x IN t IF list_contains({_sql_list(TK.STOPWORDS)}, lower(x))])::INT AS stop,
  len([x FOR x IN t IF list_contains({_sql_list(TK.BADWORDS)}, lower(x))])::INT AS bad,
  len([x FOR x IN t IF regexp_matches(x, '{TK.ALL_CAPS}')])::INT AS caps,
  len([x FOR x IN t IF regexp_matches(x, '{TK.CAPITALIZED}')])::INT AS capitalized,
  len([x FOR x IN t IF regexp_matches(x, '{TK.LOWERCASE}')])::INT AS lowercase,
  len([x FOR x IN t IF regexp_matches(x, '{TK.URL}')])::INT AS urls,
  len([x FOR x IN t IF regexp_matches(x, '{TK.listing_pattern("shop")}')])::INT AS listings,
  len([x FOR x IN t IF x <> ''])::INT AS filled,
  round(round(10 * len([x FOR x IN t IF list_contains({_sql_list(TK.STOPWORDS)}, lower(x))])::DOUBLE / len(t)) / 10, 6) AS stop_fraction,
  floor(ln(len(t)))::INT AS size_bin
FROM (SELECT doc_id, {_RAW} AS t FROM documents)""")
def seq_counts(spark, sf_dir):
    t = F.col("t")
    stop = F.size(TK.stopwords(t))
    return load(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("t")).select(
        "doc_id", TK.size(t).alias("n"), stop.alias("stop"), F.size(TK.badwords(t)).alias("bad"),
        F.size(TK.matching(t, TK.ALL_CAPS)).alias("caps"), F.size(TK.matching(t, TK.CAPITALIZED)).alias("capitalized"),
        F.size(TK.matching(t, TK.LOWERCASE)).alias("lowercase"), F.size(TK.matching(t, TK.URL)).alias("urls"),
        F.size(TK.matching(t, TK.listing_pattern("shop"))).alias("listings"), F.size(TK.without_blank(t)).alias("filled"),
        F.round(TK.fraction(stop, t), 6).alias("stop_fraction"), TK.size_bin(t).alias("size_bin"),
    )


@query(f"""
SELECT doc_id, array_to_string([x FOR x IN t IF NOT list_contains({_sql_list(TK.STOPWORDS)}, lower(x))
  AND NOT list_contains({_sql_list(TK.BADWORDS)}, lower(x)) AND NOT regexp_matches(x, '{TK.ALL_CAPS}')], ' ') AS out
FROM (SELECT doc_id, {_RAW} AS t FROM documents)""")
def seq_filters(spark, sf_dir):
    t = TK.without_matching(TK.without_badwords(TK.without_stopwords(F.split("text", " "))), TK.ALL_CAPS)
    return load(spark, sf_dir, "documents").select("doc_id", TK.join(t).alias("out"))


@query(f"""
WITH g AS (SELECT array_to_string([t[i], t[i + 1]], ' ') AS gram FROM (SELECT t, unnest(range(1, greatest(len(t), 2))) AS i
  FROM (SELECT {_TOK} AS t FROM documents)))
SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 100""")
def seq_ngrams_topk(spark, sf_dir):
    grams = load(spark, sf_dir, "documents").select(F.explode_outer(TK.ngrams(_tokens(), 2)).alias("gram")).where("gram IS NOT NULL")
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(100)


@query(f"""
WITH p AS (SELECT doc_id, list_concat([''], {_TOK}, ['']) AS t FROM documents),
g AS (SELECT doc_id, unnest(t) AS gram FROM p UNION ALL
  SELECT doc_id, t[i] || '::' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM p))
SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS kinds, min(gram) AS first, max(gram) AS last FROM g WHERE gram <> '' GROUP BY doc_id""")
def seq_ngrams_upto(spark, sf_dir):
    g = load(spark, sf_dir, "documents").select("doc_id", TK.ngrams_up_to("text", 2).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("kinds"), F.array_min("g").alias("first"), F.array_max("g").alias("last"))


@query("""
SELECT shingle, count(*) AS n FROM (SELECT substring(text, i, 4) AS shingle FROM (
  SELECT text, unnest(range(1, greatest(length(text) - 3, 1) + 1)) AS i FROM conversations WHERE length(text) > 0))
GROUP BY shingle""")
def seq_shingles(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.explode(X.shingles(F.col("text"), 4)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS t FROM conversations),
e AS (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM t),
g AS (SELECT conv_id, turn, t[i] AS gram FROM e UNION ALL SELECT conv_id, turn, t[i - 2] || '_' || t[i - 1] || '_' || t[i] FROM e WHERE i >= 3)
SELECT conv_id, turn, count(*) AS n, min(gram) AS first, max(gram) AS last FROM g GROUP BY ALL""")
def seq_grams(spark, sf_dir):
    g = load(spark, sf_dir, "conversations").select("conv_id", "turn", TK.grams(F.split("text", " "), [1, 3], "_").alias("g"))
    return g.where(F.size("g") > 0).select("conv_id", "turn", F.size("g").cast("long").alias("n"), F.array_min("g").alias("first"), F.array_max("g").alias("last"))


@query("""
WITH t AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations),
c AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY ALL)
SELECT a.conv_id, a.turn, sum(least(a.n, b.n))::INT AS common FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w
GROUP BY ALL""")
def seq_intersect(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.size(TK.intersect("t", "u")).alias("common")).where("common > 0")


@query(f"""
SELECT doc_id AS id, feature, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest({_TOK}) AS feature FROM documents) GROUP BY ALL""")
def feat_term_counts(spark, sf_dir):
    return FT.term_counts(load(spark, sf_dir, "documents"), "doc_id", _tokens())


@query("""
SELECT doc_id, feature, sum(v) AS value FROM (
  SELECT doc_id, 'lang___' || lang AS feature, 1.0::DOUBLE AS v FROM documents
  UNION ALL SELECT doc_id, 'src___' || source, 2.0 FROM documents
  UNION ALL SELECT doc_id, 'id___' || (n_chars % 7)::VARCHAR, 1.0 FROM documents) GROUP BY ALL""")
def feat_namespaced(spark, sf_dir):
    b = FT.FeatureBuilder().term("lang", ns="lang").term("source", 2.0, ns="src").id(F.col("n_chars") % 7, ns="id")
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(b.build()).alias("feature", "value"))


@query("""
SELECT vec_id AS id, 'e___' || (i - 1)::VARCHAR AS feature, embedding[i]::DOUBLE AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE abs(embedding[i]::DOUBLE) >= 1e-10""")
def feat_numeric_array(spark, sf_dir):
    rows = FT.instances(load(spark, sf_dir, "embeddings"), "vec_id", "label", FT.FeatureBuilder().numbers("embedding", ns="e"))
    return FT.long_form(rows)


@query("""
SELECT o_orderkey, feature, sum(v) AS value FROM (
  SELECT l_orderkey AS o_orderkey, 'part___' || l_partkey::VARCHAR AS feature, 1.0::DOUBLE AS v FROM lineitem
  UNION ALL SELECT l_orderkey, l_suppkey::VARCHAR, 0.5 FROM lineitem) GROUP BY ALL""")
def feat_ids(spark, sf_dir):
    grouped = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"), F.collect_list("l_suppkey").alias("s"))
    b = FT.FeatureBuilder().ids("p", ns="part").ids("s", 0.5)
    return grouped.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(b.build()).alias("feature", "value"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOK}) AS feature FROM documents), c AS (SELECT doc_id AS id, feature, count(*)::DOUBLE AS value FROM t GROUP BY ALL)
SELECT * FROM c WHERE feature IN (SELECT feature FROM c GROUP BY feature HAVING count(*) > 20)""")
def feat_df_prune(spark, sf_dir):
    return FT.keep_frequent(written(FT.term_counts(load(spark, sf_dir, "documents"), "doc_id", _tokens())), 20)


@query("""
SELECT 'l' || l_linestatus AS label, l_orderkey AS k, l_linenumber AS line, 'q___qty' AS feature, l_quantity + 1 AS value FROM lineitem
UNION ALL SELECT 'l' || l_linestatus, l_orderkey, l_linenumber, 'q___flag' || l_returnflag, 1.0 FROM lineitem""")
def vw_parse(spark, sf_dir):
    from ..sources.readers import parse_feature_line

    rows = load(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("l"), "l_linestatus", F.lit(" 1.0 tag |q qty:"), F.col("l_quantity").cast("string"), F.lit(" flag"), "l_returnflag", F.lit(" qty:1 broken:x"))
    got = rows.select("l_orderkey", "l_linenumber", parse_feature_line(line).alias("p"))
    # of an inner explode Spark infers a filter, which would parse each line twice more
    return got.select(
        F.col("p.label").alias("label"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.explode_outer("p.features").alias("feature", "value")
    ).where("feature IS NOT NULL")


@query("""
SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user')
  ELSE string_agg(text, ' ' ORDER BY turn) END AS text, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 'plain' ELSE 'html' END AS kind
FROM conversations GROUP BY conv_id""")
def email_body_parse(spark, sf_dir):
    from ..sources.readers import parse_mail_parts

    part = F.struct(F.when(F.col("role") == "user", "text/plain").otherwise("text/html").alias("type"), F.col("text").alias("body"))
    parts = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"])).alias("j"))
    return parts.select("conv_id", F.expr("j").alias("j")).select("conv_id", parse_mail_parts("j").alias("m")).select("conv_id", "m.text", "m.kind")
