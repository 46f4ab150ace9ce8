"""Quality rules: frequency of lines across the documents of a host.

Lines are normalised (digits to 0, white space collapsed, lower case) and hashed; per host, the distinct documents that
hold a line are counted. Lines above the limit are removed, and documents of which too little is left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, pick, position, small, written
from .prob_minhash import near_duplicates

MAX_DOCS = 20
MIN_KEPT = 0.3


def normal_lines(text: Column) -> Column:
    """The lines' normal forms. Digits and blanks are replaced in the whole text, as no such run crosses a line end."""
    digits = F.regexp_replace(text, "[0-9]+", "0")
    blanks = F.regexp_replace(digits, "[ \\t\\r\\f\\x0B]+", " ")
    return F.transform(F.split(F.lower(blanks), "\n", -1), lambda x: F.trim(x))


def _hashes(text: Column) -> Column:
    """Hash of each line's normal form; null for a blank line."""
    return F.transform(normal_lines(text), lambda x: F.when(x != "", F.xxhash64(x)))


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, texts: bool = False) -> DataFrame:
    """(host, line): hashes of the lines that more than ``max_docs`` documents of a host hold.

    Documents are told apart by id, those without an id by their text; with ``texts``, all by their text. Counting goes
    by (host, line, document) first, so a hot host or line is spread before it is summed.
    """
    own = F.xxhash64("text")
    lines = rows.where("text IS NOT NULL").select(
        "host", (own if texts else F.coalesce("id", own)).alias("t"), F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line")
    )
    return (
        lines.where("line IS NOT NULL")
        .groupBy("host", "line")
        .agg(F.countDistinct("t").alias("docs"))
        .where(F.col("docs") > max_docs)
        .select("host", "line")
    )


def _shelves(bad: DataFrame) -> DataFrame:
    """(h, shelves) of frequent lines (host, line): of each host, its lines in an array of arrays, line x in the one at
    place pmod(x, number of arrays), about 8 in each; so looking a line up is quick however many there are."""
    sizes = bad.groupBy("host").agg(F.count("*").alias("n")).select(F.col("host").alias("h"), F.ceil(F.col("n") / 8).cast("bigint").alias("m"))
    placed = bad.join(sizes, bad["host"].eqNullSafe(sizes["h"])).select("h", F.pmod("line", "m").alias("at"), "line")
    every = sizes.select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("at"), F.lit(None).cast("bigint").alias("line"))
    shelf = placed.unionByName(every).groupBy("h", "at").agg(F.collect_list("line").alias("lines"))
    whole = shelf.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "lines"))).alias("s"))
    return whole.select("h", F.transform("s", lambda x: x["lines"]).alias("shelves"))


def _with_bad_lines(rows: DataFrame, bad: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``hash``, the hashes of its lines, and ``bad``, of each line whether it is frequent.

    Up to ``most`` frequent lines are broadcast by host, and texts stay where they are. Beyond it, lines are joined and
    what was found goes back to its row, for which texts are shuffled by id.
    """
    if bad.limit(most + 1).count() <= most:
        joined = rows.join(F.broadcast(_shelves(bad)), F.col("host").eqNullSafe(F.col("h")), "left").withColumn("hash", _hashes(F.col("text")))
        shelf = lambda x: F.get("shelves", F.pmod(x, F.size("shelves")).cast("int"))
        return joined.withColumn("bad", F.transform("hash", lambda x: F.coalesce(F.array_contains(shelf(x), x), F.lit(False))))
    held = rows.select("id", "host", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line"))
    hits = (
        held.join(bad.select(F.col("host").alias("h"), F.col("line").alias("l")), F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
        .groupBy(F.col("id").alias("i"), F.col("host").alias("h"))
        .agg(F.collect_set("line").alias("found"))
    )
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("i")) & F.col("host").eqNullSafe(F.col("h")), "left").withColumn("hash", _hashes(F.col("text")))
    return joined.withColumn("bad", F.transform("hash", lambda x: F.coalesce(F.array_contains("found", x), F.lit(False))))


def without_families(rows: DataFrame, bad: DataFrame, max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """Of the frequent lines ``bad``, those that are frequent even if a family of near copies counts once.

    Only texts that would be rejected for these lines are put into families: of the others enough stays that is their own.
    """
    spots = rows.where("text IS NOT NULL").select(
        F.col("host").alias("h"), F.xxhash64("text").alias("t"), (F.length("text") - F.size(F.split("text", "\n", -1)) + 1).alias("n_all"),
        F.posexplode(F.arrays_zip(_hashes(F.col("text")).alias("hash"), F.transform(F.split("text", "\n", -1), F.length).alias("size"))).alias("at", "l"),
    )
    held = written(
        spots.join(small(bad), spots["h"].eqNullSafe(bad["host"]) & (F.col("l.hash") == bad["line"]))
        .select("h", "t", "n_all", "at", "line", F.col("l.size").alias("size")).distinct()
    )
    gone = held.groupBy("h", "t", "n_all").agg(F.sum("size").alias("gone"))
    depleted = written(gone.where((F.col("n_all") - F.col("gone") < min_kept * F.col("n_all")) | (F.col("n_all") <= F.col("gone"))).select(F.col("t").alias("key")).distinct())
    texts = rows.select(F.xxhash64("text").alias("doc_id"), "text").join(small(depleted), F.col("doc_id") == F.col("key"), "left_semi")
    family = written(near_duplicates(texts.dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("member"), F.col("duplicate_of").alias("family")))
    counted = held.join(small(family), F.col("t") == F.col("member"), "left").withColumn("one", F.coalesce("family", "t"))
    return (
        counted.groupBy(F.col("h").alias("host"), "line")
        .agg(F.countDistinct("one").alias("docs"))
        .where(F.col("docs") > max_docs)
        .select("host", "line")
    )


def _judged(
    docs: DataFrame, id: str, text: str, host: str, more: list[str],
    max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT, families: bool = False, most: int | None = None,
) -> DataFrame:
    """(id, host, kept: the text without frequent lines, n_lines, n_removed, n_chars, extra0 ...: the columns ``more``).

    A document counts once for a line however often it repeats it; rows that share an id are one document, and of those
    without an id each distinct text is. With ``families``, as before deduplication, exact copies count as one document,
    and so do near copies that would be rejected for their lines: else a family vanishes for lines that only it has. A
    document is rejected if fewer than ``min_kept`` of its line characters (line ends aside) are left, or if nothing but
    white space is left; so null, empty and blank texts go. A null host is a host of its own; rows with null or repeated
    ids are each judged by their own text, and equal rows give equal results. More than ``most`` frequent lines are joined
    instead of broadcast.
    """
    rows = pick(docs, id=id, text=text, host=host, **{f"extra{i}": c for i, c in enumerate(more)}).where("text IS NOT NULL")
    bad = written(frequent_lines(rows, max_docs, texts=families))
    if families:
        bad = written(without_families(rows, bad, max_docs, min_kept))
    joined = _with_bad_lines(rows, bad, BROADCAST_ROWS if most is None else most)
    # bound by one-row generators: what a filter on them says isn't worked out again below
    lines = F.split("text", "\n", -1)
    left = F.when(F.exists("bad", lambda x: x), F.filter(lines, lambda x, i: ~F.get("bad", i))).otherwise(lines)
    more_in = [f"extra{i}" for i in range(len(more))]
    bound = joined.select("id", "host", "text", *more_in, F.explode(F.array(left)).alias("left"))
    bound = bound.select(
        "id", "host", *more_in, F.size(lines).alias("n_lines"), F.size("left").alias("n_left"), (F.length("text") - F.size(lines) + 1).alias("n_all"),
        F.explode(F.array(F.array_join("left", "\n"))).alias("kept"),
    )
    return bound.where(
        (F.length("kept") - F.greatest(F.col("n_left"), F.lit(1)) + 1 >= min_kept * F.col("n_all"))
        & F.col("kept").rlike("[^ \\t\\r\\n\\f\\x0B]")
    ).select(
        "id", "host", "kept", "n_lines", (F.col("n_lines") - F.col("n_left")).alias("n_removed"), F.length("kept").cast("bigint").alias("n_chars"), *more_in
    )


def line_quality(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **options) -> DataFrame:
    """Kept documents: (doc_id, source: the host, text without frequent lines, n_lines, n_removed, n_chars), by the rules of
    ``_judged``, whose options these are. Other columns are dropped; an empty table gives an empty result."""
    return _judged(docs, id, text, host, [], **options).select(
        F.col("id").alias("doc_id"), F.col("host").alias("source"), F.col("kept").alias("text"), "n_lines", "n_removed", "n_chars"
    )


def drop_frequent_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` by the same rules: all columns, whatever their names, with what is left of the text and, where there is such
    a column, its length as ``chars``."""
    names = docs.columns
    own = {position(docs, id): "id", position(docs, host): "host", position(docs, text): "kept"}
    if chars in names:
        own[names.index(chars)] = "n_chars"
    others = [i for i in range(len(names)) if i not in own]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {v: f"c{k}" for k, v in own.items()}
    got = _judged(plain, at["id"], at["kept"], at["host"], [f"c{i}" for i in others], **options)
    return got.select(*[F.col(own[i]) if i in own else F.col(f"extra{others.index(i)}") for i in range(len(names))]).toDF(*names)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines,
    list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(
      regexp_replace(x, '[0-9]+', '0', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g')))) AS norms
  FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT source, line FROM (SELECT source, doc_id, text, unnest(norms) AS line FROM d)
  WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'text ' || text)) > {MAX_DOCS}),
p AS (
  SELECT source, list(line) AS bad FROM f GROUP BY source),
k AS (
  SELECT doc_id, d.source, text, len(lines) AS n_lines,
    [lines[i] FOR i IN range(1, len(lines) + 1) IF bad IS NULL OR NOT list_contains(bad, norms[i])] AS kept
  FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, n_lines::INT AS n_lines,
  (n_lines - len(kept))::INT AS n_removed, length(array_to_string(kept, chr(10))) AS n_chars
FROM k
WHERE length(array_to_string(kept, chr(10))) - greatest(len(kept), 1) + 1 >= {MIN_KEPT} * (length(text) - n_lines + 1)
  AND regexp_matches(array_to_string(kept, chr(10)), '[^ \\t\\r\\n\\f\\v]')
"""
