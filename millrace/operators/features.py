"""Instance builders: rows (id, label, features map<string,double>, weight, supporting_data) out of terms, ids and numbers.

Every builder adds to coordinates; a key is the term, or ``namespace___term``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions import vectors as V
from ..sources.staging import small, written

SEPARATOR = "___"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _empty() -> Column:
    return F.create_map().cast("map<string,double>")


def key(term: Column, namespace: str | None = None) -> Column:
    return term if not namespace else F.concat(F.lit(namespace + SEPARATOR), term)


class FeatureBuilder:
    """Collects expressions of one instance: ``FeatureBuilder().term("lang", ns="l").numbers("embedding", ns="e").build()``.

    The ``set_...`` methods are aliases that add, too. ``features`` is an expression of all; nulls add nothing.
    """

    def __init__(self, features: Column | str | None = None):
        self.features = _empty() if features is None else F.coalesce(_c(features), _empty())

    def vector(self, v: Column | str) -> "FeatureBuilder":
        return FeatureBuilder(V.add(self.features, F.coalesce(_c(v), _empty())))

    def term(self, term: Column | str, weight: Column | float = 1.0, ns: str | None = None) -> "FeatureBuilder":
        t = _c(term)
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        return self.vector(F.when(t.isNotNull(), F.create_map(key(t, ns), w)))

    def terms(self, terms: Column | str, weight: float = 1.0, ns: str | None = None) -> "FeatureBuilder":
        """Each element of an array; repeated ones add up."""
        held = F.filter(_c(terms), lambda x: x.isNotNull())
        return self.vector(F.transform_keys(TK.counts(held, weight), lambda k, _: key(k, ns)))

    def weighted_terms(self, terms: Column | str, ns: str | None = None) -> "FeatureBuilder":
        return self.vector(F.transform_keys(_c(terms), lambda k, _: key(k, ns)))

    def numbers(self, values: Column | str, ns: str | None = None) -> "FeatureBuilder":
        """An array of numbers under their indices."""
        entries = F.transform(_c(values), lambda x, i: F.struct(key(i.cast("string"), ns).alias("key"), F.coalesce(x.cast("double"), F.lit(0.0)).alias("value")))
        return self.vector(F.map_from_entries(entries))

    def id(self, id: Column | str, weight: Column | float = 1.0, ns: str | None = None) -> "FeatureBuilder":
        return self.term(_c(id).cast("string"), weight, ns)

    def ids(self, ids: Column | str, weight: float = 1.0, ns: str | None = None) -> "FeatureBuilder":
        return self.terms(_c(ids).cast("array<string>"), weight, ns)

    set_term, set_terms, set_weighted_terms, set_numbers, set_id, set_ids = term, terms, weighted_terms, numbers, id, ids

    def put(self, name: str, value: Column | float) -> "FeatureBuilder":
        """Replaces a coordinate."""
        return FeatureBuilder(V.set_coordinate(self.features, name, value))

    def update(self, name: str, value: Column | float) -> "FeatureBuilder":
        """Adds to a coordinate."""
        return FeatureBuilder(V.add_to_coordinate(self.features, name, value))

    def build(self) -> Column:
        return self.features


def instances(
    df: DataFrame, id: Column | str, label: Column | str | None, features: Column | FeatureBuilder,
    weight: Column | float = 1.0, supporting_data: Column | str | None = None,
) -> DataFrame:
    """The canonical instance rows; without ``label`` the label is null."""
    vec = features.build() if isinstance(features, FeatureBuilder) else features
    return df.select(
        _c(id).alias("id"), (F.lit(None).cast("double") if label is None else _c(label)).alias("label"), vec.alias("features"),
        (weight if isinstance(weight, Column) else F.lit(float(weight))).alias("weight"),
        (F.lit(None).cast("string") if supporting_data is None else _c(supporting_data).cast("string")).alias("supporting_data"),
    )


def one_vs_rest(rows: DataFrame, category: str) -> DataFrame:
    """Multiclass instances as binary ones of one category."""
    return rows.withColumn("label", (F.col("label") == category).cast("double"))


def long_form(rows: DataFrame, *extra: str) -> DataFrame:
    """(id, extra..., feature, value): a row for each coordinate. Of an inner explode Spark infers a filter, which would work
    out the features twice more."""
    return rows.select("id", *extra, F.explode_outer("features").alias("feature", "value")).where("feature IS NOT NULL")


def coordinates(vector: Column | str, keys: list[Column], fallback: list[Column]) -> Column:
    """Array of (feature, value) of the named coordinates, zeros too; of a null name or value, the value in ``fallback``."""
    pairs = [F.struct(k.alias("feature"), F.when(k.isNull() | f.isNull(), f).otherwise(V.get(vector, k)).alias("value")) for k, f in zip(keys, fallback)]
    return F.array(*pairs)


def term_counts(df: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, feature, value): how often each token occurs; the counting is done where the tokens are, without a shuffle."""
    return df.select(F.col(id).alias("id"), F.explode(TK.counts(tokens)).alias("feature", "value"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(feature, df) over instances."""
    return rows.select(F.explode(F.map_keys("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))


def keep_frequent(long: DataFrame, more_than: int) -> DataFrame:
    """Of long-form rows (id, feature, ...) those of features that more than ``more_than`` ids have."""
    frequent = long.groupBy("feature").agg(F.count_distinct("id").alias("df")).where(F.col("df") > more_than).select("feature")
    return long.join(frequent, "feature", "left_semi")


def keep_frequent_features(rows: DataFrame, more_than: int) -> DataFrame:
    """Instances whose vectors keep only features that more than ``more_than`` instances have. The list of features is
    broadcast while small; beyond that the vectors are exploded, joined and rebuilt."""
    kept = document_frequency(rows).where(F.col("df") > more_than).select("feature")
    # written, as numbers made again by a retried task could name other rows
    thin = written(rows.withColumn("nth", F.monotonically_increasing_id()))
    long = thin.select("nth", F.explode("features").alias("feature", "value")).join(small(kept), "feature", "left_semi")
    vec = long.groupBy("nth").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("new"))
    return thin.join(vec, "nth", "left").withColumn("features", F.coalesce("new", _empty())).drop("nth", "new")
