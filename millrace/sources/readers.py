"""Sources and sinks: tables, separated values, labelled text lines, feature lines, mail parts, models, HTML reports."""

from __future__ import annotations

import html as _html
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let

VECTOR = T.MapType(T.StringType(), T.DoubleType())
MODEL = T.StructType([
    T.StructField("param", T.StructType([T.StructField("vector", VECTOR), T.StructField("freezeKeySet", T.BooleanType())])),
    T.StructField("modelType", T.StringType()), T.StructField("epoch", T.LongType()),
])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, of it only ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab-separated values without a header."""
    return spark.read.csv(path, sep="\t", schema=schema)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t")


def labelled_lines(lines: DataFrame, names: list[str], value: str = "value", separator: str = "\t") -> DataFrame:
    """(label, features) of lines of numbers, one for each name, and a class at the end. Lines of another shape go."""
    parts = F.split(F.col(value), separator)
    numbers = F.transform(F.slice(parts, 1, len(names)), lambda x: x.try_cast("double"))
    rows = lines.where(F.size(parts) == len(names) + 1).select(parts[len(names)].alias("label"), numbers.alias("x"))
    return rows.where(~F.exists("x", lambda x: x.isNull())).select(
        "label", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "x").alias("features")
    )


def parse_feature_line(line: Column | str) -> Column:
    """Struct (label, importance, id, features) of ``label [importance [tag]] |ns f:v f ...`` lines.

    A feature without a value weighs 1, one whose value isn't a number is skipped, repeated ones add up; with a
    namespace the key is ``ns___f``. A namespace's own weight and the importance don't scale anything.
    """
    line = F.col(line) if isinstance(line, str) else line
    cut = F.instr(line, "|")
    head = F.split(F.trim(F.when(cut > 0, F.substring(line, F.lit(1), cut - 1)).otherwise(line)), "\\s+")
    body = F.when(cut > 0, F.substring(line, cut, F.length(line))).otherwise(F.lit(""))
    empty = F.array().cast("array<struct<key:string,value:double>>")

    def features(section: Column) -> Column:
        return let(F.split(section, "\\s+"), lambda words: let(namespace(F.get(words, F.lit(0))), lambda ns: of_words(words, ns)))

    def cut_at_colon(w: Column, name: Callable[[Column], Column], value: Callable[[Column], Column]) -> tuple[Column, Column]:
        """``name`` and ``value`` of the parts around the last colon that has something on both sides, null without one. A
        pattern is searched only where the text ends with a colon or has line ends of Unicode."""
        tail = F.substring_index(w, ":", -1)
        room = F.length(w) - F.length(tail)
        odd = (tail == "") | w.rlike("[\\x{85}\\x{2028}\\x{2029}]")
        pair = w.rlike("^.+:.+$")
        split = lambda plain, group: F.when(odd, F.when(pair, F.regexp_extract(w, "^(.+):(.+)$", group))).when(room > 1, plain)
        return name(split(F.left(w, room - 1), 1)), value(split(tail, 2))

    def namespace(first: Column) -> Column:
        return F.when(F.instr(first, ":") == 0, first).otherwise(F.coalesce(cut_at_colon(first, lambda n: n, lambda v: v)[0], first))

    def of_words(words: Column, ns: Column) -> Column:
        def feature(w: Column) -> Column:
            name, value = cut_at_colon(w, lambda n: F.coalesce(n, w), lambda v: F.when(v.isNull(), F.lit(1.0)).otherwise(v.try_cast("double")))
            key = lambda n: F.when(ns == "", n).otherwise(F.concat(ns, F.lit("___"), n))
            plain = F.struct(key(w).alias("key"), F.lit(1.0).alias("value"))
            return F.when(F.instr(w, ":") == 0, plain).otherwise(F.struct(key(name).alias("key"), value.alias("value")))

        rest = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w != "")
        return F.filter(F.transform(rest, feature), lambda e: e["value"].isNotNull())

    sections = let(F.split(body, "\\|"), lambda s: F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))))
    entries = F.aggregate(F.transform(sections, features), empty, lambda a, b: F.concat(a, b))
    return F.struct(
        F.get(head, F.lit(0)).alias("label"),
        F.coalesce(F.get(head, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("importance"),
        F.coalesce(F.get(head, F.lit(2)), F.lit("")).alias("id"),
        merge_entries(entries).alias("features"),
    )


def merge_entries(entries: Column) -> Column:
    """Map of key-value structs whose values of equal keys add up."""
    held = F.sort_array(entries)  # equal keys are neighbours: one pass over their runs

    def runs(es: Column) -> Column:
        starts = F.filter(F.transform(es, lambda e, i: F.when((i == 0) | (e["key"] != F.get(es, i - 1)["key"]), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(es))), lambda a, b: run(es, a, b)))

    def run(es: Column, a: Column, b: Column) -> Column:
        total = F.aggregate(F.slice(es, a + 1, b - a), F.lit(0.0), lambda s, e: s + e["value"])
        return F.struct(F.get(es, a)["key"].alias("key"), total.alias("value"))

    empty = F.create_map().cast("map<string,double>")
    return let(held, lambda es: F.when(F.size(es) > 0, F.map_from_entries(runs(es))).otherwise(empty))


def parse_mail_parts(parts: Column | str) -> Column:
    """Struct (text, kind) of a JSON list of {type, body}: the text/plain bodies joined by blanks, else the text/html
    ones; kind is 'plain', 'html', or 'filter' with a null text where there is neither or the JSON is broken."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    got = F.from_json(parts, T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    of = lambda kind: F.transform(F.filter(got, lambda p: F.try_element_at(p, F.lit("type")) == kind), lambda p: F.try_element_at(p, F.lit("body")))
    plain, htm = of("text/plain"), of("text/html")
    kind = F.when(F.size(plain) > 0, "plain").when(F.size(htm) > 0, "html").otherwise("filter")
    body = F.when(F.size(plain) > 0, F.array_join(plain, " ")).when(F.size(htm) > 0, F.array_join(htm, " "))
    return F.struct(body.alias("text"), kind.alias("kind"))


def model_to_json(model: DataFrame, model_type: str, epoch: int = 0) -> DataFrame:
    """(class, json) of a model table (class, feature, weight): one line for each class."""
    vector = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "weight"))))
    return model.groupBy("class").agg(vector.alias("vector")).select(
        "class",
        F.to_json(F.struct(
            F.struct(F.col("vector"), F.lit(False).alias("freezeKeySet")).alias("param"), F.lit(model_type).alias("modelType"),
            F.lit(epoch).cast("long").alias("epoch"),
        )).alias("json"),
    )


def model_from_json(rows: DataFrame, json: str = "json", most_chars: int = 200_000_000) -> DataFrame:
    """(class, feature, weight, model_type, epoch) of JSON models (and their ``class`` column, if there is one).
    Escaping slashes are dropped; models that can't be parsed give no rows, one longer than ``most_chars`` is an error."""
    long = F.raise_error(F.lit(f"a model has more than {most_chars} characters"))
    held = rows.withColumn(json, F.when(F.length(json) > most_chars, long.cast("string")).otherwise(F.col(json)))
    label = F.col("class") if "class" in rows.columns else F.lit("")
    plain = F.when(F.col(json).rlike(r'^\s*\{\\"'), F.regexp_replace(json, r"\\(.)", "$1")).otherwise(F.col(json))
    got = held.select(label.alias("class"), F.from_json(plain, MODEL).alias("m"))
    return got.select("class", F.explode("m.param.vector").alias("feature", "weight"), F.col("m.modelType").alias("model_type"), F.col("m.epoch").alias("epoch"))


def write_prediction_report(
    predictions: DataFrame, path: str, label: str = "label", prediction: str = "prediction", text: str = "supporting_data",
    only_label: float | None = None, most: int = 1000,
) -> int:
    """An HTML page of predictions, coloured by how far they are from the label (32 shades); returns the rows shown."""
    rows = predictions if only_label is None else predictions.where(F.col(label) == only_label)
    shade = F.least(F.floor(F.abs(F.col(prediction) - F.col(label)) * 32), F.lit(31)).alias("shade")
    shown = rows.select(F.col(label).alias("l"), F.col(prediction).alias("p"), F.col(text).cast("string").alias("t"), shade).limit(most).collect()
    lines = []
    for r in shown:
        s = int(r["shade"] or 0)
        colour = f"rgb({min(255, 8 * s)},{255 - 8 * s},96)"
        lines.append(f'<tr style="background:{colour}"><td>{r["l"]}</td><td>{(r["p"] if r["p"] is not None else float("nan")):.4f}</td><td>{_html.escape(r["t"] or "")}</td></tr>')
    Path(path).write_text("<html><body><table>\n" + "\n".join(lines) + "\n</table></body></html>\n", encoding="utf-8")
    return len(shown)
