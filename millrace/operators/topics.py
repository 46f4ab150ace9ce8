"""Topic models: dictionary, documents, E-step, sufficient statistics, M-step. Words are rows (doc, word, n); topics are
(topic, word, p)."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import small, written
from .relational import hash_unit, running_sums

FLOOR = 1e-8
#: Documents whose topics are inferred at a time.
DOCUMENTS = 1000


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def dictionary(words: DataFrame) -> DataFrame:
    """(word, idx) of distinct words in their order, from 0."""
    distinct = words.where("word IS NOT NULL").select("word").distinct().withColumn("one", F.lit(1))
    return running_sums(distinct, [], F.col("word"), ["one"]).select("word", (F.col("cum_one") - 1).cast("long").alias("idx"))


def index_documents(words: DataFrame, words_idx: DataFrame) -> DataFrame:
    """(doc, idxs, counts): a document's words as sorted parallel arrays; words outside the dictionary are left out."""
    rows = words.groupBy("doc", "word").agg(F.sum("n").alias("n")).join(words_idx, "word")
    pairs = F.array_sort(F.collect_list(F.struct("idx", "n")))
    return rows.groupBy("doc").agg(pairs.alias("p")).select("doc", F.col("p.idx").alias("idxs"), F.col("p.n").alias("counts"))


def random_topics(dictionary: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(topic, word, p): 1/V with up to half more or less by a hash, normalised."""
    v = dictionary.count()
    u = hash_unit("word", "topic", seed=seed)
    rows = dictionary.select("word", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("topic"))
    return normalize(rows.select("topic", "word", ((0.5 + u) / max(1, v)).alias("n")))


def normalize(statistics: DataFrame) -> DataFrame:
    """M-step: (topic, word, p) of sums (topic, word, n)."""
    total = statistics.groupBy("topic").agg(F.sum("n").alias("t"))
    return statistics.join(F.broadcast(total), "topic").select("topic", "word", F.try_divide("n", "t").alias("p"))


def word_probability(topics: DataFrame, words: DataFrame) -> DataFrame:
    """(word, topic, p) of all topics for the given words, FLOOR where a topic lacks one."""
    names = topics.select("topic").distinct()
    grid = words.select("word").distinct().crossJoin(F.broadcast(names))
    return grid.join(topics, ["topic", "word"], "left").select("word", "topic", F.coalesce("p", F.lit(FLOOR)).alias("p"))


def e_step(words: DataFrame, topics: DataFrame, alpha: float = 0.1, tolerance: float = 1e-3, most: int = 100) -> DataFrame:
    """(doc, topic, gamma, word, n, phi): a document's topic weights, and for each of its words the topics' parts.

    gamma starts at N/K + alpha and is updated until its square change is below ``tolerance``. Words come with their
    topic probabilities by a join, so no task needs the whole topic table."""
    k = topics.select("topic").distinct().count()
    kind = words.schema["doc"].dataType.simpleString()

    def run(batches):
        for doc, at, word, n, gamma, phi in _inferred(batches, k, alpha, tolerance, most):
            r, t = pa.array(np.repeat(np.arange(len(n)), k)), np.tile(np.arange(k, dtype=np.int32), len(n))
            columns = [doc.take(pa.array(at)).take(r), pa.array(t), pa.array(gamma[at].ravel()), word.take(r), pa.array(np.repeat(n, k)), pa.array(phi.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "topic", "gamma", "word", "n", "phi"])

    rows = words.groupBy("doc", "word").agg(F.sum("n").cast("double").alias("n"))
    return _documents(rows, topics, k).mapInArrow(run, f"doc {kind}, topic int, gamma double, word string, n double, phi double")


def _documents(rows: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """(doc, words): a document's words in their order, with n and the probability in each topic."""
    per_word = topics.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.col("topic").cast("int"), "p"))).alias("m"))
    floor = F.lit(FLOOR)
    p = F.array(*[F.greatest(F.coalesce(F.try_element_at("m", F.lit(t)), floor), floor) for t in range(k)])
    held = rows.join(small(per_word.select("word", p.alias("p"))), "word")
    return held.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("word", "n", "p"))).alias("words"))


def _inferred(batches, k: int, alpha: float, tolerance: float, most: int):
    """(documents, document of each word, words, n, gamma, phi) of a few documents at a time; all of them take a step at
    once, and each stays as it is when its own change is small."""
    for whole in batches:
        for i in range(0, whole.num_rows, DOCUMENTS):
            b = whole.slice(i, DOCUMENTS)
            lists = b.column("words")
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            word, n, p = lists.flatten().flatten()
            n = n.to_numpy(zero_copy_only=False)
            p = p.flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)
            gamma = np.repeat(alpha + np.bincount(at, n, b.num_rows)[:, None] / k, k, axis=1)
            phi, live, w = np.zeros_like(p), np.ones(b.num_rows, bool), np.arange(len(n))
            for _ in range(most):
                e = np.zeros_like(gamma)
                e[live] = np.exp(digamma(gamma[live]))
                part = p[w] * e[at[w]]
                part /= part.sum(1, keepdims=True)
                phi[w] = part
                new = alpha + np.stack([np.bincount(at[w], n[w] * part[:, t], b.num_rows) for t in range(k)], 1)
                done = ((new - gamma) ** 2).sum(1) < tolerance
                gamma[live] = new[live]
                live &= ~done
                if not live.any():
                    break
                w = w[live[at[w]]]
            yield b.column("doc"), at, word, n, gamma, phi


def topic_proportions(e: DataFrame) -> DataFrame:
    """(doc, topic, gamma)."""
    return e.groupBy("doc", "topic").agg(F.first("gamma").alias("gamma"))


def statistics(e: DataFrame, topics_per_word: int | None = None, topic: int | None = None) -> DataFrame:
    """(topic, word, n): sums of n * phi; of each word of a document only its largest ``topics_per_word`` parts,
    renormalised, or only one topic's."""
    rows = e
    if topics_per_word is not None:
        by = Window.partitionBy("doc", "word")
        rows = rows.withColumn("r", F.row_number().over(by.orderBy(F.desc("phi"), "topic"))).where(F.col("r") <= topics_per_word)
        rows = rows.withColumn("phi", F.col("phi") / F.sum("phi").over(by))
    if topic is not None:
        rows = rows.where(F.col("topic") == topic)
    return rows.groupBy("topic", "word").agg(F.sum(F.col("n") * F.col("phi")).alias("n"))


def merge_statistics(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("topic", "word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, k: int, iters: int = 10, alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """(topic, word, p) after ``iters`` rounds of E- and M-steps from random topics."""
    held = written(words.groupBy("doc", "word").agg(F.sum("n").cast("double").alias("n")))
    topics = written(random_topics(held.select("word").distinct(), k, seed))

    def run(batches):
        """A word's sums over a few documents."""
        for _, _, word, n, _, phi in _inferred(batches, k, alpha, 1e-3, 100):
            coded = word.dictionary_encode()
            at, v = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            sums = np.stack([np.bincount(at, n * phi[:, t], v) for t in range(k)])
            columns = [pa.array(np.repeat(np.arange(k, dtype=np.int32), v)), pa.concat_arrays([coded.dictionary] * k), pa.array(sums.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["topic", "word", "n"])

    for _ in range(iters):
        parts = _documents(held, topics, k).mapInArrow(run, "topic int, word string, n double")
        topics = written(normalize(merge_statistics(parts)))
    return topics
