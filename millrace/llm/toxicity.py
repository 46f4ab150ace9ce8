"""Toxicity by a counterfactual-regularised classifier.

A linear model scores windows (sentences, long ones in pieces) by hashed words and beginnings of words; a document's score
is that of its worst window. It is trained on labelled documents: of a toxic one the window that scores highest is taken
to be toxic, of a clean one no window is. In each labelled window identity terms are swapped for all others, and the
square of the change of the score is penalised, so that naming a group weighs nothing by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bounded_sample, pick, slices, utf8

LOG_SIZE = 18
PREFIXES = (6, 7)
WINDOW = 32
#: Labelled documents of each class that training takes at most (a bound on what the driver collects), all if there are fewer.
SAMPLE, SEED = 1500, 53
PENALTY = 4.0
RIDGE = 1e-3
#: Least likelihood-ratio statistic by which a feature must tell labelled toxic documents from clean ones to get a weight.
EVIDENCE = 20.0
#: Names of groups, and neutral words for people that they are swapped with, too.
IDENTITY = (
    "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners americans "
    "africans asians europeans arabs mexicans germans black white gay lesbian transgender straight disabled blind deaf elderly "
    "young femmes hommes juifs musulmans frauen juden muslime mujeres hombres people persons everyone neighbours"
).split()
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def window_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x features) indices, the window of each word, and the text of each window."""
    words = Words(data, offsets)
    if not len(words.start):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.cumsum(_BREAK[data])
    part = breaks[words.start]
    new = np.append(True, (part[1:] != part[:-1]) | (words.row[1:] != words.row[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
    new |= place % WINDOW == 0
    return _features(words), np.cumsum(new) - 1, words.row[new]


def _features(words: Words) -> np.ndarray:
    hashes = [words.hashes()] + [words.prefix_hashes(n) * np.uint64(2 * n + 1) for n in PREFIXES]
    return np.stack([(h >> np.uint64(64 - LOG_SIZE)).astype(np.int32) for h in hashes], axis=1)


def term_features(terms: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(terms, pa.string()))
    return _features(Words(data, offsets))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float

    def windows(self, features: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Score of each window: the sum of its distinct words' weights."""
        if not len(window):
            return np.zeros(0)
        out = np.full(int(window[-1]) - int(window[0]) + 1, float(self.bias))
        value = self.weights[features].sum(1, dtype=np.float64)
        some = np.flatnonzero(value)
        at, value = window[some] - window[0], value[some]
        # few words weigh anything; of those, repetitions in a window count once
        _, once = np.unique(at.astype(np.int64) << LOG_SIZE | features[some, 0], return_index=True)
        np.add.at(out, at[once], value[once])
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each text, -inf without a word."""
        features, window, row = window_features(data, offsets)
        out = np.full(len(offsets) - 1, -np.inf)
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[first]] = np.maximum.reduceat(self.windows(features, window), first)
        return out


def _distinct(features: np.ndarray) -> np.ndarray:
    return features[np.sort(np.unique(features[:, 0], return_index=True)[1])]


def swap_weights(windows: list[np.ndarray], share: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """(terms x terms) weights of the swaps: each identity term of a window is swapped for each term that the window doesn't
    name; a window's ``share`` is spread evenly over its swaps. Windows are the features of their distinct words."""
    known = {tuple(t): k for k, t in enumerate(terms.tolist())}
    out = np.zeros((len(terms), len(terms)))
    for f, s in zip(windows, share):
        own = {known[r] for r in map(tuple, f[np.isin(f[:, 0], terms[:, 0])].tolist()) if r in known}
        if 0 < len(own) < len(known):
            other = [k for k in known.values() if k not in own]
            out[np.ix_(sorted(own), other)] += s / (len(own) * len(other))
    return out


def counterfactual_loss(weights: np.ndarray, terms: np.ndarray, swaps: np.ndarray) -> float:
    """The mean over windows' swaps of the squared change of the score: a swap changes it by the terms' difference."""
    value = weights[terms].sum(1)
    return float((swaps * (value[:, None] - value[None, :]) ** 2).sum())


def _fit(windows: list[np.ndarray], y: np.ndarray, share: np.ndarray, start: np.ndarray, bias: float, terms: np.ndarray, may: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression over windows' features with the counterfactual penalty, by Newton steps solved with conjugate
    gradients: the loss is convex, so its least is found whatever the start."""
    flat = np.concatenate([f.ravel() for f in windows]).astype(np.int64)
    sizes = np.array([f.size for f in windows])
    swaps = swap_weights(windows, share, terms) if len(terms) else np.zeros((0, 0))
    laplace = np.diag(swaps.sum(0) + swaps.sum(1)) - swaps - swaps.T
    used, local = np.unique(np.concatenate([flat, terms.ravel().astype(np.int64)]), return_inverse=True)
    flat, term = local[: len(flat)], local[len(flat) :].reshape(terms.shape)
    # only features that may weigh anything count; the last variable is the bias
    n = len(used)
    free = np.append(may[used], True)
    owner = np.repeat(np.arange(len(windows)), sizes)[free[flat]]
    flat = flat[free[flat]]

    def times(v):  # the windows' scores
        return v[n] + np.bincount(owner, v[flat], len(windows))

    def back(r):
        return np.append(np.bincount(flat, r[owner], n), r.sum()) * free

    def pull(v):  # half the gradient of the penalty
        return np.append(np.bincount(term.ravel(), np.repeat(laplace @ v[:n][term].sum(1), term.shape[1]), n), 0.0) * free if len(terms) else np.zeros(n + 1)

    ridge = np.append(np.full(n, RIDGE), 1e-6)

    def loss(v):
        margin = times(v)
        value = v[:n][term].sum(1) if len(terms) else np.zeros(0)
        return (share * (np.logaddexp(0, margin) - y * margin)).sum() + penalty * value @ laplace @ value + 0.5 * (ridge * v * v).sum()

    v = np.append(start[used], bias) * free
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(times(v), -50, 50)))
        gradient = back((p - y) * share) + 2 * penalty * pull(v) + ridge * v
        if np.abs(gradient).max() < 1e-7:
            break
        curve = share * p * (1 - p)
        step, left = np.zeros(n + 1), -gradient
        way, size = left.copy(), left @ left
        least = 1e-6 * size
        for _ in range(60):
            bent = back(curve * times(way)) + 2 * penalty * pull(way) + ridge * way
            a = size / (way @ bent)
            step, left = step + a * way, left - a * bent
            new = left @ left
            if new <= least:
                break
            way, size = left + new / size * way, new
        now, slope, t = loss(v), gradient @ step, 1.0
        while loss(v + t * step) > now + 1e-4 * t * slope and t > 1e-6:
            t /= 2
        v = v + t * step
    out = np.zeros_like(start)
    out[used] = v[:n]
    return out, float(v[n])


def fit(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, penalty: float = PENALTY, identity: tuple[str, ...] | list[str] = tuple(IDENTITY), rounds: int = 5, seed: int = SEED) -> Model:
    """The model of documents given as (features, window of each word). A fifth of them only sets the threshold; with fewer
    than 50, or none toxic or none clean in that fifth, all of them train it and set it."""
    rng = np.random.default_rng(seed)
    size = 1 << LOG_SIZE
    hold = np.arange(len(texts)) % 5 == 0
    if len(texts) < 50 or not toxic[hold].any() or toxic[hold].all():
        hold[:] = False
    held_in = np.flatnonzero(~hold)
    df = np.zeros((2, size))
    for i in held_in:
        df[int(toxic[i])][np.unique(texts[i][0])] += 1
    n = np.maximum(1, [(toxic[held_in] == 0).sum(), (toxic[held_in] == 1).sum()])
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    share = n[1] / n.sum()
    total = np.maximum(df.sum(0), 1)
    evidence = 2 * (df[1] * np.log(np.maximum(df[1], 1e-9) / (total * share)) + df[0] * np.log(np.maximum(df[0], 1e-9) / (total * (1 - share))))
    telling = (odds > 0) & (evidence >= EVIDENCE)
    model = Model(np.where(telling, odds, 0.0), -3.0, 0.0)
    start, bias = np.zeros(size), 0.0
    terms = term_features(list(identity)) if len(identity) else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    may = telling.copy()
    may[terms] = True
    for _ in range(rounds):
        windows, y = [], []
        for i in held_in:
            features, window = texts[i]
            if not len(features):
                continue
            scores = model.windows(features, window)
            edges = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            stops = np.append(edges[1:], len(window))
            take = [int(scores.argmax())]
            if not toxic[i]:
                take += rng.integers(0, len(edges), 3).tolist()
            for k in dict.fromkeys(take):
                windows.append(_distinct(features[edges[k] : stops[k]]))
                y.append(float(toxic[i]))
        y = np.array(y)
        if not len(y):
            break
        share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        start, bias = _fit(windows, y, share, start, bias, terms, may, penalty)
        model = Model(start, bias, 0.0)
    check = np.flatnonzero(hold) if hold.any() else np.arange(len(texts))
    judge = Model(model.weights.copy(), model.bias, 0.0)
    if penalty and len(terms):
        # no threshold may lie between the terms: each counts as their mean, so that what is left of their difference decides nothing
        value = judge.weights[terms].sum(1)
        np.add.at(judge.weights, terms.ravel(), np.repeat((value.mean() - value) / terms.shape[1], terms.shape[1]))
    scores = np.array([judge.windows(*texts[i]).max(initial=-np.inf) for i in check]).round(6)
    model.weights = model.weights.astype(np.float32)
    model.threshold = _threshold(scores, toxic[check])
    return model


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """Where precision and recall are best together (F0.5); inf where no text is toxic."""
    if not y.any():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    n = np.arange(1, len(s) + 1)
    precision, recall = hit / n, hit / y.sum()
    f = 1.25 * precision * recall / np.maximum(0.25 * precision + recall, 1e-12)
    f[np.append(s[1:] == s[:-1], False)] = 0
    k = int(f.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) and np.isfinite(s[k + 1]) else float(s[k])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, seed: int = SEED, penalty: float = PENALTY, identity=tuple(IDENTITY)) -> Model:
    """Trained on a bounded sample of labelled documents, at most ``sample`` of each class, whole. Rows with a null id, text
    or label are left out, and labels other than 0 and 1; of an id with several labels the largest counts, and each of its
    texts has it. Without any, the model finds nothing."""
    marks = pick(labels, id=id, toxic=toxic).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = bounded_sample(marks.where("toxic IN (0, 1)"), "toxic", ["id"], 2 * sample, seed)
    chosen = F.broadcast(marks)  # 4 x sample narrow rows at most, whatever the tables' sizes
    rows = pick(docs, id=id, text=text).where("text IS NOT NULL").join(chosen, "id").select("id", "text", "toxic")
    rows = bounded_sample(rows, "toxic", ["id", "text"], sample, seed)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i in range(batch.num_rows):
                features, window, _ = window_features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([features.astype("<i4").tobytes()]), pa.array([window.astype("<i4").tobytes()])],
                    ["id", "toxic", "features", "window"],
                )

    got = sorted(rows.mapInArrow(run, "id long, toxic int, features binary, window binary").collect(), key=lambda r: (r["id"], len(r["features"]), bytes(r["features"])))
    texts = [(np.frombuffer(r["features"], "<i4").reshape(-1, 1 + len(PREFIXES)), np.frombuffer(r["window"], "<i4")) for r in got]
    return fit(texts, np.array([r["toxic"] for r in got], int), penalty, identity, seed=seed)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())])


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, toxic): a row for each row; score is the worst window's, less the threshold.

    Null texts and texts without a word have a null score and aren't toxic. Whole texts count. Rows with null or repeated ids
    are each judged. An empty table gives an empty result; other columns are dropped. The model (1 MB) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                got = found.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                over = np.where(np.isfinite(got), got - found.threshold, -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.round(over, 6), mask=~np.isfinite(over)), pa.array(over > 0)],
                    ["doc_id", "score", "toxic"],
                )

    return pick(docs, doc_id=id, text=text).mapInArrow(run, SCHEMA)


def toxic_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(doc_id, score) of the documents above the threshold of a model trained on the labels; see ``train``, ``score``."""
    return score(docs, train(docs, labels, id, text, toxic), id, text).where("toxic").select("doc_id", "score")
