"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte n-grams predicts it; a text's
language is the one whose codeword has the least loss against all predictions, bits weighted by how well their
classifiers do on held-out texts. Where the second codeword is nearly as near, the text is flagged as ambiguous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_sample, folded, pick, slices, utf8

GRAMS = (1, 2, 3, 4)
LOG_SIZE = 16
#: Labelled texts of each language that training takes at most (a bound on what the driver collects), all if there are fewer.
SAMPLE, SEED = 120, 41
#: A relative difference of losses below which a text is ambiguous, and the n-grams below which any is.
GAP, LEAST_GRAMS = 0.15, 40
_SALT = {1: 0x9E3779B1, 2: 0x85EBCA6B, 3: 0xC2B2AE35, 4: 0x27D4EB2F}


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """``n`` codewords: all bits that split the languages if there are at most 6, else 10 log2 n random ones that are
    far apart, the best of 200 tries."""
    if n <= 6:
        bits = 2 ** (n - 1) - 1 if n > 1 else 1
        return np.array([[1 if i == 0 or (b + 1) >> (i - 1) & 1 == 0 else -1 for b in range(bits)] for i in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    size, best, held = math.ceil(10 * math.log2(n)), -1, None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, size))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > best and (abs(code.sum(0)) < n).all():
            best, held = apart, code
    return held


def gram_indices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams: (positions x sizes) indices, where they are valid, and the row of each position.

    Case is folded, everything but letters and digits is one mark, digits are one, and no n-gram crosses texts."""
    low = folded(data)
    low[(low >= 48) & (low <= 57)] = 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = np.arange(len(low)) - np.repeat(offsets[:-1], np.diff(offsets))
    code = np.zeros(len(low), np.uint32)
    index = np.zeros((len(low), len(GRAMS)), np.uint32)
    valid = np.zeros((len(low), len(GRAMS)), bool)
    wide = low.astype(np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code[n - 1 :] |= wide[: len(low) - n + 1] << np.uint32(8 * (n - 1)) if len(low) >= n else 0
        if n in GRAMS:
            k = GRAMS.index(n)
            index[:, k] = (code + np.uint32(n)) * np.uint32(_SALT[n]) >> np.uint32(32 - LOG_SIZE)
            valid[:, k] = (inner >= n - 1) & (low != 0)
    return index, valid, rows


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    bias: np.ndarray
    trust: np.ndarray  # of the bits, sum 1

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bits) margins, and n-grams of each text."""
        n = len(offsets) - 1
        total = np.zeros((n, self.weights.shape[1]))
        count = np.zeros(n, np.int64)
        if len(data):
            index, valid, _ = gram_indices(data, offsets)
            some = np.flatnonzero(np.diff(offsets) > 0)
            for k in range(index.shape[1]):
                ok = valid[:, k]
                got = self.weights[index[:, k]]
                got[~ok] = 0
                total[some] += np.add.reduceat(got, offsets[some], axis=0, dtype=np.float64)
                count[some] += np.add.reduceat(ok.astype(np.int64), offsets[some])
        return self.bias + total / np.maximum(count, 1)[:, None], count

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword, and the relative difference of the second's loss; of equal losses the language
        that comes first by name counts as the nearest, and the gap is 0."""
        losses = np.stack([np.logaddexp(0, -margins * c) @ self.trust for c in self.code.astype(float)], axis=1)
        first = losses.argmin(1)
        two = np.sort(losses, axis=1)
        gap = (two[:, 1] - two[:, 0]) / two[:, 1] if losses.shape[1] > 1 else np.ones(len(losses))
        return first, gap


def _counted(docs: DataFrame) -> list:
    """(id, lang, grams, counts) of sampled texts."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i in range(batch.num_rows):
                index, valid, _ = gram_indices(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                grams, counts = np.unique(index[valid], return_counts=True)
                one = pa.array([0, len(grams)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.ListArray.from_arrays(one, pa.array(grams.astype(np.int32))),
                     pa.ListArray.from_arrays(one, pa.array(counts.astype(np.int32)))],
                    ["id", "lang", "grams", "counts"],
                )

    return docs.mapInArrow(run, "id long, lang string, grams array<int>, counts array<int>").collect()


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = SEED, rounds: int = 40
) -> Model:
    """Trained on a bounded sample of labelled texts, at most ``sample`` of each language, whole; a fifth of it is held out
    to weigh the bits. With fewer texts than five for each language none is held out, and bits are weighed on the texts
    they were trained on. Rows with a null or empty text or a null language are left out, those with a null or repeated id
    are like others; None if nothing is left. The languages are taken to be few: their numbers go to the driver."""
    rows = pick(docs, id=id, text=text, lang=lang).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    got = sorted(_counted(bounded_sample(rows, "lang", ["id", "text"], sample, seed).select("id", "lang", "text")), key=lambda r: (r["lang"], r["id"] is None, r["id"] or 0, r["grams"], r["counts"]))
    got = [r for r in got if r["grams"]]
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    code = codewords(len(languages), seed)
    target = code[[languages.index(r["lang"]) for r in got]].astype(float)
    sizes = np.array([len(r["grams"]) for r in got])
    starts = np.cumsum(sizes) - sizes
    grams = np.concatenate([np.array(r["grams"], np.int64) for r in got])
    parts = np.concatenate([np.array(r["counts"], float) / sum(r["counts"]) for r in got])
    # rare n-grams get large steps: each is scaled by its own mean frequency
    scale = 1 / np.sqrt(np.bincount(grams, parts, 1 << LOG_SIZE) / len(got) + 1e-5)
    parts = parts * scale[grams]
    docs_of = np.repeat(np.arange(len(got)), sizes)
    fit = np.arange(len(got)) % 5 != 0 if len(got) >= 5 * len(languages) else np.ones(len(got), bool)
    bits = code.shape[1]
    w, b = np.zeros((1 << LOG_SIZE, bits)), np.zeros(bits)
    past_w, past_b = np.full(w.shape, 1e-8), np.full(bits, 1e-8)
    share = np.zeros(len(got))
    for k, name in enumerate(languages):
        own = fit & np.array([r["lang"] == name for r in got])
        share[own] = 1 / max(1, own.sum()) / len(languages)  # languages count alike
    for _ in range(rounds):
        margin = b + np.add.reduceat(parts[:, None] * w[grams], starts, axis=0)
        slope = -target / (1 + np.exp(np.clip(margin * target, -50, 50))) * share[:, None]
        for k in range(bits):
            g = np.bincount(grams, parts * slope[docs_of, k], 1 << LOG_SIZE) + 1e-6 * w[:, k]
            past_w[:, k] += g * g
            w[:, k] -= 0.5 * g / np.sqrt(past_w[:, k])
        g = slope.sum(0)
        past_b += g * g
        b -= 0.5 * g / np.sqrt(past_b)
    margin = b + np.add.reduceat(parts[:, None] * w[grams], starts, axis=0)
    test = ~fit if (~fit).any() else fit
    right = np.clip(((margin * target)[test] > 0).mean(0), 0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right)) + 1e-6
    return Model(languages, code, (w * scale[:, None]).astype(np.float32), b, trust / trust.sum())


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("predicted", T.StringType()), T.StructField("gap", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
])


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", gap: float = GAP) -> DataFrame:
    """(doc_id, predicted, gap, ambiguous): a row for each row. ``gap`` is how much larger the second codeword's loss
    is, as a part of it; a text is ambiguous if that is below ``gap`` or it has fewer than 40 n-grams.

    A null text, one without a letter or digit, or any text where nothing was trained, has a null language and a null
    gap and is ambiguous. Whole texts count. Rows with null or repeated ids are each judged. An empty table gives an empty
    result; other columns are dropped. The model (some MB, by languages) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                n = j - i
                if found is None:
                    first, apart, count = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
                else:
                    margins, count = found.margins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    first, apart = found.decode(margins)
                apart = np.round(apart, 6)
                none = count == 0
                names = np.array(found.languages if found else [""], object)[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n), pa.array(names, pa.string(), mask=none), pa.array(apart, mask=none),
                        pa.array((apart < gap) | (count < LEAST_GRAMS)),
                    ],
                    ["doc_id", "predicted", "gap", "ambiguous"],
                )

    return pick(docs, doc_id=id, text=text).mapInArrow(run, SCHEMA)
