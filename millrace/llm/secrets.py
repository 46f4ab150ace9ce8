"""Secret scans by character Markov models.

Two models of order 2, one of random strings and one of ordinary identifiers, are trained from labelled samples. In each
run of token characters, the segments whose log-likelihood ratio of the two is largest are found; those above the
threshold are secrets.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import TOKENIZER, read_ranks
from .common import pick, slices, utf8

#: Characters of candidates; the index after the last stands for what is before a run.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/"
LEAST = 16
SAMPLES, SEED = 20_000, 29
_PAD = len(ALPHABET)
_CLASS = np.full(256, 255, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CLASS[ord(_c)] = _i


def labelled_samples(n: int = SAMPLES, seed: int = SEED, vocabulary: str = TOKENIZER) -> tuple[list[str], list[int]]:
    """``n`` random strings (label 1) and ``n`` ordinary identifiers and words (label 0), by a seeded generator.

    Ordinary ones are made of a vocabulary's pieces in the manners of code and prose, and of numbers, dates and rules."""
    rng = random.Random(seed)
    hexa, low, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", ALPHABET[:62]
    kinds = [hexa, hexa, hexa.upper(), alnum, alnum, alnum + "-_", alnum + "+/", low, low.upper(), alnum[:26] + alnum[52:], alnum[26:]]
    secret = ["".join(rng.choices(rng.choice(kinds), k=rng.choice((16, 20, 24, 32, 36, 40, 40, 48, 64)))) for _ in range(n)]
    pieces = [t.strip().decode("ascii") for t in read_ranks(vocabulary) if t.strip().isalpha() and t.isascii()]
    pieces = [p for p in pieces if len(p) > 1 and (p.islower() or p.istitle())]
    plain = []
    for _ in range(n):
        parts = rng.choices(pieces, k=rng.randint(2, 6))
        form = rng.randrange(12)
        if form < 3:
            s = "".join(parts).lower()
        elif form == 3:
            s = "".join(p.capitalize() for p in parts)
        elif form == 4:
            s = "_".join(parts).lower() + rng.choice(("", "", str(rng.randrange(1000))))
        elif form == 5:
            s = "-".join(parts) + rng.choice(("", str(rng.randrange(100))))
        elif form == 6:
            s = "/".join(parts).lower() + rng.choice(("", "/"))
        elif form == 7:
            s = "_".join(parts).upper()
        elif form == 8:
            s = str(rng.randrange(10 ** rng.randint(8, 24)))
        elif form == 9:
            s = f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}" + rng.choice(("", "-" + str(rng.randrange(10**6))))
        elif form == 10:
            s = "".join(parts).upper() if rng.random() < 0.5 else rng.choice(parts).lower() * rng.randint(3, 8)
        else:
            s = rng.choice(("-", "_", "+", "/", "0", "x", "a", "1", "-+", "ab")) * rng.randint(8, 40)
        plain.append(s)
    return secret + plain, [1] * n + [0] * n


class Markov:
    """Counts of order 2 with smoothing by those of order 1, and these by the uniform distribution."""

    def __init__(self, texts: list[str]):
        m = _PAD + 1
        codes = []
        for t in texts:
            c = _CLASS[np.frombuffer(t.encode("utf-8"), np.uint8)]
            codes += [np.array([_PAD, _PAD], np.uint8), c[c != 255]]
        s = np.concatenate(codes).astype(np.int64) if codes else np.zeros(0, np.int64)
        a, b, c = s[:-2], s[1:-1], s[2:]
        real = c != _PAD
        one = np.bincount((b * m + c)[real], minlength=m * m).reshape(m, m).astype(float)
        two = np.bincount(((a * m + b) * m + c)[real], minlength=m**3).reshape(m, m, m).astype(float)
        one = (one + 0.5) / (one + 0.5).sum(1, keepdims=True)
        self.log = np.log((two + 8 * one[None, :, :]) / (two.sum(2, keepdims=True) + 8))


class Detector:
    """``table``: log-likelihood ratio of a character after two others; ``threshold``: least of a secret's sum."""

    def __init__(self, table: np.ndarray, threshold: float):
        self.table, self.threshold = table, threshold

    @classmethod
    def train(cls, texts: list[str], labels: list[int], held_out: int = 5, false_rate: float = 1e-3) -> "Detector":
        """Trained on all samples but each ``held_out``-th; of these, at most ``false_rate`` of the ordinary ones pass
        the threshold, which is 12 nats at least."""
        fit = [i for i in range(len(texts)) if i % held_out]
        table = (Markov([texts[i] for i in fit if labels[i]]).log - Markov([texts[i] for i in fit if not labels[i]]).log).astype(np.float32)
        out = cls(table, 0.0)
        plain = [texts[i] for i in range(0, len(texts), held_out) if not labels[i]]
        gains = sorted(out.best(t) for t in plain) or [0.0]
        out.threshold = max(12.0, gains[min(len(gains) - 1, int(len(gains) * (1 - false_rate)))] + 1e-3)
        return out

    def ratios(self, codes: np.ndarray) -> np.ndarray:
        a = np.concatenate([[_PAD, _PAD], codes[:-2]])[: len(codes)]
        b = np.concatenate([[_PAD], codes[:-1]])[: len(codes)]
        return self.table[a, b, codes].astype(float)

    def best(self, text: str) -> float:
        """Largest sum of ratios over a segment of a string of token characters."""
        codes = _CLASS[np.frombuffer(text.encode("utf-8"), np.uint8)]
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(codes[codes != 255]))])
        return float((sums - np.minimum.accumulate(sums)).max())

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, stop, score) of the secrets in texts' bytes, in order."""
        code = _CLASS[data]
        inside = code != 255
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        bounds = offsets[:-1][(offsets[:-1] < len(data)) & (offsets[1:] > offsets[:-1])]
        first[bounds] = inside[bounds]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[ends] = inside[ends]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = stop - start >= LEAST
        start, stop = start[long], stop[long]
        if not len(start):
            return []
        size = stop - start
        at = np.cumsum(size) - size
        where = np.repeat(start - at, size) + np.arange(int(size.sum()))
        c = code[where].astype(np.int64)
        b, a = np.concatenate([[_PAD], c[:-1]]), np.concatenate([[_PAD, _PAD], c[:-2]])[: len(c)]
        b[at] = a[at] = _PAD
        a[at[size > 1] + 1] = _PAD
        ratio = self.table[a, b, c].astype(float)
        # each run's sums lie below all of the run before, so one running minimum serves all runs
        sums = np.cumsum(ratio)
        before = sums - ratio
        base = before[at]
        drop = 1.0 + 2 * float(np.add.reduceat(np.abs(ratio), at).max())
        level = np.repeat(-base - drop * np.arange(len(at)), size)
        gain = sums + level - np.minimum.accumulate(before + level)
        hits = np.flatnonzero(np.maximum.reduceat(gain, at) >= self.threshold)
        out = []
        for k in hits.tolist():
            here = slice(int(at[k]), int(at[k] + size[k]))
            self._segments(ratio[here], c[here] < 62, int(start[k]), out)
        return out

    def _segments(self, ratio: np.ndarray, alnum: np.ndarray, base: int, out: list) -> None:
        """The best segment of a run, widened to whole alphanumeric words, and those left and right of it."""
        breaks = np.flatnonzero(~alnum)
        todo, found = [(0, len(ratio))], []
        while todo:
            i, j = todo.pop()
            if j - i < LEAST:
                continue
            sums = np.concatenate([[0.0], np.cumsum(ratio[i:j])])
            gain = sums - np.minimum.accumulate(sums)
            end = int(gain.argmax())
            begin = int(sums[: end + 1].argmin())
            if gain[end] < self.threshold:
                continue
            begin, end, score = i + begin, i + end, float(gain[end])
            k = int(np.searchsorted(breaks, begin))
            if alnum[begin]:
                begin = max(i, int(breaks[k - 1]) + 1 if k else 0)
            k = int(np.searchsorted(breaks, end - 1))
            end = min(j, (int(breaks[k]) if k < len(breaks) else j) if alnum[end - 1] else end)
            if end - begin >= LEAST:
                found.append((base + begin, base + end, score))
            todo += [(i, begin), (end, j)]
        out += sorted(found)


_detectors: dict[tuple, Detector] = {}


def detector(n: int = SAMPLES, seed: int = SEED, vocabulary: str = TOKENIZER) -> Detector:
    """Trained from the generator's samples, once in a process."""
    key = (n, seed, vocabulary)
    if key not in _detectors:
        _detectors[key] = Detector.train(*labelled_samples(n, seed, vocabulary))
    return _detectors[key]


def train_on(samples: DataFrame, text: str = "text", label: str = "label", most: int = 200_000) -> Detector:
    """Trained from a table of labelled samples (label 1: random), at most about ``most`` rows of it: a larger table is
    sampled with a fixed seed. Rows with a null are left out."""
    rows = pick(samples, text=text, label=label).where("text IS NOT NULL AND label IS NOT NULL")
    n = rows.count()
    if n > most:
        rows = rows.sample(fraction=most / n, seed=SEED)
    got = sorted((r["text"], int(r["label"])) for r in rows.collect())
    random.Random(SEED).shuffle(got)
    return Detector.train([t for t, _ in got], [y for _, y in got])


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("secret", T.StringType()), T.StructField("score", T.DoubleType()),
])


def secret_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", model: Detector | None = None) -> DataFrame:
    """(doc_id, start, stop, secret, score) of each secret, in bytes of the text's UTF-8; score is the ratio in nats.

    A secret is at least 16 characters of A-Z a-z 0-9 _ - + / that random strings explain better than identifiers; a
    run of such characters may hold several; of segments with the same sum the one that ends, then begins first counts. Null and empty texts have none; rows with null or repeated ids are each
    scanned. Whole texts are scanned however long. An empty table gives an empty result; other columns are dropped.
    The model (1.2 MB, whatever the data) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or detector())

    def run(batches):
        found = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 1 << 20):
                raw, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hits = found.scan(raw, part)
                starts = np.array([h[0] for h in hits], np.int64)
                rows = np.searchsorted(part, starts, "right") - 1
                stops = np.array([h[1] for h in hits], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array((starts - part[rows]).astype(np.int32)),
                        pa.array((stops - part[rows]).astype(np.int32)),
                        pa.array([raw[h[0] : h[1]].tobytes().decode("ascii") for h in hits], pa.string()),
                        pa.array([round(h[2], 3) for h in hits], pa.float64()),
                    ],
                    ["doc_id", "start", "stop", "secret", "score"],
                )

    return pick(docs, doc_id=id, text=text).mapInArrow(run, SCHEMA)
