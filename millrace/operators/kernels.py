"""``trainers.Learner`` on arrays, over Arrow batches: features are numbered as they come, an instance costs a few vector
operations, and large batches are summed block by block, so that memory holds a model and one block of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMALL = 1e-10
#: Rows from which a batch is summed as blocks, where its steps don't depend on each other.
BLOCK = 64
#: Parameters in a batch that a task gives back.
OUT = 200_000


class Vocabulary:
    """Numbers of features, in the order in which they come."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def encode(self, names: pa.Array) -> np.ndarray:
        coded = names.dictionary_encode()
        ids = self.ids
        table = np.fromiter((ids.setdefault(f, len(ids)) for f in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return table[coded.indices.to_numpy(zero_copy_only=False)]


class ArrayLearner:
    """The model and the optimizer's state of one class. Rows are (number, value) arrays, each number once in a row.

    Penalties are lazy, as in ``Learner``: with p the product of all (1 - rate * gauss) up to a tick and s the sum of
    rate / p, a weight catches up by p[now] * (|w| / p[then] - laplace * (s[now] - s[then])), whatever the time between.
    """

    def __init__(self, config, epoch: int = 0):
        self.c, self.epoch, self.tick = config, epoch, 0
        self.lazy = (config.laplace > 0 or config.gauss > 0) and config.optimizer != "ftrl"
        self.w = np.zeros(0)
        self.last = np.zeros(0, np.int64)
        self.g2, self.z, self.n, self.total = (np.zeros(0) for _ in range(4))
        self.present, self.touched = np.zeros(0, bool), np.zeros(0, bool)
        self.base, self.p, self.s = 0, np.ones(1), np.zeros(1)
        self.batch, self.parts = 0, []

    def grow(self, size: int) -> None:
        if size <= len(self.w):
            return
        room = max(1024, size + size // 2) - len(self.w)
        names = ["w", "total", "touched"]
        names += ["last"] if self.lazy else []
        names += ["g2"] if self.c.optimizer in ("adagrad", "control") else ["z", "n"] if self.c.optimizer == "ftrl" else []
        names += ["present"] if self.c.frozen else []
        for k in names:
            old = getattr(self, k)
            setattr(self, k, np.concatenate([old, np.zeros(room, old.dtype)]))

    def load(self, at: np.ndarray, weights: np.ndarray) -> None:
        self.w[at] = weights
        if self.c.frozen:
            self.present[at] = True

    def rate(self, t):
        f = np.maximum(1.0, (t + 1) / self.c.examples_per_epoch)
        return np.maximum(0.0, self.c.rate / f if self.c.exponential_base is None else self.c.rate * self.c.exponential_base**f)

    # penalties

    def _advance(self) -> None:
        if self.lazy and self.c.optimizer != "adagrad":
            i = self.tick - self.base
            r = float(self.rate(self.tick))
            q = 1 - r * self.c.gauss
            if q <= 0:  # each step may change signs: no closed form
                self._caught_up(np.flatnonzero(self.w))
                self.tick += 1
                w = self.w * q
                self.w = self._pruned(np.copysign(np.maximum(0.0, np.abs(w) - r * self.c.laplace), w))
                self._rebase()
                return
            if i + 2 > len(self.p):
                self.p, self.s = np.resize(self.p, 2 * len(self.p) + 64), np.resize(self.s, 2 * len(self.s) + 64)
            self.p[i + 1] = self.p[i] * q
            self.s[i + 1] = self.s[i] + r / self.p[i + 1]
            self.tick += 1
            if self.p[i + 1] < 1e-100:
                self._caught_up(np.flatnonzero(self.w))
                self._rebase()
        else:
            self.tick += 1

    def _rebase(self) -> None:
        self.last[:] = self.tick
        self.base, self.p, self.s = self.tick, np.ones(64), np.zeros(64)

    def _pruned(self, w: np.ndarray) -> np.ndarray:
        return np.where(np.abs(w) < SMALL, 0.0, w)

    def _caught_up(self, at: np.ndarray) -> np.ndarray:
        """The weights at these numbers, penalties applied."""
        w = self.w[at]
        if not self.lazy:
            return w
        then = self.last[at]
        late = (w != 0) & (then < self.tick)
        if late.any():
            size = np.abs(w)
            if self.c.optimizer == "adagrad":
                rate, k = self.c.rate / np.sqrt(1.0 + self.g2[at]), self.tick - then
                if self.c.gauss:
                    shrink = rate * self.c.gauss
                    if (shrink[late] >= 1).any():
                        return self._stepwise(at, w, rate, k)
                    kept = k * np.log1p(-np.where(late, shrink, 0.0))
                    size = size * np.exp(kept) + self.c.laplace / self.c.gauss * np.expm1(kept)
                else:
                    size = size - k * rate * self.c.laplace
            else:
                i, now = np.maximum(then - self.base, 0), self.tick - self.base
                size = self.p[now] * (size / self.p[i] - self.c.laplace * (self.s[now] - self.s[i]))
            w = np.where(late, np.copysign(np.where(size < SMALL, 0.0, size), w), w)
            self.w[at] = w
            if self.c.frozen:
                self.present[at[late & (w == 0)]] = False
        self.last[at] = self.tick
        return w

    def _stepwise(self, at, w, rate, k) -> np.ndarray:
        for t in range(int(k[w != 0].max())):
            new = w - rate * self.c.gauss * w
            new = self._pruned(np.copysign(np.maximum(0.0, np.abs(new) - rate * self.c.laplace), new))
            w = np.where(t < k, new, w)
        if self.c.frozen:
            self.present[at[(self.w[at] != 0) & (w == 0)]] = False
        self.w[at], self.last[at] = w, self.tick
        return w

    # steps

    def _slopes(self, y, m, norm2):
        """Of labels and margins (numbers or arrays): what the features are multiplied with in the update, without the rate."""
        c, s = self.c, 2 * (y - 0.5)
        if c.optimizer == "passive_aggressive":
            if c.model == "least_squares":
                return (y - m) / (norm2 + 0.5 / c.aggressiveness)
            return s * np.maximum(0.0, 1 - s * m) / (norm2 + 0.5 / c.aggressiveness)
        if c.model == "logistic_regression":
            return s / (np.exp(np.minimum(s * m, 700.0)) + 1)
        if c.model in ("perceptron", "linear_svm"):
            return np.where(s * m <= (1.0 if c.model == "linear_svm" else 0.0), s, 0.0)
        if c.model == "mira":
            return np.where(norm2 > 0, s * np.maximum(0.0, 1 - s * m) / np.where(norm2 > 0, norm2, 1.0), 0.0)
        return -2 * (m - y)

    def _slope(self, y: float, w: np.ndarray, v: np.ndarray) -> float:
        """``_slopes`` of one row. Where the margin is compared with a number, its sum is exact, so that ties fall as in ``Learner``."""
        c, s = self.c, 2 * (y - 0.5)
        m = math.fsum((w * v).tolist()) if c.model in ("perceptron", "linear_svm") else float(w @ v)
        if c.optimizer == "passive_aggressive" or c.model == "mira":
            return float(self._slopes(y, m, float(v @ v)))
        if c.model == "logistic_regression":
            return s / (math.exp(s * m) + 1) if s * m < 700 else 0.0
        if c.model == "least_squares":
            return -2 * (m - y)
        return s if s * m <= (1.0 if c.model == "linear_svm" else 0.0) else 0.0

    def _ftrl_weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        c = self.c
        return np.where(np.abs(z) <= c.laplace, 0.0, -(z - np.copysign(c.laplace, z)) / ((c.ftrl_beta + np.sqrt(n)) / c.ftrl_alpha + c.gauss))

    def _ftrl(self, y: float, at: np.ndarray, v: np.ndarray) -> None:
        if self.c.frozen:
            held = self.w[at] != 0
            at, v = at[held], v[held]
        z, n = self.z[at], self.n[at]
        w = self._ftrl_weights(z, n)
        g = -self._slope(y, w, v) * v
        more = n + g * g
        self.w[at], self.z[at], self.n[at] = w, z + g - (np.sqrt(more) - np.sqrt(n)) / self.c.ftrl_alpha * w, more
        self.touched[at] = True

    def _change(self, y: float, at: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        c = self.c
        k = self._slope(y, w, v)
        if c.optimizer in ("adagrad", "control"):
            g = k * v
            g2 = self.g2[at] + g * g
            self.g2[at] = g2
            return c.rate * g / np.sqrt(1.0 + g2)
        if c.optimizer == "passive_aggressive" or (c.optimizer == "mira" and c.model == "mira"):
            return k * v
        f = max(1.0, (self.epoch + 1) / c.examples_per_epoch)
        return max(0.0, c.rate / f if c.exponential_base is None else c.rate * c.exponential_base**f) * k * v

    def _apply(self, at: np.ndarray, d: np.ndarray) -> None:
        if self.c.frozen:
            held = self.present[at]
            at, d = at[held], d[held]
            self.w[at] += d
        else:
            w = self.w[at] + d
            w[np.abs(w) < SMALL] = 0.0
            self.w[at] = w
        if self.lazy:
            self.last[at] = self.tick

    def _truncate(self) -> None:
        c = self.c
        if not c.period or self.epoch == 0 or self.epoch % c.period:
            return
        at = np.flatnonzero((self.w != 0) & (np.abs(self.w) < c.truncation_threshold))
        w = self.w[at]
        self.w[at] = self._pruned(np.copysign(np.maximum(0.0, np.abs(w) - float(self.rate(self.epoch)) * c.truncation_update), w))
        if c.frozen:
            self.present[at[self.w[at] == 0]] = False

    def add(self, y: float, at: np.ndarray, v: np.ndarray) -> None:
        """A row of the present batch; a full batch changes the model."""
        if self.batch == 0 and self.epoch > 0:
            self._advance()
        if self.c.optimizer == "ftrl":
            self._ftrl(y, at, v)
            self._truncate()
            self.epoch += 1
            return
        d = self._change(y, at, v, self._caught_up(at))
        self._truncate()
        self.epoch += 1
        if self.c.mini_batch_size == 1:
            self._apply(at, d)
            return
        self.total[at] += d
        self.parts.append(at)
        self.batch += 1
        if self.batch == self.c.mini_batch_size:
            self.flush()

    @property
    def blocks(self) -> bool:
        c = self.c
        return c.mini_batch_size >= BLOCK and not c.period and c.optimizer not in ("adagrad", "control", "ftrl")

    def add_block(self, y: np.ndarray, row: np.ndarray, at: np.ndarray, v: np.ndarray) -> None:
        """Rows of one batch at once; ``row`` numbers them from 0."""
        if self.batch == 0 and self.epoch > 0:
            self._advance()
        if self.lazy:
            self._caught_up(np.unique(at))
        m = np.bincount(row, self.w[at] * v, len(y))
        k = self._slopes(y, m, np.bincount(row, v * v, len(y)))
        if not (self.c.optimizer == "passive_aggressive" or (self.c.optimizer == "mira" and self.c.model == "mira")):
            k = k * self.rate(self.epoch + np.arange(len(y)))
        np.add.at(self.total, at, k[row] * v)
        self.touched[at] = True
        self.epoch += len(y)
        self.batch += len(y)
        if self.batch == self.c.mini_batch_size:
            self.flush()

    def flush(self) -> None:
        """The batch's mean change is applied."""
        if self.batch:
            at = np.flatnonzero(self.touched) if self.blocks else np.unique(np.concatenate(self.parts))
            self._apply(at, self.total[at] / self.batch)
            self.total[at] = 0.0
            self.touched[at] = False
            self.batch, self.parts = 0, []

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the parameters, all caught up."""
        if self.c.optimizer == "ftrl":
            at = np.flatnonzero(self.touched)
            self.w[at] = self._ftrl_weights(self.z[at], self.n[at])
        if self.lazy:
            self._caught_up(np.flatnonzero(self.w))
        at = np.flatnonzero(np.abs(self.w) >= SMALL)
        return at, self.w[at]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) of batches in the order of (shard, kind)."""
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("shard").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + b.column("kind").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield int(key[i]) // 2, int(key[i]) % 2, b.slice(i, j - i)


def sparse(rows: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, numbers, values) of the rows; a null value counts as absent."""
    names, values = rows.column("names"), rows.column("values")
    lengths = names.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    names, values = names.flatten(), values.flatten()
    if values.null_count:
        held = values.is_valid()
        kept = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
        offsets, names, values = kept[offsets], names.filter(held), values.filter(held)
    return offsets, vocabulary.encode(names), values.to_numpy(zero_copy_only=False).astype(np.float64)


def rows_into(learners: dict, rows: pa.RecordBatch, vocabulary: Vocabulary) -> None:
    """Instances, in order, into the learner of each class (of '': the label itself)."""
    offsets, at, v = sparse(rows, vocabulary)
    for one in learners.values():
        one.grow(len(vocabulary.ids))
    labels = {k: (rows.column("y") if k == "" else pc.equal(rows.column("class"), k).cast(pa.float64())).to_numpy(zero_copy_only=False) for k in learners}
    lengths = np.diff(offsets)
    for k, one in learners.items():
        y, i = labels[k], 0
        if one.blocks:
            while i < len(y):
                j = min(len(y), i + one.c.mini_batch_size - one.batch)
                a, b = offsets[i], offsets[j]
                one.add_block(y[i:j], np.repeat(np.arange(j - i), lengths[i:j]), at[a:b], v[a:b])
                i = j
        else:
            ends = offsets.tolist()
            for i, label in enumerate(y.tolist()):
                a, b = ends[i], ends[i + 1]
                one.add(label, at[a:b], v[a:b])


def model_into(learners: dict, rows: pa.RecordBatch, vocabulary: Vocabulary) -> None:
    """Parameters (class, names, values) with which the learners start."""
    offsets, at, v = sparse(rows, vocabulary)
    kinds = np.repeat(np.array(rows.column("class").to_pylist(), dtype=object), np.diff(offsets))
    for k, one in learners.items():
        one.grow(len(vocabulary.ids))
        own = kinds == k
        one.load(at[own], v[own])


def table(names: list[str], at: np.ndarray, weights: np.ndarray, columns: dict) -> Iterator[pa.RecordBatch]:
    """(columns..., feature, weight), in batches; ``columns``: name to (value, type), put around the two in the order of names."""
    for i in range(0, len(at), OUT):
        own = at[i : i + OUT]
        held = {"feature": pa.array([names[j] for j in own.tolist()], pa.string()), "weight": pa.array(weights[i : i + OUT])}
        held |= {k: pa.repeat(pa.scalar(x, kind), len(own)) for k, (x, kind) in columns.items()}
        order = [*[k for k in columns if k != "epoch"], "feature", "weight", *(["epoch"] if "epoch" in columns else [])]
        yield pa.RecordBatch.from_arrays([held[k] for k in order], order)
