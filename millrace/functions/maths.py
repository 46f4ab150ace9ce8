"""Scalar mathematics of the learners, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def near(a, b, small: float = 1e-10) -> Column:
    return F.abs(_c(a) - _c(b)) < small


def sigmoid(x) -> Column:
    """1 / (1 + exp(-x)), without overflow."""
    x = _c(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dsigmoid(x) -> Column:
    e = F.exp(-F.abs(_c(x)))
    return e / ((1 + e) * (1 + e))


def double_hash(x) -> Column:
    return F.xxhash64(_c(x).cast("double"))


def digamma(x) -> Column:
    """For x > 0: recurrence up to 6 at least, then the asymptotic series."""
    x = _c(x)
    shift = sum((F.when(x + k < 6, 1 / (x + k)).otherwise(0.0) for k in range(6)), F.lit(0.0))
    y = x + sum((F.when(x + k < 6, 1.0).otherwise(0.0) for k in range(6)), F.lit(0.0))
    i = 1 / (y * y)
    return F.ln(y) - 0.5 / y - i * (1 / 12.0 - i * (1 / 120.0 - i * (1 / 252.0 - i * (1 / 240.0 - i * (1 / 132.0))))) - shift


def log_sum_exp(a, b, cutoff: float = 50.0) -> Column:
    """ln(exp(a) + exp(b)); beyond ``cutoff`` nats apart, the larger."""
    a, b = _c(a), _c(b)
    gap = F.abs(a - b)
    return F.greatest(a, b) + F.when(gap > cutoff, 0.0).otherwise(F.log1p(F.exp(-gap)))


def learning_rate(t, rate: float = 0.01, examples_per_epoch: float = 10_000.0, base: float | None = None) -> Column:
    """Rate at step ``t``: rate / f or, with ``base``, rate * base ^ f, where f = max(1, (t + 1) / examples_per_epoch)."""
    f = F.greatest(F.lit(1.0), (_c(t) + 1) / examples_per_epoch)
    return F.greatest(F.lit(0.0), rate / f if base is None else rate * F.pow(F.lit(float(base)), f))
