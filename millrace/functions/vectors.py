"""Algebra of sparse vectors held as ``map<string, double>`` columns; all of it stays Catalyst expressions.

A missing key is 0. Values with magnitude below SMALL count as zero and are pruned by the operations that say so. A null
vector gives a null result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

SMALL = 1e-10


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _d(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def prune(v: Column | str, small: float = SMALL) -> Column:
    """Without zero coordinates."""
    return F.map_filter(_c(v), lambda k, x: F.abs(x) >= small)


def get(v: Column | str, key: Column | str) -> Column:
    """A coordinate, 0 if missing; ``key`` is a Column or a literal string."""
    return F.coalesce(F.try_element_at(_c(v), key if isinstance(key, Column) else F.lit(key)), F.lit(0.0))


def add_scaled(a: Column | str, b: Column | str, scale: Column | float = 1.0, frozen: bool = False) -> Column:
    """a + scale * b, pruned. ``frozen``: the key set of ``a`` can't change, so keys of ``b`` alone are ignored and
    coordinates of ``a`` that become zero stay with value 0."""
    a, b, s = _c(a), _c(b), _d(scale)
    if frozen:
        return let(b, lambda b: F.transform_values(a, lambda k, x: x + s * F.coalesce(F.try_element_at(b, k), F.lit(0.0))))
    return prune(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + s * F.coalesce(y, F.lit(0.0))))


def add(a: Column | str, b: Column | str) -> Column:
    return add_scaled(a, b, 1.0)


def subtract(a: Column | str, b: Column | str) -> Column:
    return add_scaled(a, b, -1.0)


def set_coordinate(v: Column | str, key: str, value: Column | float, frozen: bool = False) -> Column:
    """Replaces a coordinate; a zero deletes it. ``frozen``: only keys that are there change, and none goes."""
    v, x = _c(v), _d(value)
    if frozen:
        return F.transform_values(v, lambda k, old: F.when(k == key, x).otherwise(old))
    return prune(F.map_concat(F.map_filter(v, lambda k, _: k != key), F.create_map(F.lit(key), x)), SMALL)


def delete_coordinate(v: Column | str, key: str, frozen: bool = False) -> Column:
    return _c(v) if frozen else F.map_filter(_c(v), lambda k, _: k != key)


def add_to_coordinate(v: Column | str, key: str, value: Column | float, frozen: bool = False) -> Column:
    return add_scaled(v, F.create_map(F.lit(key), _d(value)), 1.0, frozen)


def multiply_pointwise(a: Column | str, b: Column | str) -> Column:
    """Product over the keys of ``b``; keys that ``a`` lacks give 0."""
    return let(_c(a), lambda a: F.transform_values(_c(b), lambda k, y: y * F.coalesce(F.try_element_at(a, k), F.lit(0.0))))


def project(a: Column | str, b: Column | str) -> Column:
    """``a`` on the nonzero coordinates of ``b``."""
    kept = lambda b: F.map_filter(_c(a), lambda k, x: (F.abs(F.coalesce(F.try_element_at(b, k), F.lit(0.0))) >= SMALL) & (F.abs(x) >= SMALL))
    return let(_c(b), kept)


def size(v: Column | str) -> Column:
    return F.cardinality(_c(v))


def contains(v: Column | str, key: str) -> Column:
    return F.map_contains_key(_c(v), key)


def keys(v: Column | str) -> Column:
    return F.array_sort(F.map_keys(_c(v)))


def values(v: Column | str) -> Column:
    """All values, equal ones too, in the order of their keys."""
    return F.transform(F.array_sort(F.map_entries(_c(v))), lambda e: e["value"])


def scale(v: Column | str, factor: Column | float) -> Column:
    s = _d(factor)
    return F.transform_values(_c(v), lambda _, x: x * s)


def transform(v: Column | str, f) -> Column:
    """``f`` (Column to Column) of each value."""
    return F.transform_values(_c(v), lambda _, x: f(x))


def _entries(v: Column) -> Column:
    # sums follow the keys' order, so a vector's sum doesn't depend on how its map was made
    return F.array_sort(F.map_entries(v))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over shared keys: both maps' keys meet by hash, then are summed in their order."""
    both = F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(_entries(both), F.lit(0.0), lambda s, e: s + e["value"])


def norm(v: Column | str, p: float = 2.0) -> Column:
    """Lp norm over all coordinates."""
    total = F.aggregate(_entries(_c(v)), F.lit(0.0), lambda s, e: s + F.pow(F.abs(e["value"]), F.lit(float(p))))
    return F.pow(total, F.lit(1.0 / p))


def maximum(v: Column | str) -> Column:
    """The largest value, at least 0."""
    return F.when(_c(v).isNotNull(), F.greatest(F.lit(0.0), F.array_max(F.map_values(_c(v)))))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cos; null if either is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def to_json(v: Column | str) -> Column:
    return F.to_json(F.map_from_entries(_entries(_c(v))))


def inner_product(coefficients: Column | str, tokens: Column | str) -> Column:
    """Sum of the coefficients of tokens, each as often as it occurs."""
    return let(_c(coefficients), lambda m: F.aggregate(_c(tokens), F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(m, t), F.lit(0.0))))


def keys_by_value(v: Column | str, n: int | None = None, ascending: bool = False) -> Column:
    """Keys in the order of their values, largest first, ties by key; the first ``n`` of them."""
    sign = 1.0 if ascending else -1.0
    pairs = F.transform(F.map_entries(_c(v)), lambda e: F.struct((e["value"] * sign).alias("x"), e["key"].alias("k")))
    out = F.transform(F.array_sort(pairs), lambda e: e["k"])
    return out if n is None else F.slice(out, 1, n)


def l1_project(v: Column | str, radius: float = 1.0) -> Column:
    """Euclidean projection on the L1 ball: soft thresholds by the exact level (sorted magnitudes, no bisection)."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("theta"))

    def step(s, u):
        total, n = s["sum"] + u, s["n"] + 1
        level = (total - radius) / n
        return F.struct(total.alias("sum"), n.alias("n"), F.when(u > level, level).otherwise(s["theta"]).alias("theta"))

    def projected(v: Column) -> Column:
        mags = F.reverse(F.array_sort(F.transform(F.map_values(v), lambda x: F.abs(x))))
        # where all of it is inside the ball, no level is positive
        theta = F.aggregate(mags, zero, step, lambda s: F.when(s["sum"] <= radius, 0.0).otherwise(F.greatest(s["theta"], F.lit(0.0))))
        return let(theta, lambda t: prune(F.transform_values(v, lambda _, x: F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0)))))

    return let(_c(v), projected)


def decay(v: Column | str, touched: Column | str, now: Column | int, f) -> Column:
    """Catches coordinates up: ``f(value, start, end)`` between the tick each was last touched (map ``touched``) and ``now``."""
    now = now if isinstance(now, Column) else F.lit(now)
    return let(_c(touched), lambda m: prune(F.transform_values(_c(v), lambda k, x: f(x, F.coalesce(F.try_element_at(m, k), now), now))))


def dense_dot(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of doubles."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dense_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dense_outer(a: Column | str, b: Column | str) -> Column:
    """Outer product of two arrays, as an array of rows."""
    return let(_c(b), lambda b: F.transform(_c(a), lambda x: F.transform(b, lambda y: x * y)))
