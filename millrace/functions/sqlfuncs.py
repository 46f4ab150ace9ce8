"""The vector, text and math functions as temporary SQL functions; their bodies stay Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "map<string, double>"
_GET = "coalesce(try_element_at({m}, {k}), 0D)"
FUNCTIONS = {
    "vec_prune": (f"v {_V}", _V, "map_filter(v, (k, x) -> abs(x) >= 1e-10D)"),
    "vec_get": (f"v {_V}, key string", "double", "coalesce(try_element_at(v, key), 0D)"),
    "vec_dot": (f"a {_V}, b {_V}", "double", "aggregate(array_sort(map_entries(map_zip_with(a, b, (k, x, y) -> coalesce(x * y, 0D)))), 0D, (s, e) -> s + e.value)"),
    "vec_add_scaled": (
        f"a {_V}, b {_V}, s double", _V,
        "map_filter(map_zip_with(a, b, (k, x, y) -> coalesce(x, 0D) + s * coalesce(y, 0D)), (k, x) -> abs(x) >= 1e-10D)",
    ),
    "vec_scale": (f"v {_V}, s double", _V, "transform_values(v, (k, x) -> x * s)"),
    "vec_norm": (f"v {_V}, p double", "double", "power(aggregate(array_sort(map_entries(v)), 0D, (s, e) -> s + power(abs(e.value), p)), 1D / p)"),
    "vec_max": (f"v {_V}", "double", "greatest(0D, array_max(map_values(v)))"),
    "text_clean_line": ("s string", "string", "lower(regexp_replace(s, '[^A-Za-z]', ' '))"),
    "text_replace_numbers": ("s string", "string", r"regexp_replace(regexp_replace(s, '[0-9]+', '_num_'), '_num_[ \\t\\n\\x0B\\f\\r]+_num_', '_num_')"),
    "text_wsclean": ("s string", "string", r"regexp_replace(regexp_replace(s, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ')"),
    "math_sigmoid": ("x double", "double", "CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END"),
    "math_log_sum_exp": ("a double, b double", "double", "greatest(a, b) + CASE WHEN abs(a - b) > 50 THEN 0D ELSE log1p(exp(-abs(a - b))) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session; returns their names."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
