"""Binding of expressions that are used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row.

    Catalyst works an expression out again for each element where it stands inside a lambda; a lambda's variable is held.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
