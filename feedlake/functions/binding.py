"""Bind an expression to a name inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A filter that the optimizer pushes below a projection carries a copy of every column it reads. A
    chain of columns that each use the one before several times would then grow exponentially; a
    lambda variable keeps it linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
