"""A value used often in an expression, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)``, where ``value`` is computed once a row.

    Catalyst shares no subexpressions within higher-order functions, so there a
    value named ten times is computed ten times.
    """
    return F.get(F.transform(F.array(value), lambda v: build(v)), F.lit(0))
