from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Inside higher-order functions, a reference to another expression is re-evaluated for every
    element; binding it through a one-element ``transform`` keeps per-row work linear."""
    return F.element_at(F.transform(F.array(value), body), 1)
