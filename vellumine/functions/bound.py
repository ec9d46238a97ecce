"""Values that an expression reads in several places, worked out once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value, which is worked out once, however often it stands in there; written in place it would be worked out at each."""
    return F.element_at(F.transform(F.array(value), use), 1)
