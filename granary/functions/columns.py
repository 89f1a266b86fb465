"""Helpers to build columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body(x)` with x computed once, also where Catalyst would copy it into each of its uses."""
    return F.element_at(F.transform(F.array(x), body), 1)
