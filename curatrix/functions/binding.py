"""Naming a value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it.

    A column that is used several times is evaluated as often, and one that a lambda captures once for every element. A
    lambda's own variable is not, so the value is bound as the only element of an array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
