"""Row predicates and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.records import has_image, valid_loose, valid_strict
from curatrix.functions.text import caption_or_null, is_missing
from curatrix.operators.merging import not_yet
from curatrix.operators.rubric import passes


def equals(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def first_by(df: DataFrame, order: list, **values) -> DataFrame:
    """The first row with the given values, by ``order``."""
    return equals(df, **values).orderBy(*order).limit(1)


def size_between(c: Column, least: int = 1, most: int = 6) -> Column:
    return F.size(c).between(least, most)


def reasoned(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def large_enough(sizes: Column, least: int = 28) -> Column:
    """Every (width, height) of a record has both sides of at least ``least``."""
    return F.forall(sizes, lambda s: F.coalesce(F.array_min(s) >= least, F.lit(False)))


def not_self(a: str, b: str) -> Column:
    return F.col(a) != F.col(b)


__all__ = ["caption_or_null", "equals", "first_by", "has_image", "is_missing", "large_enough", "not_self", "not_yet", "passes", "reasoned", "size_between", "valid_loose", "valid_strict"]
