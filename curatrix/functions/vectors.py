"""Vectors, perceptual bits and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.binding import let


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    return let(norm(v) + 1e-12, lambda size: F.transform(v, lambda x: x.cast("double") / size))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / (norm(a) * norm(b))


def median(v: Column) -> Column:
    at = lambda s, k: F.get(s, F.floor(k / 2).cast("int")).cast("double")
    return let(F.array_sort(v), lambda s: (at(s, F.size(v) - 1) + at(s, F.size(v))) / 2)


def median_bits(v: Column) -> Column:
    """64 bits of a vector of 64 values, the first value in the highest bit: whether it exceeds the median."""
    return let(median(v), lambda m: F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x.cast("double") > m).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
