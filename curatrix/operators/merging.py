"""Key joins that attach, fill or replace fields, with explicit rules for duplicates and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import is_missing
from curatrix.plans.stages import keep_keys


def pick(df: DataFrame, key: list[str], order: list, last: bool = True) -> DataFrame:
    """One row a key: the last (or first) by ``order``. Partial aggregation by a struct, so a hot key is reduced before
    the shuffle."""
    rest = [c for c in df.columns if c not in key]
    named = F.struct(*(F.col(o).alias(f"o{k}") for k, o in enumerate(order)))
    choose = F.max_by if last else F.min_by
    return df.groupBy(*key).agg(choose(F.struct(*rest), named).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def attach(left: DataFrame, right: DataFrame, key: list[str], order: list, how: str = "left") -> DataFrame:
    """Left rows with the fields of the last right row of their key."""
    return left.join(pick(right, key, order), key, how)


def attach_two_keys(left: DataFrame, right: DataFrame, first: list[str], second: list[str], fields: list[str], order: list) -> DataFrame:
    """Fields of the right row with the first key, else with the second; left rows that match neither have nulls."""
    held = F.struct(*fields)
    a = pick(right.select(*first, held.alias("_a"), *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order))), first, [f"_o{k}" for k in range(len(order))]).select(*first, "_a")
    b = pick(right.select(*second, held.alias("_b"), *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order))), second, [f"_o{k}" for k in range(len(order))]).select(*second, "_b")
    joined = left.join(a, first, "left").join(b, second, "left")
    source = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second")
    chosen = F.coalesce("_a", "_b")
    return joined.select(*left.columns, source.alias("matched_by"), *(chosen[f].alias(f) for f in fields))


def trainset(left: DataFrame, right: DataFrame, first: list[str], second: list[str], fields: list[str], order: list, images: str = "images") -> DataFrame:
    """Left rows that have the first key, with the fields of the right row of that key, else of the second; rows that match
    neither or have no image are dropped, and a null hash is empty. No rows at all are an error."""
    driven = left.where(" AND ".join(f"`{c}` IS NOT NULL" for c in first))
    found = attach_two_keys(driven, right, first, second, fields, order).where("matched_by IS NOT NULL").where(F.coalesce(F.size(images), F.lit(0)) > 0)
    out = found.withColumn("hash", F.coalesce("hash", F.lit("")))
    if out.isEmpty():
        raise ValueError("no rows match")
    return out


def resolve(df: DataFrame, key: str, label: str, order: list[str], strategy: str) -> DataFrame:
    """(key, label, labels): one label a key by ``majority`` (ties to the first seen), ``first`` or ``last``; labels is
    the number of distinct ones. With ``none`` a key with several labels is an error. Labels are counted before they are
    compared, so no key's rows are collected."""
    if strategy == "none":
        if not conflicts(df, key, label).isEmpty():
            raise ValueError(f"some keys have several values of {label}")
        strategy = "first"
    at = F.struct(*order)
    counts = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    rank = Window.partitionBy(key)
    by = {"majority": [F.desc("n"), F.asc("first_at")], "first": [F.asc("first_at")], "last": [F.desc("last_at")]}[strategy]
    ranked = counts.withColumn("_r", F.row_number().over(rank.orderBy(*by))).withColumn("labels", F.count("*").over(rank))
    return ranked.where("_r = 1").select(key, label, "labels")


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one distinct label."""
    return df.where(F.col(label).isNotNull()).groupBy(key).agg(F.countDistinct(label).alias("labels")).where("labels > 1")


def filled(left: DataFrame, right: DataFrame, key: list[str], field: str, order: list, force: bool = False) -> DataFrame:
    """``field`` of left rows where it is missing (or everywhere, with ``force``) from the last right row of the key."""
    donor = pick(right.select(*key, F.col(field).alias("_given"), *[o for o in order if o not in key and o != field]), key, order).select(*key, "_given")
    here = F.col(field)
    take = ~is_missing(F.col("_given")) & (F.lit(True) if force else is_missing(here))
    return left.join(donor, key, "left").withColumn("filled", F.coalesce(take, F.lit(False))).withColumn(field, F.when(take, F.col("_given")).otherwise(here)).drop("_given")


def matches(queries: DataFrame, rows: DataFrame, key: str, q: str, r: str, k: int) -> DataFrame:
    """Equal keys of two sides: the first ``k`` rows (by id) of each query. Rows are cut to ``k`` a key before the join,
    so a key that half of both sides share gives at most k rows a query."""
    few = rows.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(r))).where(F.col("rank") <= k)
    return queries.where(F.col(key).isNotNull()).join(few, key).select(q, r, "rank")


def not_yet(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written before."""
    return keep_keys(df, done.select(key).distinct(), key, "left_anti")


def merge_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """Number of rows for each condition."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def attach_reasoning(records: DataFrame, rollouts: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, reasoning) by equal signature. ``rollouts`` has signature, letter, reasoning and an order ``at``; of
    several the one with the record's answer letter is taken, else the first. They are cut to one for each signature and
    letter before the join."""
    best = rollouts.where("reasoning is not null").groupBy("signature", "letter").agg(F.min_by(F.struct("reasoning", "at"), "at").alias("r"))
    first = best.groupBy("signature").agg(F.min_by("r", "r.at").alias("any_letter"))
    own = best.select("signature", F.col("letter").alias("answer_label"), F.col("r").alias("same_letter"))
    joined = records.join(own, ["signature", "answer_label"], "left").join(first, "signature", "left")
    return joined.select(key, F.coalesce("same_letter", "any_letter")["reasoning"].alias("reasoning"), F.col("same_letter").isNotNull().alias("letter_matched")).where("reasoning is not null")
