"""Label rebalancing, quotas and stratified subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.records import LETTERS, permuted_options, valid_strict
from curatrix.plans.stages import materialize


def ordinals(df: DataFrame, *order: str) -> DataFrame:
    """Adds a 0-based global position ``ordinal`` by ``order``, without one task seeing all rows: rows are range
    partitioned and sorted, partitions are counted, and each starts where the ones before it end. ``order`` must be
    unique. The partitioned rows are written once, so both steps see the same partitions."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    spread = materialize(spread, "ordered")
    counts = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return spread.join(F.broadcast(before), "_p").withColumn("ordinal", (place + F.col("_before")).cast("long")).drop("_p", "_before")


def even_targets(total: int, names: tuple[str, ...]) -> dict[str, int]:
    """``total`` split evenly, the remainder to the first names."""
    return {name: total // len(names) + (k < total % len(names)) for k, name in enumerate(names)}


def k_quotas(total: int, shares: dict[int, float]) -> dict[int, int]:
    """Rounded quotas by group size; what rounding leaves over goes to the first size."""
    out = {k: round(total * p) for k, p in shares.items()}
    first = min(out)
    out[first] = max(0, out[first] + total - sum(out.values()))
    return out


def balanced_label(ordinal: Column, total: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    """Letter that record ``ordinal`` of ``total`` gets when letters are filled evenly, the emptiest first: the first
    total mod L records take the letters in turn, so do the others after them. No state is carried between records."""
    n = len(letters)
    rest = total % n
    place = F.when(ordinal < rest, ordinal).otherwise((ordinal - rest) % n).cast("int")
    return F.get(F.array(*(F.lit(x) for x in letters)), place)


def rebalanced(df: DataFrame, key: str, vqa: str = "generated_vqa", letters: tuple[str, ...] = LETTERS) -> DataFrame:
    """(key, old_answer, answer, options) of valid records in key order, answers spread evenly over the letters."""
    valid = df.where(valid_strict(F.col(vqa), letters)).select(key, F.col(vqa).alias("v"))
    placed = ordinals(valid, key)
    total = F.broadcast(placed.agg(F.count("*").alias("total")))
    target = balanced_label(F.col("ordinal"), F.col("total"), letters)
    return placed.crossJoin(total).select(key, F.col("v.question").alias("question"), F.col("v.answer").alias("old_answer"), target.alias("answer"), permuted_options(F.col("v"), target, letters).alias("options"))


def rebalanced_all(df: DataFrame, key: str, vqa: str = "generated_vqa", letters: tuple[str, ...] = LETTERS) -> DataFrame:
    """``rebalanced`` with the records that are not valid passed through as they are (old_answer and answer the same)."""
    v = F.col(vqa)
    other = df.where(~valid_strict(v, letters)).select(key, v["question"].alias("question"), v["answer"].alias("old_answer"), v["answer"].alias("answer"), F.when(v.isNotNull(), F.struct(*(v["options"][x].alias(x) for x in letters))).alias("options"))
    return rebalanced(df, key, vqa, letters).unionByName(other)


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by a unique order; an error if there are fewer."""
    out = ordinals(df, order).where(F.col("ordinal") < n).drop("ordinal")
    if out.count() < n:
        raise ValueError(f"{n} rows were asked for, but there are fewer")
    return out


def stratified(df: DataFrame, stratum: str, key: str, size: int, names: tuple[str, ...], salt: str = "s") -> DataFrame:
    """An equal number of rows of every stratum (the first ones take the remainder), by a hash order of the key."""
    goal = even_targets(size, names)
    need = F.create_map(*(x for k, v in goal.items() for x in (F.lit(k), F.lit(v))))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key)
    # A bound per stratum below the window lets Spark cut each task's rows before the shuffle.
    most = max(goal.values())
    ranked = df.where(F.col(stratum).isin(*names)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return ranked.where(F.col("_r") <= F.try_element_at(need, F.col(stratum))).drop("_r")


def hash_sample(df: DataFrame, key: str, size: int, salt: str = "s") -> DataFrame:
    """``size`` rows in a reproducible random order."""
    return df.orderBy(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), key).limit(size)


def shards(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Adds the number of a fixed-size shard by global position."""
    return ordinals(df, order).withColumn("shard", F.floor(F.col("ordinal") / rows).cast("long"))


def rank_split(df: DataFrame, order: str, ranks: int) -> DataFrame:
    """Adds the rank whose contiguous slice of ceil(n / ranks) rows a row falls in."""
    placed = ordinals(df, order)
    total = F.broadcast(placed.agg(F.count("*").alias("_total")))
    return placed.crossJoin(total).withColumn("rank", F.floor(F.col("ordinal") / F.ceil(F.col("_total") / ranks)).cast("long")).drop("_total")


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)
