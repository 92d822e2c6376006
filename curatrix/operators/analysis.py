"""Distributions with totals, word statistics and label coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import alnum_key, kept_tokens, label_key, strip


def distribution(df: DataFrame, group: Column, images: Column, sizes: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Per group and in total: records, per cent, distinct images, images a record, and records by number of images (the
    last size is that or more). Distinct images of the total are counted over all, not summed: rollup recomputes them."""
    n = F.size(images)
    rows = df.select(F.coalesce(group, F.lit("Unknown")).alias("grp"), images.alias("images"), n.alias("k"))
    by_size = [F.sum(F.when(F.col("k") == s if s != sizes[-1] else F.col("k") >= s, 1).otherwise(0)).alias(f"k{s}") for s in sizes]
    counts = rows.rollup("grp").agg(F.count("*").alias("records"), F.sum("k").alias("images"), F.grouping("grp").alias("g"), *by_size)
    distinct = rows.select("grp", F.explode("images").alias("i")).rollup("grp").agg(F.countDistinct("i").alias("distinct_images"), F.grouping("grp").alias("g"))
    name = lambda: F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("grp")).alias("grp")
    left, right = counts.select(name(), "records", "images", *(f"k{s}" for s in sizes)), distinct.select(name(), "distinct_images")
    total = F.broadcast(rows.agg(F.count("*").alias("all_records")))
    out = left.join(right, "grp", "left").crossJoin(total)
    return out.select(
        "grp", "records", F.round(100 * F.col("records") / F.greatest("all_records", F.lit(1)), 6).alias("percent"), F.coalesce("distinct_images", F.lit(0)).alias("distinct_images"),
        F.round(F.col("images") / F.col("records"), 6).alias("images_per_record"), *(f"k{s}" for s in sizes),
    )


def word_counts(df: DataFrame, text: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(word, n): occurrences of words that are no stopwords."""
    return df.select(F.explode(kept_tokens(F.col(text), stopwords)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(df: DataFrame, count: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(count), name).limit(k)


def length_stats(df: DataFrame, length: Column, by: str | None = None) -> DataFrame:
    """Least, most, mean and percentiles of a length, overall or by group."""
    rows = df.select(*([by] if by else []), length.alias("len"))
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(F.count("len").alias("n"), F.min("len").alias("least"), F.max("len").alias("most"), F.round(F.avg("len"), 6).alias("mean"), *(F.percentile("len", F.lit(p / 100)).alias(f"p{p}") for p in (10, 50, 90)))


def relative_histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """Counts in ``bins`` equal bins from 0 to the 90th percentile; what exceeds it is in the last one."""
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    edge = F.broadcast(rows.agg(F.percentile("v", F.lit(0.9)).alias("p90")))
    width = F.col("p90") / bins
    return rows.crossJoin(edge).select(F.least(F.when(width > 0, F.floor(F.col("v") / width)).otherwise(0), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def label_counts(df: DataFrame, labels: Column) -> DataFrame:
    """(label, n) over all elements, stripped, blanks dropped."""
    one = df.select(F.explode(labels).alias("x")).select(strip(F.col("x")).alias("label")).where("label <> ''")
    return one.groupBy("label").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, labels: Column, allowed: DataFrame, name: str) -> DataFrame:
    """One row: labels present, distinct ones, occurrences within and without the allowed list (compared without case and
    blanks), and how many allowed ones never occur."""
    present = df.select(F.explode(labels).alias("x")).select(label_key(F.col("x")).alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n"))
    listed = allowed.select(label_key(F.col(name)).alias("k")).distinct().withColumn("listed", F.lit(1))
    both = present.join(listed, "k", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("present"), F.count("n").alias("distinct_labels"), F.coalesce(F.sum(F.when(F.col("listed") == 1, F.col("n"))), F.lit(0)).alias("within"),
        F.coalesce(F.sum(F.when(F.col("listed").isNull(), F.col("n"))), F.lit(0)).alias("outside"), F.count_if(F.col("n").isNull()).alias("never_seen"),
    )


def never_seen(df: DataFrame, labels: Column, allowed: DataFrame, name: str) -> DataFrame:
    """Allowed labels that never occur, compared without case and blanks."""
    present = df.select(F.explode(labels).alias("x")).select(label_key(F.col("x")).alias("k")).distinct()
    return allowed.withColumn("k", label_key(F.col(name))).join(present, "k", "left_anti").select(name)


def whitelisted(df: DataFrame, label: str, allowed: DataFrame, name: str) -> DataFrame:
    """Adds ``canonical``, the allowed label of the same letters and digits, null if there is none. The list is a table, and
    Spark broadcasts it as far as its size allows."""
    listed = allowed.select(alnum_key(F.col(name)).alias("_k"), F.col(name).alias("canonical")).where("_k <> ''").groupBy("_k").agg(F.min("canonical").alias("canonical"))
    return df.withColumn("_k", alnum_key(F.col(label))).join(listed, "_k", "left").drop("_k")


def lost_texts(df: DataFrame, key: str, raw: Column, parsed: Column, k: int = 5) -> DataFrame:
    """The first ``k`` texts by key that do not parse."""
    return df.where(raw.isNotNull() & parsed.isNull()).select(key, raw.alias("text")).orderBy(key).limit(k)


def label_variants(df: DataFrame, labels: Column, k: int = 50) -> DataFrame:
    """The ``k`` commonest ways labels are written, with the key they share."""
    one = df.select(F.explode(labels).alias("raw")).where("raw is not null")
    return one.groupBy("raw").agg(F.count("*").alias("n")).select("raw", label_key(F.col("raw")).alias("key"), "n").orderBy(F.desc("n"), "raw").limit(k)


def parse_quality(df: DataFrame, raw: Column, parsed: Column) -> DataFrame:
    """Rows with a text, those that parse, and those that do not."""
    return df.agg(F.count_if(raw.isNotNull()).alias("texts"), F.count_if(parsed.isNotNull()).alias("parsed"), F.count_if(raw.isNotNull() & parsed.isNull()).alias("lost"))


def image_counters(df: DataFrame, images: str = "images") -> DataFrame:
    """One row: pictures, those without bytes, those that decode and those that do not, and records without any picture."""
    from curatrix.sources.images import picture_size

    total = df.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.size(images), F.lit(0)) <= 0).alias("without"))
    one = df.select(F.explode(images).alias("i")).select(F.coalesce(F.length("i.bytes"), F.lit(0)).alias("n"), picture_size(F.col("i.bytes")).alias("s"))
    counted = one.agg(F.count("*").alias("pictures"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if((F.col("n") > 0) & F.col("s.width").isNotNull()).alias("ok"), F.count_if((F.col("n") > 0) & F.col("s.width").isNull()).alias("failed"))
    return total.crossJoin(F.broadcast(counted))
