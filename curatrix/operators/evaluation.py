"""Grading of model outputs, accuracy, and the model-by-dataset table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.binding import let
from curatrix.functions.parsing import answer_last, grade, letter_among, prepared_options


def graded(outputs: Column, answer: Column, label: Column, options: Column | None = None, extract=answer_last) -> Column:
    """array<struct<output_text, pred_letter, is_correct>> of an array of output texts."""

    def one(text: Column, said: Column, prepared: Column | None) -> Column:
        letter = letter_among(said, prepared) if prepared is not None else F.lit(None).cast("string")
        return F.struct(text.alias("output_text"), F.coalesce(letter, said).alias("pred_letter"), grade(said, answer, label).alias("is_correct"))

    every = lambda prepared: F.transform(outputs, lambda text: let(extract(text), lambda said: one(text, said, prepared)))
    return every(None) if options is None else let(prepared_options(options), every)


def majority(values: Column) -> Column:
    """The commonest element, ties to the first seen; null of an empty array."""
    counted = lambda a: F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda x: x.eqNullSafe(v))).alias("n"), (-F.array_position(a, v)).alias("at"), v.alias("v")))
    return let(values, lambda a: F.array_max(counted(a))["v"])


def regraded(df: DataFrame, parsed: str = "parsed", label: str = "answer_label") -> DataFrame:
    """Adds num_rollouts, num_correct, average, pass at n, majority vote and whether that is right. Without rollouts the
    average and the vote are null and pass is false."""
    p = F.col(parsed)
    vote = majority(F.filter(F.transform(p, lambda x: x["pred_letter"]), lambda x: x.isNotNull()))
    right = F.size(F.filter(p, lambda x: x["is_correct"]))
    return df.select(
        "*", F.size(p).alias("num_rollouts"), right.alias("num_correct"), (right / F.nullif(F.size(p), F.lit(0))).alias("average_num_correct"), (right > 0).alias("pass_at_num_rollouts"),
        vote.alias("majority_vote_pred_letter"), F.coalesce(F.lower(vote) == F.lower(F.col(label)), F.lit(False)).alias("majority_at_num_rollouts"),
    )


def accuracy(df: DataFrame, by: str = "dataset_name") -> DataFrame:
    """Per dataset: records, mean share of right rollouts, share with any right one."""
    share = F.col("num_correct") / F.nullif(F.col("num_rollouts"), F.lit(0))
    return df.groupBy(by).agg(F.count("*").alias("records"), F.round(F.avg(share), 6).alias("accuracy"), F.round(F.avg((F.col("num_correct") > 0).cast("double")), 6).alias("pass_rate"))


def totals(df: DataFrame) -> DataFrame:
    """One row over all datasets: records, rollouts, right ones, their share."""
    one = df.agg(F.count("*").alias("records"), F.coalesce(F.sum("num_rollouts"), F.lit(0)).alias("rollouts"), F.coalesce(F.sum("num_correct"), F.lit(0)).alias("correct"))
    return one.select("*", F.round(F.try_divide("correct", "rollouts"), 6).alias("share"))


def first_correct(parsed: Column) -> Column:
    """The first right rollout, with its place; null if there is none."""
    placed = F.transform(parsed, lambda x, i: F.struct(i.alias("place"), x["output_text"].alias("output_text"), x["pred_letter"].alias("pred_letter"), x["is_correct"].alias("is_correct")))
    return F.get(F.filter(placed, lambda x: x["is_correct"]), F.lit(0))


def model_table(df: DataFrame, datasets: tuple[str, ...], model: str = "model", dataset: str = "dataset_name") -> DataFrame:
    """Mean accuracy in per cent by model and dataset, and the unweighted mean of a model's datasets. Datasets are given,
    so the pivot needs no pass to find them."""
    share = df.select(model, F.col(dataset).alias("d"), (100 * F.col("num_correct") / F.nullif(F.col("num_rollouts"), F.lit(0))).alias("a"))
    table = share.groupBy(model).pivot("d", list(datasets)).agg(F.avg("a"))
    cells = F.array_compact(F.array(*(F.col(f"`{d}`") for d in datasets)))
    mean = F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(cells), F.lit(0))
    return table.select(model, *(F.round(F.col(f"`{d}`"), 6).alias(d) for d in datasets), F.round(mean, 6).alias("overall_average"))
