"""Problem 4: a score cutoff per source that keeps a target fraction of the source's records.

Scores are counted by source and distinct score, so what is sorted is a compact table of frequencies: a window over it
gives descending cumulative sums, and the cutoff of a source is the highest score at which enough records score that or
more. Records are then compared with the few cutoffs; no source is sorted or collected as a whole, however large.

The score is the normalised rubric score: over the items of a record, a pitfall (category compared trimmed and without
case) with a negative score is a penalty of that size, any other item with a positive weight adds its weight and its
score, clamped to 0..weight; score = (sum of scores - penalties) / sum of weights, clamped to 0..1.

Cases: null weights and scores count as 0, a null category is no pitfall; a record without rubric, with an error or
without positive weight has no score and is left out, as are records with a null or blank source; repeated rows count
each; ties at the cutoff are all kept, so kept may exceed wanted; sources without a target are left out; of several
targets of one source the largest holds; a target of 0 keeps nothing and has a null cutoff; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.plans.stages import small_side


def stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def rubric_score(rubric: Column) -> Column:
    """The normalised score of an array of items; null where no item has a positive weight."""
    plain = F.filter(rubric, lambda i: i.isNotNull())
    pitfall = lambda i: F.coalesce(F.lower(stripped(i["category"])) == "pitfall", F.lit(False))
    weight = lambda i: F.coalesce(i["weight"], F.lit(0)).cast("long")
    score = lambda i: F.coalesce(i["score"], F.lit(0)).cast("long")
    total = lambda f: F.aggregate(plain, F.lit(0).cast("long"), lambda acc, i: acc + f(i))
    weights = total(lambda i: F.when(pitfall(i), F.lit(0)).otherwise(F.greatest(weight(i), F.lit(0))))
    scores = total(lambda i: F.when(pitfall(i) | (weight(i) <= 0), F.lit(0)).otherwise(F.greatest(F.least(score(i), weight(i)), F.lit(0))))
    penalty = total(lambda i: F.when(pitfall(i) & (score(i) < 0), -score(i)).otherwise(F.lit(0)))
    norm = (scores - penalty).cast("double") / F.nullif(weights, F.lit(0)).cast("double")
    return F.when(weights > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm)))


def source_key(column: str) -> Column:
    return F.nullif(F.lower(stripped(F.col(column))), F.lit(""))


def scored(records: DataFrame) -> DataFrame:
    """(verify_id, source, score) of the records that have both."""
    whole = F.when(F.col("rubric_verification.error").isNull(), F.col("rubric_verification.rubric"))
    return records.select("verify_id", source_key("dataset_name").alias("source"), rubric_score(whole).alias("score")).where("source is not null and score is not null")


def cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: n scored records, wanted = ceil(permille * n / 1000), the cutoff, and kept records."""
    goals = targets.select(source_key("dataset_name").alias("source"), "keep_permille").where("source is not null and keep_permille is not null")
    goals = goals.groupBy("source").agg(F.max("keep_permille").alias("permille"))
    counts = scored(records).groupBy("source", "score").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("source")
    down = whole.orderBy(F.desc("score"))
    summed = counts.select("source", "score", F.sum("n").over(down).alias("reached"), F.sum("n").over(whole).alias("n"))
    wanted = F.expr("(permille * n + 999) div 1000").alias("wanted")
    joined = summed.join(small_side(goals, goals.count()), "source").select("source", "score", "reached", "n", wanted)
    enough = F.when((F.col("reached") >= F.col("wanted")) & (F.col("wanted") > 0), F.col("reached"))
    found = joined.groupBy("source").agg(
        F.max("n").alias("n"), F.max("wanted").alias("wanted"), F.max(F.when(enough.isNotNull(), F.col("score"))).alias("cutoff"), F.coalesce(F.min(enough), F.lit(0)).alias("kept")
    )
    return found


def kept_records(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(verify_id, source, score) of the records at or above their source's cutoff."""
    limits = cutoffs(records, targets).select("source", "cutoff")
    return scored(records).join(small_side(limits, targets.count()), "source").where("score >= cutoff").select("verify_id", "source", "score")
