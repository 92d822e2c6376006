"""Scoring of verification rubrics, pass checks and score reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.binding import let
from curatrix.functions.text import strip

# Fixed value: titles a rubric must have in full, where the caller names no others.
REQUIRED = ("Stem Self-contained", "Vocabulary Constraint", "Diagnosis Leak", "Single Correct Option", "Option Type Consistency", "Clinical Validity", "Image–Text Consistency")


def scores(rubric: Column) -> Column:
    """struct(weight_sum, score_sum, penalty, final, norm) of an array of rubric items; nulls count as 0."""
    items = F.filter(rubric, lambda i: i.isNotNull())
    pitfall = lambda i: F.coalesce(F.lower(strip(i["category"])) == "pitfall", F.lit(False))
    w = lambda i: F.coalesce(i["weight"], F.lit(0)).cast("long")
    s = lambda i: F.coalesce(i["score"], F.lit(0)).cast("long")
    total = lambda f: F.aggregate(items, F.lit(0).cast("long"), lambda acc, i: acc + f(i))
    weight = total(lambda i: F.when(~pitfall(i) & (w(i) > 0), w(i)).otherwise(0))
    score = total(lambda i: F.when(~pitfall(i) & (w(i) > 0), F.greatest(F.lit(0).cast("long"), F.least(s(i), w(i)))).otherwise(0))
    penalty = total(lambda i: F.when(pitfall(i) & (s(i) < 0), -s(i)).otherwise(0))
    final = score - penalty
    norm = F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), final.cast("double") / F.nullif(weight, F.lit(0)).cast("double"))))
    return F.struct(weight.alias("weight_sum"), score.alias("score_sum"), penalty.alias("penalty"), final.alias("final"), norm.alias("norm"))


def required_check(rubric: Column, titles: tuple[str, ...] = REQUIRED) -> tuple[Column, Column]:
    """(passed, reason): every title is there with a positive weight and its full score; of several items of one title
    the last holds. The reason lists what is missing, else what is not full."""
    keyed = F.transform(F.filter(rubric, lambda i: i.isNotNull() & i["title"].isNotNull()), lambda i: F.struct(F.lower(strip(i["title"])).alias("k"), i["weight"].alias("w"), i["score"].alias("s")))
    # 0 is missing, 1 not full, 2 full; one state a title, found in one pass over the items each.
    last = lambda items, t: F.try_element_at(F.filter(items, lambda i: i["k"] == t.strip().lower()), F.lit(-1))
    state = lambda items, t: let(last(items, t), lambda i: F.when(i.isNull(), 0).when(F.coalesce((i["w"] > 0) & (i["s"] == i["w"]), F.lit(False)), 2).otherwise(1))
    states = let(keyed, lambda items: F.array(*(state(items, t) for t in titles)))
    listed = lambda held, n: F.array_join(F.array_compact(F.array(*(F.when(F.get(held, F.lit(k)) == n, F.lit(t)) for k, t in enumerate(titles)))), ";")
    why = lambda held: F.when(F.array_contains(held, 0), F.concat(F.lit("missing_titles:"), listed(held, 0))).when(F.array_contains(held, 1), F.concat(F.lit("essential_not_full:"), listed(held, 1))).otherwise("")
    reason = let(states, why)
    return reason == "", reason


def annotated(verified: DataFrame, titles: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Adds verify_pass, verify_score and reason. Rows with an error or without a rubric fail and have no score."""
    held = F.col("rubric_verification.rubric")
    ok = F.col("rubric_verification.error").isNull() & (F.size(held) > 0)
    passed, reason = required_check(held, titles)
    usable = F.coalesce(ok, F.lit(False))
    return verified.select("*", (usable & F.coalesce(passed, F.lit(False))).alias("verify_pass"), F.when(usable, scores(held)["norm"]).alias("verify_score"), F.when(usable, reason).alias("reason"))


def passes(score: Column, passed: Column, least: float = 0.95, require_pass: bool = True) -> Column:
    ok = score.isNotNull() & (score >= least)
    return F.coalesce(ok & passed if require_pass else ok, F.lit(False))


def summary(rows: DataFrame) -> DataFrame:
    """Totals, pass ratio, and mean and percentiles of the scores that passed."""
    evaluable = F.col("verify_score").isNotNull() | (F.col("reason").isNotNull())
    score = F.when(F.col("verify_pass"), F.col("verify_score"))
    at = lambda p: F.percentile(score, F.lit(p))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(evaluable).alias("evaluable"), F.count_if("verify_pass").alias("passed"),
        (F.count_if("verify_pass") / F.nullif(F.count_if(evaluable), F.lit(0))).alias("ratio"), F.avg(score).alias("mean"),
        *(at(p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)),
    )


def deciles(rows: DataFrame, score: str = "verify_score") -> DataFrame:
    """Counts of scores in ten bins of [0, 1], the last one closed; empty bins are there."""
    binned = rows.where(F.col(score).isNotNull()).select(F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(binned), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def item_combinations(verified: DataFrame) -> DataFrame:
    """Counts of (title, weight, category) over all items."""
    item = verified.select(F.explode("rubric_verification.rubric").alias("i")).select(strip(F.col("i.title")).alias("title"), F.col("i.weight").alias("weight"), F.lower(strip(F.col("i.category"))).alias("category"))
    return item.groupBy("title", "weight", "category").agg(F.count("*").alias("n"))


def item_consistency(verified: DataFrame) -> DataFrame:
    """Per title: items, distinct weights and categories, and OK or MIXED."""
    c = item_combinations(verified).groupBy("title").agg(F.sum("n").alias("items"), F.countDistinct("weight").alias("weights"), F.countDistinct("category").alias("categories"))
    return c.withColumn("state", F.when((F.col("weights") <= 1) & (F.col("categories") <= 1), "OK").otherwise("MIXED"))


def _title_rows(verified: DataFrame, essential: str) -> DataFrame:
    kept = F.filter("rubric_verification.rubric", lambda i: i.isNotNull() & i["title"].isNotNull() & F.coalesce(F.lower(strip(i["category"])) != essential, F.lit(True)))
    return verified.where(F.size("rubric_verification.rubric") > 0).select("verify_id", F.array_sort(F.array_distinct(F.transform(kept, lambda i: strip(i["title"])))).alias("titles"))


def title_examples(verified: DataFrame, k: int = 3, essential: str = "essential") -> DataFrame:
    """Up to ``k`` records of each set of non-essential titles, the least by id: (titles, examples)."""
    order = Window.partitionBy("titles").orderBy("verify_id")
    few = _title_rows(verified, essential).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return few.groupBy("titles").agg(F.array_sort(F.collect_list("verify_id")).alias("examples")).select(F.array_join("titles", "|").alias("titles"), "examples")


def title_sets(verified: DataFrame, essential: str = "essential") -> DataFrame:
    """Distinct sets of non-essential titles, how many records have each, the least of them, and what each set lacks and
    adds against the commonest."""
    rows = _title_rows(verified, essential)
    # Examples are the least ids: a bounded aggregate, unlike a list of all.
    sets = rows.groupBy("titles").agg(F.count("*").alias("records"), F.min("verify_id").alias("first_id"))
    top = sets.orderBy(F.desc("records"), F.array_join("titles", "|")).limit(1).select(F.col("titles").alias("common"))
    return sets.crossJoin(F.broadcast(top)).select(
        F.array_join("titles", "|").alias("titles"), "records", "first_id", F.array_join(F.array_except("common", "titles"), "|").alias("missing"), F.array_join(F.array_except("titles", "common"), "|").alias("extra")
    )


def by_record(verified: DataFrame, key: list[str]) -> DataFrame:
    """Last verification of each key."""
    order = Window.partitionBy(*key).orderBy(F.desc("verified_at"), F.desc("verify_id"))
    return verified.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
