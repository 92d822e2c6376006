"""Problem 2: records that share most of their words but differ by small edits, insertions or reordering.

Fingerprints of records are searched with vantage-point trees under the Hamming distance. One tree over all records
would prune nothing: unrelated fingerprints lie at nearly one distance from any vantage point, and a query's radius is
wider than their spread, so each query would visit every branch (README, problem 2, has figures). So fingerprints are
first partitioned by their records' rare words, which loses no pair (see ``wordjoin``), and each shard is searched with
its own tree.

Cases: null or blank texts give no words; records without words form no pair and are in no group. Exact copies (equal
multisets of words) are one representative. Very long texts are compared whole. Ties cannot occur: a pair is in or out
by integer arithmetic. An empty table gives an empty result. Extra columns are ignored; needed are record_id, question
and options.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.components import components
from curatrix.llm.wordjoin import Joined, Threshold, compare, distance, expanded, similar_records

#: Overlap by union of the multisets of words.
LEVEL = Threshold(7, 10)
#: Copies of one text in a part of the join that pairs them.
COPIES = 4096
#: Fingerprints in a leaf of a vantage-point tree.
LEAF = 24


def tree_search(prints: np.ndarray, size: np.ndarray, points: np.ndarray, queries: np.ndarray, level: Threshold, add: Callable, leaf: int = LEAF) -> None:
    """Report to ``add`` every (point, query) whose distance is within the query's radius.

    A node takes a vantage point, splits the points at the median distance to it, and sends each query only into the
    halves whose range of distances its ball meets: by the triangle inequality a point p within r of query q has
    |d(v, p) - d(v, q)| <= r. Queries whose ball crosses the boundary go into both halves.
    """
    work = [(points, queries)]
    while work:
        points, queries = work.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) <= leaf:
            compare(prints, size, points, queries, level, add)
            continue
        vantage = prints[points[len(points) // 2]]
        at, away = distance(prints[points], vantage), distance(prints[queries], vantage)
        middle = np.median(at)
        inner = at <= middle
        if inner.all():
            inner = at < at.max()
        if not inner.any() or inner.all():
            compare(prints, size, points, queries, level, add)
            continue
        radius = level.differ(2 * size[queries]) + 1
        for half in (inner, ~inner):
            low, high = at[half].min(), at[half].max()
            work.append((points[half], queries[(away - radius <= high) & (away + radius >= low)]))


def edited_records(records: DataFrame, level: Threshold = LEVEL) -> Joined:
    """Pairs of representatives whose multisets of words have overlap / union of at least ``level``, and the copies."""
    return similar_records(records.select("record_id", "question", "options", F.lit(0).alias("side")), level, search=tree_search)


def edited_pairs(records: DataFrame, level: Threshold = LEVEL) -> DataFrame:
    """Every pair (record_a < record_b) at or above ``level``, copies included."""
    joined = edited_records(records, level)
    m = joined.members.withColumn("parts", F.ceil(F.col("n") / COPIES).cast("int"))
    # A text that very many records share is spread: each of its records is in one part and meets all parts.
    one = m.select("rep", F.col("record_id").alias("record_a"), F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int").alias("part"))
    all_parts = m.select("rep", F.col("record_id").alias("record_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    copies = one.join(all_parts, ["rep", "part"])
    return expanded(joined).select("record_a", "record_b").unionByName(copies.where("record_a < record_b").select("record_a", "record_b"))


def edited_groups(records: DataFrame, level: Threshold = LEVEL) -> DataFrame:
    """One row per record that has a near copy: record_id, group_id (least record_id of its group), links (number of
    other texts it is linked to; copies of one text are one) and copies (records with its own multiset of words)."""
    joined = edited_records(records, level)
    pairs, members = joined.pairs.select("a", "b"), joined.members
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    roots = components(pairs)
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    texts = roots.join(links, "node").join(copies.withColumnRenamed("rep", "node"), "node", "full").select(
        F.col("node").alias("rep"), F.coalesce("root", "node").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
    return texts.join(members.select("rep", "record_id"), "rep", "left").select(F.coalesce("record_id", "rep").alias("record_id"), "group_id", "links", "copies")
