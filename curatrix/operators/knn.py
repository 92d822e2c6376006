"""Exact nearest neighbours of a stated query set: inner product of vectors, Hamming distance of bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries held by a task at once; more are searched in further blocks.
BLOCK = 16_384
#: Rows a task compares with a block of queries, so that its work does not grow with the table.
SLICE_ROWS = 200_000


def _blocked(queries: DataFrame, rows: DataFrame, value: str, search: Callable, k: int, shape: str, order: list) -> DataFrame:
    """Every row meets every block of queries once. Queries go to all slices of rows of their block, each slice keeps
    its k best a query, and these few are merged."""
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-rows.count() // SLICE_ROWS), 1)
    asked = queries.select(F.col("id"), F.col(value), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"))
    held = rows.select(F.col("id"), F.col(value), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asks"))
    near = asked.unionByName(held).repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", F.desc("asks")).mapInArrow(search, shape)
    top = F.slice(F.array_sort(F.collect_list(F.struct(*order, F.col("r").alias("r"), F.col("score").alias("score")))), 1, k)
    return near.groupBy("q").agg(top.alias("t")).select("q", F.posexplode("t").alias("rank", "t")).select(F.col("q").alias("query_id"), F.col("t.r").alias("train_id"), F.col("t.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def _search(k: int, load: Callable, compare: Callable, kind: pa.DataType) -> Callable:
    """Streams a partition: queries of a block come first, then the rows they are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, values, best = None, None, None, None

        def found() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2], kind)], ["q", "r", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            b, s, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "slice", "asks"))
            key = b * (1 << 31) + s
            for p in sorted(set(key.tolist())):
                if p != place:
                    yield from found()
                    place, ids, values, best = p, None, None, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                for asking in (True, False):
                    at = np.flatnonzero((key == p) & (asks == asking))
                    if not len(at):
                        continue
                    part = batch.take(pa.array(at))
                    own, what = part.column("id").to_numpy(), load(part.column(1))
                    if asking:
                        ids, values = (own, what) if ids is None else (np.concatenate([ids, own]), np.concatenate([values, what]))
                        continue
                    if ids is None:
                        continue
                    score = compare(values, what)
                    take = min(k, len(own))
                    cut = np.sort(score, axis=1)[:, take - 1]
                    q, r = np.nonzero(score <= cut[:, None])
                    allq, allr, alls = (np.concatenate(x) for x in zip(best, (ids[q], own[r], score[q, r])))
                    order = np.lexsort((allr, alls, allq))
                    allq, allr, alls = allq[order], allr[order], alls[order]
                    first = np.searchsorted(allq, allq)
                    keep = np.arange(len(allq)) - first < k
                    best = (allq[keep], allr[keep], alls[keep])
        yield from found()

    return run


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, train_id, cosine_sim, rank) of the k rows of highest cosine; ties go to the smaller id. Both sides
    have id and vec, an array of doubles of one length; the query itself may be among the rows."""

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        unit = lambda x: x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)
        return -np.round(unit(a) @ unit(b).T, 6)

    near = _blocked(queries, rows, "vec", _search(k, _vectors, compare, pa.float64()), k, "q long, r long, score double", [F.col("score").alias("s")])
    return near.select("query_id", "train_id", (-F.col("score")).alias("cosine_sim"), "rank")


def hamming_topk(queries: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, train_id, hamming, rank) of the k rows of least Hamming distance; both sides have id and bits."""

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]).astype(np.float64)

    near = _blocked(queries, rows, "bits", _search(k, lambda c: c.to_numpy(), compare, pa.float64()), k, "q long, r long, score double", [F.col("score").alias("s")])
    return near.select("query_id", "train_id", F.col("score").cast("int").alias("hamming"), "rank")


def best_other(top: DataFrame, score: str, high: bool = True) -> DataFrame:
    """(query_id, best): best neighbour that is not the query itself, within those retrieved; null if there is none."""
    other = F.when(F.col("query_id") != F.col("train_id"), F.col(score))
    return top.groupBy("query_id").agg((F.max if high else F.min)(other).alias("best"))


def overlap(best: DataFrame, cuts: tuple[float, ...], high: bool = True) -> DataFrame:
    """(cut, hits, valid, rate): queries whose best neighbour reaches each cut."""
    valid = best.where("best is not null")
    counted = valid.agg(F.count("*").alias("valid"), *(F.count_if((F.col("best") >= c) if high else (F.col("best") <= c)).alias(f"c{i}") for i, c in enumerate(cuts)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("cut"), F.col(f"c{i}").alias("hits")) for i, c in enumerate(cuts)))).alias("x")
    return counted.select("valid", rows).select("x.cut", "x.hits", "valid", (F.col("x.hits") / F.greatest(F.col("valid"), F.lit(1))).alias("rate"))
