"""Problem 5: the k most similar vectors of the same space for every vector.

A permutation index: every vector is represented by the order of its nearest pivots and is posted in the inverted files of
the first few of them. Within a file every vector that asks ranks all others by the footrule distance of the orders; the
first ``RERANK`` are compared by cosine, and of the rest those that the triangle inequality on the angles to the file's
pivot does not rule out against the k-th of these. So no vector of a file is lost, however long the file is, and the best
of all files of a vector are its answer.

Pivots are a bounded sample: ``PIVOT_RATE`` times the root of the vectors of a space, ``MOST_PIVOTS`` at most, chosen by hash,
so files grow with the root of the vectors; every vector is indexed. Pivots near to each other form groups, and a vector
is sent once to each group of its files.

Cases: vectors that are null, empty, of another length, all zero or that hold null, NaN or infinite elements take no
part. Exactly repeated vectors are searched once and stand for each other afterwards. Ties go to the smaller vec_id. A
space with fewer than k + 1 vectors gives what there is; an empty table an empty result. Extra columns are ignored;
needed are vec_id, space and vec. A null space is a space of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.plans.stages import keep_keys, materialize

#: Similar vectors asked for, and the length of vectors that take part.
K, DIM = 5, 64
#: Pivots by the root of the vectors of a space, the least and greatest number (16 MB); nearest pivots kept of a vector;
#: inverted files a vector is posted in.
PIVOT_RATE, LEAST_PIVOTS, MOST_PIVOTS, PREFIX, POSTS = 8.5, 64, 1 << 16, 8, 5
#: Vectors of a group of files, about; pivots of a group at least.
GROUP_ROWS, GROUP_PIVOTS = 2000, 8
#: Vectors indexed in one part of an inverted file; a longer file has several parts and is asked in all of them.
PART_ROWS = 4096
#: Vectors that ask in one part; for a longer file they are split as well, so a part is bounded on both sides.
ASKING_ROWS = 100_000
#: Candidates of a file that are compared by cosine first, in footrule order.
RERANK = 32
#: Vectors that ask in a block of the brute-force comparison, and vectors a task of it reads.
BLOCK, SLICE_ROWS = 16_384, 100_000
#: Postings one task of the search reads.
TASK_ROWS = 40_000


def usable(vec: str = "vec", dim: int = DIM) -> Column:
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


@dataclass(frozen=True)
class Pivots:
    """Unit vectors of the pivots of a space, and the group each belongs to."""

    units: np.ndarray
    group: np.ndarray


def _grouped(units: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each pivot, near ones together: a few steps of spherical k-means from the first pivots."""
    centres, own = units[:groups].copy(), np.zeros(len(units), np.int32)
    for _ in range(rounds):
        own = np.concatenate([(units[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(units), 4096)]).astype(np.int32)
        for g in range(groups):
            total = units[own == g].sum(0)
            if total.any():
                centres[g] = total / np.linalg.norm(total)
    return own


def pivots_of(vectors: DataFrame, pivots: int | None, dim: int) -> dict[str, Pivots]:
    """Distinct unit vectors of each space: those whose content hash is least, found under a cut that is expected to leave
    somewhat more than are wanted. One job collects them for all spaces."""
    spaces = {r["space"]: r["n"] for r in vectors.groupBy("space").agg(F.count("*").alias("n")).collect()}
    wanted = {s: pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOT_RATE * n**0.5))) for s, n in spaces.items()}
    if not spaces:
        return {}
    limits = [x for s, n in spaces.items() for x in (F.lit(s), F.lit(int((1 << 30) * min(1.0, (1.5 * wanted[s] + 100) / n))))]
    hashed = vectors.select("space", "vec", F.pmod(F.xxhash64("vec"), F.lit(1 << 30)).alias("h"))
    rows = hashed.where(F.col("h") < F.element_at(F.create_map(*limits), F.col("space"))).dropDuplicates(["space", "vec"]).toArrow()
    out, names, order = {}, np.array(rows.column("space").to_pylist(), object), rows.column("h").to_numpy()
    for space in spaces:
        at = np.flatnonzero(names == space)
        values = _matrix(rows.column("vec").take(pa.array(at)), dim)
        first = np.lexsort((*values.T[::-1], order[at]))[: wanted[space]]
        units = _unit(values[first]).astype(np.float32) if len(first) else np.zeros((0, dim), np.float32)
        groups = max(1, min(len(units) // GROUP_PIVOTS, spaces[space] // GROUP_ROWS))
        out[space] = Pivots(units, _grouped(units, groups) if len(units) else np.zeros(0, np.int32))
    return out


def _represent(pivots, prefix: int, posts: int, dim: int) -> Callable:
    """(vec_id, space, unit, pivots, groups): the order of the nearest pivots, and the groups of the first ``posts`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            unit, spaces = _unit(_matrix(batch.column("vec"), dim)), batch.column("space").to_pylist()
            order = np.full((len(unit), prefix), -1, np.int32)
            for space in set(spaces):
                at = np.flatnonzero([s == space for s in spaces])
                near = unit[at].astype(np.float32) @ pivots.value[space].units.T
                take = min(prefix, near.shape[1])
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                rank = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
                order[at, :take] = np.take_along_axis(best, rank, 1)
            groups = [sorted({int(pivots.value[s].group[p]) for p in o if p >= 0}) for s, o in zip(spaces, order[:, :posts].tolist())]
            ids = batch.column("vec_id")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * prefix), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([ids, batch.column("space"), pa.array([u.tobytes() for u in unit.astype(np.float32)], pa.binary()), lists, pa.array(groups, pa.list_(pa.int32()))], ["vec_id", "space", "unit", "pivots", "groups"])

    return run


def footrule_gain(asked: np.ndarray, posted: np.ndarray) -> np.ndarray:
    """How much the footrule distance of two pivot orders falls below that of disjoint ones, halved.

    With weights prefix - rank (0 outside the prefix) the footrule distance is the sum over pivots of |wa - wb|, that is
    the sum of both weights less twice the sum of the smaller one; only the last term differs between candidates.
    """
    prefix = asked.shape[1]
    flat, other = asked.ravel(), posted.ravel()
    by = np.argsort(other, kind="stable")
    low, high = np.searchsorted(other[by], flat), np.searchsorted(other[by], flat, side="right")
    count = np.where(flat >= 0, high - low, 0)
    # Every occurrence of a pivot in an asking order meets every one in a posted order.
    mine = np.repeat(np.arange(len(flat)), count)
    theirs = by[np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    weight = prefix - np.maximum(mine % prefix, theirs % prefix)
    return np.bincount(mine // prefix * len(posted) + theirs // prefix, weight, len(asked) * len(posted)).reshape(len(asked), len(posted)).astype(np.int16)


def file_answers(units: np.ndarray, orders: np.ndarray, ids: np.ndarray, asked: np.ndarray, posted: np.ndarray, pivot: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(asking row, row) of the best k + 2 of a file's posted rows for each asking row, and how many pairs were compared by
    cosine beyond the first ``rerank`` in footrule order."""
    near = np.full((len(asked), len(posted)), -2, np.float32)
    self_pair = ids[asked][:, None] == ids[posted][None, :]
    more = 0
    if len(posted) > rerank:
        gain = footrule_gain(orders[asked], orders[posted])
        gain[self_pair] = -1
        first = np.argpartition(-gain, rerank - 1, axis=1)[:, :rerank]
        cosine = np.matmul(units[posted[first]], units[asked][:, :, None])[:, :, 0]
        np.put_along_axis(near, first, cosine, axis=1)
        near[self_pair] = -2
        kth = -np.partition(-np.take_along_axis(near, first, 1), min(k, rerank) - 1, axis=1)[:, min(k, rerank) - 1]
        # By the triangle inequality an angle is at least the difference of the angles to the file's pivot.
        a, b = (np.arccos(np.clip(units[x] @ pivot, -1, 1)) for x in (asked, posted))
        rest = (np.abs(a[:, None] - b[None, :]) <= np.arccos(np.clip(kth, -1, 1))[:, None] + 1e-3) & (near == -2) & ~self_pair
        more = int(rest.sum())
        if more:
            np.copyto(near, units[asked] @ units[posted].T, where=rest)
    else:
        near = np.where(self_pair, np.float32(-2), units[asked] @ units[posted].T)
    take = min(k + 2, len(posted))
    best = np.argpartition(-near, take - 1, axis=1)[:, :take]
    q, c = np.repeat(np.arange(len(asked)), take), best.ravel()
    real = near[q, c] > -2
    return asked[q[real]], posted[c[real]], more


def _search(pivots, k: int, rerank: int, posts: int, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        shard, ids, group = (table.column(c).to_numpy() for c in ("shard", "vec_id", "group"))
        space = np.array(table.column("space").to_pylist(), object)
        index, asks = table.column("indexed").to_numpy().astype(bool), table.column("asks").to_numpy().astype(bool)
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(len(ids), dim)
        orders = _matrix(table.column("pivots"), len(table.column("pivots")[0]))
        del table, rows
        by = np.argsort(shard, kind="stable")
        start = np.flatnonzero(np.append(True, shard[by][1:] != shard[by][:-1]))
        for members in np.split(by, start[1:]):
            known = pivots.value[space[members[0]]]
            # The files of this group: rows by those of their first pivots that are in it.
            near = orders[members, :posts]
            mine = (near >= 0) & (known.group[near] == group[members[0]])
            row, rank = np.nonzero(mine)
            pivot = near[row, rank]
            order = np.argsort(pivot, kind="stable")
            names, first = np.unique(pivot[order], return_index=True)
            found = []
            for name, file in zip(names.tolist(), np.split(members[row[order]], first[1:])):
                posted, asking = file[index[file]], file[asks[file]]
                if len(posted) and len(file) > 1:
                    step = max(1, 400_000 // len(posted))
                    for at in range(0, len(asking), step):
                        found.append(file_answers(units, orders, ids, asking[at : at + step], posted, known.units[name], k, rerank)[:2])
            if not found:
                continue
            q, c = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
            cosine = np.round((_unit(units[q]) * _unit(units[c])).sum(1), 9) if len(q) else np.zeros(0)
            best = np.lexsort((ids[c], -cosine, q))
            q, c, cosine = q[best], c[best], cosine[best]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k + 2
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(ids[c[keep]]), pa.array(cosine[keep])], ["q", "r", "cosine"])

    return run


def neighbours(vectors: DataFrame, k: int = K, dim: int = DIM, pivots: int | None = None, prefix: int = PREFIX, posts: int = POSTS, rerank: int = RERANK) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): the ``k`` most similar other vectors of the same space, within the index's
    accuracy. ``pivots`` is their number a space; None lets it grow with the vectors."""
    spark = vectors.sparkSession
    good = vectors.where(usable(dim=dim)).select("vec_id", F.coalesce("space", F.lit("")).alias("space"), F.col("vec").cast("array<float>").alias("vec"))
    hashed = good.select("vec_id", "space", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    key = ["space", "h1", "h2"]
    copied = hashed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(hashed.join(copied, key).select("rep", "vec_id"), "copies")
    single = keep_keys(good, members.where("rep <> vec_id").select("vec_id"), "vec_id", "left_anti")

    known = spark.sparkContext.broadcast(pivots_of(good, pivots, dim))
    shape = "vec_id long, space string, unit binary, pivots array<int>, groups array<int>"
    indexed = materialize(single.mapInArrow(_represent(known, prefix, posts, dim), shape), "permutations")
    # The longest file of a group says into how many parts it is split; pivots and so groups are bounded.
    files = indexed.select("space", F.explode(F.slice("pivots", 1, posts)).alias("pivot")).where("pivot >= 0").groupBy("space", "pivot").agg(F.count("*").alias("n"))
    longest: dict[tuple[str, int], int] = {}
    for r in files.toLocalIterator():
        key_of = (r["space"], int(known.value[r["space"]].group[r["pivot"]]))
        longest[key_of] = max(longest.get(key_of, 0), r["n"])
    split = [(s, g, -(-n // PART_ROWS), -(-n // ASKING_ROWS)) for (s, g), n in longest.items()]
    sizes = F.broadcast(spark.createDataFrame(split, "space string, group int, parts int, blocks int"))
    first = indexed.select("vec_id", "space", "unit", "pivots", F.explode("groups").alias("group"))
    # A vector asks in one block, all its parts, and is indexed in one part, in all its blocks.
    own, home = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.col("blocks")).cast("int")
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), home.alias("block"), F.lit(1).alias("asks"), (p == own).cast("int").alias("indexed")))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != home)
    held = F.transform(others, lambda b: F.struct(own.alias("part"), b.alias("block"), F.lit(0).alias("asks"), F.lit(1).alias("indexed")))
    spread = first.join(sizes, ["space", "group"]).select("vec_id", "space", "group", "unit", "pivots", F.explode(F.concat(asking, held)).alias("p"))
    posted = spread.select(F.xxhash64("space", "group", "p.part", "p.block").alias("shard"), "vec_id", "space", "group", "p.indexed", "p.asks", "unit", "pivots")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-indexed.count() * 3 // TASK_ROWS))
    near = posted.repartition(tasks, "shard").mapInArrow(_search(known, k, rerank, posts, dim), "q long, r long, cosine double")
    return _ranked(near, members, k)


def _ranked(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The k best of each vector; a repeated vector has its copies at cosine 1 and the neighbours of its representative."""

    def best(pairs: DataFrame) -> DataFrame:
        top = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), F.col("r").alias("r")))), 1, k)
        return pairs.groupBy("q").agg(top.alias("top")).select("q", F.posexplode("top").alias("rank", "t")).select("q", F.col("t.r").alias("r"), (-F.col("t.d")).alias("cosine"), (F.col("rank") + 1).alias("rank"))

    found = materialize(best(near), "neighbours")
    order = Window.partitionBy("rep").orderBy("vec_id")
    few = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("rep", "vec_id")
    # Any of a neighbour's copies may be the answer, at the same cosine; k of them are enough.
    answers = found.join(few.select(F.col("rep").alias("r"), F.col("vec_id").alias("copy")), "r", "left").select("q", F.coalesce("copy", "r").alias("r"), "cosine")
    asked = answers.join(members.select(F.col("rep").alias("q"), F.col("vec_id").alias("copy")), "q", "left").select(F.coalesce("copy", "q").alias("q"), "r", "cosine")
    twins = members.select("rep", F.col("vec_id").alias("q")).join(few.select("rep", F.col("vec_id").alias("r")), "rep").where("q <> r").select("q", "r", F.lit(1.0).alias("cosine"))
    return best(asked.unionByName(twins)).select(F.col("q").alias("vec_id"), F.col("r").alias("neighbour"), "cosine", "rank")


def neighbour_pairs(vectors: DataFrame, **options) -> DataFrame:
    """(vec_a < vec_b) of which at least one is among the k most similar of the other."""
    found = neighbours(vectors, **options)
    return found.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


def recall(vectors: DataFrame, k: int = K, dim: int = DIM, every: int = 50, **options) -> DataFrame:
    """Recall of the index per space against brute force: every vector whose vec_id is divisible by ``every`` is asked
    against all vectors, in blocks. A found neighbour counts if its cosine reaches that of the true k-th."""
    good = vectors.where(usable(dim=dim)).select("vec_id", F.coalesce("space", F.lit("")).alias("space"), F.col("vec").cast("array<float>").alias("vec"))
    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // BLOCK))
    # Each block of questions meets all vectors, which come in slices that a task can hold.
    slices = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-good.count() // SLICE_ROWS), 1)
    questions = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "space", "vec", F.lit(1).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    rows = good.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "space", "vec", F.lit(0).alias("asks"), F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(slices)).cast("int").alias("slice"))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        unit, ids, asks = _unit(_matrix(t.column("vec"), dim)), t.column("vec_id").to_numpy(), t.column("asks").to_numpy().astype(bool)
        place = np.array([f"{b} {s}" for b, s in zip(t.column("block").to_pylist(), t.column("slice").to_pylist())])
        space, single = np.array(t.column("space").to_pylist(), object), unit.astype(np.float32)
        for p in np.unique(place):
            for s in set(space[place == p]):
                at = (place == p) & (space == s)
                q, r = np.flatnonzero(at & asks), np.flatnonzero(at & ~asks)
                for i in range(0, len(q) if len(r) else 0, 256):
                    at = q[i : i + 256]
                    near = single[at] @ single[r].T
                    near[ids[at][:, None] == ids[r][None, :]] = -2
                    take = min(k + 5, len(r))
                    best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    a, b = np.repeat(np.arange(len(at)), take), best.ravel()
                    real = near[a, b] > -2
                    a, b = at[a[real]], r[b[real]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(np.round((unit[a] * unit[b]).sum(1), 9))], ["q", "r", "cosine"])

    true = questions.unionByName(rows).repartition(blocks * slices, "block", "slice").mapInArrow(brute, "q long, r long, cosine double")
    kth = true.groupBy("q").agg(F.element_at(F.slice(F.array_sort(F.collect_list(-F.col("cosine"))), 1, k), -1).alias("d"), F.least(F.count("*"), F.lit(k)).alias("wanted"))
    found = neighbours(vectors, k=k, dim=dim, **options).withColumnRenamed("vec_id", "q")
    hit = kth.join(found, "q", "left").groupBy("q", "wanted").agg(F.count_if(F.col("cosine") >= -F.col("d") - 1e-6).alias("hits"))
    return hit.join(asked.select(F.col("vec_id").alias("q"), "space"), "q").groupBy("space").agg(
        F.count("*").alias("queries"), F.round(F.sum("hits") / F.sum("wanted"), 4).alias("recall")
    )
