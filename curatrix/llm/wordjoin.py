"""Exact similarity join of records on their multisets of words.

Two multisets with ``overlap / union >= t`` share many of their words, so if all words of a record are put in one
global order and only the first few are posted, every such pair still meets under some word. The order is by how
often a word occurs (from a count sketch of fixed size over *all* records), so the posted words are rare ones and the
shards stay small. Within a shard records are compared by a 128-bit parity fingerprint: each word flips one bit, so
the Hamming distance of two fingerprints is at most the number of words in which the multisets differ, and a pair at
or above the threshold is never lost. Survivors are verified on their real words.

The unit that is posted is a word with its occurrence number, so a repeated word counts as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.text import record_words
from curatrix.plans.stages import BROADCAST_ROWS, keep_keys, materialize, small_side

#: Cells of the count sketch for each record, and the least and greatest number of cells as powers of two: it is sized so
#: that words seldom share a cell, and at 64 MB of 32-bit counts it may still be broadcast.
CELLS_A_RECORD, LEAST_BITS, MOST_BITS = 4, 16, 24
#: Cells of a chunk in which tasks hand over their counts.
CHUNK = 1 << 14
#: Postings a word may have in one shard, as the indexed side and as the asking side; a word that more records post is
#: split into a grid of shards, so a shard is bounded on both sides.
SHARD_ROWS = 1_000_000
ASKING_ROWS = 1_000_000
#: Postings one task of the shard stage reads.
TASK_ROWS = 400_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Threshold:
    """A similarity threshold as a fraction, so that every bound is exact integer arithmetic."""

    num: int
    den: int

    def needed(self, total):
        """Least overlap of two multisets with ``total`` words together: overlap/(total-overlap) >= num/den."""
        return -(-self.num * total // (self.num + self.den))

    def passes(self, overlap, total):
        return (self.num + self.den) * overlap >= self.num * total

    def sizes(self, small, large):
        return self.den * small >= self.num * large

    def probe(self, size):
        """Words a record posts to meet any smaller partner."""
        return size - -(-self.num * size // self.den) + 1

    def index(self, size):
        """Words a record posts to meet any partner of its size or more."""
        return size - -(-2 * self.num * size // (self.num + self.den)) + 1

    def differ(self, total):
        """Most words in which a pair at the threshold can differ."""
        return total - 2 * self.needed(total)


class _Words:
    """Hashes of words, remembered up to a fixed number."""

    def __init__(self, keep: int = 500_000):
        self.known: dict[str, int] = {}
        self.keep = keep

    def hash(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        out = []
        for w in texts:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def _tokens(batch: pa.RecordBatch, memory: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, row of each token, token): a token is a word with its occurrence number, hashed."""
    flat: list[int] = []
    sizes = np.zeros(batch.num_rows, np.int64)
    for i, (q, o) in enumerate(zip(batch.column("question").to_pylist(), batch.column("options").to_pylist())):
        found = memory.hash(record_words(q, o))
        sizes[i] = len(found)
        flat += found
    row = np.repeat(np.arange(batch.num_rows), sizes)
    word = np.array(flat, np.uint64)
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    occurrence = np.arange(len(word)) - np.repeat(start, np.diff(np.append(start, len(word))))
    return sizes, row, _mix(word + occurrence.astype(np.uint64) * _GOLD)


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    if len(row):
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        total[row[start]] = np.add.reduceat(values, start)
    return total


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def sketch_bits(records: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (CELLS_A_RECORD * records).bit_length()))


def describing(bits: int) -> Callable:
    """kind 0: record, digest (a, b), size; kind 1: a chunk of the count sketch of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, sketch = _Words(), np.zeros(1 << bits, np.int32)
        names = ["kind", "id", "a", "b", "size", "cells"]
        for batch in batches:
            sizes, row, token = _tokens(batch, memory)
            n = batch.num_rows
            cell, often = np.unique(token >> np.uint64(64 - bits), return_counts=True)
            sketch[cell.astype(np.int64)] += often.astype(np.int32)
            full = np.flatnonzero(sizes)
            a, b = _sums(row, _mix(token ^ _M1), n), _sums(row, _mix(token ^ _M2), n)
            ids = batch.column("record_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(full), np.int32)), _int64(ids[full]), _int64(a[full]), _int64(b[full]), pa.array(sizes[full].astype(np.int32)), pa.nulls(len(full), pa.binary())], names)
        chunks = sketch.reshape(-1, CHUNK)
        for c in np.flatnonzero(chunks.any(1)).tolist():
            zero = pa.array([0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([c], pa.int64()), zero, zero, pa.array([0], pa.int32()), pa.array([chunks[c].tobytes()], pa.binary())], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, cells in zip(batch.column("id").to_pylist(), batch.column("cells").to_pylist()):
            total.setdefault(c, np.zeros(CHUNK, np.int64))[:] += np.frombuffer(cells, np.int32)
    for c, cells in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.minimum(cells, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], ["id", "cells"])


def word_counts(described: DataFrame, bits: int) -> np.ndarray:
    """The count sketch over all records; chunks are summed where they lie, and 64 MB at most come to the driver."""
    counts = np.zeros(1 << bits, np.int32)
    chunks = described.where("kind = 1").select("id", "cells").repartition("id").mapInArrow(_summed, "id long, cells binary")
    for r in chunks.toLocalIterator():
        counts[r["id"] * CHUNK : (r["id"] + 1) * CHUNK] = np.frombuffer(r["cells"], np.int32)
    return counts


def _fingerprints(row: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit words a record; bit k is the parity of the record's tokens that hash to k."""
    bit = ((token >> np.uint64(20)) & np.uint64(127)).astype(np.int64)
    parity = (np.bincount(row * 128 + bit, minlength=n * 128) & 1).astype(np.uint8).reshape(n, 128)
    return np.packbits(parity, axis=1, bitorder="little").view(np.uint64)


def posting(sketch, bits: int, level: Threshold, many: int) -> Callable:
    """Postings (shard, id, meta, f1, f2, common): meta is size * 8 + side * 4 + asks * 2 + (posted as the smaller record);
    common says that the word may have more than ``many`` postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, counts = _Words(), sketch.value
        for batch in batches:
            sizes, row, token = _tokens(batch, memory)
            n = batch.num_rows
            prints = _fingerprints(row, token, n)
            often = counts[(token >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((token, often, row))
            row, token, often = row[order], token[order], often[order]
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            size = sizes[row]
            keep = place < level.probe(size)
            row, token, often, size, place = row[keep], token[keep], often[keep], size[keep], place[keep]
            ids = batch.column("record_id").to_numpy(zero_copy_only=False)[row]
            side = batch.column("side").to_numpy(zero_copy_only=False)[row].astype(np.int64)
            meta = size * 8 + side * 4 + 2 + (place < level.index(size))
            yield pa.RecordBatch.from_arrays([_int64(token), _int64(ids), _int64(meta), _int64(prints[row, 0]), _int64(prints[row, 1]), pa.array(often > many)], ["shard", "id", "meta", "f1", "f2", "common"])

    return run


def split_postings(posts: DataFrame) -> DataFrame:
    """Postings with those of words that more records post than a shard holds spread over a grid of parts and blocks: a
    record is indexed in one part, in all its blocks, and asks in one block, all its parts. Such words are at most as many
    as the postings divided by the rows of a shard."""
    posts = materialize(posts, "postings")
    size = lambda rows: F.ceil(F.col("n") / rows).cast("int")
    hot = posts.where("common").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > min(SHARD_ROWS, ASKING_ROWS))
    hot = materialize(hot.select("shard", size(SHARD_ROWS).alias("parts"), size(ASKING_ROWS).alias("blocks")), "common-words")
    wide = posts.join(small_side(hot, hot.count()), "shard", "left")
    own, home = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64(F.lit(5), "id"), F.col("blocks")).cast("int")
    base = F.col("meta") - F.col("meta").bitwiseAND(3)
    indexed = F.col("meta").bitwiseAND(1)
    name = lambda part, block: F.xxhash64("shard", part, block)
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(name(p, home).alias("shard"), (base + 2 + F.when(p == own, indexed).otherwise(0)).alias("meta")))
    held = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (b != home) & (indexed == 1)), lambda b: F.struct(name(own, b).alias("shard"), (base + 1).alias("meta")))
    whole = F.array(F.struct(F.col("shard"), F.col("meta")))
    rows = wide.select("id", "f1", "f2", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(F.concat(asking, held))).alias("p"))
    return rows.select("p.shard", "id", "p.meta", "f1", "f2")


def distance(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, broadcast over the leading axes."""
    return np.bitwise_count(f ^ g).sum(-1, dtype=np.int64)


def _join(level: Threshold, two_sided: bool, size, side, ids, smaller, asks, prints, i, j) -> np.ndarray:
    """Which of the candidate rows (i, j) may reach the threshold; the smaller record must be posted as such and the
    other must ask."""
    swap = (size[i] > size[j]) | ((size[i] == size[j]) & (ids[i] > ids[j]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    ok = smaller[i] & asks[j] & level.sizes(size[i], size[j]) & (ids[i] != ids[j])
    if two_sided:
        ok &= side[i] != side[j]
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    return at[distance(prints[i], prints[j]) <= level.differ(size[i] + size[j])]


def pairs_in_shards(level: Threshold, two_sided: bool, search: Callable | None = None, tiny: int = 24) -> Callable:
    """Pairs of records (a < b) that meet in a shard and whose fingerprints are near enough.

    Shards of at most ``tiny`` rows are compared all at once by shifted array comparison; larger ones by ``search``,
    or block by block where none is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("meta", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())]))
        if not table.num_rows:
            return
        shard, ids, meta = (table.column(c).to_numpy() for c in ("shard", "id", "meta"))
        prints = np.stack([table.column("f1").to_numpy().view(np.uint64), table.column("f2").to_numpy().view(np.uint64)], 1)
        del table
        order = np.lexsort((ids, meta >> 3, shard))
        shard, ids, meta, prints = shard[order], ids[order], meta[order], prints[order]
        size, side, asks, smaller = meta >> 3, (meta >> 2) & 1, (meta & 2).astype(bool), (meta & 1).astype(bool)
        start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        length = np.diff(np.append(start, len(shard)))
        found: list[np.ndarray] = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            at = _join(level, two_sided, size, side, ids, smaller, asks, prints, i, j)
            if len(at):
                a, b = ids[i[at]], ids[j[at]]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))

        small = np.repeat(length <= tiny, length)
        for step in range(1, min(tiny, len(shard))):
            i = np.flatnonzero(small[:-step] & (shard[step:] == shard[:-step]))
            if not len(i):
                break
            add(i, i + step)
        for s, n in zip(start[length > tiny], length[length > tiny]):
            at = np.arange(s, s + n)
            points = at[smaller[at]]
            if len(points):
                (search or compare)(prints, size, points, at[asks[at]], level, add)
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([_int64(pairs[:, 0]), _int64(pairs[:, 1])], ["a", "b"])

    return run


def compare(prints, size, points, queries, level: Threshold, add: Callable, block: int = 1 << 20) -> None:
    """All points against all queries of a fitting size, in blocks of bounded memory. Both are in order of size."""
    rows = max(1, block // max(1, len(points)))
    held = size[points]
    for k in range(0, len(queries), rows):
        q = queries[k : k + rows]
        # Both come in order of size, and a point is the smaller record of its pair.
        low, high = np.searchsorted(held, -(-level.num * int(size[q[0]]) // level.den)), np.searchsorted(held, size[q[-1]], side="right")
        near_points = points[low:high]
        if not len(near_points):
            continue
        near = np.bitwise_count(prints[q, None, 0] ^ prints[None, near_points, 0]).astype(np.int16)
        near += np.bitwise_count(prints[q, None, 1] ^ prints[None, near_points, 1])
        # A point is the smaller record of its pair, so a query's radius follows from its own size.
        i, j = np.nonzero(near <= level.differ(2 * size[q])[:, None] + 1)
        if len(i):
            add(near_points[j], q[i])


@dataclass
class Joined:
    """Pairs of representatives; of every record that has copies its representative, side, and the number n of copies."""

    pairs: DataFrame
    members: DataFrame


def similar_records(records: DataFrame, level: Threshold, two_sided: bool = False, search: Callable | None = None) -> Joined:
    """Pairs of records at or above ``level``.

    ``records`` has record_id, question, options and side (0 or 1). Records with equal multisets of words (and, with
    ``two_sided``, on the same side) are one representative, the least id, so a hot group of copies is posted once.
    With ``two_sided`` only pairs of different sides are found. Records without words take no part. ``pairs`` has
    a < b (representatives), overlap and the sizes of both.
    """
    spark = records.sparkSession
    records = records.select("record_id", "question", "options", F.col("side").cast("int").alias("side"))
    bits = sketch_bits(records.count())
    described = materialize(records.select("record_id", "question", "options").mapInArrow(describing(bits), "kind int, id long, a long, b long, size int, cells binary"), "words")
    counts = word_counts(described, bits)
    many = min(SHARD_ROWS, ASKING_ROWS)
    common = int(counts.max()) > many
    sketch = spark.sparkContext.broadcast(counts)

    digests = described.where("kind = 0").select(F.col("id").alias("record_id"), "a", "b")
    if two_sided:
        digests = digests.join(records.select("record_id", "side"), "record_id")
    else:
        digests = digests.withColumn("side", F.lit(0))
    key = ["a", "b", "side"]
    groups = digests.groupBy(*key).agg(F.min("record_id").alias("rep"), F.count("*").alias("n"))
    copied = groups.where("n > 1")
    members = materialize(digests.join(copied, key).select("rep", "record_id", "side", "n"), "members")
    spare = members.where("rep <> record_id").select("record_id")
    total = described.where("kind = 0").count()
    texts = keep_keys(records, spare, "record_id", "left_anti")

    posts = texts.mapInArrow(posting(sketch, bits, level, many), "shard long, id long, meta long, f1 long, f2 long, common boolean")
    posts = split_postings(posts) if common else posts.drop("common")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 25 // TASK_ROWS))
    candidates = materialize(
        posts.repartition(tasks, "shard").mapInArrow(pairs_in_shards(level, two_sided, search), "a long, b long").distinct(), "candidates"
    )
    return Joined(_verified(texts, candidates, level), members)


def _verified(texts: DataFrame, candidates: DataFrame, level: Threshold) -> DataFrame:
    """The candidates whose real words reach the level. Only texts of candidates are moved."""
    ids = candidates.select(F.explode(F.array("a", "b")).alias("record_id")).distinct()
    wanted = materialize(keep_keys(texts, ids, "record_id").select("record_id", "question", "options"), "texts")
    a = wanted.select(F.col("record_id").alias("a"), F.col("question").alias("qa"), F.col("options").alias("oa"))
    b = wanted.select(F.col("record_id").alias("b"), F.col("question").alias("qb"), F.col("options").alias("ob"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                m, n = Counter(record_words(x["qa"], x["oa"])), Counter(record_words(x["qb"], x["ob"]))
                overlap, sa, sb = (m & n).total(), m.total(), n.total()
                if level.passes(overlap, sa + sb):
                    rows.append((x["a"], x["b"], overlap, sa, sb))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["a", "b", "overlap", "size_a", "size_b"])

    return candidates.join(a, "a").join(b, "b").select("a", "b", "qa", "oa", "qb", "ob").mapInArrow(check, "a long, b long, overlap int, size_a int, size_b int")


def expanded(joined: Joined) -> DataFrame:
    """Pairs (record_a < record_b) of records from pairs of representatives, since copies stand for each other, with
    their overlap and the sizes of both."""
    members = joined.members
    ma = members.select(F.col("rep").alias("a"), F.col("record_id").alias("ra"))
    mb = members.select(F.col("rep").alias("b"), F.col("record_id").alias("rb"))
    full = joined.pairs.join(ma, "a", "left").join(mb, "b", "left")
    x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return full.select(
        F.least(x, y).alias("record_a"), F.greatest(x, y).alias("record_b"), "overlap",
        F.when(x < y, F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(x < y, F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"),
    )


__all__ = ["BROADCAST_ROWS", "Joined", "Threshold", "compare", "distance", "expanded", "similar_records"]
