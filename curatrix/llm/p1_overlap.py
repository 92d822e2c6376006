"""Problem 1: validation and test records that also stand, exactly or nearly, in the training split.

Word n-gram hashes of evaluation records are partitioned (they grow with the data, so they are not broadcast), training
records are scanned against them, and hits are verified by the containment of the evaluation record in the training
record. The criterion compares multisets of words, which a reordering leaves equal but which no longer n-gram survives,
so the n-gram length is one word (with its occurrence number); rare ones are posted first (see ``wordjoin``).

Cases: null or blank texts give no words, and a record without words is in no pair. Pictures that are null, empty or
without bytes are ignored, and two records without any picture agree. Pictures that cannot be decoded are alike only if
their bytes are equal. Records whose split is null count as evaluation records. Repeated records give a pair each. Extra
columns are ignored; needed are record_id, split, question, options and images (and dataset_name for the report).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.wordjoin import Threshold, similar_records
from curatrix.plans.stages import keep_keys, materialize
from curatrix.sources.images import pixels

LEVEL = Threshold(7, 10)
#: Greatest mean absolute difference, in grey levels, of pictures that are alike.
GREY = 4.0


def decode(raw: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, 8-bit grey pixels) of a picture; None if it cannot be decoded."""
    grey = pixels(raw)
    return None if grey is None or not grey.size else (grey.shape[1], grey.shape[0], np.ascontiguousarray(grey).tobytes())


def alike(x, y, grey: float = GREY) -> bool:
    """Pictures of one size whose mean absolute pixel difference is at most ``grey``."""
    if x == y:
        return True
    if isinstance(x, bytes) or isinstance(y, bytes) or x[:2] != y[:2]:
        return False
    difference = np.abs(np.frombuffer(x[2], np.uint8).astype(np.int16) - np.frombuffer(y[2], np.uint8))
    return int(difference.sum()) <= grey * difference.size


def same_pictures(first: list | None, second: list | None, grey: float = GREY) -> bool:
    """Equal numbers, and each picture has a like one on the other side; order, path and file format do not matter."""
    a, b = ([decode(p) or p for p in side or [] if p] for side in (first, second))
    if len(a) != len(b):
        return False
    return all(any(alike(x, y, grey) for y in b) for x in a) and all(any(alike(x, y, grey) for x in a) for y in b)


def _training(column: str = "split"):
    return F.coalesce((F.lower(F.trim(column)) == "train").cast("int"), F.lit(0))


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, side, n, frames, low, high, upper, digest, pictures): number of pictures, their different sizes, their
    least and greatest mean grey, the least mean of an upper half, and a digest of their bytes in any order. A picture that
    cannot be decoded has a size and means made from its bytes, so that equal bytes have equal ones."""
    for batch in batches:
        rows = []
        for pictures in batch.column("pictures").to_pylist():
            held = sorted(p for p in pictures or [] if p)
            means, uppers, frames = [], [], set()
            for p in held:
                seen = decode(p)
                if seen is None:
                    means.append(zlib.crc32(p) % 256)
                    uppers.append(means[-1])
                    frames.add(f"?{zlib.crc32(p)}")
                    continue
                grey = np.frombuffer(seen[2], np.uint8)
                means.append(grey.mean())
                uppers.append(grey[: seen[0] * -(-seen[1] // 2)].mean())
                frames.add(f"{seen[0]}x{seen[1]}")
            digest = hashlib.md5(b"".join(hashlib.md5(p).digest() for p in held)).hexdigest()
            rows.append((len(held), ",".join(sorted(frames)), float(min(means, default=-1)), float(max(means, default=-1)), float(min(uppers, default=-1)), digest, held))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("side"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["record_id", "side", "n", "frames", "low", "high", "upper", "digest", "pictures"])


def _matched_classes(records: DataFrame, level: Threshold, grey: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, classes of records). A class is all records of one multiset of words, one side and the same
    pictures, named by its least record_id; classes are compared, not their records.

    Pictures that are alike differ by at most ``grey`` in their mean, so two records whose pictures are the same differ by
    at most that in the least and in the greatest mean of theirs. Classes meet by number of pictures and bucket of the
    least mean, which keeps a text that very many records share from being compared with all of them.
    """
    records = records.select("record_id", "question", "options", _training().alias("side"), F.col("images.bytes").alias("pictures"))
    joined = similar_records(records, level, two_sided=True)
    pairs = materialize(joined.pairs, "overlaps")
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = materialize(reps.join(joined.members.select("rep", "record_id"), "rep", "left").select("rep", F.coalesce("record_id", "rep").alias("record_id")), "wanted")
    shape = "record_id long, side int, n int, frames string, low double, high double, upper double, digest string, pictures array<binary>"
    chosen = keep_keys(records.select("record_id", "side", "pictures"), wanted.select("record_id"), "record_id")
    outlines = materialize(chosen.mapInArrow(_outline, shape), "pictures")
    placed = wanted.join(outlines.drop("pictures"), "record_id")
    names = placed.groupBy("rep", "digest").agg(F.min("record_id").alias("class"))
    members = materialize(placed.join(names, ["rep", "digest"]).select("class", "record_id", "side", "rep", "n", "frames", "low", "high", "upper"), "classes")
    step = max(grey, 1.0) + 1e-6
    classes = members.where("class = record_id").withColumn("bucket", F.floor(F.col("low") / step)).withColumn("half", F.floor(F.col("upper") / (2.2 * step)))

    def end(k: str) -> DataFrame:
        return classes.select(F.col("rep").alias(k), F.col("class").alias(f"class_{k}"), "n", "frames", "bucket", "half", F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"), F.col("side").alias(f"side_{k}"))

    near = end("b")
    for c in ("bucket", "half"):
        near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    # Sizes are estimated from compressed files and before rows are multiplied, so these joins are told not to broadcast.
    met = pairs.join(end("a").hint("merge"), "a").join(near.hint("merge"), ["b", "n", "frames", "bucket", "half"]).where((F.abs(F.col("low_a") - F.col("low_b")) <= grey + 1e-6) & (F.abs(F.col("high_a") - F.col("high_b")) <= grey + 1e-6))
    looks = lambda k: outlines.select(F.col("record_id").alias(f"class_{k}"), F.col("pictures").alias(f"p{k}"))
    kept = ["class_a", "class_b", "side_a", "side_b", "overlap", "size_a", "size_b"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("pa").to_pylist(), batch.column("pb").to_pylist()
            keep = pa.array([same_pictures(p, q, grey) for p, q in zip(x, y)], pa.bool_())
            yield batch.drop_columns(["pa", "pb"]).filter(keep)

    both = met.join(looks("a").hint("merge"), "class_a").join(looks("b").hint("merge"), "class_b").select(*kept, "pa", "pb")
    shape = "class_a long, class_b long, side_a int, side_b int, overlap int, size_a int, size_b int"
    return materialize(both.mapInArrow(check, shape), "matched"), members.select("class", "record_id", "side")


def cross_split_pairs(records: DataFrame, level: Threshold = LEVEL, grey: float = GREY) -> DataFrame:
    """record_a < record_b of which exactly one is in training, with like texts and the same pictures, their overlap in
    words and its share of the evaluation record (containment)."""
    matched, members = _matched_classes(records, level, grey)
    a, b = (members.select(F.col("class").alias(f"class_{k}"), F.col("record_id").alias(f"r{k}")) for k in "ab")
    size = F.when(F.col("side_a") == 0, F.col("size_a")).otherwise(F.col("size_b"))
    return matched.join(a.hint("merge"), "class_a").join(b.hint("merge"), "class_b").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"), "overlap", (F.col("overlap") / size).alias("containment"))


def overlap_report(records: DataFrame, level: Threshold = LEVEL, grey: float = GREY) -> DataFrame:
    """Per split and dataset_name of the evaluation side: its records, those found in training, the pairs, and the mean
    over found records of the greatest containment in a training record. Pairs are counted by class sizes, never formed."""
    matched, members = _matched_classes(records, level, grey)
    sizes = members.groupBy("class").agg(F.count("*").alias("members"))
    held_a = F.col("side_a") == 0
    turned = matched.select(
        F.when(held_a, F.col("class_a")).otherwise(F.col("class_b")).alias("held"), F.when(held_a, F.col("class_b")).otherwise(F.col("class_a")).alias("class"),
        (F.col("overlap") / F.when(held_a, F.col("size_a")).otherwise(F.col("size_b"))).alias("containment"),
    )
    hits = turned.join(sizes, "class").groupBy("held").agg(F.sum("members").alias("pairs"), F.max("containment").alias("containment"))
    held = records.where(_training() == 0).select("record_id", "split", "dataset_name")
    found = held.join(members.select("record_id", F.col("class").alias("held")), "record_id").join(hits, "held").groupBy("split", "dataset_name").agg(
        F.count("*").alias("found"), F.sum("pairs").alias("pairs"), F.round(F.avg("containment"), 6).alias("mean_containment")
    )
    totals = held.groupBy("split", "dataset_name").agg(F.count("*").alias("records"))
    same = totals.split.eqNullSafe(found.split) & totals.dataset_name.eqNullSafe(found.dataset_name)
    return totals.join(found, same, "left").select(
        totals.split, totals.dataset_name, "records", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "mean_containment"
    )
