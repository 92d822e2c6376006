"""Near-duplicate texts: MinHash bands for candidates, edit distance for verification, containment of short texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import levenshtein_similarity, normalize_text
from curatrix.plans.stages import BROADCAST_ROWS, materialize, small_side

PRIME = 2_147_483_647
#: Texts of one band in a part of the join that pairs them.
BAND_ROWS = 4096


def permutations(n: int, seed: int = 11) -> list[tuple[int, int]]:
    """Coefficients (a, b) of h -> (a h + b) mod 2^31 - 1 from a linear congruential sequence."""
    out, x = [], seed
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def bands_for(threshold: float, n: int) -> tuple[int, int]:
    """(bands, rows) that balance the areas of false positives and negatives of a threshold."""
    grid = (np.arange(1000) + 0.5) / 1000
    best = None
    for b in range(1, n + 1):
        for r in range(1, n // b + 1):
            p = 1 - (1 - grid**r) ** b
            error = p[grid < threshold].sum() + (1 - p[grid >= threshold]).sum()
            if best is None or error < best[0]:
                best = (error, b, r)
    return best[1], best[2]


def _modulo(x: np.ndarray) -> np.ndarray:
    """Remainder by 2^31 - 1 of numbers below 2^62, by folding the upper bits onto the lower ones."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


def band_hashes(texts: DataFrame, key: str, text: str, n: int, bands: int, rows: int, perms: int, seed: int = 11) -> DataFrame:
    """(key, band, hash) of every text with at least ``n`` characters.

    Minima over a text's windows are one NumPy reduction a text; with built-ins they would need every window exploded
    for every permutation.
    """
    coefficients = permutations(perms, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.array([x for x, _ in coefficients[: bands * rows]], np.int64)[:, None]
        b = np.array([x for _, x in coefficients[: bands * rows]], np.int64)[:, None]
        known: dict[str, int] = {}
        for batch in batches:
            keys, hashed = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None or len(t) + 2 < n:
                    continue
                s = f"^{t}$"
                windows = {s[i : i + n] for i in range(len(s) - n + 1)}
                if len(known) > 500_000:
                    known.clear()
                # Texts made from one template share most of their windows, which are hashed once.
                for w in windows.difference(known):
                    known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % PRIME
                h = np.array([known[w] for w in windows], np.int64)
                least = np.full(len(a), PRIME, np.int64)
                for at in range(0, len(h), 4096):
                    least = np.minimum(least, _modulo(a * h[None, at : at + 4096] + b).min(1))
                values = least.tolist()
                keys.append(k)
                hashed.append([hashlib.md5(",".join(map(str, values[i * rows : (i + 1) * rows])).encode()).hexdigest() for i in range(bands)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashed, pa.list_(pa.string()))], [key, "hashes"])

    # Spread first: texts that were just grouped may lie in few partitions, and signing them is the costly step.
    spread = texts.select(key, text).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return spread.mapInArrow(sign, f"{key} long, hashes array<string>").select(key, F.posexplode("hashes").alias("band", "hash"))


def window_hashes(df: DataFrame, key: str, text: str, n: int, only: np.ndarray | None = None) -> DataFrame:
    """(key, gram): hashes of the distinct windows of ``n`` characters of every text, or those of them among the sorted
    hashes ``only``. Cut in Python, since a substring of a UTF-8 string is found by counting from its start, which makes all
    windows of a long text quadratic."""
    import xxhash

    held = None if only is None else df.sparkSession.sparkContext.broadcast(only)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = t or ""
                if len(s) < n:
                    continue
                grams = np.unique(np.array([xxhash.xxh3_64_intdigest(s[i : i + n]) - (1 << 63) for i in range(len(s) - n + 1)], np.int64))
                if held is not None:
                    at = np.searchsorted(held.value, grams)
                    grams = grams[held.value[np.minimum(at, len(held.value) - 1)] == grams] if len(held.value) else grams[:0]
                if len(grams):
                    keys.append(k)
                    lists.append(grams)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], [key, "grams"])

    return df.select(key, text).mapInArrow(cut, f"{key} long, grams array<long>").select(key, F.explode("grams").alias("gram"))


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, copies): one row a distinct text, that of the least key. The text itself never is a shuffle key."""
    hashed = df.where(F.col(text).isNotNull()).select(key, F.col(text), F.md5(text).alias("_h"))
    return hashed.groupBy("_h").agg(F.min(key).alias(key), F.min_by(text, key).alias(text), F.count("*").alias("copies")).select(key, text, "copies")


def banded_pairs(hashes: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (id_a < id_b) that share a band. Bands of one text are dropped before the join, and a band that very
    many texts share is spread: each of them is in one part and meets all parts."""
    shared = hashes.groupBy("band", "hash").agg(F.count("*").alias("_n")).where("_n > 1").select("band", "hash", F.ceil(F.col("_n") / BAND_ROWS).cast("int").alias("_parts"))
    held = hashes.join(shared, ["band", "hash"])
    a = held.select(F.col(key).alias("id_a"), "band", "hash", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"))
    b = held.select(F.col(key).alias("id_b"), "band", "hash", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return a.join(b, ["band", "hash", "_part"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 13, threshold: float = 0.8, perms: int = 128, least: float = 0.92) -> DataFrame:
    """Pairs (id_a < id_b, levenshtein_sim) of distinct normalised texts that share a MinHash band and whose edit
    similarity is at least ``least``. Copies are represented by their least key."""
    bands, rows = bands_for(threshold, perms)
    texts = materialize(distinct_texts(df.select(key, normalize_text(F.col(text)).alias("norm")), key, "norm").drop("copies"), "texts")
    # Both sides of the join read the signatures, which are the costly step.
    hashes = materialize(band_hashes(texts, key, "norm", n, bands, rows, perms), "bands")
    candidates = banded_pairs(hashes, key)
    ta, tb = (texts.select(F.col(key).alias(f"id_{s}"), F.col("norm").alias(f"t{s}")) for s in "ab")
    similarity = levenshtein_similarity(F.col("ta"), F.col("tb"), least)
    return candidates.join(ta, "id_a").join(tb, "id_b").select("id_a", "id_b", F.round(similarity, 6).alias("levenshtein_sim")).where("levenshtein_sim is not null")


def memberships(df: DataFrame, key: str, text: str, n: int = 0) -> DataFrame:
    """(key, rep): each row and the least key with the same normalised text, of texts that have a window of ``n``
    characters."""
    norm = df.select(key, normalize_text(F.col(text)).alias("_t"))
    hashed = norm.where(F.length("_t") + 2 >= n).select(key, F.md5("_t").alias("_h"))
    reps = hashed.groupBy("_h").agg(F.min(key).alias("rep"))
    return hashed.join(reps, "_h").select(key, "rep")


def copy_classes(members: DataFrame, pairs: DataFrame, similarity: str = "levenshtein_sim") -> DataFrame:
    """(rep, copies, hits, top): every class of equal texts with its rows, the other rows that each of them matches (its
    copies, and all rows of the classes that ``pairs`` joins it to, from either end) and the best similarity of those.
    Rows are counted by class sizes, so a text that a third of all rows share is not joined with itself."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = _both_ends(pairs, similarity).join(sizes.select(F.col("rep").alias("other"), F.col("copies").alias("many")), "other")
    near = ends.groupBy("rep").agg(F.sum("many").alias("many"), F.max("sim").alias("top"))
    one = sizes.join(near, "rep", "left")
    copied = F.col("copies") > 1
    return one.select("rep", "copies", (F.col("copies") - 1 + F.coalesce("many", F.lit(0))).alias("hits"), F.when(copied, F.lit(1.0)).otherwise(F.col("top")).alias("top"))


def _both_ends(pairs: DataFrame, similarity: str) -> DataFrame:
    one = pairs.select(F.col("id_a").alias("rep"), F.col("id_b").alias("other"), F.col(similarity).alias("sim"))
    return one.unionByName(pairs.select(F.col("id_b").alias("rep"), F.col("id_a").alias("other"), F.col(similarity).alias("sim")))


def row_report(pairs: DataFrame, members: DataFrame, rows: int | DataFrame, similarity: str = "levenshtein_sim", edges: tuple[float, ...] = (0.80, 0.85, 0.90, 0.95, 1.01)) -> DataFrame:
    """``pair_report`` of all rows instead of one a distinct text: every row asks all others, so exact copies are matches of
    similarity 1 and a pair counts from both ends. ``pairs`` are those of distinct texts, ``members`` (key, rep) their rows."""
    total = rows.count() if isinstance(rows, DataFrame) else rows
    pairs, members = materialize(pairs, "pairs"), materialize(members, "members")
    classes = materialize(copy_classes(members, pairs, similarity), "classes")
    hit = classes.where("hits > 0")
    c = F.col("copies")
    heads = hit.agg(
        F.coalesce(F.sum(c * F.col("hits")), F.lit(0)).alias("pairs"), F.coalesce(F.sum(c), F.lit(0)).alias("hit_queries"), (F.coalesce(F.sum(c), F.lit(0)) / F.lit(max(1, total))).alias("hit_rate"), (F.sum(c * F.col("hits")) / F.sum(c)).alias("mean_hits"), F.max("hits").alias("max_hits"),
        (F.sum(c * F.col("top")) / F.sum(c)).alias("top_mean"), F.percentile("top", F.lit(0.5), c).alias("top_median"), F.percentile("top", F.lit(0.95), c).alias("top_p95"),
    )
    size = lambda k: classes.select(F.col("rep").alias(k), F.col("copies").alias(f"n_{k}"))
    between = pairs.join(size("id_a"), "id_a").join(size("id_b"), "id_b").select(F.col(similarity).alias("sim"), (2 * F.col("n_id_a") * F.col("n_id_b")).alias("n"))
    counted = between.unionByName(classes.where("copies > 1").select(F.lit(1.0).alias("sim"), (c * (c - 1)).alias("n")))
    bins = [F.coalesce(F.sum(F.when((F.col("sim") >= lo) & (F.col("sim") < hi), F.col("n"))), F.lit(0)).alias(f"bin_{int(round(lo * 100))}") for lo, hi in zip(edges, edges[1:])]
    return heads.crossJoin(F.broadcast(counted.agg(*bins)))


def row_templates(pairs: DataFrame, members: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` rows that match most other rows, copies included. A class is named by its least key, so the rows are
    among the classes that are first by matches and name."""
    pairs, members = materialize(pairs, "pairs"), materialize(members, "members")
    first = copy_classes(members, pairs).where("hits > 0").orderBy(F.desc("hits"), "rep").limit(k)
    return members.join(F.broadcast(first), "rep").select(F.col(key).alias("id"), F.col("hits").alias("matches")).orderBy(F.desc("matches"), "id").limit(k)


def row_best(pairs: DataFrame, members: DataFrame, key: str, similarity: str = "levenshtein_sim") -> DataFrame:
    """(id_a, id_b, similarity): every row that matches any and its best match, a copy before others, then the least key."""
    pairs, members = materialize(pairs, "pairs"), materialize(members, "members")
    # Second least key: the match of the row that names its class.
    copied = members.where(F.col(key) != F.col("rep")).groupBy("rep").agg(F.min(key).alias("second"))
    ends = _both_ends(pairs, similarity)
    near = ends.groupBy("rep").agg(F.min(F.struct((-F.col("sim")).alias("d"), F.col("other").alias("other"))).alias("m"))
    best = copied.join(near, "rep", "full").select("rep", "second", F.col("m.other").alias("other"), F.when(F.col("second").isNotNull(), F.lit(1.0)).otherwise(-F.col("m.d")).alias(similarity))
    match = F.when(F.col("second").isNull(), F.col("other")).when(F.col(key) == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    return members.join(best, "rep").select(F.col(key).alias("id_a"), match.alias("id_b"), similarity)


def contained(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", n: int = 13, least: float = 0.8) -> DataFrame:
    """(doc, item, shared, size, containment): share of an item's distinct windows that a text holds, from ``least`` on.
    While the items' distinct windows number within the checked limit, they are broadcast and texts' windows are sifted by
    them where they are cut, so only hits leave a batch; beyond it both sides are shuffled."""
    windows = lambda df, key, only=None: window_hashes(df.select(key, normalize_text(F.col(text)).alias("norm")), key, "norm", n, only)
    grams = materialize(windows(items, item), "windows")
    sizes = grams.groupBy(item).agg(F.count("*").alias("size"))
    total = grams.count()
    only = np.sort(grams.select("gram").distinct().toArrow().column("gram").to_numpy()) if total <= BROADCAST_ROWS else None
    shared = windows(docs, doc, only).join(small_side(grams, total), "gram").groupBy(doc, item).agg(F.count("*").alias("shared"))
    return shared.join(sizes, item).select(doc, item, "shared", "size", F.round(F.col("shared") / F.col("size"), 6).alias("containment")).where(F.col("containment") >= least)


def pair_report(pairs: DataFrame, query: str, match: str, similarity: str, queries: int | DataFrame, edges: tuple[float, ...] = (0.80, 0.85, 0.90, 0.95, 1.01)) -> DataFrame:
    """One row: pairs, distinct queries that hit, hit rate, mean and most hits a query, best similarity (mean, median,
    95th percentile), and counts by similarity bin."""
    total = queries.count() if isinstance(queries, DataFrame) else queries
    per = pairs.groupBy(query).agg(F.count("*").alias("hits"), F.max(similarity).alias("top"))
    bins = [F.count_if((F.col(similarity) >= lo) & (F.col(similarity) < hi)).alias(f"bin_{int(round(lo * 100))}") for lo, hi in zip(edges, edges[1:])]
    heads = per.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("pairs"), F.count("*").alias("hit_queries"), (F.count("*") / F.lit(max(1, total))).alias("hit_rate"), F.avg("hits").alias("mean_hits"), F.max("hits").alias("max_hits"),
        F.avg("top").alias("top_mean"), F.percentile("top", F.lit(0.5)).alias("top_median"), F.percentile("top", F.lit(0.95)).alias("top_p95"),
    )
    return heads.crossJoin(F.broadcast(pairs.agg(*bins)))


def top_templates(pairs: DataFrame, side: str, other: str, k: int = 10) -> DataFrame:
    """The ``k`` ids that match most different others."""
    return pairs.groupBy(F.col(side).alias("id")).agg(F.countDistinct(other).alias("matches")).orderBy(F.desc("matches"), "id").limit(k)


def best_per_query(pairs: DataFrame, query: str, match: str, similarity: str) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(similarity), match)
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def capped(candidates: DataFrame, query: str, match: str, limit: int) -> DataFrame:
    """At most ``limit`` candidates a query, the least by id, and in ``left_out`` how many others it has, so that a cut is
    seen. The bound on the rank lets each task cut before the shuffle."""
    order = Window.partitionBy(query).orderBy(match)
    few = candidates.select(query, match).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    total = candidates.groupBy(query).agg(F.count("*").alias("_n"))
    return few.join(total, query).select(query, match, "rank", F.greatest(F.col("_n") - limit, F.lit(0)).alias("left_out"))
