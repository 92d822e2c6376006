"""Problem 8: documents that hold a passage of an evaluation item.

Every window of ``PASSAGE`` consecutive words, the length from which a passage counts, is cut into ``changed + 1`` runs of
words, and each run gets a 64-bit SimHash, in documents and items alike. The items' fingerprints are indexed in blocks of
bits: of ``RADIUS + 1`` blocks at least one is equal for any two fingerprints within the radius, so looking up each block
of a document's window finds all of them. Two windows that differ in at most ``changed`` words, place by place, have a run
in common and so an equal fingerprint: none is missed. Candidates are verified on their words: a run must be equal, and
the weight of the words that agree, place by place, must reach ``SIMILARITY`` of the item's window (a word weighs its
letters, up to 15). At 1, the value of the found query, the windows are equal word by word and ``changed`` is 0.

Items of up to ``ITEM_WORDS`` words are one broadcast index, and documents are scanned where they lie, without a shuffle.
More items than that are not broadcast: documents' windows are sifted by a bitmap of the items' fingerprints, of at most
``1 << BITMAP_BITS`` bits, and only those that pass are joined with the items' windows by fingerprint and verified.

Cases: null, empty and short texts (under ten words) hold no passage, and items under ten words are never found;
windows never cross from one text to the next; equal windows of several items report all of them; repeated documents
give rows each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.text import words
from curatrix.plans.stages import materialize

PASSAGE, RADIUS, SIMILARITY = 10, 2, 1.0
#: Words of items in the broadcast index: at most about 60 MB.
ITEM_WORDS = 500_000
#: Bits, as a power of two, of the bitmap that sifts windows when there are more items: 32 MB.
BITMAP_BITS = 28
_BITS_A_CHUNK = 1 << 20
_CHUNK = 60_000


class _Hashes(dict):
    """Hashes of words whose lowest four bits are the word's weight."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) & ~15 | min(len(word), 15)
        return value


def simhash(hashes: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of every window of ``length`` words: bit k is set if most of its words' hashes have bit k."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    bits = np.unpackbits((mixed ^ (mixed >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    more = (sums[length:] - sums[:-length]) * 2 > length
    return np.packbits(more, axis=1, bitorder="little").view(np.uint64).ravel()


def _windows(texts: list, memory: _Hashes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, start of each window, text of each window); windows lie within one text."""
    found = [[memory[w] for w in words(t)] for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    hashes = np.array([h for f in found for h in f], np.uint64)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.cumsum(sizes) - sizes, counts)
    return hashes, start, owner


def _blocks(radius: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def runs(length: int, changed: int) -> list[tuple[int, int]]:
    """(start, words) of the runs a window is cut into."""
    edges = np.linspace(0, length, changed + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def verified(theirs: np.ndarray, own: np.ndarray, similarity: float, cut: list[tuple[int, int]]) -> np.ndarray:
    """Which windows agree with the items' windows: one run is equal, and the equal words carry enough weight."""
    same = theirs == own
    weight = (own & np.uint64(15)).astype(np.int64)
    enough = (same * weight).sum(1) >= similarity * weight.sum(1) - 1e-9
    return enough & np.any([same[:, a : a + n].all(1) for a, n in cut], axis=0)


class ItemIndex:
    """Distinct windows of items by blocks of the fingerprints of their runs."""

    def __init__(self, items: list[tuple[int, str]], length: int = PASSAGE, radius: int = RADIUS, changed: int = 0):
        self.length, self.radius, self.runs = length, radius, runs(length, changed)
        hashes, start, owner = _windows([t for _, t in items], _Hashes(), length)
        ids = np.array([i for i, _ in items], np.int64)
        rows = hashes[start[:, None] + np.arange(length)] if len(start) else np.zeros((0, length), np.uint64)
        # Equal windows are one entry with all their items.
        self.rows, entry = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        owners = np.unique(np.stack([entry.ravel(), ids[owner]], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.item = owners[:, 1]
        self.first = np.searchsorted(owners[:, 0], np.arange(len(self.rows) + 1))
        self.run_prints = [simhash(np.ascontiguousarray(self.rows[:, a : a + n]).ravel(), n)[::n] if len(self.rows) else np.zeros(0, np.uint64) for a, n in self.runs]
        self.tables = []
        for prints in self.run_prints:
            self.tables.append([])
            for shift, width in _blocks(radius):
                value = self.block(prints, shift, width)
                order = np.argsort(value, kind="stable")
                self.tables[-1].append((shift, width, value[order], order))

    @property
    def prints(self) -> np.ndarray:
        return self.run_prints[0]

    @staticmethod
    def block(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def candidates(self, prints: np.ndarray, run: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) of all whose fingerprints of a run are within the radius, each once for every block that is equal."""
        out = []
        for shift, width, values, order in self.tables[run]:
            mine = self.block(prints, shift, width)
            low, high = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            window = np.repeat(hit, count)
            entry = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)]
            near = np.bitwise_count(prints[window] ^ self.run_prints[run][entry]) <= self.radius
            out.append((window[near], entry[near]))
        return np.concatenate([w for w, _ in out]), np.concatenate([e for _, e in out])


def _printed(hashes: np.ndarray, start: np.ndarray, length: int, cut: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(windows, the fingerprints of each of their runs) of some texts, in pieces of bounded memory."""
    for k in range(0, len(hashes) - length + 1, _CHUNK):
        inside = np.flatnonzero((start >= k) & (start < k + _CHUNK))
        piece = hashes[k : k + _CHUNK + length - 1]
        prints = {n: simhash(piece, n) for n in {n for _, n in cut}}
        at = start[inside] - k
        yield inside, [prints[n][at + a] for a, n in cut]


def _scan(held, similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = held.value
        memory, length = _Hashes(), index.length
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, batch.num_rows, 500):
                hashes, start, owner = _windows(texts.slice(at, 500).to_pylist(), memory, length)
                if not len(start) or not len(index.rows):
                    continue
                hits = [np.zeros((0, 2), np.int64)]
                for inside, prints in _printed(hashes, start, length, index.runs):
                    for number, mine in enumerate(prints):
                        window, entry = index.candidates(mine, number)
                        if len(window):
                            good = verified(hashes[start[inside[window]][:, None] + np.arange(length)], index.rows[entry], similarity, index.runs)
                            hits.append(np.stack([inside[window[good]], entry[good]], 1))
                hits = np.unique(np.concatenate(hits), axis=0)
                if not len(hits):
                    continue
                found: dict[tuple[int, int], set] = {}
                for w, e in hits.tolist():
                    for item in index.item[index.first[e] : index.first[e + 1]].tolist():
                        found.setdefault((int(owner[w]), item), set()).add(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at + d] for d, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array([len(e) for e in found.values()], pa.int32())],
                    ["doc_id", "item_id", "windows"],
                )

    return run


def _keys(prints: np.ndarray, run: int) -> np.ndarray:
    """Join key of a run's fingerprint; its highest bits are its place in the bitmap."""
    x = (prints ^ np.uint64(run)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _exploded(names: tuple[str, ...], length: int, cut: list[tuple[int, int]], bitmap=None) -> Callable:
    """(key, the named columns, words) of every run of every window; with a bitmap only of those whose key is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        known = None if bitmap is None else bitmap.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, start, owner = _windows(part.column("text").to_pylist(), memory, length)
                for inside, prints in _printed(hashes, start, length, cut):
                    for number, mine in enumerate(prints):
                        key = _keys(mine, number)
                        place = (key >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                        keep = np.arange(len(key)) if known is None else np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                        rows = hashes[start[inside[keep]][:, None] + np.arange(length)]
                        owners = pa.array(owner[inside[keep]])
                        yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), *(part.column(c).take(owners) for c in names), pa.array([r.tobytes() for r in rows], pa.binary())], ["key", *names, "words"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the bitmap of a partition's keys."""
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        place = (batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        for c in np.unique(place // _BITS_A_CHUNK).tolist():
            own = place[place // _BITS_A_CHUNK == c] % _BITS_A_CHUNK
            np.bitwise_or.at(chunks.setdefault(c, np.zeros(_BITS_A_CHUNK >> 3, np.uint8)), own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
    for c, bits in chunks.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["id", "bits"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, bits in zip(batch.column("id").to_pylist(), batch.column("bits").to_pylist()):
            chunks.setdefault(c, np.zeros(_BITS_A_CHUNK >> 3, np.uint8))[:] |= np.frombuffer(bits, np.uint8)
    for c, bits in chunks.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["id", "bits"])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of the highest bits of all keys, merged in chunks where they lie; no more than the bitmap comes to the driver."""
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    size = _BITS_A_CHUNK >> 3
    for r in keys.mapInArrow(_marked, "id long, bits binary").repartition("id").mapInArrow(_merged, "id long, bits binary").toLocalIterator():
        out[r["id"] * size : (r["id"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(documents: DataFrame, items: DataFrame, length: int, similarity: float, changed: int) -> DataFrame:
    """``leaks`` for more items than are broadcast."""
    cut = runs(length, changed)
    entries = materialize(items.select("item_id", "text").mapInArrow(_exploded(("item_id",), length, cut), "key long, item_id long, words binary").distinct(), "item-windows")
    held = documents.sparkSession.sparkContext.broadcast(_bitmap(entries.select("key")))
    # Repeated documents have a row each, so a document is known by its place.
    placed = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    sifted = placed.mapInArrow(_exploded(("doc_id", "place"), length, cut, held), "key long, doc_id long, place long, words binary").withColumnRenamed("words", "theirs").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                theirs, own = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, length) for c in ("theirs", "words"))
                yield batch.drop_columns(["theirs"]).filter(pa.array(verified(theirs, own, similarity, cut)))

    good = sifted.join(entries, "key").select("doc_id", "place", "item_id", "words", "theirs").mapInArrow(check, "doc_id long, place long, item_id long, words binary")
    return good.groupBy("doc_id", "place", "item_id").agg(F.count_distinct("words").cast("int").alias("windows")).drop("place")


def leaks(documents: DataFrame, items: DataFrame, length: int = PASSAGE, radius: int = RADIUS, similarity: float = SIMILARITY, changed: int | None = None) -> DataFrame:
    """(doc_id, item_id, windows): documents with a passage of an item, and how many different windows of it they hold.
    ``changed`` is the number of words in which a window may differ; None takes 0 at similarity 1, else what it allows of
    words of one weight, at least 1."""
    if changed is None:
        changed = 0 if similarity >= 1 else max(1, int((1 - similarity) * length + 1e-9))
    sized = items.select(F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+")).alias("n"))
    if int(sized.agg(F.sum("n")).first()[0] or 0) > ITEM_WORDS:
        return _joined(documents, items, length, similarity, changed)
    rows = items.select("item_id", "text").collect()
    held = documents.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in rows], length, radius, changed))
    return documents.select("doc_id", "text").mapInArrow(_scan(held, similarity), "doc_id long, item_id long, windows int")


def leaked_items(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per item: dataset_name, split, documents that leak it, and the greatest share of its windows in one document."""
    found = leaks(documents, items, **options).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("windows").alias("most_windows"))
    return items.select("item_id", "dataset_name", "split").join(F.broadcast(found) if items.count() <= 100_000 else found, "item_id", "left").select(
        "item_id", "dataset_name", "split", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_windows", F.lit(0)).alias("most_windows")
    )
