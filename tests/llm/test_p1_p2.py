"""Cross-split overlap and small edits against brute force, and their edge cases."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import p1_overlap, p2_edits, wordjoin
from curatrix.llm.components import components
from curatrix.llm.text import option_texts, record_words, words
from curatrix.sources.images import encode_png

SHAPE = "record_id long, split string, question string, options string, images array<struct<bytes:binary,path:string>>, dataset_name string, a string, b string, id long, size int"


def table(spark, rows):
    full = [(*r, *([None] * (5 - len(r)))) for r in rows]
    return spark.createDataFrame([(i, s, q, o, p or None, "d", "x", "y", 7, 1) for i, s, q, o, p in full], SHAPE)


def brute(rows, level=(7, 10)):
    bags = [(r[0], Counter(record_words(r[2], r[3]))) for r in rows]
    bags = [(i, b) for i, b in bags if b]
    out = set()
    for k, (i, a) in enumerate(bags):
        for j, b in bags[k + 1 :]:
            overlap = (a & b).total()
            if level[1] * overlap >= level[0] * (a.total() + b.total() - overlap):
                out.add((min(i, j), max(i, j)))
    return out


def found(df):
    rows = [(r[0], r[1]) for r in df.select("record_a", "record_b").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            q = rows[rng.integers(len(rows))][2].split()
            for _ in range(rng.integers(0, 6)):
                q[rng.integers(len(q))] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                rng.shuffle(q)
            q = q[: max(1, len(q) - rng.integers(0, 4))]
        else:
            q = [str(w) for w in rng.choice(vocabulary, rng.integers(1, 24))]
        rows.append((i, "train" if rng.random() < 0.7 else "test", " ".join(q), '{"A": "same"}' if rng.random() < 0.5 else None))
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_edited_pairs_equal_brute_force(spark, seed):
    rows = random_rows(seed)
    assert found(p2_edits.edited_pairs(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_cross_split_pairs_equal_brute_force(spark, seed):
    rows = random_rows(seed)
    split = {r[0]: r[1] for r in rows}
    want = {(a, b) for a, b in brute(rows) if (split[a] == "train") != (split[b] == "train")}
    assert found(p1_overlap.cross_split_pairs(table(spark, rows))) == want


def test_split_shards_lose_nothing(spark, monkeypatch):
    """A word far commoner than a shard may hold is split over shards."""
    monkeypatch.setattr(wordjoin, "SHARD_ROWS", 7)
    monkeypatch.setattr(wordjoin, "ASKING_ROWS", 13)
    rows = random_rows(5)
    assert found(p2_edits.edited_pairs(table(spark, rows))) == brute(rows)


def test_tree_search_equals_blocks():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, (900, 2), dtype=np.uint64)
    prints[300:600] = prints[:300] ^ (np.uint64(1) << rng.integers(0, 60, (300, 2)).astype(np.uint64))
    size = np.full(900, 30)
    points, queries = np.arange(0, 900, 2), np.arange(900)
    got = []
    for search in (lambda *a: p2_edits.tree_search(*a, leaf=16), wordjoin.compare):
        pairs = set()
        search(prints, size, points, queries, p2_edits.LEVEL, lambda i, j, pairs=pairs: pairs.update(zip(i.tolist(), j.tolist())))
        got.append(pairs)
    assert got[0] == got[1] and len(got[0]) > 450


def test_thresholds_are_exact():
    level = wordjoin.Threshold(7, 10)
    for a in range(1, 60):
        for b in range(a, 60):
            least = next(o for o in range(a + 1) if o * 10 >= 7 * (a + b - o)) if a * 10 >= 7 * b else None
            assert (least is not None) == bool(level.sizes(a, b))
            if least is not None:
                assert level.needed(a + b) == least and level.differ(a + b) == a + b - 2 * least
                assert level.index(a) >= a - level.needed(2 * a) + 1 and level.probe(b) >= b - least + 1


def test_option_layouts():
    assert option_texts('{"A": "x y", "B": null, "C": "z"}') == ["x y", "z"]
    assert option_texts('{"A": "x y", "B": "cut of') == ["x y", "cut of"]
    assert option_texts("(A) one\nB) two\nC. three\nD: four") == ["one", "two", "three", "four"]
    assert option_texts('["A. one", "two"]') == ["one", "two"]
    assert option_texts(None) == option_texts("") == option_texts("{}") == []
    assert words("Ｆｕｌｌ x_y É ² <|end|>") == ["full", "x", "y", "é", "2", "end"]


def test_nulls_blanks_copies_and_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, "train", None, None), (2, "test", "  ", "{}"), (3, "train", "Same text here", None), (4, "test", "here, same TEXT!", ""), (5, "train", "same text here", None), (6, "train", long, None), (7, "test", long + " more", None), (8, None, "one", None)]
    assert found(p2_edits.edited_pairs(table(spark, rows))) == {(3, 4), (3, 5), (4, 5), (6, 7)}
    assert found(p1_overlap.cross_split_pairs(table(spark, rows))) == {(3, 4), (4, 5), (6, 7)}
    groups = {r["record_id"]: (r["group_id"], r["links"], r["copies"]) for r in p2_edits.edited_groups(table(spark, rows)).collect()}
    assert groups == {3: (3, 0, 3), 4: (3, 0, 3), 5: (3, 0, 3), 6: (6, 1, 1), 7: (6, 1, 1)}


def test_empty_table(spark):
    empty = table(spark, [(1, "train", None, None)]).limit(0)
    assert found(p2_edits.edited_pairs(empty)) == set() and found(p1_overlap.cross_split_pairs(empty)) == set()
    assert p2_edits.edited_groups(empty).count() == 0 and p1_overlap.overlap_report(empty).count() == 0


def picture(value, size=(4, 4)):
    return encode_png(np.full(size, value, np.uint8))


def test_pictures():
    same = p1_overlap.same_pictures
    a, near, far = picture(10), picture(14), picture(15)
    pgm = b"P5\n# c\n4 4\n255\n" + bytes([10] * 16)
    assert same([a], [near]) and not same([a], [far]) and same([a], [pgm])
    assert same([a, picture(90)], [picture(90), pgm]) and not same([a, a], [a]) and not same([a, picture(90)], [a, a])
    assert same(None, [None, b""]) and same([], None) and not same([a], None)
    assert not same([a], [picture(10, (2, 8))]) and same([b"odd"], [b"odd"]) and not same([b"odd"], [b"other"])


def test_pictures_with_line_filters():
    import struct
    import zlib

    grey = np.arange(64, dtype=np.uint8).reshape(8, 8) * 3
    lines = b"".join(b"\x01" + bytes([row[0], *((row[1:].astype(int) - row[:-1]) & 255).tolist()]) for row in grey)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    filtered = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert p1_overlap.same_pictures([filtered], [encode_png(grey)]) and not p1_overlap.same_pictures([filtered], [encode_png(255 - grey)])


def test_pictures_decide_pairs_and_report(spark):
    rows = [
        (1, "train", "a b c d", None, [(picture(10), "x")]), (2, "test", "a b c d", None, [(picture(13), None), (b"", "y"), (None, "z")]),
        (3, "validation", "a b c d", None, [(picture(99), "x")]), (4, "test", "a b c d", None, None), (5, "train", "d c b a", None, []),
    ]
    assert found(p1_overlap.cross_split_pairs(table(spark, rows))) == {(1, 2), (4, 5)}
    report = {r["split"]: (r["records"], r["found"], r["pairs"], r["mean_containment"]) for r in p1_overlap.overlap_report(table(spark, rows)).collect()}
    assert report == {"test": (2, 2, 2, 1.0), "validation": (1, 0, 0, None)}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2)) if a != b]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_text_with_many_pictures(spark):
    """One text on a third of the rows, each with its own or a shared picture: pairs follow the pictures."""
    rng = np.random.default_rng(9)
    rows, values = [], {}
    for i in range(120):
        values[i] = int(rng.integers(0, 256))
        rows.append((i, "train" if i % 3 else "test", "what is shown here", None, [(picture(values[i]), None)]))
    rows += [(1000 + i, "train", f"other{i} words{i} here{i}", None, None) for i in range(200)]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if (a % 3 == 0) != (b % 3 == 0) and abs(values[a] - values[b]) <= 4}
    df = table(spark, rows)
    assert found(p1_overlap.cross_split_pairs(df)) == want
    report = p1_overlap.overlap_report(df).collect()
    assert [(r["split"], r["records"], r["pairs"]) for r in report] == [("test", 40, len(want))]
    assert report[0]["found"] == len({x for p in want for x in p if x % 3 == 0}) and report[0]["mean_containment"] == 1.0
