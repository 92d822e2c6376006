"""Token ids against the public library, leaks against brute force, and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import p7_tokens as p7
from curatrix.llm import p8_leaks as p8
from curatrix.llm.text import words
from curatrix.plans.tables import table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return p7.Encoder(p7.read_ranks())


def test_ids_of_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in p7.token_ids(docs).collect()}
    assert got == {k: library(v or "") for k, v in texts.items()}


@pytest.mark.parametrize("text", ["", " ", "\n\n \t", "<|endoftext|> x", "a" * 3000, "ab" * 2000, "é中🧬​" * 300, "\x00\x01", "don't I'LL 12345", "!" * 700 + "?", "  　x"])
def test_ids_of_odd_texts(encoder, library, text):
    assert encoder.encode(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_random_texts(text):
    one = test_ids_of_random_texts
    if not hasattr(one, "held"):
        t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
        t.encode_special_tokens = True
        one.held = (p7.Encoder(p7.read_ranks()), t)
    encoder, t = one.held
    assert encoder.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_null_rows_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "a", "z")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in p7.token_ids(df).collect())
    assert got == [(1, []), (2, []), (2, [64])]
    assert p7.token_ids(df.limit(0)).count() == 0


def test_rank_queue_pops_in_order():
    q = p7.RankQueue()
    for rank, position in ((50_000, 3), (5, 9), (5, 2), (4096, 1), (63, 0), (64, 0)):
        q.add(rank, position)
    got = []
    while (item := q.pop()) is not None:
        got.append(item)
    assert got == [(5, [2, 9]), (63, [0]), (64, [0]), (4096, [1]), (50_000, [3])]


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - 9):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + 10]), ())}
    return out


def test_leaks_equal_brute_force(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark_items"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = [(r["doc_id"], r["item_id"]) for r in p8.leaks(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_leak_edges(spark, monkeypatch):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, f"Start. {ten.upper()} end"), (2, ten.replace("five", "5")), (3, "one two three"), (4, None), (5, ""), (6, f"{'filler ' * 70_000}{ten}"), (7, ten.rsplit(" ", 1)[0]), (1, ten)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, f"{ten} eleven", "d", "test"), (11, f"zero {ten}", "d", "test"), (12, "too short", "d", "test"), (13, None, "d", "test")], "item_id long, text string, dataset_name string, split string")
    want = [(1, 10), (1, 10), (1, 11), (1, 11), (6, 10), (6, 11)]
    assert sorted((r["doc_id"], r["item_id"]) for r in p8.leaks(docs, items).collect()) == want
    report = {r["item_id"]: (r["documents"], r["most_windows"]) for r in p8.leaked_items(docs, items).collect()}
    assert report == {10: (3, 1), 11: (3, 1), 12: (0, 0), 13: (0, 0)}
    monkeypatch.setattr(p8, "ITEM_WORDS", 5)  # many broadcast blocks
    assert sorted((r["doc_id"], r["item_id"]) for r in p8.leaks(docs, items).collect()) == want
    assert p8.leaks(docs.limit(0), items).count() == 0 and p8.leaks(docs, items.limit(0)).count() == 0


def test_many_items_are_joined_not_broadcast(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark_items"))
    want = sorted(map(tuple, p8.leaks(docs, items).collect()))
    monkeypatch.setattr(p8, "ITEM_WORDS", 50)
    assert sorted(map(tuple, p8.leaks(docs, items).collect())) == want and want


def test_changed_words_are_found_by_either_way(spark, monkeypatch):
    """One word of a passage is another one: every such passage is found below similarity 1, none at 1."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 5000, 10)) for _ in range(40)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    docs = []
    for i, t in enumerate(texts):
        w = t.split()
        w[i % 10] = "changed"
        docs.append((i, " ".join(["before", *w, "after"])))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (p8.ITEM_WORDS, 50):
        monkeypatch.setattr(p8, "ITEM_WORDS", limit)
        assert {(r["doc_id"], r["item_id"]) for r in p8.leaks(documents, items, similarity=0.85).collect()} == {(i, i) for i in range(40)}
        assert p8.leaks(documents, items).count() == 0


def test_words_weigh_their_letters():
    item = np.array([[p8._Hashes()[w] for w in "a b c d e f g h i longestword".split()]], np.uint64)
    short, long = item.copy(), item.copy()
    short[0, 0] = long[0, 9] = np.uint64(16)
    cut = p8.runs(10, 1)
    assert cut == [(0, 5), (5, 5)]
    assert p8.verified(short, item, 0.9, cut).all() and not p8.verified(long, item, 0.9, cut).any() and p8.verified(long, item, 0.4, cut).all()


def test_blocks_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    index = p8.ItemIndex([(i, " ".join(f"w{k}" for k in rng.integers(0, 500, 30))) for i in range(20)])
    base = index.prints[rng.integers(0, len(index.prints), 200)]
    flipped = base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    window, entry = index.candidates(flipped)
    near = np.bitwise_count(flipped[:, None] ^ index.prints[None]) <= p8.RADIUS
    assert set(zip(window.tolist(), entry.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))
