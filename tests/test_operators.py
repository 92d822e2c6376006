"""Operators on small tables: invariants, ties, nulls, empty input."""

import os
import tarfile
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import prompts, records
from curatrix.functions.records import options_map
from curatrix.operators import analysis, balance, curation, evaluation, exports, filters, knn, merging, neardup, rubric
from curatrix.plans import stages
from curatrix.sources import images, readers, sinks
from curatrix.streaming import resume


def test_balanced_label_equals_greedy(spark):
    for n in (0, 1, 4, 5, 12, 23):
        want, counts = [], dict.fromkeys("ABCDE", 0)
        goal = balance.even_targets(n, tuple("ABCDE"))
        for _ in range(n):
            x = max("ABCDE", key=lambda k: (goal[k] - counts[k], -ord(k)))
            counts[x] += 1
            want.append(x)
        got = [r[0] for r in spark.range(n).orderBy("id").select(balance.balanced_label(F.col("id"), F.lit(n))).collect()]
        assert got == want


def test_ordinals_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = balance.ordinals(df, "k").orderBy("k").collect()
    assert [r["ordinal"] for r in got] == list(range(1000))
    assert balance.ordinals(df.limit(0), "k").count() == 0


def test_quotas():
    assert balance.k_quotas(1041, {1: 0.9, 2: 0.02, 3: 0.02, 4: 0.02, 5: 0.02, 6: 0.02}) == {1: 936, 2: 21, 3: 21, 4: 21, 5: 21, 6: 21}


def test_stratified_counts_and_repeatability(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("s"))
    pick = lambda: sorted(r["id"] for r in balance.stratified(df, "s", "id", 41, ("A", "B")).collect())
    assert pick() == pick()
    assert balance.stratified(df, "s", "id", 41, ("A", "B")).groupBy("s").count().orderBy("s").collect()[0]["count"] == 21


@pytest.mark.parametrize(("strategy", "want"), [("majority", "b"), ("first", "a"), ("last", "c")])
def test_resolve(spark, strategy, want):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "b", 2), (1, "c", 3), (1, None, 4), (2, "x", 0), (2, "y", 1)], "k int, l string, o int")
    got = {r["k"]: (r["l"], r["labels"]) for r in merging.resolve(df, "k", "l", ["o"], strategy).collect()}
    assert got[1] == (want, 3)
    assert got[2][0] == {"majority": "x", "first": "x", "last": "y"}[strategy]


def test_attach_last_wins_and_keeps_left_rows(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, o int")

    assert [r["v"] for r in merging.attach(left, right, ["k"], ["o"]).orderBy("k").collect()] == ["new", "new", None]


def test_fill_missing_or_force(spark):
    left = spark.createDataFrame([(1, None), (2, "keep"), (3, "none")], "k int, f string")
    right = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "", 1)], "k int, f string, o int")
    got = lambda force: [r["f"] for r in merging.filled(left, right, ["k"], "f", ["o"], force).orderBy("k").collect()]
    assert got(False) == ["a", "keep", "none"]
    assert got(True) == ["a", "b", "none"]


def test_matches_are_bounded_on_a_hot_key(spark):
    q = spark.range(50).select(F.col("id").alias("q"), F.lit("hot").alias("h"))
    r = spark.range(1000).select(F.col("id").alias("r"), F.lit("hot").alias("h"))
    assert merging.matches(q, r, "h", "q", "r", 3).count() == 150


def item(title, category, weight, score):
    return (title, category, weight, score)


RUBRIC = "id int, rubric array<struct<title:string,category:string,weight:int,score:int>>"


def test_rubric_scores(spark):
    rows = [
        (0, [item("a", "Essential", 5, 5), item("b", " pitfall\t", -2, -2), item("c", None, 3, 9)]),
        (1, [item("a", "Bonus", 0, 3), item("b", "Pitfall", -1, 2)]),
        (2, [item("a", "Essential", None, None), item("b", "Essential", 4, -1)]),
        (3, []),
        (4, None),
    ]
    got = [r["s"] for r in spark.createDataFrame(rows, RUBRIC).orderBy("id").select(rubric.scores(F.col("rubric")).alias("s")).collect()]
    assert got[0][:4] == (8, 8, 2, 6) and got[0]["norm"] == 0.75
    assert got[1]["norm"] is None and got[2]["norm"] == 0.0 and got[3]["norm"] is None and got[4]["norm"] is None


def test_required_titles(spark):
    rows = [
        (0, [item(" stem ", "e", 5, 1), item("Stem", "e", 5, 5), item("Two", "e", 3, 3)]),
        (1, [item("Stem", "e", 5, 4), item("Two", "e", None, None)]),
        (2, [item("Two", "e", 3, 3)]),
    ]
    ok, why = rubric.required_check(F.col("rubric"), ("Stem", "Two"))
    got = [(r["a"], r["b"]) for r in spark.createDataFrame(rows, RUBRIC).orderBy("id").select(ok.alias("a"), why.alias("b")).collect()]
    assert got == [(True, ""), (False, "essential_not_full:Stem;Two"), (False, "missing_titles:Stem")]


def test_majority_and_regrade(spark):
    df = spark.createDataFrame([(0, "A", [("x", "B", False), ("y", "A", True), ("z", "B", False), ("w", "A", True)]), (1, "A", [])], "i int, answer_label string, parsed array<struct<output_text:string,pred_letter:string,is_correct:boolean>>")
    a, b = evaluation.regraded(df).orderBy("i").collect()
    assert (a["num_correct"], a["majority_vote_pred_letter"], a["majority_at_num_rollouts"]) == (2, "B", False)
    assert (b["num_rollouts"], b["average_num_correct"], b["pass_at_num_rollouts"], b["majority_vote_pred_letter"]) == (0, None, False, None)


def test_model_table_skips_absent_datasets(spark):
    df = spark.createDataFrame([("m", "d1", 1, 2), ("m", "d2", 2, 2), ("n", "d1", 0, 2)], "model string, dataset_name string, num_correct int, num_rollouts int")
    got = {r["model"]: r for r in evaluation.model_table(df, ("d1", "d2")).collect()}
    assert got["m"]["overall_average"] == 75.0 and got["n"]["overall_average"] == 0.0 and got["n"]["d2"] is None


def test_cosine_topk_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = knn.cosine_topk(rows.where("id % 10 = 0"), rows, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 200, 10):
        s = np.round(u[q] @ u.T, 6)
        want = sorted(range(200), key=lambda r: (-s[r], r))[:4]
        assert [r["train_id"] for r in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want


def test_hamming_topk_with_ties_and_few_rows(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "id long, bits long")
    got = [(r["query_id"], r["train_id"], r["hamming"]) for r in knn.hamming_topk(rows.where("id = 1"), rows, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 64)]
    best = knn.best_other(knn.hamming_topk(rows, rows.where("id = 1"), 1), "hamming", high=False)
    assert {r["query_id"]: r["best"] for r in best.collect()} == {1: None, 2: 1, 3: 64}
    assert knn.overlap(best, (1, 70), high=False).orderBy("cut").select("hits", "valid").collect() == [(1, 2), (2, 2)]


def test_self_join_finds_every_text(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank number "
    df = spark.createDataFrame([(i, base * 3 + str(i % 4) * 2 + " tail" * (i // 4)) for i in range(8)] + [(90, None), (91, ""), (92, "short")], "id long, text string")
    pairs = neardup.near_duplicates(df, "id", "text", n=5, least=0.9).collect()
    assert pairs and all(r["id_a"] < r["id_b"] and r["levenshtein_sim"] >= 0.9 for r in pairs)
    members = {r["id"]: r["rep"] for r in neardup.memberships(df, "id", "text").collect()}
    assert members[0] == 0 and 90 not in members


def test_row_report_counts_copies_and_both_ends(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6)], "record_id long, rep long")
    pairs = spark.createDataFrame([(1, 4, 0.93)], "id_a long, id_b long, levenshtein_sim double")
    got = neardup.row_report(pairs, members, 8).collect()[0].asDict()
    # Rows 1, 2, 3 match each other and 4; 6 and 7 match; 5 matches none.
    assert (got["pairs"], got["hit_queries"], got["hit_rate"], got["max_hits"], got["bin_90"], got["bin_95"]) == (14, 6, 0.75, 3, 6, 8)
    assert got["mean_hits"] == pytest.approx(14 / 6) and got["top_mean"] == pytest.approx((5 + 0.93) / 6) and got["top_median"] == 1.0
    assert [tuple(r) for r in neardup.row_templates(pairs, members, "record_id", 5).collect()] == [(1, 3), (2, 3), (3, 3), (4, 3), (6, 1)]
    best = {r["id_a"]: (r["id_b"], r["levenshtein_sim"]) for r in neardup.row_best(pairs, members, "record_id").collect()}
    assert best == {1: (2, 1.0), 2: (1, 1.0), 3: (1, 1.0), 4: (1, 0.93), 6: (7, 1.0), 7: (6, 1.0)}
    none = neardup.row_report(pairs.limit(0), members.limit(0), 0).collect()[0]
    assert (none["pairs"], none["hit_queries"], none["hit_rate"], none["bin_95"]) == (0, 0, 0.0, 0)


def test_containment(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta yy"), (2, "nothing here at all"), (3, None)], "doc long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta"), (8, "ab")], "item long, text string")
    got = neardup.contained(docs, items, "doc", "item", n=5, least=0.9).collect()
    assert [(r["doc"], r["item"], r["containment"]) for r in got] == [(1, 7, 1.0)]


def test_distribution_total_counts_distinct_images_once(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), (None, ["x"])], "g string, i array<string>")
    got = {r["grp"]: r for r in analysis.distribution(df, F.col("g"), F.col("i"), (1, 2)).collect()}
    assert got["TOTAL"]["distinct_images"] == 2 and got["TOTAL"]["records"] == 3 and got["Unknown"]["k1"] == 1 and got["a"]["k2"] == 1


def test_groups_and_samples(spark):
    rows = [(i, ("im%d" % i, "art%d" % (i // 3), "cap", ["clinical imaging"], ["ultrasound"] if i % 2 else ["ultrasound", "eye"])) for i in range(60)] + [(99, ("im99", "art99", "No caption found", ["clinical imaging"], ["eye"]))]
    df = spark.createDataFrame(rows, "row_id long, mini_rec struct<image_id:string,article_accession_id:string,caption:string,image_primary_label:array<string>,image_secondary_label:array<string>>")
    cats = curation.allowed_categories(F.col("mini_rec.image_primary_label"), F.col("mini_rec.image_secondary_label"))
    groups = curation.groups(df, cats)
    assert groups.count() == 20 and {r["k"] for r in groups.collect()} == {3}
    drawn = curation.sample_groups(groups, ("eye", "ultrasound"), {3: 4}).collect()
    assert len({(r["article"], r["caption"]) for r in drawn}) == len(drawn) == 8
    assert sorted(r["category"] for r in drawn) == ["eye"] * 4 + ["ultrasound"] * 4


def test_exports_leave_out_unreadable_options(spark):
    rows = [(1, [(b"x", "p")], "q?", '{"A": "a", "B": "b"}', "A", "a", "d", "h", 1, " r ", None), (2, None, "q?", "A. a", "A", "a", "d", None, 2, None, None)]
    df = spark.createDataFrame(rows, "record_id long, images array<struct<bytes:binary,path:string>>, question string, options string, answer_label string, answer string, dataset_name string, hash string, dataset_index long, reasoning string, misc string")
    rl = exports.rl_records(df, "s", "train").collect()
    assert len(rl) == 1 and rl[0]["prompt"][0]["content"].startswith("<image>You will solve") and rl[0]["reward_model"]["ground_truth"] == "a"
    assert exports.sft_records(df).collect()[0]["response"] == "<think> r </think>\n<answer> A </answer>"
    assert exports.normalised_bytes(df).count() == 1
    assert [r["images"] for r in exports.standard(df).orderBy("record_id").collect()] == [[bytearray(b"x")], []]


def test_normalised_bytes_keeps_all_pictures_or_the_first(spark):
    from curatrix.plans import catalog

    pictures = [(bytes([i]), "p") for i in range(1, 5)]
    shape = "record_id long, images array<struct<bytes:binary,path:string>>, options string, hash string"
    df = spark.createDataFrame([(1, [(None, "p"), *pictures], "{}", None)], shape)
    held = lambda most: [bytes(x["bytes"]) for x in exports.normalised_bytes(df, most).collect()[0]["images"]]
    assert held(None) == [b"\1", b"\2", b"\3", b"\4"] and held(2) == [b"\1", b"\2"]
    found = catalog.queries()["normalised_bytes_all"](spark, "/root/testdata/sf0.01").agg(F.max("images")).first()[0]
    assert found > 2


def test_curate_sample_draws_all_group_sizes(spark, monkeypatch):
    from curatrix.plans import q_records

    rows = [(f"a{k}{i}", "c", k, ["endoscopy view"]) for k in range(1, 7) for i in range(23)]
    monkeypatch.setattr(q_records, "_groups", lambda spark, d: spark.createDataFrame(rows, "article string, caption string, k int, categories array<string>"))
    got = q_records.curate_sample(spark, "").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {1: 23, 2: 21, 3: 21, 4: 21, 5: 21, 6: 21}


def test_png_filters_and_pgm_round_trip():
    grey = np.arange(60, dtype=np.uint8).reshape(6, 10)
    assert (images.pixels(images.encode_png(grey)) == grey).all()
    assert (images.pixels(b"P5 # note\n10 6\n255\n" + grey.tobytes()) == grey).all()
    assert images.pixels(b"junk") is None and images.pixels(b"") is None and images.pixels(None) is None
    assert images.pixels(b"P5\n10 6\n255\n" + b"x") is None
    assert images.shrink(grey, 5).shape == (3, 5)
    assert bin(images.perceptual_bits(grey) ^ images.perceptual_bits(grey)).count("1") == 0


def test_json_lines_skip_bad_rows(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text('{"k": 1}\n\nbroken\n{"k": 2}\n')
    (folder / "y.txt").write_text('{"k": 9}\n')
    got = readers.json_lines(spark, str(tmp_path)).orderBy("ordinal").select(F.col("value").cast("string").alias("v")).collect()
    assert [json.loads(r["v"])["k"] for r in got] == [1, 2]
    assert [r["k"] for r in readers.json_records(spark, str(tmp_path), "k int, z string").orderBy("k").collect()] == [1, 2]


def test_parquet_filled(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "i long, x string").write.parquet(str(tmp_path / "p"))
    got = readers.parquet_filled(spark, str(tmp_path / "p"), {"x": F.lit(""), "y": F.lit("-"), "i": F.lit(-1)}).collect()
    assert tuple(got[0]) == ("a", "-", 1)
    assert readers.path_list("a, b,a,,c") == ["a", "b", "c"] and readers.reader_for("x.PQ") == "parquet" and readers.reader_for("x.csv") == "json"


def test_archives(spark, tmp_path):
    def add(tar, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "one.tar", "w") as tar:
        add(tar, "b.json", json.dumps({"image_cluster_id": 5}).encode())
        add(tar, "b.jpg", b"picture")
        add(tar, "a.json", b"{bad")
        add(tar, "c.json", b"{}")
    (tmp_path / "two.tar").write_bytes(b"not an archive")
    got = readers.archives(spark, str(tmp_path)).collect()
    assert [(r["member"], r["picture"]) for r in got] == [("b.json", "b.jpg")]
    wanted = spark.createDataFrame([(got[0]["archive"], "b.jpg"), (got[0]["archive"], "none.jpg")], "archive string, member string")
    assert [bytes(r["bytes"]) for r in readers.archive_pictures(spark, str(tmp_path), wanted).collect()] == [b"picture"]


def test_sinks(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "k")
    sinks.sharded(df, str(tmp_path / "s"), "k", 10)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()) == [(0, 10), (1, 10), (2, 5)]
    sinks.json_lines(df.withColumn("t", F.lit(None).cast("string")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 25
    sinks.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 25
    sinks.one_parquet(df, str(tmp_path / "o"), "k string")
    assert len([f for f in os.listdir(tmp_path / "o") if f.endswith(".parquet")]) == 1
    assert json.loads(sinks.summary(df.agg(F.sum("k").alias("s"))).first()[0]) == {"s": 300}


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    work = lambda df: df.withColumn("y", F.col("k") * 2)
    spark.range(5).withColumnRenamed("id", "k").write.parquet(source)
    resume.run_available(spark, source, "k long", target, state, work, key="k")
    spark.range(3, 9).withColumnRenamed("id", "k").write.mode("append").parquet(source)
    resume.run_available(spark, source, "k long", target, state, work, key="k")
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == list(range(9))
    done = spark.read.parquet(target)
    assert resume.resume(spark.range(12).withColumnRenamed("id", "k"), done, "k", work).count() == 3


def test_model_step_is_called_in_batches(spark):
    df = spark.range(7).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    got = resume.model_step(df, lambda rows: [r["prompt"].upper() for r in rows], ["prompt"], batch=3).orderBy("id").collect()
    assert [r["raw_model_output"] for r in got] == [f"P{i}" for i in range(7)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", [[30, 40]]), (2, "b", [[20, 40]]), (3, "a", [])], "i int, n string, s array<array<int>>")
    assert [r["i"] for r in filters.equals(df, n="a").orderBy("i").collect()] == [1, 3]
    assert filters.first_by(df, ["i"], n="a").first()["i"] == 1
    assert [r[0] for r in df.orderBy("i").select(filters.large_enough(F.col("s"))).collect()] == [True, False, True]
    assert options_map is not None


def test_more_readers(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("The\n\n of \nthe\n")
    assert readers.stopwords(spark, str(tmp_path / "stop.txt")) == ("of", "the")
    (tmp_path / "a.json").write_text('[{"k": 1},\n {"k": 2}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "k int").count() == 2
    for model in ("m1", "m2"):
        (tmp_path / "runs" / model).mkdir(parents=True)
        (tmp_path / "runs" / model / "regraded_eval_results.jsonl").write_text('{"num_correct": 1}\n')
        (tmp_path / "runs" / model / "other.jsonl").write_text('{"num_correct": 9}\n')
    got = readers.result_files(spark, str(tmp_path / "runs"), "num_correct int").orderBy("model").collect()
    assert [(r["model"], r["num_correct"]) for r in got] == [("m1", 1), ("m2", 1)]
    (tmp_path / "b.jsonl").write_text('{"k": 5}\n')
    assert readers.read_any(spark, str(tmp_path / "b.jsonl")).first()["k"] == 5
    numbers = spark.createDataFrame([("7",), ("x",), (None,)], "x string").select(readers.index_number(F.col("x")).alias("n"))
    assert [r["n"] for r in numbers.collect()] == [7, -1, -1]


def test_examples_and_provenance(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.95), (2, 3, 0.1)], "q long, m long, s double")
    got = sinks.examples(pairs, rows, rows, "q", "m", "s", "id", 2).orderBy(F.desc("s")).collect()
    assert [(r["query_row"]["t"], r["match_row"]["t"]) for r in got] == [("a", "c"), ("a", "b")]
    sinks.provenance(rows, str(tmp_path / "args"), {"n": 13})
    assert json.loads(spark.read.text(str(tmp_path / "args")).first()[0]) == {"n": 13}
    sinks.per_source(rows.withColumn("source_file", F.concat(F.lit("x/"), F.col("t"), F.lit(".jsonl"))), str(tmp_path / "per"))
    assert sorted(d for d in os.listdir(tmp_path / "per") if d.startswith("source=")) == ["source=a", "source=b", "source=c"]


def test_reasoning_prefers_the_same_letter(spark):
    records = spark.createDataFrame([(1, "s", "B"), (2, "s", "C"), (3, "t", "A")], "record_id long, signature string, answer_label string")
    rollouts = spark.createDataFrame([("s", "A", "first", 0), ("s", "B", "own", 1), ("s", "B", "late", 2), ("s", "C", None, 3)], "signature string, letter string, reasoning string, at int")
    got = {r["record_id"]: (r["reasoning"], r["letter_matched"]) for r in merging.attach_reasoning(records, rollouts).collect()}
    assert got == {1: ("own", True), 2: ("first", False)}


def test_two_key_fallback(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (9, "z")], "a int, b string")
    right = spark.createDataFrame([(1, "q", "one", 0), (5, "y", "two", 1), (1, "x", "newer", 2)], "a int, b string, f string, o int")
    got = {r["b"]: (r["matched_by"], r["f"]) for r in merging.attach_two_keys(left, right, ["a"], ["b"], ["f"], ["o"]).collect()}
    assert got == {"x": ("first", "newer"), "y": ("second", "two"), "z": (None, None)}


def test_lines_are_numbered_and_a_missing_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nbroken\n{"x": 2}\n{"x": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 9}\n')
    got = readers.numbered(readers.json_lines(spark, str(tmp_path))).collect()
    assert sorted((r["source_file"][-7:], r["line_no"], r["line"]) for r in got) == [("a.jsonl", 1, '{"x": 1}'), ("a.jsonl", 2, '{"x": 2}'), ("a.jsonl", 3, '{"x": 3}'), ("b.jsonl", 1, '{"x": 9}')]
    assert readers.one_json_lines(spark, str(tmp_path / "b.jsonl")).count() == 1
    for path in (tmp_path / "none.jsonl", tmp_path):
        with pytest.raises(FileNotFoundError):
            readers.one_json_lines(spark, str(path))


def test_shards_are_concatenated_by_name(spark, tmp_path):
    for name, lines in (("dp_1.jsonl", "c\nd\n"), ("dp_0.jsonl", "a\nb\n"), ("other.jsonl", "x\n")):
        (tmp_path / name).write_text(lines)
    assert [r["line"] for r in sinks.concatenated(spark, str(tmp_path)).collect()] == ["a", "b", "c", "d"]


def test_conflicts_may_be_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3)], "k int, label string, at int")
    assert {(r["k"], r["label"]) for r in merging.resolve(df, "k", "label", ["at"], "none").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(ValueError):
        merging.resolve(df.unionByName(spark.createDataFrame([(2, "c", 4)], df.schema)), "k", "label", ["at"], "none")


def test_head_needs_enough_rows(spark):
    df = spark.range(5)
    assert sorted(r["id"] for r in balance.head(df, "id", 3).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        balance.head(df, "id", 6)


def test_pictures_are_read_from_paths(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"content")
    rows = [(b"own", str(tmp_path / "p.png")), (None, f"file://{tmp_path}/p.png"), (b"", str(tmp_path / "p.png")), (None, str(tmp_path / "none")), (None, None)]
    got = spark.createDataFrame(rows, "b binary, p string").select(images.bytes_or_file("b", "p").alias("x")).collect()
    assert [None if r["x"] is None else bytes(r["x"]) for r in got] == [b"own", b"content", b"content", None, None]


def test_folded_signatures_ignore_width_case_and_order(spark):
    rows = [("Ｗhat  IS it?", '{"A": "ﬁne", "B": "Left"}'), ("what is it?", '{"B": "fine", "A": " left "}'), ("what is it?", '{"A": "fine", "B": "right"}')]
    df = spark.createDataFrame(rows, "q string, o string").select(records.folded_signature(F.col("q"), records.options_map(F.col("o"))).alias("s"))
    a, b, c = (r["s"] for r in df.collect())
    assert a == b != c


def test_trainset_drops_rows_without_a_match_or_a_picture(spark):
    left = spark.createDataFrame([(1, 10, "x"), (2, 11, "y"), (3, None, "x"), (4, 12, "none"), (5, 13, "z")], "row int, i int, c string")
    right = spark.createDataFrame([(10, "x", "h", ["p"], 1), (99, "y", None, ["p"], 2), (98, "z", "h", None, 3)], "i int, c string, hash string, images array<string>, at int")
    got = merging.trainset(left, right, ["i"], ["c"], ["hash", "images"], ["at"]).collect()
    assert sorted((r["row"], r["hash"], r["matched_by"]) for r in got) == [(1, "h", "first"), (2, "", "second")]
    with pytest.raises(ValueError):
        merging.trainset(left.limit(0), right, ["i"], ["c"], ["hash", "images"], ["at"])


def test_rows_without_a_pair_get_an_error(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "mcq_id int")
    done = spark.createDataFrame([(1, '{"rubric": [{"title": "t", "weight": 2, "score": 1}]}'), (2, "no json")], "mcq_id int, raw_model_output string")
    got = {r["mcq_id"]: (r["error"], r["rubric"] and r["rubric"][0]["score"]) for r in prompts.verification_rows(rows, done).collect()}
    assert got == {1: (None, 1), 2: ("parse_error", None), 3: ("missing_mcq", None)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, name, default=None):
            return self.master if name == "spark.master" else default

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert stages.shared_folder(Session("local[4]")).endswith("curatrix-checkpoints")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            stages.shared_folder(Session(master))


def test_signature_remainders():
    x = np.random.default_rng(0).integers(0, 2**62, 5000)
    assert (neardup._modulo(x) == x % neardup.PRIME).all() and neardup._modulo(np.array([neardup.PRIME, 2 * neardup.PRIME, 0])).tolist() == [0, 0, 0]


def test_bands_of_many_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BAND_ROWS", 3)
    rows = [(i, 0, "hot") for i in range(11)] + [(i, 1, f"own{i}") for i in range(11)] + [(20, 0, "x"), (21, 0, "x")]
    got = [tuple(r) for r in neardup.banded_pairs(spark.createDataFrame(rows, "k long, band int, hash string"), "k").collect()]
    assert sorted(got) == [(i, j) for i in range(11) for j in range(i + 1, 11)] + [(20, 21)]
