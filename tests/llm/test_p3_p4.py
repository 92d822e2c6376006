"""Quotas and cutoffs: SQL, brute force, and edge cases."""

import math

import pytest

from curatrix.llm import p3_quota, p4_cutoffs
from curatrix.llm import queries as llm_queries
from curatrix.llm import sql as llm_sql
from tests.helpers import same_as_sql


@pytest.mark.parametrize("name", sorted(llm_sql.oracle_sql()))
def test_matches_sql(spark, name):
    same_as_sql(spark, llm_queries.queries()[name], llm_sql.oracle_sql()[name], "/root/testdata/sf0.01")


IMAGES = "row_id long, mini_rec struct<image_id:string,image_primary_label:array<string>,image_secondary_label:array<string>>, secondary_label string"
TARGETS = "primary_label string, secondary_label string, target_permille long, min_rows long"


def image(i, primary, secondary, name=None):
    return (i, (name or f"im{i}", primary, secondary), "clash")


def test_short_categories_and_sample(spark):
    rows = [image(i, ["Clinical-Imaging"], ["CT  slice."] + (["eye"] if i % 4 == 0 else [])) for i in range(200)]
    rows += [image(300 + i, ["microscopy"], ["light_micrograph"]) for i in range(3)] + [image(400, None, None), image(401, ["clinical imaging", None], [None, ""]), image(402, ["microscopy"], ["ct slice"])]
    rows += [image(500, ["clinical imaging"], ["ct slice"], "im0"), (501, None, "clash")]
    images = spark.createDataFrame(rows, IMAGES)
    targets = spark.createDataFrame([("clinical imaging", "ct slice", 600, 1), ("clinical imaging", "eye", 300, 2), ("microscopy", "light micrograph", 100, 5)], TARGETS)
    assert [r[0] for r in p3_quota.short_categories(images, targets).collect()] == ["light micrograph"]
    report = {r["secondary_label"]: r for r in p3_quota.quota_report(images, targets).collect()}
    assert report["ct slice"]["available"] == 200 and report["eye"]["available"] == 50 and report["light micrograph"]["sampled"] == 3
    drawn = p3_quota.quota_sample(images, targets).collect()
    counts = {}
    for r in drawn:
        counts[r["secondary_label"]] = counts.get(r["secondary_label"], 0) + 1
    size = 206 // 10
    assert counts == {"ct slice": math.ceil(600 * size / 1000), "eye": math.ceil(300 * size / 1000), "light micrograph": 3}
    assert len({r["image_id"] for r in drawn}) == len(drawn)
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, p3_quota.quota_sample(images, targets).collect()))


def test_targets_that_can_be_met_together_are_met():
    report, cells = p3_quota.plan({("A", "B"): 10, ("A", "C"): 10, ("B",): 4}, [("A", 0, 7), ("B", 0, 10), ("C", 0, 7)], 24)
    assert {x["secondary_label"]: (x["sampled"], x["met"]) for x in report} == {"A": (7, True), "B": (10, True), "C": (7, True)}
    assert sum(n for (_, s), n in cells.items() if s == ("A", "B")) <= 10


def test_plans_serve_as_many_as_any_plan_can():
    """Against the marriage condition over all subsets of categories."""
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(300):
        names = "ABCD"[: rng.randint(1, 4)]
        strata = {s: rng.randint(0, 12) for k in range(len(names) + 1) for s in itertools.combinations(names, k) if rng.random() < 0.7}
        report, cells = p3_quota.plan(strata, [(n, rng.randint(0, 500), rng.randint(0, 8)) for n in names], rng.randint(0, 40))
        need = {x["secondary_label"]: x["required"] for x in report}
        served = lambda sub: sum(n for s, n in strata.items() if set(s) & set(sub))
        subsets = [sub for k in range(len(names) + 1) for sub in itertools.combinations(names, k)]
        assert all(sum(n for (_, x), n in cells.items() if x == s) <= strata[s] for s in strata)
        assert sum(x["sampled"] for x in report) == min(sum(need[n] for n in names if n not in sub) + served(sub) for sub in subsets)
        assert all(x["short"] == (x["available"] < x["required"]) for x in report)


def test_sample_has_the_shares_and_minimums(spark):
    """On the given images: every category gets its number, each image is drawn once and belongs to its category."""
    from curatrix.plans.tables import table

    images, targets = (table(spark, "/root/testdata/sf0.1", n) for n in ("curated_images", "category_targets"))
    report = {r["secondary_label"]: r for r in p3_quota.quota_report(images, targets).collect()}
    drawn = p3_quota.quota_sample(images, targets).collect()
    counts = {}
    for r in drawn:
        counts[r["secondary_label"]] = counts.get(r["secondary_label"], 0) + 1
    assert len({r["image_id"] for r in drawn}) == len(drawn) and counts == {k: r["sampled"] for k, r in report.items() if r["sampled"]}
    wanted = {r["secondary_label"]: r for r in targets.collect()}
    size = sum(1 for _ in images.select("mini_rec.image_id").where("image_id is not null").distinct().collect()) // 10
    for name, r in report.items():
        assert r["required"] == max(wanted[name]["min_rows"], math.ceil(wanted[name]["target_permille"] * size / 1000))
        assert r["sampled"] == r["required"] if r["met"] else r["sampled"] < r["required"]
    member = {r["image_id"]: r["categories"] for r in p3_quota.memberships(images, targets).collect()}
    assert all(r["secondary_label"] in member[r["image_id"]] for r in drawn)
    # A category that is short takes all it has, unless another needs it more.
    assert sum(not r["met"] for r in report.values()) <= sum(r["short"] for r in report.values()) + 2


def test_empty_images(spark):
    images = spark.createDataFrame([], IMAGES)
    targets = spark.createDataFrame([("p", "s", 1000, 1), ("p", "t", 0, 0)], TARGETS)
    assert [r[0] for r in p3_quota.short_categories(images, targets).collect()] == ["s"]
    assert p3_quota.quota_sample(images, targets).count() == 0


def test_controlled_rounding_keeps_both_margins():
    import random

    rng = random.Random(1)
    for _ in range(40):
        columns = [f"s{k}" for k in range(rng.randint(1, 9))]
        rows = {f"c{k}": rng.randint(0, 30) for k in range(rng.randint(1, 6))}
        table = {}
        for r, n in rows.items():
            w = [rng.random() for _ in columns]
            for c, x in zip(columns, w):
                table[r, c] = n * x / sum(w)
        total = {c: sum(v for (_, k), v in table.items() if k == c) for c in columns}
        cells = p3_quota.controlled_rounding(table, rows, {c: 10**6 for c in columns})
        for k, v in table.items():
            assert math.floor(v - 1e-9) <= cells[k] <= math.ceil(v + 1e-9) or abs(v - round(v)) < 1e-9
        for r, n in rows.items():
            assert sum(v for (a, _), v in cells.items() if a == r) == n
        for c, t in total.items():
            assert math.floor(t - 1e-6) <= sum(v for (_, b), v in cells.items() if b == c) <= math.ceil(t + 1e-6)


RECORDS = "verify_id long, dataset_name string, rubric_verification struct<error:string,rubric:array<struct<category:string,weight:int,score:int>>>, score string, source string"


def record(i, name, score, weight=10, category="Essential", error=None):
    return (i, name, (error, [(category, weight, score)]), "clash", "clash")


def test_cutoffs(spark):
    rows = [record(i, " Alpha " if i % 2 else "alpha", i % 5) for i in range(10)] + [record(20 + i, "beta", 5) for i in range(4)]
    rows += [record(30, None, 9), record(31, " ", 9), (32, "alpha", None, "x", "y"), record(33, "alpha", 9, error="failed"), (34, "alpha", (None, []), "x", "y"), record(35, "alpha", 9, weight=0), record(36, "gamma", 1), record(37, "zero", 3)]
    records = spark.createDataFrame(rows, RECORDS)
    targets = spark.createDataFrame([("ALPHA", 250), ("beta", 300), ("zero", 0), ("none", 500), (None, 5)], "dataset_name string, keep_permille long")
    got = {r["source"]: (r["n"], r["wanted"], r["cutoff"], r["kept"]) for r in p4_cutoffs.cutoffs(records, targets).collect()}
    assert got == {"alpha": (10, 3, 0.3, 4), "beta": (4, 2, 0.5, 4), "zero": (1, 0, None, 0)}
    kept = {r["verify_id"] for r in p4_cutoffs.kept_records(records, targets).collect()}
    assert kept == {i for i in range(10) if i % 5 >= 3} | {20, 21, 22, 23}
    assert p4_cutoffs.kept_records(records.limit(0), targets).count() == 0 and p4_cutoffs.kept_records(records, targets.limit(0)).count() == 0
