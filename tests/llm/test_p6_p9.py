"""Taggers: held-out accuracy on made pairs, resolution rules, and edge cases; residue likewise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import p6_defects as p6
from curatrix.llm import p9_residue as p9
from curatrix.plans.tables import table


@pytest.mark.parametrize(
    ("answer", "want"),
    [("B", "two"), (" (b) ", "two"), ("B.", "two"), ("Option B", "two"), ("Answer: B", "two"), ("The answer is B", "two"), ("B. given text", "given text"), ("plain text", "plain text"), ("E", None), (None, None), ("A 3 mm focus", "A 3 mm focus")],
)
def test_answer_text(answer, want):
    assert p6.answer_text({"question": "q", "options": {"A": "one", "B": "two", "E": None}, "answer": answer}) == want


def test_nothing():
    assert all(map(p6.is_nothing, [None, "", "  ", "​", "--", "N/A", "n.a.", "NaN", "null", "()", "no answer", "Answer:"]))
    assert not any(map(p6.is_nothing, ["no mass", "one", "中文", "3"]))
    assert p6.answer_text(None) is None


def test_language():
    assert p6.language("Which finding is seen in the image of this patient?") == "en"
    assert p6.language("¿Qué señala la flecha sobre el riñón?") == "es"
    assert p6.language("没有肿块，但是") == "zh" and p6.language("изменений нет") == "ru" and p6.language("") == ""


VQA = "question:string,options:struct<A:string,B:string,C:string,D:string,E:string>,answer:string"


def test_made_defects_are_told_apart(spark):
    """Defects are planted in copies of sound rows that were not in the training sample."""
    source = table(spark, "/root/testdata/sf0.1", "generated_mcq")
    known = {(r["mcq_id"]): r["defect"] for r in p6.defective_pairs(source).collect()}
    rows = [r for r in source.select("mcq_id", "generated_vqa").collect() if r["generated_vqa"] is not None and r["mcq_id"] not in known]
    english = [r["generated_vqa"] for r in rows if p6.language(r["generated_vqa"]["question"]) == "en" and r["generated_vqa"]["question"]][:300]
    french = [r["generated_vqa"] for r in rows if p6.language(r["generated_vqa"]["question"]) == "fr"]
    made, want = [], {}

    def plant(kind, vqa, text):
        want[len(made)] = kind
        options = vqa["options"].asDict() if hasattr(vqa["options"], "asDict") else dict(vqa["options"])
        options["A"] = text
        made.append((len(made), (vqa["question"], tuple(options[x] for x in "ABCDE"), "A")))

    for k, vqa in enumerate(english):
        text = p6.answer_text(vqa.asDict(recursive=True))
        plant(None, vqa, text)
        ws = text.rstrip(".").split()
        plant("truncated", vqa, " ".join(ws[: len(ws) // 2]))
        plant("refusal", vqa, ("I'm sorry, but I cannot help with that.", "As an assistant, I can't view pictures", "I won't answer this question without more context.")[k % 3])
        plant("copied_question", vqa, vqa["question"] if k % 2 else vqa["question"].lower().rstrip("?"))
        plant("other_language", vqa, p6.answer_text(french[k % len(french)].asDict(recursive=True)))
        plant("empty", vqa, ("", None, "n/a", "--")[k % 4])
    planted = spark.createDataFrame(made, f"mcq_id long, generated_vqa struct<{VQA}>")
    got = {r["mcq_id"]: r["defect"] for r in p6.defective_pairs(planted.unionByName(source.select((source.mcq_id + 10**6).alias("mcq_id"), "generated_vqa"))).collect() if r["mcq_id"] < 10**6}
    for kind in {None, *want.values()}:
        mine = [k for k, v in want.items() if v == kind]
        assert sum(got.get(k) == kind for k in mine) / len(mine) >= 0.9, kind


def test_defects_of_empty_and_null_rows(spark):
    shape = f"mcq_id long, dataset_name string, generated_vqa struct<{VQA}>, defect string"
    empty = spark.createDataFrame([], shape)
    assert p6.defective_pairs(empty).count() == 0 and p6.defect_counts(empty).count() == 0
    rows = [(1, "d", None, "x"), (2, "d", (None, None, None), "x"), (3, "d", ("q?", ("a", None, None, None, None), "E"), "x"), (3, "d", ("q?", ("a", None, None, None, None), "E"), "x")]
    assert sorted(r["mcq_id"] for r in p6.defective_pairs(spark.createDataFrame(rows, shape)).collect()) == [2, 3, 3]


def test_field_marginals_sum_to_one_and_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores, transition = rng.normal(size=(3, 5)), rng.normal(size=(5, 5))
    p, moves = p6._marginals(scores, transition, np.array([0, 0, 0]), np.array([0, 1, 2]), np.array([3]))
    want, z = np.zeros((3, 5)), 0.0
    for tags in itertools.product(range(5), repeat=3):
        w = np.exp(sum(scores[i, t] for i, t in enumerate(tags)) + transition[tags[0], tags[1]] + transition[tags[1], tags[2]])
        z += w
        for i, t in enumerate(tags):
            want[i, t] += w
    assert np.allclose(p, want / z) and np.isclose(moves.sum(), 2)


RESIDUE = ["{{ caption }}", "Title: ${title}", "Please enable JavaScript to view this figure.", "404 Not Found", "lorem ipsum dolor amet sedulo vestra", "test test test test", "Access denied.", "[INSERT FIGURE HERE]", "Traceback (most recent call last):", "[your finding]"]
CONTENT = ["The web viewer was written in JavaScript and drew overlays.", "All 3 scans filed under error code 404 were found again.", "Let {x, y} be the two points.", "Weights were fitted as $w_{i}$ per scan.", "Values are mean [range] with p < 0.05.", "See <i>this</i> <|endoftext|> note.", "The session expired before the sequence was complete.", "A placeholder catheter was left in place.", "", "Fig. 2."]


def test_weak_labels():
    assert all(p9.weak_label(t) for t in RESIDUE) and not any(p9.weak_label(t) for t in CONTENT)
    assert [p9.kind_of(t) for t in ("The browser drew a rim.", "Error code 404 was filed.", "A pale rim.", "blah blah asdf test")] == [1, 1, 0, 2]


# Labelled by hand, none of them from the given texts: residue first, content after it.
HAND_RESIDUE = [
    "Hello {first_name}, your scan is ready.", "The mass measured ${size} in the axial plane.", "Patient: [[patient_name]]", "Seen in <<organ>> only.", "Grade __GRADE__ of the lesion.", "%(side)s kidney is enlarged.", "Reviewed by «doctor» on Monday.",
    "[INSERT SCALE BAR]", "TODO: describe the arrow", "The legend is TBD for now.", "[object Object]", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "blah blah blah blah", "asdf asdf asdf asdf", "Error 500. Please contact the administrator.",
    "HTTP 404 Not Found", "Access denied. You are not authorized to view this page.", "You need to enable JavaScript to view the atlas.", "Your session has expired. Please log in.", "Page introuvable.", "Zugriff verweigert.", "Traceback (most recent call last):", "ValueError: could not convert string", "Coming soon.",
]
HAND_CONTENT = [
    "The error of the measurement was 4.04 mm.", "Scripts for the analysis were written in the laboratory.", "Access to the joint was gained from behind.", "A blank control was run on page 3 of the protocol.", "The set {a, b} holds both nodes.", "Means are given as value [range].", "We found 404 cells in the left kidney.",
    "The catheter was inserted here without force.", "Samples were held at 500 rpm for an hour.", "Each reader typed the text of the caption.", "Under the construction of the septum lay a cyst.", "The patient could not sign the form.", "Weights $w_{k}$ were kept fixed.", "See <b>Table 2</b> for details.", "Test results were normal in both groups.",
    "Le patient a quitté la page du registre.", "Der Server der Klinik fiel nach 3 Tagen aus.", "El acceso fue lateral.", "The content of the cyst was clear.", "No change was seen in the later scans.",
]


def test_hand_labels_on_an_unseen_source(spark):
    """The classifier is fitted on all given texts and asked about texts of a source that is not among them."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "source")
    clean = "No peritracheitis was noted, although the inner tibial plateau had postmuralar texture."
    texts = HAND_RESIDUE + HAND_CONTENT
    held = spark.sparkContext.broadcast(p9.train(docs))
    asked = spark.createDataFrame([(i, f"{clean} {t}" if i % 2 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in asked.mapInArrow(p9._score(held, p9.THRESHOLD), "doc_id long, score double").collect()}
    true = set(range(len(HAND_RESIDUE)))
    assert len(got & true) >= 0.9 * len(true) and len(got & true) >= 0.9 * len(got), (sorted(texts[i] for i in true - got), sorted(texts[i] for i in got - true))


def test_classifier_finds_what_no_label_matches(spark):
    """Words of labelled mock Latin carry over to text that no label matches; words that stand in content do not."""
    rng = np.random.default_rng(3)
    latin = [f"{a}{b}" for a in ("vel", "nor", "pra", "sul", "tem") for b in ("ora", "inum", "etis", "agit")]
    say = lambda n: " ".join(rng.choice(latin, n))
    docs = [(i, f"Lorem ipsum {say(12)}.", "a") for i in range(60)] + [(100 + i, f"{say(14).capitalize()}.", "b") for i in range(30)]
    docs += [(1000 + i, f"The left {w} of reader {i} was free of change and {v} was seen.", "c") for i, (w, v) in enumerate(zip(rng.choice(["kidney", "lung", "hip"], 900), rng.choice(["none", "air", "fluid"], 900)))]
    docs += [(3000 + i, f"Lorem was the name of trial {i} on hips.", "c") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in p9.residue(frame).collect()}
    assert not any(p9.weak_label(t) for i, t, _ in docs if 100 <= i < 130)
    assert len([i for i in got if 100 <= i < 130]) >= 27 and not {i for i in got if i >= 1000} and len([i for i in got if i < 60]) == 60


def test_segments_cover_the_text():
    text = "Fig. 2. One sentence here. Two\nthree words more.  " + "x" * 10_000
    assert "".join("".join(p9.segments(text)).split()) == "".join(text.split())
    assert p9.segments(None) == p9.segments("") == p9.segments(" \n ") == []


def test_residue_found_in_documents(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "source")
    clean = "No peritracheitis was noted, although the inner tibial plateau had postmuralar texture."
    made = [(10**7 + i, f"{clean} {t} {clean}", None, "clash") for i, t in enumerate(RESIDUE)] + [(2 * 10**7 + i, f"{clean}\n{t}", "web", "clash") for i, t in enumerate(CONTENT)]
    planted = spark.createDataFrame([*made, (3 * 10**7, None, None, "x"), (3 * 10**7 + 1, " ", None, "x")], "doc_id long, text string, source string, score string")
    got = {r["doc_id"] for r in p9.residue(planted.drop("score").unionByName(docs)).collect()}
    assert len([i for i in range(len(RESIDUE)) if 10**7 + i in got]) >= len(RESIDUE) - 1
    assert len([i for i in range(len(CONTENT)) if 2 * 10**7 + i in got]) == 0
    assert not {3 * 10**7, 3 * 10**7 + 1} & got


def test_sample_does_not_thin_out_with_copies(spark):
    """Copies of all texts leave the sample, and so the classifier, as it was."""
    base = spark.createDataFrame([(i, f"The left lung of reader {i} was clear.\n{RESIDUE[i % 10]}\nTest {i} of the browser was passed.") for i in range(300)], "doc_id long, text string")
    once = p9.training_sample(base, 50)
    assert [len(once[k]) for k in (0, 1, 2)] == [50, 50, len(RESIDUE)]
    assert p9.training_sample(base.crossJoin(spark.range(30).select(F.col("id").alias("copy"))), 50) == once


def test_rare_labels_stay_in_the_sample(spark):
    """Sentences with placeholders, each of them new, do not push out phrases that are always the same."""
    rare = ["Access denied.", "Please enable JavaScript to view this figure.", "404 Not Found", "Zugriff verweigert."]
    texts = [f"The left lung of reader {i} was {{{{ finding }}}} at the apex of case {i}." for i in range(800)] + rare
    got = p9.training_sample(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 20, 20)[2]
    assert len(got) == 20 and set(rare) <= {s for s, *_ in got}


def test_rare_labels_are_found_beside_very_many_of_others(spark):
    """A phrase of one wording is found when almost all labelled segments of a large table are of other labels."""
    rng = np.random.default_rng(7)
    some = [f"{a}{b}" for a in ("peri", "endo", "hypo", "neo", "sub", "trans", "exo", "iso") for b in ("cardial", "hepatic", "gastric", "renal", "ocular", "dental")]
    say = lambda: " ".join(rng.choice(some, 6))
    many = [f"The {say()} {mark} was seen {i} times." for i, mark in zip(range(22_000), ["{{ finding }}", "${site}", "[[organ]]", "<%= label %>"] * 5500)]
    rare = ["Active JavaScript para ver esta imagen.", "Under construction, check back later.", "Bitte melden Sie sich an.", "Contact the site owner."]
    clean = [f"The {say()} was seen {i} times." for i in range(20_000)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(rare + many + clean)], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in p9.residue(docs.repartition(4)).collect()}
    assert {0, 1, 2, 3} <= got and len(got) >= 0.99 * (len(rare) + len(many)) and not [i for i in got if i >= len(rare) + len(many)]


def test_residue_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert p9.residue(empty).count() == 0 and p9.validation(empty).count() == 0


def test_validation_on_unseen_sources(spark):
    got = p9.validation(table(spark, "/root/testdata/sf0.1", "documents")).collect()
    assert got and all(r["precision"] is None or r["precision"] >= 0.85 for r in got)


def test_validation_judges_every_segment_of_held_out_sources(spark, monkeypatch):
    """The sample bounds training only: repeated segments and those above it count too, by the rule of p9_found."""
    monkeypatch.setattr(p9, "SAMPLE", 40)
    shape = "doc_id long, text string, source string"
    rows = [(i, f"Panel {i} of the study showed no change.\n{RESIDUE[i % 4]}", s) for i, s in enumerate(["a", "b", "c", None] * 30)]
    got = {r["source"]: r for r in p9.validation(spark.createDataFrame(rows, shape)).collect()}
    # Names in order: none, a, b, c; every third from the first is held out.
    assert set(got) == {"", "c"}
    for source, r in got.items():
        parts = [s for _, text, name in rows if (name or "") == source for s in p9.segments(text)]
        assert (r["segments"], r["labelled"]) == (len(parts), sum(map(p9.weak_label, parts))) == (60, 30)
