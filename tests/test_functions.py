"""Column functions against plain Python on edge cases."""

import base64
import json
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.functions import parsing, records, text, vectors


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def run(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression.alias("y")).collect()]


def normal(s):
    if s is None:
        return None
    s = " ".join(s.lower().split())
    s = re.sub(r"[^\w\s.,\-+()/#:%;']", " ", s)
    return re.sub(r"\b\d+(\.\d+)?\b", "<NUM>", " ".join(s.split()))


TEXTS = ["Age: 45.5 yrs, T1-weighted 3T?", "v1.2.3 2x", None, "", "   ", "A\tB C\n", "1 2 3 4.5 6", "Straße — café №5!", "x_1 _2 3_", "(12) [7] {8}", "50% of 3/4; it's 'ok'"]


def test_normalize_text(spark):
    assert run(col(spark, TEXTS), text.normalize_text(F.col("x"))) == [normal(t) for t in TEXTS]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1 2.5,-_?é\n\t%", max_size=30), min_size=25, max_size=40))
def test_normalize_text_random(spark, texts):
    assert run(col(spark, texts), text.normalize_text(F.col("x"))) == [normal(t) for t in texts]


def test_ngrams_shorter_than_n_are_none(spark):
    got = run(col(spark, ["abc", "", None, "a"]), text.char_ngrams(F.col("x"), 3))
    assert got == [["^ab", "abc", "bc$"], [], [], ["^a$"]]


def test_folded_and_keys(spark):
    values = ["Ｆｕｌｌ  Straße", None, " a  B "]
    assert run(col(spark, values), text.folded(F.col("x"))) == [None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).casefold() for v in values]
    assert run(col(spark, [" A  b\n", None]), text.question_key(F.col("x"))) == ["a b", None]
    assert run(col(spark, ["X-Ray (2)", None]), text.alnum_key(F.col("x"))) == ["xray2", None]
    assert run(col(spark, ["CT  Slice"]), text.label_key(F.col("x"))) == ["ctslice"]


def test_missing_and_captions(spark):
    assert run(col(spark, [None, "", " NaN ", "None", "null", "x"]), text.is_missing(F.col("x"))) == [True] * 5 + [False]
    assert run(col(spark, [None, " ", "No Caption Found", " a "]), text.caption_or_null(F.col("x"))) == [None, None, None, "a"]


def test_tokens(spark):
    assert run(col(spark, ["The cat, a CAT x2"]), text.kept_tokens(F.col("x"), ("the",))) == [["cat", "cat"]]


def test_levenshtein_similarity(spark):
    df = spark.createDataFrame([(0, "", ""), (1, "abcd", "abcx"), (2, "a", "bcdef")], "i int, x string, y string")
    assert run(df, text.levenshtein_similarity(F.col("x"), F.col("y"))) == [1.0, 0.75, 0.0]
    assert run(df, text.levenshtein_similarity(F.col("x"), F.col("y"), 0.9)) == [1.0, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0], [3.0, 4.0]), (1, [0.0, 0.0], [1.0, 0.0])], "i int, x array<double>, y array<double>")
    assert run(df, F.round(vectors.norm(F.col("x")), 6)) == [5.0, 0.0]
    assert [round(v[0], 6) for v in run(df, vectors.l2_normalize(F.col("x")))] == [0.6, 0.0]
    assert run(df, vectors.inner(F.col("x"), F.col("y"))) == [25.0, 0.0]
    one = spark.createDataFrame([(0, 0b1011, 0b0001)], "i int, x long, y long")
    assert run(one, vectors.hamming(F.col("x"), F.col("y"))) == [2]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('text {"a": [1, 2,],} end', {"a": [1, 2]}),
        ("{“a”: “b”}", {"a": "b"}),
        ("no braces", None),
        ("{broken", None),
        (None, None),
        ("", None),
    ],
)
def test_model_json(spark, raw, want):
    got = run(col(spark, [raw]), parsing.model_json(F.col("x")))[0]
    assert (json.loads(got) if got else None) == want


def test_loose_json(spark):
    values = ["<|begin_of_box|>{'modality': 'CT',}<|end_of_box|>", '{"modality": "it\'s"}', None]
    got = run(col(spark, values), F.get_json_object(parsing.loose_json(F.col("x")), "$.modality"))
    assert got == ["CT", "it's", None]


def test_answers(spark):
    values = ["<answer> B </answer> <answer>C. x\nmore</answer>", "The answer is: D", "answer: A\nanswer: E ", "plain", None, "", "it is: B <think>"]
    assert run(col(spark, values), parsing.answer_simple(F.col("x"))) == ["B", "The answer is: D", "answer: A\nanswer: E", "plain", None, "", "it is: B <think>"]
    assert run(col(spark, values), parsing.answer_last(F.col("x"))) == ["C. x", "D", "E", "plain", None, "", "B"]


def test_answer_letter_steps(spark):
    options = F.create_map(F.lit("A"), F.lit("lung"), F.lit("B"), F.lit("left lung"))
    values = ["<think>A</think><answer> b) x</answer>", "The final answer is C", "therefore, the answer is D", "I pick option e now", "It shows the left lung here", "maybe A or B. So E", "nothing at all"]
    assert run(col(spark, values), parsing.answer_letter(F.col("x"), options)) == ["B", "C", "D", "E", "B", "E", "nothing at all"]


def test_grade_and_letter(spark):
    df = col(spark, ["a. Lung", " A ", "lung", "kidney", None])
    assert run(df, parsing.grade(F.col("x"), F.lit("Lung"), F.lit("A"))) == [True, True, True, False, False]
    options = F.create_map(F.lit("A"), F.lit("kidney"), F.lit("B"), F.lit("lung"))
    assert run(df, parsing.predicted_letter(F.col("x"), options)) == [None, "A", "B", "A", None]


def test_prompt_round_trip(spark):
    options = F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two\nlines"))
    df = col(spark, ["What is it?"])
    prompt = records.prompt_text(F.col("x"), options)
    q, o = parsing.prompt_parts(prompt)
    assert run(df, q) == ["What is it?"]
    assert run(df, o) == [{"A": "one", "B": "two"}]
    assert run(df, prompt)[0].startswith(records.INSTRUCTION)


def test_numbers(spark):
    assert run(col(spark, ["007", " 12 ", "x1", None]), parsing.index_key(F.col("x"))) == ["7", "12", "x1", None]
    assert run(col(spark, ["5", "5.0", "x", None, " 3 "]), parsing.lenient_int(F.col("x"))) == [5, 0, 0, 0, 3]


def test_labels(spark):
    df = col(spark, ["ct  SLICE", "Xray", "chest radiograph", "", None, "odd"])
    assert run(df, parsing.canonical_label(F.col("x"), ("CT Slice", "X-Ray"))) == ["CT Slice", "X-Ray", None, None, None, None]
    label, source = parsing.alias_label(F.col("x"), ("X-Ray",), {"xray": "X-Ray"}, {"radiograph": "X-Ray"})
    assert run(df, label) == ["Other", "X-Ray", "X-Ray", "Other", "Other", "Other"]
    assert run(df, source) == ["unmapped", "mapped-alias", "loose-map", "no-raw", "no-raw", "unmapped"]


def test_options(spark):
    df = col(spark, ['{"B": "two", "A": "one", "C": null}', " A. raw ", None, '["x", "b) y"]', "{}"])
    assert run(df, records.options_text(F.col("x"))) == ["A. one\nB. two", "A. raw", "", '["x", "b) y"]', ""]
    assert run(df, records.options_lines(F.col("x")))[3] == "A. x\nB. y"


def test_permuted_options_keep_the_right_text(spark):
    schema = "i int, v struct<question:string,options:struct<A:string,B:string,C:string,D:string,E:string>,answer:string>"
    letters = "ABCDE"
    rows = [(i * 5 + k, ("q", tuple("abcde"), letters[i])) for i in range(5) for k in range(5)]
    df = spark.createDataFrame(rows, schema).withColumn("t", F.get(F.array(*map(F.lit, letters)), F.col("i") % 5))
    for r in df.select("v", "t", records.permuted_options(F.col("v"), F.col("t")).alias("o")).collect():
        old = dict(zip(letters, "abcde"))
        assert r["o"][r["t"]] == old[r["v"]["answer"]]
        assert [r["o"][x] for x in letters if x != r["t"]] == [old[x] for x in letters if x != r["v"]["answer"]]


def test_coerced_bytes(spark):
    df = spark.createDataFrame([(0, b"ab", None, None, None), (1, None, "0x61 62", None, None), (2, None, None, base64.b64encode(b"ab").decode(), None), (3, None, "zz", None, [97, 98]), (4, b"", "", "", [])], "i int, r binary, h string, b string, n array<int>")
    got = run(df, records.coerced_bytes(F.col("r"), F.col("h"), F.col("b"), F.col("n")))
    assert [bytes(g) if g is not None else None for g in got] == [b"ab"] * 4 + [None]


def test_resize(spark):
    df = spark.createDataFrame([(0, 768, 384), (1, 10, 20), (2, 10000, 1)], "i int, w int, h int")
    assert run(df, records.resized(F.col("w"), F.col("h"))) == [[384, 192], [10, 20], [384, 1]]


def test_members_and_paths(spark):
    df = spark.createDataFrame([(0, ["B.jpg", "a.jpg", "B.jpg"], ["x"], ["y"]), (1, None, ["t.tar::C.jpg", "d/e.jpg"], ["y"]), (2, [], None, ["Z "])], "i int, m array<string>, p array<string>, n array<string>")
    assert run(df, records.image_members(F.col("m"), F.col("p"), F.col("n"))) == [["a.jpg", "b.jpg"], ["c.jpg", "e.jpg"], ["z"]]


def test_caption_block(spark):
    df = spark.createDataFrame([(0, ["a", None, " "]), (1, None)], "i int, c array<string>")
    assert run(df, records.caption_block(F.col("c"))) == ["[Image 1] a\n[Image 2] (empty)\n[Image 3] (empty)", "N/A"]


def test_chat_layouts(spark):
    df = col(spark, ["hi"])
    assert "<|image_pad|><|image_pad|>" in run(df, records.chat_prompt(F.col("x"), F.lit(2), "qwen"))[0]
    assert run(df, records.chat_prompt(F.col("x"), F.lit(0), "qwen"))[0].count("vision") == 0
    assert run(df, records.chat_prompt(F.col("x"), F.lit(1)))[0] == "<image>\nhi"


def test_letter_ladder(spark):
    """Each step of the ladder in turn, and that a surer step goes first."""
    options = {"A": "left kidney", "B": "left kidney stone", "C": "liver"}
    cases = [
        ("<think>answer: D</think> <answer> b) stone</answer>", "B"), ("The final answer is c.", "C"), ("Correct answer: (B)", "B"), ("My answer should be a", "A"), ("answer a question about D", "D"), ("I take option e here", "E"),
        ("The best one of these is D, I think", "D"), ("It shows a Left Kidney Stone.", "B"), ("It may be the spleen. D", "D"), ("nothing found", "nothing found"), ("Option A, but the final answer is B", "B"),
        ("<|begin_of_box|>C<|end_of_box|> answer: A", "C"), ("Therefore, we choose B", "B"),
    ]
    rows = [(i, t, options) for i, (t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, t string, o map<string,string>").select("i", parsing.answer_letter(F.col("t"), F.col("o")).alias("x"))
    got = {r["i"]: r["x"] for r in df.collect()}
    assert {t: got[i] for i, (t, _) in enumerate(cases)} == dict(cases)


def test_question_types_and_raw_labels(spark):
    df = spark.createDataFrame([('{"Question Type": " Finding ", "question_type": "x"}',), ('{"question_type": "y"}',), ('{"Question Type": " "}',), (None,)], "j string").select(parsing.question_type(F.col("j")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["Finding", "y", "Unknown", "Unknown"]
    label, parsed = parsing.raw_label(F.col("t"), ("image_modality", "organ"))
    df = spark.createDataFrame([('{"ORGAN": "lung"}',), ("organ = 'liver'",), ("nothing",)], "t string").select(label.alias("x"), parsed.alias("p"))
    assert [(r["x"], r["p"]) for r in df.collect()] == [("lung", True), ("liver", False), (None, False)]
