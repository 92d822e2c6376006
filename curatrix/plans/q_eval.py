"""Queries over model outputs and answers, and distributions of labels and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import parsing, records
from curatrix.operators import analysis, evaluation
from curatrix.plans.q_text import WS, sql_strip
from curatrix.plans.tables import table

DATASETS = ("openfig_mcq", "slidebank_qa", "radiquiz", "derm_items", "eyeset_plus", "toothcase", "scope_vqa", "echo_drill", "wardbook", "nucmed_mini", "pathpairs", "larynx_lab")
STOP = ("the", "of", "and", "in", "with", "was", "is", "to", "at", "on", "for", "by", "as")


def _outputs(spark, d):
    """Five outputs a record in different layouts, some right and some wrong, made from its own fields."""
    i = F.col("record_id")
    letter = F.coalesce("answer_label", F.lit("A"))
    other = F.get(F.split(F.lit("B,C,D,E,A"), ","), F.pmod(F.ascii(letter) - 65, F.lit(5)).cast("int"))
    said = lambda k: F.when((i + k) % 3 == 0, other).otherwise(letter)
    outs = F.array(
        F.concat(F.lit("<think>"), F.coalesce("reasoning", F.lit("")), F.lit("</think>\n<answer> "), said(0), F.lit(" </answer>")),
        F.concat(F.lit("The correct answer is: "), said(1)),
        F.concat(F.lit("I looked at it.\nFinal answer: "), F.coalesce("answer", F.lit("nothing")), F.lit("\nDone")),
        F.concat(F.lit("<answer>x</answer> then <answer>\n"), said(2), F.lit(". "), F.coalesce("answer", F.lit("nothing")), F.lit("\nmore</answer>")),
        F.concat(F.lit("It could be option "), F.lower(said(3)), F.lit(" here.")),
    )
    return table(spark, d, "vqa_records").select("record_id", "dataset_name", "split", "answer_label", "answer", "options", outs.alias("outs"))


def answer_extract(spark, d):
    o = _outputs(spark, d).select("record_id", F.posexplode("outs").alias("place", "t"))
    return o.select("record_id", "place", F.md5(parsing.answer_simple(F.col("t"))).alias("simple_md5"), F.md5(parsing.answer_last(F.col("t"))).alias("last_md5"))


def answer_letters(spark, d):
    o = _outputs(spark, d).select("record_id", records.options_map(F.col("options")).alias("m"), F.posexplode("outs").alias("place", "t"))
    return o.select("record_id", "place", F.md5(parsing.answer_letter(F.col("t"), F.col("m"))).alias("letter_md5"))


def _graded(spark, d):
    m = records.options_map(F.col("options"))
    return _outputs(spark, d).select("record_id", "dataset_name", "split", "answer_label", evaluation.graded(F.col("outs"), F.col("answer"), F.col("answer_label"), m).alias("parsed"))


def grades(spark, d):
    g = _graded(spark, d).select("record_id", F.posexplode("parsed").alias("place", "p"))
    return g.select("record_id", "place", "p.is_correct", F.md5("p.pred_letter").alias("pred_md5"))


def regrade(spark, d):
    return evaluation.regraded(_graded(spark, d)).select("record_id", "num_rollouts", "num_correct", F.round("average_num_correct", 6).alias("average"), "pass_at_num_rollouts", F.md5("majority_vote_pred_letter").alias("vote_md5"), "majority_at_num_rollouts")


def accuracy(spark, d):
    return evaluation.accuracy(evaluation.regraded(_graded(spark, d)))


def model_pivot(spark, d):
    """Splits stand for models."""
    return evaluation.model_table(evaluation.regraded(_graded(spark, d)).withColumnRenamed("split", "model"), DATASETS)


def _rawjson(spark, d):
    return table(spark, d, "generated_mcq").select("mcq_id", parsing.model_json(F.col("raw_model_output")).alias("j"), "raw_model_output")


def model_json(spark, d):
    return _rawjson(spark, d).where("j is not null").select("mcq_id", F.get_json_object("j", "$.question").alias("question"), F.get_json_object("j", "$.answer").alias("answer"))


def parse_quality(spark, d):
    return analysis.parse_quality(_rawjson(spark, d), F.col("raw_model_output"), F.col("j"))


def loose_json(spark, d):
    raw = F.concat(F.lit("said <|begin_of_box|>{'modality': 'CT', 'n': "), F.col("event_id").cast("string"), F.lit(",}<|end_of_box|>"))
    wrapped = F.when(F.col("event_id") % 2 == 0, raw).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    j = parsing.loose_json(F.col("raw"))
    return table(spark, d, "events").select("event_id", wrapped.alias("raw")).select("event_id", F.get_json_object(j, "$.modality").alias("modality"), F.coalesce(F.get_json_object(j, "$.n"), F.get_json_object(j, "$.k")).alias("number"))


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", parsing.json_field(F.col("props"), "k", "missing").alias("k"), parsing.index_key(F.get_json_object("props", "$.k")).alias("k_key"), parsing.lenient_int(F.get_json_object("props", "$.k")).alias("k_int"), parsing.plain_number(F.col("value")).rlike("^-?[0-9]+$").alias("whole"))


ALLOWED = ("ct slice", "mr slice", "ultrasound", "plain radiography", "light micrograph")
ALIASES = {"ctslice": "ct slice", "ct_slice": "ct slice", "mrslice": "mr slice", "mr_slice": "mr slice", "lightmicrograph": "light micrograph"}
LOOSE = {"radiograph": "plain radiography", "micrograph": "light micrograph"}


def _labels(spark, d):
    return table(spark, d, "curated_images").select("row_id", F.posexplode("mini_rec.image_secondary_label").alias("place", "raw"))


def label_canonicalize(spark, d):
    return _labels(spark, d).select("row_id", "place", parsing.canonical_label(F.col("raw"), ALLOWED).alias("label"))


def alias_ladder(spark, d):
    label, source = parsing.alias_label(F.col("raw"), ALLOWED, ALIASES, LOOSE)
    return _labels(spark, d).select("row_id", "place", label.alias("label"), source.alias("source"))


def distribution_total(spark, d):
    g = table(spark, d, "generated_mcq")
    tuples = records.image_tuples(F.col("image_id"), F.col("image_file_name"), F.col("article_accession_id"))
    return analysis.distribution(g, F.col("dataset_name"), tuples)


def type_distribution(spark, d):
    g = table(spark, d, "generated_mcq")
    return analysis.distribution(g, F.lower(F.get(records.flat_labels(F.col("image_primary_label")), F.lit(0))), F.coalesce("image_id", F.array().cast("array<string>")), (1, 2, 3))


def word_freq(spark, d):
    return analysis.word_counts(table(spark, d, "documents"), "text", STOP)


def top_words(spark, d):
    return analysis.top(word_freq(spark, d), "n", "word", 100)


def token_stats(spark, d):
    return analysis.length_stats(table(spark, d, "vqa_records"), F.size(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), 0)), "dataset_name")


def length_histogram(spark, d):
    return analysis.relative_histogram(table(spark, d, "documents"), F.col("n_chars"))


def label_freq(spark, d):
    return analysis.label_counts(table(spark, d, "curated_images"), F.col("mini_rec.image_secondary_label"))


def label_variants(spark, d):
    return analysis.label_variants(table(spark, d, "curated_images"), F.col("mini_rec.image_secondary_label"))


def coverage(spark, d):
    return analysis.coverage(table(spark, d, "curated_images"), F.col("mini_rec.image_secondary_label"), table(spark, d, "category_targets"), "secondary_label")


def answer_distribution(spark, d):
    return table(spark, d, "vqa_records").groupBy("answer_label").agg(F.count("*").alias("n"))


_OUTS = """
src AS (SELECT record_id, dataset_name, split, answer_label, answer, options, coalesce(reasoning, '') AS reasoning, coalesce(answer_label, 'A') AS l, split_part('B,C,D,E,A', ',', ((((ascii(coalesce(answer_label, 'A')) - 65) % 5) + 5) % 5 + 1)::INT) AS o, coalesce(answer, 'nothing') AS a FROM vqa_records),
outs AS (
  SELECT *, [
    '<think>' || reasoning || '</think>' || chr(10) || '<answer> ' || CASE WHEN record_id % 3 = 0 THEN o ELSE l END || ' </answer>',
    'The correct answer is: ' || CASE WHEN (record_id + 1) % 3 = 0 THEN o ELSE l END,
    'I looked at it.' || chr(10) || 'Final answer: ' || a || chr(10) || 'Done',
    '<answer>x</answer> then <answer>' || chr(10) || CASE WHEN (record_id + 2) % 3 = 0 THEN o ELSE l END || '. ' || a || chr(10) || 'more</answer>',
    'It could be option ' || lower(CASE WHEN (record_id + 3) % 3 = 0 THEN o ELSE l END) || ' here.'] AS outs FROM src),
one AS (SELECT record_id, dataset_name, split, answer_label, answer, options, unnest(outs) AS t, generate_subscripts(outs, 1) - 1 AS place FROM outs)
"""


def _cue(cue: str) -> str:
    return rf"CASE WHEN regexp_matches(t, '(?i){cue}') THEN list_last(regexp_extract_all(t, '(?i){cue}[ \t\r\n]*([^\n\r]*)', 1)) END"


_LAST = sql_strip("regexp_replace(" + sql_strip(rf"""CASE WHEN regexp_matches(t, '(?s)<answer>.*?</answer>') THEN regexp_extract({sql_strip("list_last(regexp_extract_all(t, '(?s)<answer>(.*?)</answer>', 1))")}, '^([^\n\r]+)', 1) ELSE coalesce({', '.join(map(_cue, ('answer:', 'answer is:', 'answer is', 'is:')))}, t) END""") + ", '</?(?:think|answer)>', '', 'g')")
_JSON = "CASE WHEN json_valid(options) AND json_type(CASE WHEN json_valid(options) THEN options END) = 'OBJECT' THEN options END"
_GRADED = rf"""{_OUTS},
said AS (SELECT record_id, dataset_name, split, answer_label, answer, place, {_LAST} AS p, {_JSON} AS j FROM one),
marked AS (
  SELECT *, coalesce(lower({sql_strip('p')}) = lower({sql_strip("answer_label || '. ' || answer")}) OR lower({sql_strip('p')}) = lower({sql_strip('answer_label')}) OR lower({sql_strip('p')}) = lower({sql_strip('answer')}), false) AS is_correct,
    list_first(list_filter(json_keys(j), lambda k: coalesce(lower({sql_strip('p')}) = lower({sql_strip("k || '. ' || json_extract_string(j, '$.' || k)")}) OR lower({sql_strip('p')}) = lower({sql_strip('k')}) OR lower({sql_strip('p')}) = lower({sql_strip("json_extract_string(j, '$.' || k)")}), lower({sql_strip('p')}) = lower({sql_strip('k')})))) AS letter FROM said),
graded AS (SELECT *, coalesce(letter, p) AS pred FROM marked),
votes AS (SELECT record_id, pred, count(*) AS n, min(place) AS f FROM graded GROUP BY 1, 2),
vote AS (SELECT record_id, pred FROM votes QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY n DESC, f) = 1),
rows AS (SELECT record_id, any_value(dataset_name) AS dataset_name, any_value(split) AS split, any_value(answer_label) AS answer_label, count(*) AS num_rollouts, count(*) FILTER (is_correct) AS num_correct FROM graded GROUP BY 1)
"""

_MODEL = r"""
u AS (SELECT mcq_id, raw_model_output, regexp_extract(regexp_replace(regexp_replace(trim(raw_model_output, chr(10) || chr(9) || chr(13) || ' '), '^```(?:json|JSON)?', ''), '```$', ''), '(?s)\{.*\}') AS r FROM generated_mcq),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(r, '[“”]', '"', 'g'), '[‘’]', '''', 'g'), ',\s*([}\]])', '\1', 'g') AS f FROM u),
w AS (SELECT mcq_id, raw_model_output, CASE WHEN json_valid(nullif(r, '')) THEN r WHEN json_valid(nullif(f, '')) THEN f END AS j FROM v)
"""


def _distribution_sql(group: str, images: str, sizes: tuple) -> str:
    ks = ", ".join(f"count(*) FILTER (len(i) {'=' if s != sizes[-1] else '>='} {s}) AS k{s}" for s in sizes)
    return f"""WITH r AS (SELECT coalesce({group}, 'Unknown') AS grp, {images} AS i FROM generated_mcq), t AS (SELECT count(*) AS n FROM r),
    s AS (SELECT grp, count(*) AS records, sum(len(i)) AS images, {ks} FROM r GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), sum(len(i)), {ks} FROM r),
    e AS (SELECT grp, unnest(i) AS x FROM r), u AS (SELECT grp, count(DISTINCT x) AS d FROM e GROUP BY 1 UNION ALL SELECT 'TOTAL', count(DISTINCT x) FROM e)
    SELECT s.grp, records, round(100.0 * records / greatest(n, 1), 6) AS percent, coalesce(d, 0) AS distinct_images, round(images::DOUBLE / records, 6) AS images_per_record, {', '.join(f'k{k}' for k in sizes)} FROM s LEFT JOIN u ON s.grp = u.grp CROSS JOIN t"""


_TUPLES = "CASE WHEN greatest(len(coalesce(image_id, [])), len(coalesce(image_file_name, []))) = 0 THEN [coalesce(article_accession_id, '') || '|__UNKNOWN__|__UNKNOWN__'] ELSE list_transform(range(1, greatest(len(coalesce(image_id, [])), len(coalesce(image_file_name, []))) + 1), lambda i: coalesce(article_accession_id, '') || '|' || coalesce(image_id[i], '') || '|' || coalesce(image_file_name[i], '')) END"
_WORDS = f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) > 1 AND word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY 1"
_SECOND = "(SELECT row_id, unnest(mini_rec.image_secondary_label) AS raw, generate_subscripts(mini_rec.image_secondary_label, 1) - 1 AS place FROM curated_images)"


def _case(column: str, table_: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


Q = {
    "answer_extract": (answer_extract, rf"""WITH {_OUTS} SELECT record_id, place, md5({sql_strip("CASE WHEN regexp_matches(t, '(?s)<answer>.*?</answer>') THEN regexp_extract(t, '(?s)<answer>(.*?)</answer>', 1) ELSE t END")}) AS simple_md5, md5({_LAST}) AS last_md5 FROM one"""),
    "answer_letters": (answer_letters, None),
    "grades": (grades, f"WITH {_GRADED} SELECT record_id, place, is_correct, md5(pred) AS pred_md5 FROM graded"),
    "regrade": (regrade, f"WITH {_GRADED} SELECT r.record_id, num_rollouts, num_correct, round(num_correct::DOUBLE / num_rollouts, 6) AS average, num_correct > 0 AS pass_at_num_rollouts, md5(pred) AS vote_md5, coalesce(lower(pred) = lower(answer_label), false) AS majority_at_num_rollouts FROM rows r JOIN vote USING (record_id)"),
    "accuracy": (accuracy, f"WITH {_GRADED} SELECT dataset_name, count(*) AS records, round(avg(num_correct::DOUBLE / num_rollouts), 6) AS accuracy, round(avg((num_correct > 0)::INT), 6) AS pass_rate FROM rows GROUP BY 1"),
    "model_pivot": (
        model_pivot,
        f"""WITH {_GRADED}, c AS (SELECT split AS model, dataset_name, avg(100.0 * num_correct / num_rollouts) AS a FROM rows WHERE dataset_name IN ({', '.join(f"'{x}'" for x in DATASETS)}) GROUP BY 1, 2)
        SELECT m.model, {', '.join(f"round(max(a) FILTER (dataset_name = '{x}'), 6) AS {x}" for x in DATASETS)}, round(avg(a), 6) AS overall_average FROM (SELECT DISTINCT split AS model FROM rows) m LEFT JOIN c USING (model) GROUP BY 1""",
    ),
    "model_json": (model_json, f"WITH {_MODEL} SELECT mcq_id, json_extract_string(j, '$.question') AS question, json_extract_string(j, '$.answer') AS answer FROM w WHERE j IS NOT NULL"),
    "parse_quality": (parse_quality, f"WITH {_MODEL} SELECT count(raw_model_output) AS texts, count(j) AS parsed, count(*) FILTER (raw_model_output IS NOT NULL AND j IS NULL) AS lost FROM w"),
    "loose_json": (loose_json, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'CT' END AS modality, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE json_extract_string(props, '$.k') END AS number FROM events"),
    "json_props": (json_props, "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS k_key, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k_int, value = floor(value) AS whole FROM events"),
    "label_canonicalize": (label_canonicalize, f"SELECT row_id, place, {_case('''regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g')''', {a.replace(' ', ''): a for a in ALLOWED})} AS label FROM {_SECOND}"),
    "alias_ladder": (
        alias_ladder,
        f"""WITH x AS (SELECT row_id, place, lower({sql_strip('raw')}) AS low FROM {_SECOND}), y AS (SELECT *, {_case('low', {a: a for a in ALLOWED})} AS a, {_case('low', ALIASES)} AS b, CASE WHEN contains(low, 'radiograph') THEN 'plain radiography' WHEN contains(low, 'micrograph') THEN 'light micrograph' END AS c FROM x)
        SELECT row_id, place, CASE WHEN coalesce(low, '') = '' THEN 'Other' ELSE coalesce(a, b, c, 'Other') END AS label, CASE WHEN coalesce(low, '') = '' THEN 'no-raw' WHEN a IS NOT NULL THEN 'whitelist-direct' WHEN b IS NOT NULL THEN 'mapped-alias' WHEN c IS NOT NULL THEN 'loose-map' ELSE 'unmapped' END AS source FROM y""",
    ),
    "distribution_total": (distribution_total, _distribution_sql("dataset_name", _TUPLES, (1, 2, 3, 4, 5, 6))),
    "type_distribution": (type_distribution, _distribution_sql(f"lower((list_filter(list_transform(flatten(list_filter(image_primary_label, lambda x: x IS NOT NULL)), lambda x: {sql_strip('x')}), lambda x: coalesce(x <> '', false)))[1])", "coalesce(image_id, [])", (1, 2, 3))),
    "word_freq": (word_freq, _WORDS),
    "top_words": (top_words, f"{_WORDS} ORDER BY n DESC, word LIMIT 100"),
    "token_stats": (
        token_stats,
        f"""WITH t AS (SELECT dataset_name, CASE WHEN question IS NOT NULL THEN len(regexp_extract_all(lower(question), '[a-z]+')) END AS len FROM vqa_records)
        SELECT dataset_name, count(len) AS n, min(len)::INT AS least, max(len)::INT AS most, round(avg(len), 6) AS mean, {', '.join(f'quantile_cont(len::DOUBLE, {p / 100}) AS p{p}' for p in (10, 50, 90))} FROM t GROUP BY 1""",
    ),
    "length_histogram": (length_histogram, "WITH v AS (SELECT n_chars::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL), e AS (SELECT quantile_cont(v, 0.9) / 10 AS w FROM v) SELECT least(CASE WHEN w > 0 THEN floor(v / w) ELSE 0 END, 9)::INT AS bin, count(*) AS n FROM v CROSS JOIN e GROUP BY 1"),
    "label_freq": (label_freq, f"SELECT {sql_strip('raw')} AS label, count(*) AS n FROM {_SECOND} WHERE {sql_strip('raw')} <> '' GROUP BY 1"),
    "label_variants": (label_variants, f"SELECT raw, lower(regexp_replace(raw, '{WS}+', '', 'g')) AS key, count(*) AS n FROM {_SECOND} WHERE raw IS NOT NULL GROUP BY 1 ORDER BY n DESC, raw LIMIT 50"),
    "coverage": (
        coverage,
        f"""WITH p AS (SELECT lower(regexp_replace(raw, '{WS}+', '', 'g')) AS k, count(*) AS n FROM {_SECOND} WHERE lower(regexp_replace(raw, '{WS}+', '', 'g')) <> '' GROUP BY 1), l AS (SELECT DISTINCT lower(regexp_replace(secondary_label, '{WS}+', '', 'g')) AS k, 1 AS listed FROM category_targets)
        SELECT coalesce(sum(n), 0)::BIGINT AS present, count(n) AS distinct_labels, coalesce(sum(n) FILTER (listed = 1), 0)::BIGINT AS within, coalesce(sum(n) FILTER (listed IS NULL), 0)::BIGINT AS outside, count(*) FILTER (n IS NULL) AS never_seen FROM p FULL JOIN l USING (k)""",
    ),
    "answer_distribution": (answer_distribution, "SELECT answer_label, count(*) AS n FROM vqa_records GROUP BY 1"),
}
