"""Queries over question-answering records: merging, rubrics, balancing, curation and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import parsing, records

from curatrix.operators import balance, curation, exports, filters, merging, rubric
from curatrix.plans.q_text import _OPTIONS, WS, sql_strip
from curatrix.plans.tables import table

TITLES = ("Stem stands alone", "Plain vocabulary", "No answer leak", "One correct option", "Options of one kind", "Clinically sound", "Picture and text agree")
LETTERS = ("A", "B", "C", "D", "E")
KEYS = ["dataset_name", "dataset_index"]


def merge_back(spark, d):
    """Generated pairs attached to records of the same natural key; of several the latest."""
    r = table(spark, d, "vqa_records").select("record_id", *KEYS)
    g = table(spark, d, "generated_mcq").select(*KEYS, "mcq_id", "generated_at", F.col("generated_vqa.answer").alias("generated_answer"))
    return merging.attach(r, g, KEYS, ["generated_at", "mcq_id"]).select("record_id", "mcq_id", "generated_answer")


def merge_composite(spark, d):
    """Verified rows with the pair of their id, else of the same article and images."""
    g = table(spark, d, "generated_mcq").withColumn("ck", records.composite_key(F.col("article_accession_id"), F.col("image_id"), F.col("image_file_name")))
    left = g.select(F.when(F.col("mcq_id") % 2 == 0, F.col("mcq_id")).alias("mcq_id"), F.col("mcq_id").alias("row"), "ck")
    right = table(spark, d, "verified_mcq").join(g.select("mcq_id", "ck"), "mcq_id").select("mcq_id", "ck", "verify_id")
    out = merging.attach_two_keys(left, right, ["mcq_id"], ["ck"], ["verify_id"], ["verify_id"])
    return out.select("row", "matched_by", "verify_id")


def key_intersection(spark, d):
    a = table(spark, d, "vqa_records").select(*KEYS)
    b = table(spark, d, "generated_mcq").select(*KEYS)
    return a.intersect(b)


def first_of_key(spark, d):
    r = table(spark, d, "vqa_records").select(*KEYS, "record_id", "answer_label")
    return merging.pick(r, KEYS, ["record_id"], last=False)


def split_union(spark, d):
    """Records and generated pairs under one schema."""
    a = table(spark, d, "vqa_records").select(F.lit("record").alias("kind"), "dataset_name", "split")
    b = table(spark, d, "generated_mcq").select(F.lit("generated").alias("kind"), "dataset_name")
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind", "dataset_name", "split").agg(F.count("*").alias("n"))


def conflict(strategy):
    def run(spark, d):
        return merging.resolve(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], strategy)

    return run


def conflict_keys(spark, d):
    return merging.conflicts(table(spark, d, "vqa_records").withColumn("k", F.concat_ws("#", *KEYS)), "k", "answer_label")


def fill_missing(spark, d):
    r = table(spark, d, "vqa_records").select("record_id", *KEYS, "hash")
    return merging.filled(r, r, KEYS, "hash", ["record_id"]).select("record_id", "hash", "filled")


def force_fill(spark, d):
    r = table(spark, d, "vqa_records").select("record_id", *KEYS, "hash")
    return merging.filled(r, r, KEYS, "hash", ["record_id"], force=True).select("record_id", "hash", "filled")


def fill_counts(spark, d):
    return merging.merge_counts(fill_missing(spark, d), filled_rows=F.col("filled"), kept_rows=~F.col("filled"), still_missing=filters.is_missing(F.col("hash")))


def _annotated(spark, d):
    return rubric.annotated(table(spark, d, "verified_mcq"), TITLES)


def rubric_score(spark, d):
    s = rubric.scores(F.col("rubric_verification.rubric"))
    v = table(spark, d, "verified_mcq").where("rubric_verification.error is null and size(rubric_verification.rubric) > 0")
    return v.select("verify_id", s.alias("s")).select("verify_id", "s.weight_sum", "s.score_sum", "s.penalty", "s.final", "s.norm")


def required_check(spark, d):
    return _annotated(spark, d).select("verify_id", "verify_pass", "reason")


def score_filter(spark, d):
    return _annotated(spark, d).where(rubric.passes(F.col("verify_score"), F.col("verify_pass"), 0.9)).select("verify_id", "verify_score")


def score_summary(spark, d):
    return rubric.summary(_annotated(spark, d))


def score_histogram(spark, d):
    return rubric.deciles(_annotated(spark, d).where("verify_pass"))


def item_consistency(spark, d):
    return rubric.item_consistency(table(spark, d, "verified_mcq"))


def title_sets(spark, d):
    return rubric.title_sets(table(spark, d, "verified_mcq"))


def last_verification(spark, d):
    return rubric.by_record(table(spark, d, "verified_mcq"), ["mcq_id"]).select("mcq_id", "verify_id")


def rebalance_labels(spark, d):
    return balance.rebalanced(table(spark, d, "generated_mcq"), "mcq_id").groupBy("old_answer", "answer").agg(F.count("*").alias("n"))


def permute_options(spark, d):
    out = balance.rebalanced(table(spark, d, "generated_mcq"), "mcq_id")
    return out.select("mcq_id", "answer", F.md5(F.concat_ws("|", *(F.col(f"options.{x}") for x in LETTERS))).alias("options_md5"))


def valid_counts(spark, d):
    g = F.col("generated_vqa")
    return table(spark, d, "generated_mcq").agg(F.count_if(records.valid_strict(g)).alias("strict"), F.count_if(records.valid_strict(g, LETTERS[:4])).alias("strict_four"), F.count_if(records.valid_loose(g)).alias("loose"), F.count("*").alias("records"))


def stratified_subset(spark, d):
    r = table(spark, d, "vqa_records").select("record_id", "answer_label")
    return balance.stratified(r, "answer_label", "record_id", 103, LETTERS)


def hash_sample(spark, d):
    return balance.hash_sample(table(spark, d, "vqa_records").select("record_id", "dataset_name"), "record_id", 100)


def train_fields(spark, d):
    q, o, letter, answer = records.train_fields(F.col("generated_vqa"))
    return table(spark, d, "generated_mcq").select("mcq_id", F.md5(q).alias("question_md5"), letter.alias("answer_label"), answer.alias("answer"), F.get_json_object(o, "$.C").alias("option_c")).where("answer_label is not null")


CLINICAL = ("plain radiography", "ct slice", "mr slice", "ultrasound", "endoscopy view", "angiography", "fundus photograph", "oct section", "mammography", "skin photograph", "dental panorama", "gross specimen", "operative field", "ecg trace", "pet overlay", "laryngeal view", "face photograph", "wound photograph", "bone scan", "gait still", "capsule frame", "hand photograph")
MICRO = ("light micrograph", "electron micrograph", "fluorescence micrograph")


def _categories():
    # Labels are compared by letters and digits, since they are written in many ways.
    return curation.allowed_categories(F.col("mini_rec.image_primary_label"), F.col("mini_rec.image_secondary_label"), CLINICAL, MICRO, key=lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))


def _groups(spark, d):
    return curation.groups(table(spark, d, "curated_images"), _categories())


def curate_groups(spark, d):
    return _groups(spark, d).select("article", F.md5("caption").alias("caption_md5"), "k", F.array_join("image_ids", ",").alias("image_ids"), F.array_join("categories", ",").alias("categories"))


def group_counts(spark, d):
    return curation.available(_groups(spark, d))


# Records a category and shares of group sizes, as the reference draws them.
PER_CATEGORY, K_SHARES = 1041, {1: 0.90, 2: 0.02, 3: 0.02, 4: 0.02, 5: 0.02, 6: 0.02}


def curate_sample(spark, d):
    return curation.sample_groups(_groups(spark, d), CLINICAL + MICRO, balance.k_quotas(PER_CATEGORY, K_SHARES)).select("article", F.md5("caption").alias("caption_md5"), "k", "category")


def assemble_records(spark, d):
    images = table(spark, d, "curated_images")
    g = _groups(spark, d).withColumn("category", F.get("categories", F.lit(0)))
    out = curation.assemble(images, g)
    return out.select("article", "category", F.array_join("image_ids", ",").alias("image_ids"), F.md5(F.array_join("image_file_name", ",", "")).alias("files_md5"), "article_title")


def quota_targets(spark, d):
    rows = [(k, n) for k, n in balance.k_quotas(PER_CATEGORY, K_SHARES).items()]
    return spark.createDataFrame(rows, "k int, quota long")


def caption_blocks(spark, d):
    return table(spark, d, "generated_mcq").select("mcq_id", F.md5(records.caption_block(F.col("caption"))).alias("block_md5"))


def filled_prompts(spark, d):
    t = "Captions:\n{captions}\n\nQuestion: {question}\nAnswer with one letter."
    return table(spark, d, "generated_mcq").select("mcq_id", F.md5(records.filled(t, captions=records.caption_block(F.col("caption")), question=F.col("generated_vqa.question"))).alias("prompt_md5"))


def image_members(spark, d):
    m = F.col("mini_rec")
    r = table(spark, d, "curated_images").select("row_id", records.image_members(F.when(F.col("row_id") % 3 == 0, F.array(m["image_wds_member"])), F.when(F.col("row_id") % 3 == 1, F.array(m["image_wds_path"])), F.array(m["image_file_name"])).alias("m"), records.locator(m["image_wds_tar"], m["image_wds_member"], m["image_wds_path"]).alias("at"))
    return r.select("row_id", F.array_join("m", ",").alias("members"), "at")


def image_tuples(spark, d):
    g = table(spark, d, "generated_mcq").select("mcq_id", F.explode(records.image_tuples(F.col("image_id"), F.col("image_file_name"), F.col("article_accession_id"))).alias("t"))
    return g.select("mcq_id", "t.article", "t.id", "t.name")


def image_paths(spark, d):
    r = table(spark, d, "vqa_records")
    return r.select("record_id", F.array_join(records.image_paths(F.col("images")), ",").alias("paths"), records.has_image(F.col("images")).alias("has_image"), F.size(records.with_bytes(F.col("images"))).alias("with_bytes"))


def options_lines(spark, d):
    return table(spark, d, "vqa_records").select("record_id", F.md5(records.options_lines(F.col("options"))).alias("lines_md5"))


def export_rl(spark, d):
    out = exports.rl_records(table(spark, d, "vqa_records").where("split = 'train'"), "curatrix/mcq", "train")
    return out.select("data_source", "ability", F.md5(F.get("prompt", F.lit(0))["content"]).alias("prompt_md5"), "reward_model.style", "reward_model.ground_truth", F.col("extra_info.index").alias("record_id"))


def export_sft(spark, d):
    return exports.sft_records(table(spark, d, "vqa_records")).select("record_id", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"))


def eval_prompts(style):
    def run(spark, d):
        return exports.eval_prompts(table(spark, d, "vqa_records"), style).select("record_id", F.md5("prompts").alias("prompt_md5"))

    return run


def prompt_parse(spark, d):
    p = exports.eval_prompts(table(spark, d, "vqa_records"))
    q, o = parsing.prompt_parts(F.col("prompts"))
    return p.select("record_id", F.md5(q).alias("question_md5"), F.element_at(o, "A").alias("option_a"), F.size(o).alias("options"))


def standard_format(spark, d):
    return exports.standard(table(spark, d, "vqa_records")).select("record_id", F.size("images").alias("images"), F.md5(F.get("images", F.lit(0))).alias("first_md5"), "reasoning")


def normalised_bytes(spark, d):
    return exports.normalised_bytes(table(spark, d, "vqa_records"), 2).select("record_id", F.size("images").alias("images"), F.md5("options").alias("options_md5"), "hash")


def normalised_bytes_all(spark, d):
    """``normalised_bytes`` with all pictures of a record, which is the default; that query's SQL keeps two."""
    return exports.normalised_bytes(table(spark, d, "vqa_records")).select("record_id", F.size("images").alias("images"), F.md5("options").alias("options_md5"), "hash")


def bytes_coerce(spark, d):
    b = F.get("images", F.lit(0))["bytes"]
    none = F.lit(None)
    kind = F.col("record_id") % 3
    out = records.coerced_bytes(F.when(kind == 0, b), F.when(kind == 1, F.concat(F.lit("0x"), F.lower(F.hex(b)))), F.when(kind == 2, F.base64(b)), none.cast("array<int>"))
    return table(spark, d, "vqa_records").select("record_id", F.md5(out).alias("bytes_md5"))


def resume_anti(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    half = e.where(F.col("event_id") % 2 == 0)
    return merging.not_yet(e, half, "event_id")


def rank_split(spark, d):
    return balance.rank_split(table(spark, d, "events").select("event_id", "ts"), "event_id", 7).groupBy("rank").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def shards(spark, d):
    return balance.shards(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000).groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def paginate(spark, d):
    return balance.page(table(spark, d, "vqa_records").select("record_id", "dataset_name"), [F.asc("dataset_name"), F.asc("record_id")], 40, 20)


def lookup_first(spark, d):
    return filters.first_by(table(spark, d, "vqa_records"), ["record_id"], dataset_name="openfig_mcq", dataset_index=5).select("record_id", "answer_label")


def context_size(spark, d):
    c = F.array_distinct(records.as_list(F.col("mini_rec.context")))
    return table(spark, d, "curated_images").select("row_id", F.size(c).alias("contexts"), F.md5(F.array_join(c, "|")).alias("contexts_md5"), filters.size_between(F.col("mini_rec.image_secondary_label")).alias("labelled"))


def cot_attach(spark, d):
    """Reasoning of training records attached to other records of the same question and options."""
    r = table(spark, d, "vqa_records").select("record_id", "answer_label", "reasoning", "split", records.mcq_signature(F.col("question"), records.options_map(F.col("options"))).alias("signature")).where("signature <> ''")
    given = r.select("signature", F.col("answer_label").alias("letter"), "reasoning", F.col("record_id").alias("at"))
    out = merging.attach_reasoning(r.where("reasoning is null").select("record_id", "answer_label", "signature"), given)
    return out.select("record_id", F.md5("reasoning").alias("reasoning_md5"), "letter_matched")


def mcq_fields(spark, d):
    q, o = records.mcq_fields(F.col("j"))
    return table(spark, d, "generated_mcq").select("mcq_id", parsing.model_json(F.col("raw_model_output")).alias("j")).select("mcq_id", F.md5(q).alias("question_md5"), o.isNotNull().alias("has_options"))


def image_meta(spark, d):
    i = F.col("images")
    return table(spark, d, "vqa_records").select(
        records.record_uid(F.col("dataset_name"), F.col("dataset_index")).alias("uid"), F.size(records.packed_images(i)).alias("packed"), F.size(records.packed_images(i, False)).alias("places"), F.md5(F.get(records.packed_images(i), F.lit(0))["bytes"]).alias("first_md5")
    )


def resume_stream(spark, d):
    """Events copied by a stream of available files, run twice over the same checkpoint: the second run adds nothing."""
    from curatrix.plans.stages import temporary_path
    from curatrix.streaming.resume import run_available

    base = temporary_path(spark, "stream")
    source, shape = f"{base}/in", "event_id long, user_id long"
    table(spark, d, "events").select("event_id", "user_id").write.parquet(source)
    for _ in range(2):
        run_available(spark, source, shape, f"{base}/out", f"{base}/state", lambda df: df, key="event_id")
    return spark.read.schema(shape).parquet(f"{base}/out")


_ITEMS = rf"""
items AS (SELECT verify_id, unnest(rubric_verification.rubric) AS i, generate_subscripts(rubric_verification.rubric, 1) AS pos FROM verified_mcq WHERE rubric_verification.error IS NULL),
parts AS (SELECT verify_id, pos, {sql_strip('i.title')} AS title, lower({sql_strip('i.category')}) AS category, i.weight AS weight, i.score AS score, coalesce(lower({sql_strip('i.category')}) = 'pitfall', false) AS pitfall, coalesce(i.weight, 0) AS w, coalesce(i.score, 0) AS s FROM items),
sums AS (SELECT verify_id, sum(CASE WHEN NOT pitfall AND w > 0 THEN w ELSE 0 END)::BIGINT AS weight_sum, sum(CASE WHEN NOT pitfall AND w > 0 THEN greatest(0, least(s, w)) ELSE 0 END)::BIGINT AS score_sum, sum(CASE WHEN pitfall AND s < 0 THEN -s ELSE 0 END)::BIGINT AS penalty FROM parts GROUP BY 1),
scores AS (SELECT *, score_sum - penalty AS final, CASE WHEN weight_sum > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (score_sum - penalty)::DOUBLE / weight_sum)) END AS norm FROM sums),
needed AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in enumerate(TITLES))}) n(seq, title)),
held AS (SELECT p.verify_id, n.seq, n.title, arg_max(p.weight, pos) AS lw, arg_max(coalesce(p.score, -99), pos) AS ls, arg_max(coalesce(p.weight, -98), pos) AS lw2 FROM parts p JOIN needed n ON lower(p.title) = lower(n.title) GROUP BY 1, 2, 3),
checked AS (SELECT v.verify_id, n.seq, n.title, h.verify_id IS NULL AS missing, coalesce(h.lw2 > 0 AND h.ls = h.lw2, false) AS is_full FROM (SELECT DISTINCT verify_id FROM items) v CROSS JOIN needed n LEFT JOIN held h ON h.verify_id = v.verify_id AND h.seq = n.seq),
reasons AS (SELECT verify_id, bool_and(NOT missing AND is_full) AS ok, string_agg(title, ';' ORDER BY seq) FILTER (missing) AS lost, string_agg(title, ';' ORDER BY seq) FILTER (NOT missing AND NOT is_full) AS short FROM checked GROUP BY 1),
annotated AS (
  SELECT v.verify_id, coalesce(r.ok, false) AS verify_pass, s.norm AS verify_score,
         CASE WHEN r.verify_id IS NULL THEN NULL WHEN lost IS NOT NULL THEN 'missing_titles:' || lost WHEN short IS NOT NULL THEN 'essential_not_full:' || short ELSE '' END AS reason
  FROM verified_mcq v LEFT JOIN reasons r USING (verify_id) LEFT JOIN scores s USING (verify_id))
"""



def _strict(letters: str) -> str:
    return "coalesce(generated_vqa.question IS NOT NULL AND generated_vqa.answer IN (" + ", ".join(f"'{x}'" for x in letters) + ") AND " + " AND ".join(f"generated_vqa.options.{x} IS NOT NULL" for x in letters) + ", false)"


_REBALANCED = f"""
valid AS (SELECT mcq_id, generated_vqa AS v, row_number() OVER (ORDER BY mcq_id) - 1 AS i, count(*) OVER () AS n FROM generated_mcq WHERE {_strict('ABCDE')}),
placed AS (SELECT mcq_id, v.answer AS old_answer, substr('ABCDE', (CASE WHEN i < n % 5 THEN i ELSE (i - n % 5) % 5 END + 1)::INT, 1) AS answer, [v.options.A, v.options.B, v.options.C, v.options.D, v.options.E] AS o FROM valid),
moved AS (SELECT mcq_id, old_answer, answer, o[instr('ABCDE', old_answer)] AS hit, list_filter(o, lambda x, k: k <> instr('ABCDE', old_answer)) AS rest, instr('ABCDE', answer) AS g FROM placed)
"""

_CATS = "[" + ", ".join(f"CASE WHEN list_contains(p, '{a.replace(' ', '')}') AND list_contains(s, '{x.replace(' ', '')}') THEN '{x}' END" for a, xs in (("clinical imaging", CLINICAL), ("microscopy", MICRO)) for x in xs) + "]"
_GROUPED = rf"""
src AS (SELECT mini_rec.article_accession_id AS article, {sql_strip('mini_rec.caption')} AS c, mini_rec.image_id AS image_id, mini_rec.image_file_name AS file, mini_rec.article_title AS title, row_id,
  list_transform(coalesce(mini_rec.image_primary_label, []), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS p, list_transform(coalesce(mini_rec.image_secondary_label, []), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS s FROM curated_images),
rows AS (SELECT article, CASE WHEN c <> '' AND lower(c) <> 'no caption found' THEN c END AS caption, image_id, file, title, row_id, list_filter({_CATS}, lambda x: x IS NOT NULL) AS cats FROM src),
kept AS (SELECT * FROM rows WHERE article IS NOT NULL AND caption IS NOT NULL AND image_id IS NOT NULL AND len(cats) > 0),
per AS (SELECT article, caption, image_id, list_sort(list_distinct(flatten(list(cats)))) AS cats FROM kept GROUP BY 1, 2, 3),
grouped AS (SELECT article, caption, count(*)::INT AS k, list_sort(list(image_id)) AS ids, list_sort(list_distinct(flatten(list(cats)))) AS cats FROM per GROUP BY 1, 2 HAVING count(*) <= 6)
"""

_JSON = "CASE WHEN json_valid(options) THEN options END"
_ISMAP = f"json_type({_JSON}) = 'OBJECT'"


def _prompt_sql(order: str) -> str:
    keys = f"json_keys({_JSON})" if order == "" else f"list_sort(json_keys({_JSON}))"
    lines = f"""array_to_string(list_transform({keys}, lambda k: chr(10) || chr(10) || k || '. ' || coalesce(json_extract_string({_JSON}, '$."' || k || '"'), 'None')), '')"""
    instruction = records.INSTRUCTION.replace("\n", "' || chr(10) || '").replace("''", "")
    return f"'{instruction}' || chr(10) || chr(10) || 'Question: ' || coalesce(question, 'None') || chr(10) || chr(10) || 'Options:' || {lines}"


def _chat_sql(style: str) -> str:
    n = "len(list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false)))"
    p = _prompt_sql("")
    nl = "' || chr(10) || '"
    if style == "qwen":
        return f"'<|im_start|>system{nl}You are a helpful assistant.<|im_end|>{nl}<|im_start|>user{nl}' || CASE WHEN {n} > 0 THEN '<|vision_start|>' || repeat('<|image_pad|>', {n}) || '<|vision_end|>' ELSE '' END || {p} || '<|im_end|>{nl}<|im_start|>assistant{nl}'"
    if style == "glm":
        return f"'[gMASK]<sop><|user|>{nl}' || repeat('<|begin_of_image|><|image|><|end_of_image|>', {n}) || {p} || '<|assistant|>{nl}'"
    if style == "gemma":
        return f"'<bos><start_of_turn>user{nl}' || repeat('<start_of_image>', {n}) || {p} || '<end_of_turn>{nl}<start_of_turn>model{nl}'"
    return f"repeat('<image>' || chr(10), {n}) || {p}"


def _resolved(order: str) -> str:
    return f"""WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f, max((ts, event_id)) AS l FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS labels FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {order}) = 1"""


_MISSING = f"lower(coalesce({sql_strip('hash')}, '')) IN ('', 'none', 'null', 'nan')"
_FILL = f"""WITH r AS (SELECT record_id, dataset_name, dataset_index, hash, {_MISSING} AS lost FROM vqa_records), g AS (SELECT dataset_name, dataset_index, arg_max(coalesce(hash, ''), record_id) AS given FROM r GROUP BY 1, 2),
j AS (SELECT r.*, given, coalesce({_MISSING.replace('hash', 'given')}, true) AS no_gift FROM r LEFT JOIN g USING (dataset_name, dataset_index))"""

def _first_of(*names: str) -> str:
    paths = [f"nullif({sql_strip(f"json_extract_string(j, '$.{p}{n}')")}, '')" for n in names for p in ("", "generated_vqa.")]
    return f"coalesce({', '.join(paths)})"


_MODEL = r"""
u AS (SELECT mcq_id, regexp_extract(regexp_replace(regexp_replace(trim(raw_model_output, chr(10) || chr(9) || chr(13) || ' '), '^```(?:json|JSON)?', ''), '```$', ''), '(?s)\{.*\}') AS r FROM generated_mcq),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(r, '[“”]', '"', 'g'), '[‘’]', '''', 'g'), ',\s*([}\]])', '\1', 'g') AS f FROM u),
w AS (SELECT mcq_id, CASE WHEN json_valid(nullif(r, '')) THEN r WHEN json_valid(nullif(f, '')) THEN f END AS j FROM v)
"""

Q = {
    "merge_back": (merge_back, "WITH g AS (SELECT dataset_name, dataset_index, mcq_id, generated_vqa.answer AS generated_answer FROM generated_mcq QUALIFY row_number() OVER (PARTITION BY dataset_name, dataset_index ORDER BY generated_at DESC, mcq_id DESC) = 1) SELECT record_id, mcq_id, generated_answer FROM vqa_records LEFT JOIN g USING (dataset_name, dataset_index)"),
    "merge_composite": (
        merge_composite,
        """WITH g AS (SELECT mcq_id, coalesce(article_accession_id, '') AS a, list_transform(coalesce(image_id, []), lambda x: coalesce(x, '')) AS i, list_transform(coalesce(image_file_name, []), lambda x: coalesce(x, '')) AS f FROM generated_mcq),
        byid AS (SELECT mcq_id, max(verify_id) AS v FROM verified_mcq JOIN g USING (mcq_id) GROUP BY 1), bykey AS (SELECT a, i, f, max(verify_id) AS v FROM verified_mcq JOIN g USING (mcq_id) GROUP BY 1, 2, 3)
        SELECT g.mcq_id AS row, CASE WHEN b.v IS NOT NULL THEN 'first' WHEN k.v IS NOT NULL THEN 'second' END AS matched_by, coalesce(b.v, k.v) AS verify_id
        FROM g LEFT JOIN byid b ON g.mcq_id = b.mcq_id AND g.mcq_id % 2 = 0 LEFT JOIN bykey k ON g.a = k.a AND g.i = k.i AND g.f = k.f""",
    ),
    "key_intersection": (key_intersection, "SELECT dataset_name, dataset_index FROM vqa_records INTERSECT SELECT dataset_name, dataset_index FROM generated_mcq"),
    "first_of_key": (first_of_key, "SELECT dataset_name, dataset_index, record_id, answer_label FROM vqa_records QUALIFY row_number() OVER (PARTITION BY dataset_name, dataset_index ORDER BY record_id) = 1"),
    "split_union": (split_union, "SELECT kind, dataset_name, split, count(*) AS n FROM (SELECT 'record' AS kind, dataset_name, split FROM vqa_records UNION ALL SELECT 'generated', dataset_name, NULL FROM generated_mcq) GROUP BY ALL"),
    "conflict_majority": (conflict("majority"), _resolved("n DESC, f")),
    "conflict_first": (conflict("first"), _resolved("f")),
    "conflict_last": (conflict("last"), _resolved("l DESC")),
    "conflict_keys": (conflict_keys, "SELECT concat_ws('#', dataset_name, dataset_index) AS k, count(DISTINCT answer_label) AS labels FROM vqa_records GROUP BY 1 HAVING count(DISTINCT answer_label) > 1"),
    "fill_missing": (fill_missing, f"{_FILL} SELECT record_id, CASE WHEN lost AND NOT no_gift THEN given ELSE hash END AS hash, lost AND NOT no_gift AS filled FROM j"),
    "force_fill": (force_fill, f"{_FILL} SELECT record_id, CASE WHEN NOT no_gift THEN given ELSE hash END AS hash, NOT no_gift AS filled FROM j"),
    "fill_counts": (fill_counts, f"{_FILL} SELECT count(*) FILTER (lost AND NOT no_gift) AS filled_rows, count(*) FILTER (NOT (lost AND NOT no_gift)) AS kept_rows, count(*) FILTER (lost AND no_gift) AS still_missing FROM j"),
    "rubric_score": (rubric_score, f"WITH {_ITEMS} SELECT verify_id, weight_sum, score_sum, penalty, final, norm FROM scores"),
    "required_check": (required_check, f"WITH {_ITEMS} SELECT verify_id, verify_pass, reason FROM annotated"),
    "score_filter": (score_filter, f"WITH {_ITEMS} SELECT verify_id, verify_score FROM annotated WHERE verify_pass AND verify_score >= 0.9"),
    "score_summary": (
        score_summary,
        f"""WITH {_ITEMS} SELECT count(*) AS total, count(*) FILTER (reason IS NOT NULL) AS evaluable, count(*) FILTER (verify_pass) AS passed, count(*) FILTER (verify_pass)::DOUBLE / nullif(count(*) FILTER (reason IS NOT NULL), 0) AS ratio, avg(verify_score) FILTER (verify_pass) AS mean,
        {', '.join(f'quantile_cont(verify_score, {p / 100}) FILTER (verify_pass) AS p{p}' for p in (10, 25, 50, 75, 90))} FROM annotated""",
    ),
    "score_histogram": (score_histogram, f"WITH {_ITEMS} SELECT b::INT AS bin, count(verify_score) AS n FROM range(10) r(b) LEFT JOIN (SELECT verify_score, least(floor(verify_score * 10), 9)::INT AS k FROM annotated WHERE verify_pass AND verify_score IS NOT NULL) ON k = b GROUP BY 1"),
    "item_consistency": (
        item_consistency,
        f"""WITH p AS (SELECT {sql_strip('i.title')} AS title, i.weight AS weight, lower({sql_strip('i.category')}) AS category FROM (SELECT unnest(rubric_verification.rubric) AS i FROM verified_mcq))
        SELECT title, count(*) AS items, count(DISTINCT weight) AS weights, count(DISTINCT category) AS categories, CASE WHEN count(DISTINCT weight) <= 1 AND count(DISTINCT category) <= 1 THEN 'OK' ELSE 'MIXED' END AS state FROM p GROUP BY 1""",
    ),
    "title_sets": (
        title_sets,
        f"""WITH r AS (SELECT verify_id, list_sort(list_distinct(list_transform(list_filter(rubric_verification.rubric, lambda i: i.title IS NOT NULL AND coalesce(lower({sql_strip('i.category')}) <> 'essential', true)), lambda i: {sql_strip('i.title')}))) AS t FROM verified_mcq WHERE len(rubric_verification.rubric) > 0),
        s AS (SELECT t, count(*) AS records, min(verify_id) AS first_id FROM r GROUP BY 1), c AS (SELECT t AS common FROM s ORDER BY records DESC, array_to_string(t, '|') LIMIT 1)
        SELECT array_to_string(t, '|') AS titles, records, first_id, array_to_string(list_filter(common, lambda x: NOT list_contains(t, x)), '|') AS missing, array_to_string(list_filter(t, lambda x: NOT list_contains(common, x)), '|') AS extra FROM s CROSS JOIN c""",
    ),
    "last_verification": (last_verification, "SELECT mcq_id, verify_id FROM verified_mcq QUALIFY row_number() OVER (PARTITION BY mcq_id ORDER BY verified_at DESC, verify_id DESC) = 1"),
    "rebalance_labels": (rebalance_labels, f"WITH {_REBALANCED} SELECT old_answer, answer, count(*) AS n FROM placed GROUP BY 1, 2"),
    "permute_options": (permute_options, f"WITH {_REBALANCED} SELECT mcq_id, answer, md5(concat_ws('|', {', '.join(f'CASE WHEN g = {k} THEN hit WHEN g < {k} THEN rest[{k - 1}] ELSE rest[{k}] END' for k in range(1, 6))})) AS options_md5 FROM moved"),
    "valid_counts": (valid_counts, f"SELECT count(*) FILTER ({_strict('ABCDE')}) AS strict, count(*) FILTER ({_strict('ABCD')}) AS strict_four, count(*) FILTER (generated_vqa.question IS NOT NULL AND generated_vqa.options IS NOT NULL AND generated_vqa.answer IN ('A', 'B', 'C', 'D', 'E')) AS loose, count(*) AS records FROM generated_mcq"),
    "stratified_subset": (stratified_subset, "SELECT record_id, answer_label FROM vqa_records WHERE answer_label IN ('A', 'B', 'C', 'D', 'E') QUALIFY row_number() OVER (PARTITION BY answer_label ORDER BY md5('s' || record_id), record_id) <= 20 + (answer_label <= 'C')::INT"),
    "hash_sample": (hash_sample, "SELECT record_id, dataset_name FROM vqa_records ORDER BY md5('s' || record_id), record_id LIMIT 100"),
    "train_fields": (train_fields, "SELECT mcq_id, md5(generated_vqa.question) AS question_md5, generated_vqa.answer AS answer_label, coalesce(struct_extract(generated_vqa.options, generated_vqa.answer), '') AS answer, coalesce(generated_vqa.options.C, '') AS option_c FROM generated_mcq WHERE generated_vqa.question IS NOT NULL AND generated_vqa.answer IN ('A', 'B', 'C', 'D', 'E')".replace("struct_extract(generated_vqa.options, generated_vqa.answer)", "CASE generated_vqa.answer " + " ".join(f"WHEN '{x}' THEN generated_vqa.options.{x}" for x in LETTERS) + " END")),
    "curate_groups": (curate_groups, f"WITH {_GROUPED} SELECT article, md5(caption) AS caption_md5, k, array_to_string(ids, ',') AS image_ids, array_to_string(cats, ',') AS categories FROM grouped"),
    "group_counts": (group_counts, f"WITH {_GROUPED} SELECT k, category, count(*) AS groups FROM (SELECT k, unnest(cats) AS category FROM grouped) GROUP BY 1, 2"),
    "curate_sample": (curate_sample, None),
    "assemble_records": (
        assemble_records,
        f"""WITH {_GROUPED}, allrows AS (SELECT r.article, r.caption, r.image_id, arg_max(coalesce(r.file, ''), r.row_id) AS file, arg_max(r.title, r.row_id) AS title, any_value(g.cats[1]) AS category FROM rows r JOIN grouped g ON r.article = g.article AND r.caption = g.caption WHERE r.image_id IS NOT NULL GROUP BY 1, 2, 3)
        SELECT article, category, string_agg(image_id, ',' ORDER BY image_id) AS image_ids, md5(string_agg(file, ',' ORDER BY image_id)) AS files_md5, arg_min(title, image_id) AS article_title FROM allrows GROUP BY article, caption, category""",
    ),
    "quota_targets": (quota_targets, "SELECT * FROM (VALUES (1, 936::BIGINT), (2, 21), (3, 21), (4, 21), (5, 21), (6, 21)) q(k, quota)"),
    "caption_blocks": (caption_blocks, f"SELECT mcq_id, md5(CASE WHEN len(coalesce(caption, [])) = 0 THEN 'N/A' ELSE array_to_string(list_transform(caption, lambda x, i: '[Image ' || i || '] ' || coalesce(nullif({sql_strip('x')}, ''), '(empty)')), chr(10)) END) AS block_md5 FROM generated_mcq"),
    "filled_prompts": (filled_prompts, f"SELECT mcq_id, md5('Captions:' || chr(10) || CASE WHEN len(coalesce(caption, [])) = 0 THEN 'N/A' ELSE array_to_string(list_transform(caption, lambda x, i: '[Image ' || i || '] ' || coalesce(nullif({sql_strip('x')}, ''), '(empty)')), chr(10)) END || chr(10) || chr(10) || 'Question: ' || coalesce(generated_vqa.question, '') || chr(10) || 'Answer with one letter.') AS prompt_md5 FROM generated_mcq"),
    "image_members": (
        image_members,
        f"""WITH m AS (SELECT row_id, mini_rec AS m FROM curated_images), x AS (SELECT row_id, m, CASE WHEN row_id % 3 = 0 THEN lower({sql_strip('m.image_wds_member')}) END AS a, CASE WHEN row_id % 3 = 1 THEN lower({sql_strip("split_part(m.image_wds_path, '::', 2)")}) END AS b, lower({sql_strip('m.image_file_name')}) AS c FROM m)
        SELECT row_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), '') AS members, CASE WHEN m.image_wds_tar <> '' AND m.image_wds_member <> '' THEN m.image_wds_tar || '::' || m.image_wds_member ELSE nullif(m.image_wds_path, '') END AS at FROM x""",
    ),
    "image_tuples": (image_tuples, "SELECT mcq_id, coalesce(article_accession_id, '') AS article, coalesce(z.a, '') AS id, coalesce(z.b, '') AS name FROM (SELECT mcq_id, article_accession_id, unnest(CASE WHEN greatest(len(coalesce(image_id, [])), len(coalesce(image_file_name, []))) = 0 THEN [{'a': '__UNKNOWN__', 'b': '__UNKNOWN__'}] ELSE list_transform(range(1, greatest(len(coalesce(image_id, [])), len(coalesce(image_file_name, []))) + 1), lambda i: {'a': image_id[i], 'b': image_file_name[i]}) END) AS z FROM generated_mcq)"),
    "image_paths": (image_paths, "SELECT record_id, array_to_string(list_filter(list_transform(images, lambda x: x.path), lambda p: p IS NOT NULL), ',') AS paths, len(list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false))) > 0 AS has_image, len(list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false))) AS with_bytes FROM vqa_records"),
    "options_lines": (
        options_lines,
        rf"""WITH k AS (SELECT record_id, options, CASE WHEN json_valid(options) THEN json_type({_JSON}) ELSE '' END AS kind, {_OPTIONS} AS lines FROM vqa_records),
        l AS (SELECT *, CASE WHEN kind = 'ARRAY' THEN from_json(options, '["VARCHAR"]') ELSE list_filter(list_transform(regexp_split_to_array(options, '[\n;|]'), lambda x: {sql_strip('x')}), lambda x: x <> '') END AS plain FROM k)
        SELECT record_id, md5(CASE WHEN options IS NULL THEN NULL WHEN kind = 'OBJECT' THEN lines ELSE array_to_string(list_transform(plain, lambda x, i: chr((64 + i)::INT) || '. ' || regexp_replace(x, '^[A-Za-z]\s*[.)]\s*', '')), chr(10)) END) AS lines_md5 FROM l""",
    ),
    "export_rl": (export_rl, f"SELECT 'curatrix/mcq' AS data_source, 'medical_mcq' AS ability, md5(repeat('<image>', len(coalesce(images, []))) || {_prompt_sql('')}) AS prompt_md5, 'rule' AS style, answer AS ground_truth, record_id FROM vqa_records WHERE split = 'train' AND {_ISMAP}"),
    "export_sft": (export_sft, f"SELECT record_id, md5({_prompt_sql('sorted')}) AS prompt_md5, md5('<think> ' || {sql_strip('reasoning')} || ' </think>' || chr(10) || '<answer> ' || {sql_strip('answer_label')} || ' </answer>') AS response_md5 FROM vqa_records WHERE {_ISMAP} AND coalesce({sql_strip('reasoning')}, '') <> ''"),
    "eval_prompts_plain": (eval_prompts("plain"), f"SELECT record_id, md5({_chat_sql('plain')}) AS prompt_md5 FROM vqa_records WHERE {_ISMAP}"),
    "eval_prompts_glm": (eval_prompts("glm"), f"SELECT record_id, md5({_chat_sql('glm')}) AS prompt_md5 FROM vqa_records WHERE {_ISMAP}"),
    "eval_prompts_gemma": (eval_prompts("gemma"), f"SELECT record_id, md5({_chat_sql('gemma')}) AS prompt_md5 FROM vqa_records WHERE {_ISMAP}"),
    "eval_prompts_qwen": (eval_prompts("qwen"), f"SELECT record_id, md5({_chat_sql('qwen')}) AS prompt_md5 FROM vqa_records WHERE {_ISMAP}"),
    "prompt_parse": (
        prompt_parse,
        rf"""WITH p AS (SELECT record_id, {_chat_sql('plain')} AS p FROM vqa_records WHERE {_ISMAP}),
        r AS (SELECT record_id, p, regexp_extract(regexp_extract(p, '(?s)Question:.*?\n\s*\n\s*Options:(.*)', 1), '(?s)^(.*?)(?:<\|assistant\|>|$)', 1) AS block FROM p),
        o AS (SELECT record_id, p, regexp_extract_all(block, '(?m)^[ \t]*([A-Z])\.[ \t]*\S[^\n]*$', 1) AS letters, regexp_extract_all(block, '(?m)^[ \t]*[A-Z]\.[ \t]*(\S[^\n]*?)[ \t]*$', 1) AS texts FROM r)
        SELECT record_id, md5(nullif({sql_strip(r"regexp_extract(p, '(?s)Question:\s*(.*?)\n\s*\n\s*Options:', 1)")}, '')) AS question_md5, texts[list_position(letters, 'A')] AS option_a, CASE WHEN len(letters) > 0 THEN len(letters)::INT END AS options FROM o""",
    ),
    "standard_format": (standard_format, f"WITH r AS (SELECT record_id, list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false)) AS i, nullif({sql_strip('reasoning')}, '') AS reasoning FROM vqa_records) SELECT record_id, len(i) AS images, md5(i[1].bytes) AS first_md5, reasoning FROM r"),
    "normalised_bytes": (normalised_bytes, "WITH r AS (SELECT *, list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false)) AS i FROM vqa_records) SELECT record_id, least(len(i), 2)::INT AS images, md5(CASE WHEN json_valid(options) THEN options ELSE '{}' END) AS options_md5, coalesce(hash, '') AS hash FROM r WHERE len(i) > 0"),
    "normalised_bytes_all": (normalised_bytes_all, "WITH r AS (SELECT *, list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false)) AS i FROM vqa_records) SELECT record_id, len(i)::INT AS images, md5(CASE WHEN json_valid(options) THEN options ELSE '{}' END) AS options_md5, coalesce(hash, '') AS hash FROM r WHERE len(i) > 0"),
    "bytes_coerce": (bytes_coerce, "SELECT record_id, md5(CASE WHEN octet_length(images[1].bytes) > 0 THEN images[1].bytes END) AS bytes_md5 FROM vqa_records"),
    "resume_anti": (resume_anti, "SELECT event_id, user_id FROM events WHERE event_id % 2 <> 0"),
    "rank_split": (rank_split, "WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT (i // ceil(n / 7)::BIGINT)::BIGINT AS rank, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM o GROUP BY 1"),
    "shards": (shards, "WITH o AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders) SELECT shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM o GROUP BY 1"),
    "paginate": (paginate, "SELECT record_id, dataset_name FROM vqa_records ORDER BY dataset_name NULLS FIRST, record_id LIMIT 20 OFFSET 40"),
    "lookup_first": (lookup_first, "SELECT record_id, answer_label FROM vqa_records WHERE dataset_name = 'openfig_mcq' AND dataset_index = 5 ORDER BY record_id LIMIT 1"),
    "context_size": (
        context_size,
        "WITH c AS (SELECT row_id, list_transform(coalesce(mini_rec.context, []), lambda x: coalesce(x, '')) AS c, len(mini_rec.image_secondary_label) AS n FROM curated_images), d AS (SELECT row_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS c, n FROM c) SELECT row_id, len(c)::INT AS contexts, md5(array_to_string(c, '|')) AS contexts_md5, n BETWEEN 1 AND 6 AS labelled FROM d",
    ),
    "cot_attach": (
        cot_attach,
        f"""WITH s AS (SELECT record_id, answer_label, reasoning, concat_ws(chr(10), lower({sql_strip(f"regexp_replace(question, '{WS}+', ' ', 'g')")}),
          array_to_string(list_sort(list_transform(list_filter(list_transform(json_keys({_JSON}), lambda k: json_extract_string({_JSON}, '$."' || k || '"')), lambda v: v IS NOT NULL), lambda v: lower({sql_strip(f"regexp_replace(v, '{WS}+', ' ', 'g')")}))), '|')) AS g FROM vqa_records),
        r AS (SELECT * FROM s WHERE g <> ''), b AS (SELECT g, answer_label AS l, arg_min(reasoning, record_id) AS reasoning, min(record_id) AS seq FROM r WHERE reasoning IS NOT NULL GROUP BY 1, 2), f AS (SELECT g, arg_min(reasoning, seq) AS reasoning FROM b GROUP BY 1)
        SELECT record_id, md5(coalesce(b.reasoning, f.reasoning)) AS reasoning_md5, b.g IS NOT NULL AS letter_matched FROM r LEFT JOIN b ON r.g = b.g AND r.answer_label = b.l LEFT JOIN f ON r.g = f.g WHERE r.reasoning IS NULL AND coalesce(b.reasoning, f.reasoning) IS NOT NULL""",
    ),
    "mcq_fields": (mcq_fields, f"WITH {_MODEL} SELECT mcq_id, md5({_first_of('question', 'stem', 'prompt')}) AS question_md5, {_first_of('options', 'choices')} IS NOT NULL AS has_options FROM w"),
    "image_meta": (image_meta, "WITH r AS (SELECT coalesce(dataset_name, '') || '#' || coalesce(dataset_index::VARCHAR, '-1') AS uid, images, list_filter(coalesce(images, []), lambda x: coalesce(octet_length(x.bytes) > 0, false)) AS i FROM vqa_records) SELECT uid, len(i) AS packed, len(coalesce(images, [])) AS places, md5(i[1].bytes) AS first_md5 FROM r"),
    "resume_stream": (resume_stream, "SELECT event_id, user_id FROM events"),
}
