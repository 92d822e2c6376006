"""Queries over sources and sinks, each a round trip through the shared folder, and over model steps."""

from __future__ import annotations

import re
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import parsing, prompts, records, text
from curatrix.operators import analysis, balance, evaluation, merging, neardup, rubric
from curatrix.plans.q_eval import _GRADED, _graded, _outputs
from curatrix.plans.q_records import _MODEL, _REBALANCED
from curatrix.plans.q_text import WS, sql_strip
from curatrix.plans.stages import temporary_path
from curatrix.plans.tables import table
from curatrix.sources import readers, sinks
from curatrix.streaming.resume import model_step


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props")


EVENT = "event_id long, user_id long, event_type string, value double, props string"


def jsonl_round_trip(spark, d):
    path = temporary_path(spark, "jsonl")
    sinks.json_lines(_events(spark, d), path)
    return readers.json_records(spark, path, EVENT, glob="*.json").select("event_id", "user_id", "event_type", "value", "props")


def jsonl_numbers(spark, d):
    """Lines of one file with their numbers; events are written in order, so the number follows the id."""
    path = temporary_path(spark, "lines")
    table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).orderBy("r_regionkey").write.json(path)
    lines = readers.numbered(readers.json_lines(spark, path, glob="*.json"))
    return lines.select("line_no", F.get_json_object("line", "$.r_name").alias("r_name"))


def csv_round_trip(spark, d):
    path = temporary_path(spark, "csv")
    sinks.csv(_events(spark, d), path)
    return spark.read.option("header", True).option("escape", '"').schema(EVENT).csv(path)


def parquet_codecs(spark, d):
    """The same rows through four codecs, with and without dictionaries: rows and sums of each."""
    out = None
    for codec, dictionary in (("zstd", True), ("snappy", False), ("gzip", True), ("none", False)):
        path = temporary_path(spark, codec)
        sinks.parquet(_events(spark, d), path, codec, dictionary=dictionary, block_bytes=1 << 20)
        one = spark.read.parquet(path).agg(F.lit(codec).alias("codec"), F.count("*").alias("n"), F.sum("event_id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


def json_array_scan(spark, d):
    path = temporary_path(spark, "array")
    rows = table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    rows.coalesce(1).write.text(path)
    return readers.json_array(spark, path, "n_nationkey long, n_name string")


def sources_apart(spark, d):
    """Rows of two input files written to a folder each, and counted by folder."""
    base, path = temporary_path(spark, "inputs"), temporary_path(spark, "apart")
    for name, kind in (("clicks", "click"), ("errors", "error")):
        _events(spark, d).where(F.col("event_type") == kind).select("event_id").coalesce(1).write.parquet(f"{base}/{name}")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(base).select("event_id", F.regexp_replace(F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1), "$", ".parquet").alias("source_file"))
    sinks.per_source(rows, path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


def sharded_files(spark, d):
    path = temporary_path(spark, "shards")
    sinks.sharded(table(spark, d, "orders").select("o_orderkey"), path, "o_orderkey", 1000)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def exact_schema(spark, d):
    """A single file whose columns have the types asked for, nested ones included."""
    path = temporary_path(spark, "exact")
    small = table(spark, d, "category_targets").select("secondary_label", "target_permille", F.struct("primary_label", "min_rows").alias("detail"))
    sinks.one_parquet(small, path, "secondary_label string, target_permille int, detail struct<primary_label:string,min_rows:int>")
    read = spark.read.parquet(path)
    return read.select("secondary_label", "target_permille", "detail.primary_label", "detail.min_rows", F.lit(dict(read.dtypes)["target_permille"]).alias("kind"))


def filled_columns(spark, d):
    """Two files of different columns read into the wanted ones."""
    base = temporary_path(spark, "filled")
    table(spark, d, "region").select("r_regionkey", "r_name").write.parquet(f"{base}/a")
    table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("r_regionkey"), F.lit("x").alias("mark")).write.parquet(f"{base}/b")
    return readers.parquet_filled(spark, f"{base}/a,{base}/b", {"r_regionkey": F.lit(-1), "r_name": F.lit("?"), "mark": F.lit("none"), "absent": F.lit(7)})


def run_arguments(spark, d):
    path = temporary_path(spark, "run")
    sinks.provenance(table(spark, d, "region"), path, {"threshold": 0.8, "name": "region", "seed": 3})
    return spark.read.text(path).select(F.get_json_object("value", "$.threshold").alias("threshold"), F.get_json_object("value", "$.name").alias("name"))


def merged_results(spark, d):
    """Result files of models, one folder each, read as one table."""
    base = temporary_path(spark, "results")
    r = table(spark, d, "vqa_records").select("record_id", "dataset_name", "split")
    for model in ("train", "validation", "test"):
        r.where(F.col("split") == model).select("record_id", "dataset_name").coalesce(1).write.json(f"{base}/{model}")
    rows = readers.result_files(spark, base, "record_id long, dataset_name string", "*.json")
    return rows.groupBy("model", "dataset_name").agg(F.count("*").alias("n"))


def stopword_counts(spark, d):
    """Words that are left once the words of a file are taken out."""
    path = temporary_path(spark, "stop")
    spark.createDataFrame([(" The",), ("of",), ("",), ("AND",), ("of",)], "value string").coalesce(1).write.text(path)
    words = F.explode(text.kept_tokens(F.col("text"), readers.stopwords(spark, path)))
    return table(spark, d, "benchmark_items").select("item_id", words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def shard_concatenation(spark, d):
    """Lines of rank shards as one list, and whether each is where its id says."""
    base = temporary_path(spark, "ranks")
    ranked = balance.rank_split(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 4)
    for rank in range(4):
        path = f"{base}/part{rank}"
        ranked.where(F.col("rank") == rank).select("s_suppkey").orderBy("s_suppkey").coalesce(1).write.json(path)
    lines = sinks.concatenated(spark, base, "*.json")
    return lines.select(F.get_json_object("line", "$.s_suppkey").cast("long").alias("s_suppkey"))


def example_rows(spark, d):
    """The pairs of highest similarity with the rows of both sides."""
    r = table(spark, d, "benchmark_items").select("item_id", "dataset_name", "text")
    pairs = r.select(F.col("item_id").alias("a"), "dataset_name").join(r.select(F.col("item_id").alias("b"), "dataset_name"), "dataset_name").where("a < b").select("a", "b", (1.0 / (F.col("b") - F.col("a"))).alias("score"))
    out = sinks.examples(pairs, r, r, "a", "b", "score", "item_id", 12)
    return out.select("a", "b", F.md5("query_row.text").alias("query_md5"), F.md5("match_row.text").alias("match_md5"))


def _tars(spark, d) -> str:
    """Archives of curated images, each with a JSON member and a picture an image, one archive for each partition."""
    path = temporary_path(spark, "tars")
    where = path.removeprefix("file://")
    m = F.col("mini_rec")
    rows = table(spark, d, "curated_images").where(m["image_id"].isNotNull()).groupBy(m["image_id"].alias("key")).agg(F.min_by(F.struct("row_id", "mini_rec"), "row_id").alias("r"))
    image_set = F.array(F.struct(F.lit("other").alias("image_id"), F.lit("no").alias("caption")), F.struct(F.col("key").alias("image_id"), F.col("r.mini_rec.caption").alias("caption")))
    record = F.struct(
        F.col("key").alias(readers.RECORD_ID), F.col("r.mini_rec.article_accession_id").alias("article_accession_id"), F.col("r.mini_rec.article_title").alias("article_title"), F.col("r.mini_rec.image_file_name").alias("image_file_name"),
        F.col("r.mini_rec.image_primary_label").alias("image_primary_label"), image_set.alias("image_set"), F.create_map("key", F.col("r.mini_rec.context")).alias("image_context"),
    )

    def write(batches):
        import io
        import os
        import tarfile

        # The name follows from the partition, so a task that is run again replaces its archive.
        os.makedirs(where, exist_ok=True)
        name, n = f"part{TaskContext.get().partitionId()}", 0
        with tarfile.open(mine := f"{where}/.{name}-{uuid.uuid4().hex}", "w") as tar:
            for batch in batches:
                for key, value in zip(batch["key"], batch["value"]):
                    for ending, body in ((".json", value.encode()), (".jpg", key.encode())):
                        info = tarfile.TarInfo(key + ending)
                        info.size = len(body)
                        tar.addfile(info, io.BytesIO(body))
                    n += 1
            bad = tarfile.TarInfo("broken.json")
            bad.size = 3
            tar.addfile(bad, io.BytesIO(b"{x}"))
        os.replace(mine, f"{where}/{name}.tar")
        import pandas as pd

        yield pd.DataFrame({"n": [n]})

    rows.select("key", F.to_json(record).alias("value")).mapInPandas(write, "n long").count()
    return path


def archive_records(spark, d):
    """Curated records of archives: caption of the image itself, contexts, labels and where the picture lies."""
    path = _tars(spark, d)
    c = readers.curated(readers.archives(spark, path), path)
    return c.select("image_id", "article_accession_id", "article_title", F.md5("caption").alias("caption_md5"), F.size("context").alias("contexts"), F.array_join("image_primary_label", "|").alias("labels"), "image_wds_member", F.col("image_wds_path").endswith(F.concat(F.lit(".tar::"), "image_wds_member")).alias("located"))


def archive_members(spark, d):
    """Pictures fetched from archives by name."""
    path = _tars(spark, d)
    wanted = readers.archives(spark, path).select("archive", F.col("picture").alias("member"))
    return readers.archive_pictures(spark, path, wanted).select("member", F.decode("bytes", "UTF-8").alias("content"))


def read_by_ending(spark, d):
    base = temporary_path(spark, "ending")
    table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.json(f"{base}/rows.json")
    table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.parquet(f"{base}/rows.parquet")
    a, b = (readers.read_any(spark, f"{base}/rows.{x}").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(readers.reader_for(f"rows.{x}")).alias("reader")) for x in ("json", "parquet"))
    return a.unionByName(b)


def capped_candidates(spark, d):
    """At most five candidates a query among items of the same dataset."""
    r = table(spark, d, "benchmark_items").select("item_id", "dataset_name")
    pairs = r.select(F.col("item_id").alias("a"), "dataset_name").join(r.select(F.col("item_id").alias("b"), "dataset_name"), "dataset_name").where("a <> b")
    return neardup.capped(pairs, "a", "b", 5)


def first_correct_rollout(spark, d):
    return _graded(spark, d).select("record_id", evaluation.first_correct(F.col("parsed")).alias("r")).where("r is not null").select("record_id", F.col("r.place").cast("long").alias("place"), F.md5("r.pred_letter").alias("pred_md5"))


def rollout_totals(spark, d):
    return evaluation.totals(evaluation.regraded(_graded(spark, d)))


def cot_attach_folded(spark, d):
    """Reasoning of the first right rollout of records, attached by the folded signature."""
    g = _graded(spark, d).select("record_id", evaluation.first_correct(F.col("parsed")).alias("r"))
    r = table(spark, d, "vqa_records").select("record_id", "answer_label", "reasoning", records.folded_signature(F.col("question"), records.options_map(F.col("options"))).alias("signature")).where("signature is not null")
    thought = g.where("r is not null").select("record_id", parsing.thinking(F.col("r.output_text")).alias("reasoning")).where("reasoning is not null")
    given = r.drop("reasoning").join(thought, "record_id").select("signature", F.col("answer_label").alias("letter"), "reasoning", F.col("record_id").alias("at"))
    return merging.attach_reasoning(r.where("reasoning is null").select("record_id", "answer_label", "signature"), given).select("record_id", F.md5("reasoning").alias("reasoning_md5"), "letter_matched")


def question_types(spark, d):
    i = F.col("record_id")
    j = F.when(i % 3 == 0, F.to_json(F.struct(F.col("dataset_name").alias("Question Type"), F.lit("x").alias("question_type")))).when(i % 3 == 1, F.to_json(F.struct(F.col("split").alias("question_type")))).otherwise(F.col("misc"))
    return table(spark, d, "vqa_records").select(parsing.question_type(j).alias("question_type")).groupBy("question_type").agg(F.count("*").alias("n"))


def raw_labels(spark, d):
    """Labels in model outputs, under one of several keys or in no JSON at all."""
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit('```json\n{"Organ": "'), "event_type", F.lit('"}\n```'))).when(i % 4 == 1, F.concat(F.lit('{"image_modality": "'), "event_type", F.lit('",}'))).when(i % 4 == 2, F.concat(F.lit("I say organ: '"), "event_type", F.lit("' here")))
    label, parsed = parsing.raw_label(F.col("raw"), ("image_modality", "organ"))
    return _events(spark, d).select("event_id", raw.alias("raw")).select("event_id", label.alias("label"), F.coalesce(parsed, F.lit(False)).alias("parsed"))


def image_counts(spark, d):
    return analysis.image_counters(table(spark, d, "vqa_records"))


def rebalance_all(spark, d):
    """Rebalanced records and those passed through."""
    return balance.rebalanced_all(table(spark, d, "generated_mcq"), "mcq_id").select("mcq_id", "old_answer", "answer")


def conflict_labels(spark, d):
    """Articles whose records have different answer letters."""
    return merging.conflicts(table(spark, d, "vqa_records"), "article_accession_id", "answer_label")


def first_rows(spark, d):
    return balance.head(table(spark, d, "vqa_records").select("record_id", "dataset_name"), "record_id", 50)


def distinct_values(spark, d):
    return table(spark, d, "vqa_records").select("dataset_name").distinct().orderBy("dataset_name")


def _generated(spark, d) -> DataFrame:
    g = table(spark, d, "generated_mcq")
    return g.select("mcq_id", "generated_vqa", prompts.verification(F.col("generated_vqa"), F.col("caption")).alias("prompt"))


def _echo(rows: list[dict]) -> list[str]:
    """A stand-in for a model: its output depends on the prompt only."""
    return [f'{{"rubric": [{{"title": "Length", "category": "Essential", "weight": 5, "score": {len(r["prompt"] or "") % 6}}}]}}' for r in rows]


def verified_rows(spark, d):
    """Verification by a stand-in for a model; rows without a pair get an error instead."""
    rows = _generated(spark, d)
    done = model_step(rows.where(records.valid_loose(F.col("generated_vqa"))).select("mcq_id", "prompt"), _echo, ["prompt"])
    return prompts.verification_rows(rows.select("mcq_id"), done).select("mcq_id", "error", F.size("rubric").alias("items"), F.get("rubric", F.lit(0))["score"].alias("score"))


def generation_prompts(spark, d):
    g = table(spark, d, "generated_mcq")
    return g.select("mcq_id", F.md5(prompts.generation(F.col("caption"))).alias("five_md5"), F.md5(prompts.generation(F.col("caption"), letters="ABCD")).alias("four_md5"))


def type_answers(spark, d):
    """Types that outputs name: stripped, else Unknown."""
    return _events(spark, d).select("event_id", prompts.type_answer(F.when(F.col("event_id") % 3 == 0, F.lit("  ")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit("\n")))).alias("kind"))


def modality_answers(spark, d):
    """Modality of outputs that parse, on the list or not, and parse errors."""
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.lit('{"modality": "CT  Slice", "anatomy": "lung"}')).when(i % 3 == 1, F.lit("{'modality': 'drawing',}")).otherwise("no braces")
    return _events(spark, d).select("event_id", prompts.modality_answer(raw, ("ct slice", "mr slice")).alias("a")).select("event_id", "a.modality", "a.parse_error")


def title_examples(spark, d):
    return rubric.title_examples(table(spark, d, "verified_mcq")).select("titles", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def never_seen(spark, d):
    labels = table(spark, d, "category_targets").select("secondary_label").unionByName(spark.createDataFrame([("no such label",)], "secondary_label string"))
    return analysis.never_seen(table(spark, d, "curated_images"), F.col("mini_rec.image_secondary_label"), labels, "secondary_label")


def label_whitelist(spark, d):
    """Labels of images brought to those of the whole list of categories, and counted."""
    one = table(spark, d, "curated_images").select(F.explode("mini_rec.image_secondary_label").alias("raw"))
    return analysis.whitelisted(one, "raw", table(spark, d, "category_targets"), "secondary_label").groupBy("canonical").agg(F.count("*").alias("n"))


def lost_texts(spark, d):
    rows = table(spark, d, "generated_mcq").select("mcq_id", "raw_model_output", parsing.model_json(F.col("raw_model_output")).alias("j"))
    return analysis.lost_texts(rows, "mcq_id", F.col("raw_model_output"), F.col("j")).select("mcq_id", F.md5("text").alias("text_md5"))


def build_trainset(spark, d):
    """Generated pairs with the pictures of the record of their natural key, else of their article."""
    keys = ["dataset_name", "dataset_index"]
    left = table(spark, d, "generated_mcq").select("mcq_id", *keys, "article_accession_id")
    right = table(spark, d, "vqa_records").select(*keys, "article_accession_id", "record_id", "hash", "images")
    out = merging.trainset(left, right, keys, ["article_accession_id"], ["record_id", "hash", "images"], ["record_id"])
    return out.select("mcq_id", "record_id", "hash", F.size("images").alias("images"), "matched_by")


def fitted_sizes(spark, d):
    s = F.col("mini_rec.image_size")
    w, h = F.get(s, F.lit(0)), F.get(s, F.lit(1))
    rows = table(spark, d, "curated_images").where((w > 0) & (h > 0))
    return rows.select("row_id", *(F.array_join(F.transform(records.fitted(w, h, 300, m), lambda x: x.cast("string")), "x").alias(m) for m in ("drop", "pad", "resize")))


def loose_grades(spark, d):
    """Grades of the last answers, where holding the answer's text is enough."""
    o = _outputs(spark, d).select("record_id", "answer", "answer_label", F.posexplode("outs").alias("place", "t"))
    return o.select("record_id", "place", parsing.grade(parsing.answer_last(F.col("t")), F.col("answer"), F.col("answer_label"), loose=True).alias("is_correct"))


def normalized_vqa(spark, d):
    """Generated pairs with the options A to E, and pictures of records cut to two."""
    v = records.normalize_vqa(F.col("generated_vqa"))
    return table(spark, d, "generated_mcq").select("mcq_id", v.alias("v")).select("mcq_id", F.col("v").isNull().alias("none"), F.md5("v.question").alias("question_md5"), F.md5(F.concat_ws("|", *(F.coalesce(f"v.options.{x}", F.lit("-")) for x in "ABCDE"))).alias("options_md5"), F.md5("v.answer").alias("answer_md5"))


def first_pictures(spark, d):
    return table(spark, d, "vqa_records").select("record_id", F.transform(records.first_images(F.col("images"), 2), lambda x: x["path"]).alias("p")).select("record_id", F.size("p").alias("n"), F.array_join("p", ",", "-").alias("paths"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _generation_sql(letters: str) -> str:
    """The template with the captions in place of its marks, the other marks being filled already."""
    options = "{" + ", ".join(f'"{x}": "..."' for x in letters) + "}"
    text = prompts.GENERATE.replace("{{options}}", options).replace("{count}", str(len(letters))).replace("{letters}", ", ".join(letters)).replace("{contexts}", "")
    before, after = text.split("{captions}")
    return f"{_quoted(before)} || block || {_quoted(after)}"


_BLOCK = f"CASE WHEN len(coalesce(caption, [])) = 0 THEN 'N/A' ELSE array_to_string(list_transform(caption, lambda x, i: '[Image ' || i || '] ' || coalesce(nullif({sql_strip('x')}, ''), '(empty)')), chr(10)) END"
_ASKED = "coalesce(generated_vqa.question IS NOT NULL AND generated_vqa.options IS NOT NULL AND generated_vqa.answer IN ('A', 'B', 'C', 'D', 'E'), false)"
_PROMPT_LENGTH = (
    f"{len(re.sub(r'{(caption|question|options|answer)}', '', prompts.VERIFY))} + length(coalesce(nullif({sql_strip('caption[1]')}, ''), 'N/A')) + length(coalesce(generated_vqa.question, '')) + length(coalesce(generated_vqa.answer, ''))"
    + " + length(concat_ws(chr(10), " + ", ".join(f"'{x}. ' || generated_vqa.options.{x}" for x in "ABCDE") + "))"
)

_BENCH_PAIRS = "p AS (SELECT a.item_id AS a, b.item_id AS b FROM benchmark_items a JOIN benchmark_items b USING (dataset_name) WHERE a.item_id <> b.item_id)"
_MINI = "m AS (SELECT arg_min(mini_rec, row_id) AS r FROM curated_images WHERE mini_rec.image_id IS NOT NULL GROUP BY mini_rec.image_id)"
_SQL_EVENTS = "SELECT event_id, user_id, event_type, value, props FROM events"
_CAP = sql_strip("r.caption")

Q = {
    "jsonl_round_trip": (jsonl_round_trip, _SQL_EVENTS),
    "jsonl_numbers": (jsonl_numbers, "SELECT row_number() OVER (ORDER BY r_regionkey) AS line_no, r_name FROM region"),
    "csv_round_trip": (csv_round_trip, _SQL_EVENTS),
    "parquet_codecs": (parquet_codecs, "SELECT c.codec, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events CROSS JOIN (VALUES ('zstd'), ('snappy'), ('gzip'), ('none')) c(codec) GROUP BY 1"),
    "json_array_scan": (json_array_scan, "SELECT n_nationkey, n_name FROM nation"),
    "sources_apart": (sources_apart, "SELECT CASE event_type WHEN 'click' THEN 'clicks' ELSE 'errors' END AS source, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1"),
    "sharded_files": (sharded_files, "WITH o AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders) SELECT shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM o GROUP BY 1"),
    "exact_schema": (exact_schema, "SELECT secondary_label, target_permille::INT AS target_permille, primary_label, min_rows::INT AS min_rows, 'int' AS kind FROM category_targets"),
    "filled_columns": (filled_columns, "SELECT r_regionkey, r_name, 'none' AS mark, 7 AS absent FROM region UNION ALL SELECT r_regionkey + 100, '?', 'x', 7 FROM region"),
    "run_arguments": (run_arguments, "SELECT '0.8' AS threshold, 'region' AS name"),
    "merged_results": (merged_results, "SELECT split AS model, dataset_name, count(*) AS n FROM vqa_records WHERE split IN ('train', 'validation', 'test') GROUP BY 1, 2"),
    "stopword_counts": (stopword_counts, "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark_items) WHERE length(word) > 1 AND word NOT IN ('the', 'of', 'and') GROUP BY 1"),
    "shard_concatenation": (shard_concatenation, "SELECT s_suppkey FROM supplier ORDER BY s_suppkey"),
    "example_rows": (example_rows, "WITH p AS (SELECT a.item_id AS a, b.item_id AS b, a.text AS x, b.text AS y FROM benchmark_items a JOIN benchmark_items b USING (dataset_name) WHERE a.item_id < b.item_id) SELECT a, b, md5(x) AS query_md5, md5(y) AS match_md5 FROM p ORDER BY 1.0 / (b - a) DESC, a, b LIMIT 12"),
    "archive_records": (
        archive_records,
        f"""WITH {_MINI} SELECT r.image_id AS image_id, coalesce(r.article_accession_id, '') AS article_accession_id, coalesce(r.article_title, '') AS article_title, md5(CASE WHEN {_CAP} <> '' AND lower({_CAP}) <> 'no caption found' THEN {_CAP} END) AS caption_md5,
        len(list_distinct(list_transform(coalesce(r.context, []), lambda x: coalesce(x, ''))))::INT AS contexts,
        array_to_string(list_filter(coalesce(r.image_primary_label, []), lambda x: coalesce(x <> '', false)), '|') AS labels, r.image_id || '.jpg' AS image_wds_member, true AS located FROM m""",
    ),
    "archive_members": (archive_members, f"WITH {_MINI} SELECT r.image_id || '.jpg' AS member, r.image_id AS content FROM m"),
    "read_by_ending": (read_by_ending, "SELECT n_nationkey, n_name, unnest(['json', 'parquet']) AS reader FROM nation"),
    "capped_candidates": (capped_candidates, f"WITH {_BENCH_PAIRS} SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b)::INT AS rank, greatest(count(*) OVER (PARTITION BY a) - 5, 0) AS left_out FROM p QUALIFY rank <= 5"),
    "first_correct_rollout": (first_correct_rollout, f"WITH {_GRADED} SELECT record_id, min(place) AS place, md5(arg_min(pred, place)) AS pred_md5 FROM graded WHERE is_correct GROUP BY 1"),
    "rollout_totals": (rollout_totals, f"WITH {_GRADED} SELECT count(*) AS records, sum(num_rollouts)::BIGINT AS rollouts, sum(num_correct)::BIGINT AS correct, round(sum(num_correct)::DOUBLE / sum(num_rollouts), 6) AS share FROM rows"),
    "cot_attach_folded": (cot_attach_folded, None),
    "question_types": (question_types, "SELECT coalesce(CASE record_id % 3 WHEN 0 THEN nullif(trim(dataset_name), '') WHEN 1 THEN nullif(trim(split), '') END, CASE WHEN record_id % 3 = 0 THEN 'x' ELSE 'Unknown' END) AS question_type, count(*) AS n FROM vqa_records GROUP BY 1"),
    "raw_labels": (raw_labels, "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS label, event_id % 4 < 2 AS parsed FROM events"),
    "image_counts": (
        image_counts,
        """WITH i AS (SELECT unnest(images).bytes AS x FROM vqa_records) SELECT (SELECT count(*) FROM vqa_records) AS records, (SELECT count(*) FILTER (coalesce(len(images), 0) = 0) FROM vqa_records) AS without, count(*) AS pictures, count(*) FILTER (coalesce(octet_length(x), 0) = 0) AS missing,
        count(*) FILTER (hex(x[1:8]) = '89504E470D0A1A0A' OR hex(x[1:2]) = '5035') AS ok, count(*) FILTER (octet_length(x) > 0 AND NOT (hex(x[1:8]) = '89504E470D0A1A0A' OR hex(x[1:2]) = '5035')) AS failed FROM i""",
    ),
    "rebalance_all": (rebalance_all, f"WITH {_REBALANCED} SELECT mcq_id, old_answer, answer FROM placed UNION ALL SELECT mcq_id, generated_vqa.answer, generated_vqa.answer FROM generated_mcq WHERE mcq_id NOT IN (SELECT mcq_id FROM placed)"),
    "conflict_labels": (conflict_labels, "SELECT article_accession_id, count(DISTINCT answer_label) AS labels FROM vqa_records GROUP BY 1 HAVING count(DISTINCT answer_label) > 1"),
    "first_rows": (first_rows, "SELECT record_id, dataset_name FROM vqa_records ORDER BY record_id LIMIT 50"),
    "distinct_values": (distinct_values, "SELECT DISTINCT dataset_name FROM vqa_records ORDER BY 1"),
    "verified_rows": (
        verified_rows,
        f"SELECT mcq_id, CASE WHEN NOT {_ASKED} THEN 'missing_mcq' END AS error, CASE WHEN {_ASKED} THEN 1 END AS items, CASE WHEN {_ASKED} THEN (({_PROMPT_LENGTH}) % 6)::INT END AS score FROM generated_mcq",
    ),
    "generation_prompts": (generation_prompts, f"WITH b AS (SELECT mcq_id, {_BLOCK} AS block FROM generated_mcq) SELECT mcq_id, md5({_generation_sql('ABCDE')}) AS five_md5, md5({_generation_sql('ABCD')}) AS four_md5 FROM b"),
    "normalized_vqa": (
        normalized_vqa,
        "SELECT mcq_id, generated_vqa IS NULL AS none, md5(generated_vqa.question) AS question_md5, md5(concat_ws('|', " + ", ".join(f"coalesce(generated_vqa.options.{x}, '-')" for x in "ABCDE") + ")) AS options_md5, md5(generated_vqa.answer) AS answer_md5 FROM generated_mcq",
    ),
    "first_pictures": (first_pictures, "SELECT record_id, len(images[1:2])::INT AS n, array_to_string(list_transform(images[1:2], lambda x: coalesce(x.path, '-')), ',') AS paths FROM vqa_records"),
    "title_examples": (
        title_examples,
        f"""WITH r AS (SELECT verify_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(rubric_verification.rubric, lambda i: i.title IS NOT NULL AND coalesce(lower({sql_strip('i.category')}) <> 'essential', true)), lambda i: {sql_strip('i.title')}))), '|') AS titles FROM verified_mcq WHERE len(rubric_verification.rubric) > 0),
        k AS (SELECT titles, verify_id FROM r QUALIFY row_number() OVER (PARTITION BY titles ORDER BY verify_id) <= 3) SELECT titles, string_agg(verify_id::VARCHAR, ',' ORDER BY verify_id) AS examples FROM k GROUP BY 1""",
    ),
    "never_seen": (
        never_seen,
        rf"""WITH p AS (SELECT DISTINCT lower(regexp_replace(raw, '{WS}+', '', 'g')) AS k FROM (SELECT unnest(mini_rec.image_secondary_label) AS raw FROM curated_images)), l AS (SELECT secondary_label FROM category_targets UNION ALL SELECT 'no such label')
        SELECT secondary_label FROM l WHERE lower(regexp_replace(secondary_label, '{WS}+', '', 'g')) NOT IN (SELECT k FROM p WHERE k IS NOT NULL)""",
    ),
    "label_whitelist": (
        label_whitelist,
        """WITH l AS (SELECT regexp_replace(lower(secondary_label), '[^a-z0-9]+', '', 'g') AS k, min(secondary_label) AS canonical FROM category_targets GROUP BY 1), x AS (SELECT regexp_replace(lower(unnest(mini_rec.image_secondary_label)), '[^a-z0-9]+', '', 'g') AS k FROM curated_images)
        SELECT canonical, count(*) AS n FROM x LEFT JOIN (SELECT * FROM l WHERE k <> '') l USING (k) GROUP BY 1""",
    ),
    "lost_texts": (lost_texts, f"WITH {_MODEL} SELECT w.mcq_id, md5(g.raw_model_output) AS text_md5 FROM w JOIN generated_mcq g USING (mcq_id) WHERE j IS NULL AND g.raw_model_output IS NOT NULL ORDER BY 1 LIMIT 5"),
    "build_trainset": (
        build_trainset,
        """WITH a AS (SELECT dataset_name, dataset_index, max(record_id) AS record_id FROM vqa_records GROUP BY 1, 2), b AS (SELECT article_accession_id, max(record_id) AS record_id FROM vqa_records GROUP BY 1),
        m AS (SELECT g.mcq_id, coalesce(a.record_id, b.record_id) AS record_id, CASE WHEN a.record_id IS NOT NULL THEN 'first' ELSE 'second' END AS matched_by FROM generated_mcq g LEFT JOIN a USING (dataset_name, dataset_index) LEFT JOIN b USING (article_accession_id) WHERE g.dataset_name IS NOT NULL AND g.dataset_index IS NOT NULL)
        SELECT mcq_id, m.record_id, coalesce(hash, '') AS hash, len(images)::INT AS images, matched_by FROM m JOIN vqa_records r ON r.record_id = m.record_id WHERE len(images) > 0""",
    ),
    "fitted_sizes": (
        fitted_sizes,
        """WITH s AS (SELECT row_id, mini_rec.image_size[1] AS w, mini_rec.image_size[2] AS h FROM curated_images), f AS (SELECT *, greatest(1.0::DOUBLE, 300.0::DOUBLE / least(w, h)) AS k FROM s WHERE w > 0 AND h > 0)
        SELECT row_id, CASE WHEN least(w, h) >= 300 THEN w || 'x' || h END AS drop, greatest(w, 300) || 'x' || greatest(h, 300) AS pad, ceil(round(w * k, 6))::INT || 'x' || ceil(round(h * k, 6))::INT AS resize FROM f""",
    ),
    "loose_grades": (
        loose_grades,
        f"WITH {_GRADED} SELECT record_id, place, coalesce(lower({sql_strip('p')}) IN (lower({sql_strip(chr(34) + 'answer_label' + chr(34) + ' || ' + repr('. ') + ' || answer')}), lower({sql_strip('answer_label')}), lower({sql_strip('answer')})) OR contains(lower(p), lower(answer)), false) AS is_correct FROM said",
    ),
    "type_answers": (type_answers, "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN trim(event_type) ELSE 'Unknown' END AS kind FROM events"),
    "modality_answers": (modality_answers, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ct slice' WHEN 1 THEN 'Other' END AS modality, event_id % 3 = 2 AS parse_error FROM events"),
}
