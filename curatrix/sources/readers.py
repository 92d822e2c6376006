"""Readers: JSON lines, Parquet with missing columns, archives of records, path lists."""

from __future__ import annotations

import json
import re
import tarfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.records import as_list, context_lookup, image_of_set, locator, picture_member
from curatrix.functions.text import caption_or_null

RECORD_ID = "image_cluster_id"


def path_list(spec: str) -> list[str]:
    """Paths of a comma-separated list of files, folders and patterns, each once, in order."""
    return list(dict.fromkeys(p.strip() for p in spec.split(",") if p.strip()))


def json_lines(spark: SparkSession, spec: str, recursive: bool = True, glob: str = "*.jsonl") -> DataFrame:
    """(source_file, ordinal, line, value): lines that parse as JSON, with a position that orders them within their file.

    Blank and broken lines are left out. ``ordinal`` grows with the position in the file; lines of one file keep their
    order by it. ``value`` is a VARIANT.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    paths = path_list(spec)
    if any(not p.endswith((".jsonl", ".json")) and not set("*?[") & set(p) for p in paths):
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    parsed = lines.withColumn("value", F.try_parse_json("line")).where("value is not null")
    return parsed.select("source_file", F.struct("_at", "_id").alias("ordinal"), "line", "value")


def one_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``json_lines`` of a single file; an error if the path is no file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isFile():
        raise FileNotFoundError(path)
    return json_lines(spark, path)


def numbered(lines: DataFrame) -> DataFrame:
    """``json_lines`` with ``line_no``, the position from 1 among the kept lines of a file. Blocks of a file are counted, and
    lines numbered within their block, so that no task sees a whole large file."""
    placed = lines.withColumn("_at", F.col("ordinal._at"))
    counts = placed.groupBy("source_file", "_at").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("source_file").orderBy("_at")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("source_file", "_at").orderBy("ordinal._id"))
    return placed.withColumn("_own", own).join(before, ["source_file", "_at"]).withColumn("line_no", F.col("_own") + F.col("_before")).drop("_at", "_own", "_before")


def json_records(spark: SparkSession, spec: str, schema: str, **options) -> DataFrame:
    """JSON lines read into columns of a given schema; keys that are absent are null."""
    lines = json_lines(spark, spec, **options)
    return lines.select("source_file", "ordinal", F.from_json("line", schema).alias("r")).select("source_file", "ordinal", "r.*")


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def reader_for(first_path: str) -> str:
    """Kind of the files, from the ending of the first one."""
    return "parquet" if first_path.lower().endswith((".parquet", ".pq")) else "json"


def read_any(spark: SparkSession, spec: str) -> DataFrame:
    paths = path_list(spec)
    return spark.read.parquet(*paths) if reader_for(paths[0]) == "parquet" else spark.read.json(paths)


def parquet_filled(spark: SparkSession, spec: str, defaults: dict[str, Column]) -> DataFrame:
    """Exactly the wanted columns of Parquet files of differing schemas; a column that none has takes its default, and
    nulls of the others do too. Only wanted columns are read."""
    df = spark.read.option("mergeSchema", True).parquet(*path_list(spec))
    return df.select(*((F.coalesce(F.col(c), d) if c in df.columns else d).alias(c) for c, d in defaults.items()))


def index_number(c: Column) -> Column:
    """A record number; what is no number becomes -1."""
    return F.coalesce(c.cast("string").try_cast("long"), F.lit(-1).cast("long"))


def stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct().collect()
    return tuple(sorted(r["w"] for r in rows))


def result_files(spark: SparkSession, folder: str, schema: str, name: str = "regraded_eval_results.jsonl") -> DataFrame:
    """Records of all result files below a folder; the model is the folder a file lies in."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(folder)
    return rows.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("model"))


_MEMBER = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("picture", T.StringType()), T.StructField("record", T.StringType())])


def _opened(path: str):
    """A stream of a file of a mounted folder, or of a file system that pyarrow knows."""
    if "://" not in path or path.startswith("file:"):
        return open(unquote(urlparse(path).path) if path.startswith("file:") else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _archive_paths(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths only: the content of the files is not read by the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path")


def archives(spark: SparkSession, folder: str, glob: str = "*.tar") -> DataFrame:
    """(archive, member, picture, record): the JSON members of archives, by name, with the picture of the same stem.

    Members that are no JSON object or have no record id are left out; an archive that cannot be read gives nothing.
    Each archive is opened once, from its path, and read member by member, so its size does not matter.
    """
    paths = _archive_paths(spark, folder, glob)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(_read_archive(path), columns=["archive", "member", "picture", "record"])

    return paths.repartition(max(1, paths.count())).mapInPandas(members, _MEMBER)


def _read_archive(path: str) -> list[tuple]:
    rows = []
    try:
        with _opened(path) as stream, tarfile.open(fileobj=stream) as tar:
            names = {m.name: m for m in tar.getmembers() if m.isfile()}
            for name in sorted(n for n in names if n.endswith(".json")):
                try:
                    record = json.loads(tar.extractfile(names[name]).read())
                except ValueError:
                    continue
                if isinstance(record, dict) and record.get(RECORD_ID):
                    picture = name[: -len(".json")] + ".jpg"
                    rows.append((path, name, picture if picture in names else None, json.dumps(record, ensure_ascii=False)))
    except (tarfile.TarError, OSError, EOFError):
        return []
    return rows


def curated(members: DataFrame, base: str) -> DataFrame:
    """The curated fields of archive members: a record's labels, size and own caption (of the element of its image set that
    is itself), its own contexts (each once), and where its picture lies below ``base``."""
    shape = (
        f"{RECORD_ID} string, article_accession_id string, pmid string, article_title string, image_file_name string, image_panel_type string, image_panel_subtype string, "
        "image_primary_label array<string>, image_secondary_label array<string>, image_size array<int>, image_set array<struct<image_id:string,caption:string>>, image_context map<string,array<string>>"
    )
    r = members.select("archive", "picture", "member", F.from_json("record", shape).alias("r"))
    key = F.col(f"r.{RECORD_ID}")
    tar = F.regexp_replace(F.replace(F.regexp_replace("archive", "^file:/+", "/"), F.lit(re.sub("^file:/+", "/", base.rstrip("/"))), F.lit("")), "^/+", "")
    picture = picture_member(F.col("member"))
    labels = lambda c: F.filter(as_list(F.col(f"r.{c}")), lambda x: x != "")
    some = lambda c: F.nullif(F.col(f"r.{c}"), F.lit(""))
    return r.select(
        key.alias("image_id"), F.coalesce(some("article_accession_id"), some("pmid"), F.lit("")).alias("article_accession_id"), F.coalesce("r.article_title", F.lit("")).alias("article_title"),
        "r.image_file_name", "r.image_panel_type", "r.image_panel_subtype", labels("image_primary_label").alias("image_primary_label"), labels("image_secondary_label").alias("image_secondary_label"), "r.image_size",
        caption_or_null(image_of_set(F.col("r.image_set"), key)["caption"]).alias("caption"), context_lookup(F.col("r.image_context"), key).alias("context"), tar.alias("image_wds_tar"), picture.alias("image_wds_member"),
        locator(tar, picture, F.lit(None)).alias("image_wds_path"),
    )


def archive_pictures(spark: SparkSession, folder: str, wanted: DataFrame, glob: str = "*.tar") -> DataFrame:
    """(archive, member, bytes) of wanted (archive, member) pairs. Pairs are grouped by archive, which is opened once, from its
    path; no more than names is shuffled."""
    known = _archive_paths(spark, folder, glob).withColumnRenamed("path", "archive")
    grouped = wanted.groupBy("archive").agg(F.collect_set("member").alias("members")).join(known, "archive", "left_semi")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, members in zip(batch["archive"], batch["members"]):
                try:
                    with _opened(archive) as stream, tarfile.open(fileobj=stream) as tar:
                        for m in sorted(members):
                            try:
                                yield pd.DataFrame([(archive, m, tar.extractfile(m).read())], columns=["archive", "member", "bytes"])
                            except (KeyError, AttributeError):
                                continue
                except (tarfile.TarError, OSError, EOFError):
                    continue

    return grouped.mapInPandas(fetch, "archive string, member string, bytes binary")
