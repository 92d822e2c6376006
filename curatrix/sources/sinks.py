"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.operators.balance import shards


def parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite", dictionary: bool = True, block_bytes: int | None = None) -> None:
    """Parquet with a codec (zstd, snappy, gzip, brotli, none), dictionaries on or off, and a size of row groups."""
    writer = df.write.mode(mode).option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower())
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).parquet(path)


def one_parquet(df: DataFrame, path: str, schema: str) -> None:
    """A single file of an exact schema, nested types included; for small results only, since one task writes it."""
    typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields))
    typed.coalesce(1).write.mode("overwrite").parquet(path)


def sharded(df: DataFrame, path: str, order: str, rows: int, compression: str = "zstd") -> None:
    """Contiguous row ranges of a fixed size, one folder ``shard=N`` each."""
    numbered = shards(df, order, rows).drop("ordinal")
    numbered.repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").option("compression", compression).partitionBy("shard").parquet(path)


def per_source(df: DataFrame, path: str, source: str = "source_file") -> None:
    """One folder for each input file."""
    df.withColumn("source", F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")).write.mode("overwrite").partitionBy("source").parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary(df: DataFrame) -> DataFrame:
    """The one row of a report as JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("summary"))


def provenance(df: DataFrame, path: str, arguments: dict) -> None:
    """The arguments of a run beside its output."""
    df.sparkSession.createDataFrame([(json.dumps(arguments, sort_keys=True),)], "arguments string").coalesce(1).write.mode("overwrite").text(path)


def examples(pairs: DataFrame, left: DataFrame, right: DataFrame, query: str, match: str, score: str, key: str, k: int = 10) -> DataFrame:
    """The ``k`` best pairs with the rows of both sides as structs."""
    best = pairs.orderBy(F.desc(score), query, match).limit(k)
    a = left.select(F.col(key).alias(query), F.struct("*").alias("query_row"))
    b = right.select(F.col(key).alias(match), F.struct("*").alias("match_row"))
    return a.join(F.broadcast(best), query).join(b, match)


def concatenated(spark: SparkSession, folder: str, pattern: str = "dp_*.jsonl") -> DataFrame:
    """(source_file, line): the lines of a run's shards, by name of the shard and position in it."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    return lines.select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")).orderBy("source_file", "_path", "_at", "_id").select("source_file", "line")
