"""Records for training and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.records import INSTRUCTION, chat_prompt, options_map, prompt_text, response_text, with_bytes
from curatrix.functions.text import strip


def rl_records(df: DataFrame, source: str, split: str, ability: str = "medical_mcq", index: str = "record_id") -> DataFrame:
    """Prompt, reward and extra information of a reinforcement-learning record; rows whose options are no JSON object are
    left out. The rule's ground truth is the answer text."""
    options = options_map(F.col("options"))
    text = prompt_text(F.col("question"), options, INSTRUCTION)
    marks = F.repeat(F.lit("<image>"), F.size(F.coalesce("images", F.array().cast("array<struct<bytes:binary,path:string>>"))))
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.concat(marks, text).alias("content")))
    extra = F.struct(F.lit(split).alias("split"), F.col(index).alias("index"), "question", "options", "answer_label", "answer", "dataset_name", "dataset_index")
    return df.where(options.isNotNull()).select(
        F.lit(source).alias("data_source"), prompt.alias("prompt"), "images", F.lit(ability).alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"), extra.alias("extra_info")
    )


def sft_records(df: DataFrame) -> DataFrame:
    """Adds prompt and response to rows with reasoning; options in A to E order, others after them."""
    options = options_map(F.col("options"))
    lettered = F.map_from_entries(F.array_sort(F.map_entries(options)))
    usable = options.isNotNull() & (strip(F.col("reasoning")) != "")
    return df.where(usable).select("*", prompt_text(F.col("question"), lettered, INSTRUCTION).alias("prompt"), response_text(F.col("reasoning"), F.col("answer_label")).alias("response"))


def eval_prompts(df: DataFrame, style: str = "plain") -> DataFrame:
    """(record_id, prompts): evaluation prompts in a model family's layout."""
    options = options_map(F.col("options"))
    return df.where(options.isNotNull()).select("record_id", chat_prompt(prompt_text(F.col("question"), options), F.size(with_bytes(F.col("images"))), style).alias("prompts"))


def standard(df: DataFrame) -> DataFrame:
    """Images as a list of bytes, unreadable ones dropped; blank reasoning becomes null."""
    return df.withColumn("images", F.transform(with_bytes(F.col("images")), lambda x: x["bytes"])).withColumn("reasoning", F.nullif(strip(F.col("reasoning")), F.lit("")))


def normalised_bytes(df: DataFrame, most: int | None = None) -> DataFrame:
    """At most ``most`` images, each with bytes and no path; rows without any are dropped; options and misc are JSON."""
    kept = with_bytes(F.col("images"))
    kept = F.slice(kept, 1, most) if most else kept
    images = F.transform(kept, lambda x: F.struct(x["bytes"].alias("bytes"), F.lit(None).cast("string").alias("path")))
    json_or: Column = F.when(F.try_parse_json("options").isNotNull(), F.col("options")).otherwise("{}")
    return df.where(F.size(kept) > 0).withColumn("images", images).withColumn("options", json_or).withColumn("hash", F.coalesce("hash", F.lit("")))
