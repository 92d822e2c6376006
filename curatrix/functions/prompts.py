"""Prompts of the model steps and the rows made from their outputs. No model is run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.parsing import canonical_label, loose_json, model_json
from curatrix.functions.records import caption_block, filled
from curatrix.functions.text import strip

RUBRIC = "array<struct<idx:int,title:string,description:string,category:string,weight:int,score:int,notes:string>>"

GENERATE = """Write one multiple-choice question about the pictures below, for a reader who sees the pictures but not these captions.
The question must need the pictures, name no answer, and have {count} options ({letters}) of one kind, exactly one of them right.

Captions:
{captions}
{contexts}
Answer with one JSON object: {"question": "...", "options": {{options}}, "answer": "one letter"}."""

VERIFY = """Judge the question below by a rubric of essential items, bonus items and pitfalls. For each item give its title, a description,
its category, its weight and the score it earns, at most its weight; a pitfall earns nothing or less.

Public caption:
{caption}

Question: {question}
{options}
Answer: {answer}

Answer with one JSON object: {"rubric": [{"idx": 1, "title": "...", "description": "...", "category": "...", "weight": 0, "score": 0, "notes": "..."}]}."""


def generation(captions: Column, contexts: Column | None = None, letters: str = "ABCDE") -> Column:
    """Prompt that asks for a question of as many options as there are letters; without contexts only captions are given."""
    options = "{" + ", ".join(f'"{x}": "..."' for x in letters) + "}"
    given = F.lit("") if contexts is None else F.concat(F.lit("\nContexts:\n"), caption_block(contexts), F.lit("\n"))
    return filled(GENERATE.replace("{{options}}", options).replace("{count}", str(len(letters))).replace("{letters}", ", ".join(letters)), captions=caption_block(captions), contexts=given)


def verification(vqa: Column, captions: Column) -> Column:
    """Prompt that asks for a rubric of a pair; of the captions the first is shown."""
    lines = F.concat_ws("\n", *(F.concat(F.lit(f"{x}. "), vqa["options"][x]) for x in "ABCDE"))
    return filled(VERIFY, caption=F.coalesce(F.nullif(strip(F.get(captions, F.lit(0))), F.lit("")), F.lit("N/A")), question=vqa["question"], options=lines, answer=vqa["answer"])


def verification_rows(rows: DataFrame, done: DataFrame, key: str = "mcq_id", output: str = "raw_model_output") -> DataFrame:
    """(key, error, rubric): the rubric of an output; ``missing_mcq`` for rows that were not asked, ``parse_error`` for
    outputs without one."""
    read = done.select(key, F.lit(True).alias("_asked"), F.from_json(model_json(F.col(output)), f"rubric {RUBRIC}")["rubric"].alias("rubric"))
    error = F.when(F.col("_asked").isNull(), "missing_mcq").when(F.col("rubric").isNull(), "parse_error")
    return rows.join(read, key, "left").select(key, error.alias("error"), "rubric")


def type_answer(c: Column) -> Column:
    """The type an output names: stripped, else ``Unknown``."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("Unknown"))


def modality_answer(c: Column, allowed: tuple[str, ...], other: str = "Other") -> Column:
    """struct<modality, anatomy, parse_error> of an output; a modality off the list is ``other``."""
    j = loose_json(c)
    named = strip(F.get_json_object(j, "$.modality"))
    return F.struct(F.when(j.isNotNull(), F.coalesce(canonical_label(named, allowed), F.lit(other))).alias("modality"), F.get_json_object(j, "$.anatomy").alias("anatomy"), j.isNull().alias("parse_error"))
