"""Queries of the training-data problems, registered by ``__spark_entry__`` where this subpackage is present."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import p1_overlap, p2_edits, p3_quota, p4_cutoffs, p5_neighbours, p6_defects, p7_tokens, p8_leaks, p9_residue
from curatrix.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *names: str, **fixed) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return operator(*(table(spark, folder, n) for n in names), **fixed)

    return query


def _p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_overlap.cross_split_pairs(table(spark, folder, "vqa_records")).select("record_a", "record_b")


def _p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_cutoffs.kept_records(table(spark, folder, "verified_mcq"), table(spark, folder, "keep_targets")).select("verify_id")


def _p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items")).select("doc_id", "item_id")


def _p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_residue.residue(table(spark, folder, "documents")).select("doc_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_report": _over(p1_overlap.overlap_report, "vqa_records"),
        "p2_found": _over(p2_edits.edited_pairs, "vqa_records"),
        "p2_groups": _over(p2_edits.edited_groups, "vqa_records"),
        "p3_found": _over(p3_quota.short_categories, "curated_images", "category_targets"),
        "p3_report": _over(p3_quota.quota_report, "curated_images", "category_targets"),
        "p3_sample": _over(p3_quota.quota_sample, "curated_images", "category_targets"),
        "p4_found": _p4_found,
        "p4_cutoffs": _over(p4_cutoffs.cutoffs, "verified_mcq", "keep_targets"),
        "p5_found": _over(p5_neighbours.neighbour_pairs, "record_vectors"),
        "p5_recall": _over(p5_neighbours.recall, "record_vectors"),
        "p6_found": _over(p6_defects.defective_pairs, "generated_mcq"),
        "p6_counts": _over(p6_defects.defect_counts, "generated_mcq"),
        "p7_ids": _over(p7_tokens.token_ids, "documents"),
        "p8_found": _p8_found,
        "p9_found": _p9_found,
        "p9_validation": _over(p9_residue.validation, "documents"),
        "p8_items": _over(p8_leaks.leaked_items, "documents", "benchmark_items"),
    }
