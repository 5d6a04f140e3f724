"""The queries of the numbered problems; each reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import boilerplate, caps, lookalike, mojibake, packing, residue, subjects, tokens, truncation
from gleanwork.session import table


def _hits_and_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "search_hits"), table(spark, sf_dir, "content_cache")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_cut(*_hits_and_pages(spark, sf_dir)).select("field", "row_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(*_hits_and_pages(spark, sf_dir))


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.storage_limits(*_hits_and_pages(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_damaged(table(spark, sf_dir, "content_cache"), ["content", "title"]).select("field", "content_id")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_damaged(table(spark, sf_dir, "content_cache"), ["content", "title"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf_dir, "search_hits"), ["title", "snippet"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.alike_classes(table(spark, sf_dir, "search_hits"), ["title", "snippet"])


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.uniform(table(spark, sf_dir, "search_hits"), ["title", "snippet"], ["hit_id"]).drop("title", "snippet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.find_furniture(table(spark, sf_dir, "content_cache"))


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_body(table(spark, sf_dir, "content_cache"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.over_cap(table(spark, sf_dir, "json_sources"), table(spark, sf_dir, "source_caps"))


def p5_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "json_sources")
    kept = caps.capped(rows, p5_found(spark, sf_dir))
    return kept.select("run_id", "row_id", caps.url_host(F.col("url")).alias("host"), caps.source_kind(F.col("source_type")).alias("kind"), "score")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "content_cache")).select("content_id")


def p6_clean_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each layer and how many are excluded as residue."""
    pages = table(spark, sf_dir, "content_cache")
    found = residue.find_residue(pages).groupBy("content_id").agg(F.count("*").alias("hits"))
    joined = pages.select("content_id", "layer_used").join(found, "content_id", "left")
    return joined.groupBy("layer_used").agg(F.count("*").alias("pages"), F.count("hits").alias("excluded"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def _windows(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    # the windows' table has a row for each prompt window, set by hand
    return [(r[0], r[1]) for r in table(spark, sf_dir, "context_windows").select("window_name", "capacity_tokens").collect()]


def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf_dir, "documents")), _windows(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_windows(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p9_found(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_rates, p1_limits, p2_found, p2_restored, p3_found, p3_classes, p3_forms, p4_found, p4_bodies, p5_found, p5_capped, p6_found, p6_clean_share, p7_ids, p8_windows, p8_fill, p9_found, p9_composition)
    return {f.__name__: f for f in found}
