"""From questions to results: the variants of the whole path, for all questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.operators import answers, hits

#: Columns of a query set that hold its answer key.
KEY_COLUMNS = ["canonical_answer", "must_contain_domains", "must_contain_terms", "forbidden_domains", "expected_source_types"]


def blind(queries: DataFrame) -> DataFrame:
    """A query set without its answer key, as the path from question to answer may see it."""
    return queries.drop(*KEY_COLUMNS)


def found_hits(found: DataFrame) -> DataFrame:
    """Well-formed hits of distinct pages of each question; hits without a question are left out."""
    return hits.deduplicated(hits.well_formed(found.where("question_id IS NOT NULL")))


def baseline(found: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, source_no, hit_id, source_type, url, title, score): the first `most` hits as they came, unscored."""
    return hits.previews(found_hits(found), most).select("question_id", F.col("n").alias("source_no"), "hit_id", "source_type", "url", "title", F.lit(None).cast("double").alias("score"))


def selected_sources(questions: DataFrame, found: DataFrame, scores: dict[str, float], per_type: int = 10, total: int = 25) -> DataFrame:
    """As baseline: hits scored against their question and selected evenly over source types."""
    chosen = hits.selected(hits.scored(found_hits(found), questions, scores), per_type, total)
    return chosen.select("question_id", "source_no", "hit_id", "source_type", "url", "title", "score")


def results(sources: DataFrame, pages: DataFrame, variant: str) -> DataFrame:
    """(question_id, variant, sources, fetched, prompt): what a variant brings for each question, prompt null without a fetched source.

    sources: as of baseline or selected_sources; pages: (url, content), a url once.
    """
    held = answers.with_content(sources, pages)
    counts = held.groupBy("question_id").agg(F.count("*").alias("sources"), F.count("content").alias("fetched"))
    asked = held.withColumnsRenamed({"source_no": "id", "hit_id": "row_id"})
    prompts = answers.prompts(asked, "question_id").select(F.col("question_id").alias("_q"), "prompt")
    joined = counts.join(prompts, F.col("question_id") == F.col("_q"), "left")
    return joined.select("question_id", F.lit(variant).alias("variant"), "sources", "fetched", "prompt")
