"""Search hits: fan-out of planned queries, deduplication, scoring and selection, for many questions per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import texts, urls
from gleanwork.operators.ranking import packed, unpacked
from gleanwork.values import DEFAULT_AUTHORITY, DOCS_AUTHORITY, HIT_WEIGHTS, SNIPPET_STEPS


def enabled(modules: DataFrame, names: list[str] | None) -> DataFrame:
    """The modules that are switched on: those named, or all if no name is given."""
    return modules.where(F.col("name").isin(names)) if names else modules


def collected(parsed: dict[str, DataFrame], modules: DataFrame) -> DataFrame:
    """All modules' hits in one table, each with the module, its source type and the task that brought it.

    parsed: (task_id, pos, title, url, snippet) by module; a module without a manifest has no source type. modules: a few rows.
    """
    columns = ["task_id", "pos", "title", "url", "snippet"]
    out = None
    for name, df in parsed.items():
        df = df.select(F.col("task_id").cast("string").alias("task_id"), F.col("pos").cast("long").alias("pos"), *columns[2:], F.lit(name).alias("module"))
        out = df if out is None else out.unionByName(df)
    return out.join(F.broadcast(modules.select(F.col("name").alias("_n"), "source_type")), F.col("module") == F.col("_n"), "left").drop("_n")


def previews(hits: DataFrame, most: int = 3, group: str = "question_id", order: tuple[str, ...] = ("pos", "hit_id")) -> DataFrame:
    """The first `most` hits of each group by order, as results are shown; Spark's group limit drops the rest before the shuffle."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return hits.withColumn("n", n).where(F.col("n") <= most)


def search_tasks(plans: DataFrame, modules: DataFrame) -> DataFrame:
    """(question_id, name, source_type, query): each planned query goes to each module of its source type.

    plans: (question_id, queries MAP<source type, ARRAY<query>>); empty queries and types without a module
    give no task, null maps none either.
    """
    asked = plans.select("question_id", F.explode("queries").alias("source_type", "queries")).select("question_id", "source_type", F.explode("queries").alias("query"))
    return asked.where("query <> ''").join(modules.select("name", "source_type"), "source_type").select("question_id", "name", "source_type", "query")


def well_formed(hits: DataFrame) -> DataFrame:
    """Hits with a title and a url."""
    return hits.where("title <> '' AND url <> ''")


def keep_first(hits: DataFrame, key: Column, order: list[str], group: str = "question_id") -> DataFrame:
    """Of each group and key the row that comes first by order, with all its columns; null groups are a group.

    Only group, key and order, at most two columns of whole numbers that aren't negative and of which the last is
    unique, are aggregated, with combining before the shuffle; the rows kept are then looked up by id. Null is last.
    """
    first = hits.select(F.col(group).alias("_g"), key.alias("_k"), packed(order, (1 << 63) - 1).alias("_r")).groupBy("_g", "_k").agg(F.min("_r").alias("_r"))
    kept = first.select(unpacked(F.col("_r")).alias("_id"))
    id_col = order[-1]
    return hits.join(kept, F.col(id_col) == F.col("_id"), "left_semi")


def previous(rows: DataFrame, key: Column, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Rows that repeat the key of an earlier one (in their group), with `first`, the order columns of the first such row as a struct.

    Combined before the shuffle; the first of each key is joined back to its repeats.
    """
    group = group or []
    keyed = rows.withColumns({"_k": key, "_o": F.struct(*order)})
    first = keyed.where("_k IS NOT NULL").groupBy(*group, "_k").agg(F.min("_o").alias("first"))
    names = {g: f"_g_{g}" for g in group}
    first = first.withColumnsRenamed({**names, "_k": "_fk"})
    on = F.col("_k") == F.col("_fk")
    for g, n in names.items():
        on = on & F.col(g).eqNullSafe(F.col(n))
    return keyed.join(first, on).where("first <> _o").drop("_k", "_o", "_fk", *names.values())


def deduplicated(hits: DataFrame) -> DataFrame:
    """Hits of distinct pages of each question; the first to arrive (pos, hit_id) stays, with its url as it was."""
    return keep_first(hits, urls.url_key(F.col("url")), ["pos", "hit_id"])


def with_authority(hits: DataFrame, scores: dict[str, float], url_col: str = "url") -> DataFrame:
    """hits with `authority`: the score of the longest configured domain that the host is or ends with.

    scores: domains in lower case, a list set by hand. A host without one has DOCS_AUTHORITY if it starts with docs.,
    else DEFAULT_AUTHORITY. A projection: nothing is shuffled.
    """
    host = F.coalesce(urls.url_authority(F.col(url_col)), F.lit(""))
    return hits.withColumn("authority", urls.domain_score(host, scores, DEFAULT_AUTHORITY, DOCS_AUTHORITY))


def scored(hits: DataFrame, questions: DataFrame, scores: dict[str, float]) -> DataFrame:
    """hits with `score`: weighted authority, keyword overlap with the question's text, and snippet length.

    A hit without a question in questions has no tokens to match. The score isn't clamped, but
    rounded to 9 places, so that ties don't hang on the order of a sum.
    """
    asked = questions.select(F.col("question_id").alias("_q"), texts.tokens(F.col("query")).alias("_tokens"))
    h = with_authority(hits, scores).join(asked, F.col("question_id") == F.col("_q"), "left")
    overlap = texts.keyword_overlap(F.coalesce("_tokens", F.array().cast("array<string>")), F.col("title"), F.col("snippet"))
    score = HIT_WEIGHTS["domain"] * F.col("authority") + HIT_WEIGHTS["keyword"] * overlap + HIT_WEIGHTS["snippet"] * texts.snippet_score(F.col("snippet"), SNIPPET_STEPS)
    return h.withColumn("score", F.round(score, 9)).drop("_q", "_tokens")


def selected(hits: DataFrame, per_type: int = 10, total: int = 25) -> DataFrame:
    """Of each question at most total hits with `source_no` from 1: first the best per_type of each source type, then the
    best of the rest, in the order of score; ties by pos, then hit_id.

    A row beyond total within its type can't be chosen, so both ranks run over few rows (group limits apply
    before the shuffle).
    """
    by = [F.desc("score"), "pos", "hit_id"]
    typed = hits.withColumn("_t", F.row_number().over(Window.partitionBy("question_id", "source_type").orderBy(*by))).where(F.col("_t") <= total)
    first = F.when(F.col("_t") <= per_type, 0).otherwise(1)
    chosen = typed.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy(first, *by))).where(F.col("_n") <= total)
    return chosen.withColumn("source_no", F.row_number().over(Window.partitionBy("question_id").orderBy(*by))).drop("_t", "_n")
