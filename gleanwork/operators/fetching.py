"""Fetch attempts along an ordered chain of layers, and the quality of what they brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import texts
from gleanwork.operators.articles import article
from gleanwork.operators.ranking import percentiles
from gleanwork.values import NOISE

def status_error(status: Column) -> Column:
    """Class of an HTTP status: null for 2xx, blocked, not_found, transport or unknown."""
    return (
        F.when(status.between(200, 299), F.lit(None).cast("string"))
        .when(status.isin(401, 403, 429), "blocked").when(status.isin(404, 410), "not_found").when(status.between(500, 599), "transport").otherwise("unknown")
    )


def transport_error(timed_out: Column, canceled: Column) -> Column:
    """Class of a failed connection: timeout, canceled or transport; null flags count as false."""
    return F.when(F.coalesce(timed_out, F.lit(False)), "timeout").when(F.coalesce(canceled, F.lit(False)), "canceled").otherwise("transport")


def body_complete(encoding: Column, ended_early: Column, received: Column, announced: Column, most: Column) -> Column:
    """Whether a response body may be used: it ended as it should, or it is sent as it is and too little was announced to tell.

    A body that ended early is complete only without a content encoding, and if no length was announced (negative or
    null), or the bytes received reach the announced length or the most that is read.
    """
    plain = F.lower(F.trim(F.coalesce(encoding, F.lit("")))).isin("", "identity")
    enough = (F.coalesce(announced, F.lit(-1)) < 0) | (received >= announced) | F.coalesce(received >= most, F.lit(False))
    return ~F.coalesce(ended_early, F.lit(False)) | (plain & F.coalesce(enough, F.lit(False)))


def first_success(attempts: DataFrame) -> DataFrame:
    """(url, layer, layer_order, content_type, latency_ms, errors) of each url: the enabled layer that won.

    Of several wins the lowest layer_order counts, then the lowest attempt_id. errors lists the failed layers before
    the winner in order (all failed ones if none won, with null winner columns). Disabled attempts don't count.
    """
    tried = attempts.where("enabled")
    won = F.min(F.when(F.col("ok"), F.struct("layer_order", "attempt_id", "layer", "content_type", "latency_ms"))).alias("w")
    # a url has as many distinct failures as layers times error kinds
    failed = F.collect_set(F.when(~F.col("ok"), F.struct("layer_order", "layer", "err_kind"))).alias("f")
    by = tried.groupBy("url").agg(won, failed)
    before = F.filter(F.array_sort("f"), lambda x: F.col("w").isNull() | (x["layer_order"] < F.col("w.layer_order")))
    named = F.transform(before, lambda x: F.concat(x["layer"], F.lit(":"), F.coalesce(x["err_kind"], F.lit("unknown"))))
    return by.select("url", "w.layer", "w.layer_order", "w.content_type", "w.latency_ms", F.array_join(named, ", ").alias("errors"))


def layer_report(attempts: DataFrame) -> DataFrame:
    """(layer, tries, wins, mean_ms, p50_ms, p95_ms) of enabled attempts; negative latencies are no latencies.

    Means are whole milliseconds rounded down; percentiles are nearest-rank.
    """
    ms = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    rows = attempts.where("enabled").select("layer", "ok", ms.alias("ms"))
    sums = rows.groupBy("layer").agg(F.count("*").alias("tries"), F.count_if("ok").alias("wins"), F.floor(F.sum("ms") / F.count("ms")).alias("mean_ms"))
    ranks = percentiles(rows, ["layer"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95}, 1).withColumnRenamed("layer", "_l")
    return sums.join(ranks, F.col("layer").eqNullSafe(F.col("_l")), "left").drop("_l")


def success_report(fetched: DataFrame, by: str) -> DataFrame:
    """(by, urls, fetched, rate, mean_ms): successes of urls by a column, and the mean latency of those fetched, rounded down.

    fetched: (by, won BOOLEAN, latency_ms); latencies that are null or negative don't count; of nothing the rate is 0.
    """
    ms = F.when(F.col("won") & (F.col("latency_ms") >= 0), F.col("latency_ms"))
    sums = fetched.groupBy(by).agg(F.count("*").alias("urls"), F.count_if("won").alias("fetched"), F.coalesce(F.floor(F.avg(ms)), F.lit(0)).alias("mean_ms"))
    return sums.withColumn("rate", F.round(texts.percent(F.col("fetched"), F.col("urls")), 1))


def quality(pages: DataFrame) -> DataFrame:
    """pages with title_found, noise_found (names), tag_count, encoding_ok, paragraph_count, content_bytes."""
    c = F.coalesce("content", F.lit(""))
    names = F.filter(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in NOISE.items())), lambda x: x.isNotNull())
    return pages.withColumns({
        "title_found": F.coalesce(F.trim("title"), F.lit("")) != "", "noise_found": F.array_join(names, ", "), "tag_count": texts.tag_count(c), "encoding_ok": ~F.contains(c, F.lit("�")) & F.is_valid_utf8(c),
        "paragraph_count": F.size(texts.paragraphs(c)), "content_bytes": F.octet_length(c),
    })


def cleaned(pages: DataFrame, least_bytes: int = 200, most_chars: int = 20_000) -> DataFrame:
    """(content_id, title, text, error): each page read as text, without noise lines and runs of newlines.

    A null or empty title is taken from a first heading. Texts under least_bytes have the error `too short` and no
    text, longer ones than most_chars are cut at a word with a note.
    """
    body = F.trim(texts.strip_line_ends(texts.collapse_newlines(texts.drop_noise(F.coalesce("content", F.lit(""))))))
    return _finished(pages.select("content_id", "title", body.alias("body")), texts.markdown_title(F.col("body")), least_bytes, most_chars)


def _finished(rows: DataFrame, title, least_bytes: int, most_chars: int) -> DataFrame:
    size = F.octet_length("body")
    error = F.when(size == 0, "empty").when(size < least_bytes, "too short")
    return rows.select("content_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(title, F.lit(""))).alias("title"), F.when(error.isNull(), texts.cut_to(F.col("body"), most_chars)).alias("text"), error.alias("error"))


def extracted(pages: DataFrame, least_bytes: int = 200, most_chars: int = 20_000) -> DataFrame:
    """(content_id, title, text, error) of each page by its media type.

    Of HTML the main text without elements that are no article (articles.article) and without noise lines, and the
    page's title; of Markdown the text without blanks at line ends, and its first heading; anything else as it is. Runs of
    newlines become one. A title that is there stays. An empty text has the error `empty`, one under least_bytes `too
    short`, both no text; longer ones than most_chars are cut at a word with a note. Null content is empty.
    """
    kind = texts.media_type(F.coalesce("content_type", F.lit("")))
    rows = pages.select("content_id", "title", F.coalesce("content", F.lit("")).alias("content"), F.when(F.contains(kind, F.lit("text/html")), "html").when(F.contains(kind, F.lit("text/markdown")), "markdown").otherwise("text").alias("kind"))
    read = rows.withColumn("_a", article(F.when(F.col("kind") == "html", F.col("content"))))  # only HTML is sent to Python
    body = F.when(F.col("kind") == "html", texts.drop_noise(F.col("_a.text"))).when(F.col("kind") == "markdown", texts.strip_line_ends(texts.collapse_newlines(F.col("content")))).otherwise(F.col("content"))
    title = F.when(F.col("kind") == "html", F.col("_a.title")).when(F.col("kind") == "markdown", texts.markdown_title(F.col("content")))
    bare = F.regexp_replace(texts.collapse_newlines(body), r"^\s+|\s+$", "")
    return _finished(read.select("content_id", "title", bare.alias("body"), title.alias("_title")), F.col("_title"), least_bytes, most_chars)
