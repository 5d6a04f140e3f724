"""The page cache as a keyed table: expiry rules, lookup, upsert and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.ranking import oldest, packed, unpacked
from gleanwork.values import TTL_DAYS

DAY = 86_400
DEFAULT_TTL = 3 * DAY
TTL_RULES = [(part, days * DAY) for part, days in TTL_DAYS]


def ttl_for(url: Column, rules: list[tuple[str, int]] = TTL_RULES, default: int = DEFAULT_TTL) -> Column:
    """Seconds of the first rule whose text the url's host and path contain in lower case, else default."""
    place = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", ""))
    out = F.lit(default)
    for part, seconds in reversed(rules):
        out = F.when(F.contains(place, F.lit(part)), F.lit(seconds)).otherwise(out)
    return out


def latest(rows: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "content_id")) -> DataFrame:
    """Of each key the row put last by order, with all columns: an upsert of all puts.

    Only key and order, not negative whole numbers of which the last is unique, are aggregated; contents are not. Null is first.
    """
    last = rows.select(F.col(key).alias("_k"), packed(order, 0).alias("_r")).groupBy("_k").agg(F.max("_r").alias("_r"))
    kept = last.select(unpacked(F.col("_r")).alias("_id"))
    return rows.join(kept, F.col(order[-1]) == F.col("_id"), "left_semi")


def upserted(stored: DataFrame, put: DataFrame) -> DataFrame:
    """stored with put on top: of each url the row put last."""
    return latest(stored.unionByName(put))


def looked_up(requests: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """requests with the columns of the live cache row of their raw url, null if there is none, and `from_cache`.

    A row lives while fetched_at + ttl_seconds > now. cache must hold a url once.
    """
    live = cache.where(F.col("fetched_at") + F.col("ttl_seconds") > now).select(F.col("url").alias("_url"), *(c for c in cache.columns if c != "url" and c not in requests.columns))
    joined = requests.join(live, F.col("url") == F.col("_url"), "left")
    return joined.withColumn("from_cache", F.col("_url").isNotNull()).drop("_url")


def coalesced(requests: DataFrame, cache: DataFrame, fetched: DataFrame, now: int, rules: list[tuple[str, int]] = TTL_RULES) -> tuple[DataFrame, DataFrame]:
    """(results, puts) of urls asked: live cache rows, else what was fetched, and what goes into the cache.

    requests: (url), distinct; cache: (url, content, content_type, layer_used, fetched_at, ttl_seconds), a url once; fetched: (url,
    content, content_type, layer_used), a url once, null content where all layers failed. results has from_cache and
    null content where neither has the url; only fetched contents of urls that missed are put, with the ttl of their url.
    """
    found = looked_up(requests.select("url"), cache, now)
    columns = ["content", "content_type", "layer_used"]
    new = fetched.where("content IS NOT NULL").select(F.col("url").alias("_f"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = found.join(new, (F.col("url") == F.col("_f")) & ~F.col("from_cache"), "left")
    results = joined.select("url", *(F.when(F.col("from_cache"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in columns), "from_cache")
    put = results.where("NOT from_cache AND content IS NOT NULL").drop("from_cache")
    return results, put.withColumns({"fetched_at": F.lit(now).cast("long"), "ttl_seconds": ttl_for(F.col("url"), rules).cast("long")})


def over_size(cache: DataFrame, most_bytes: int) -> DataFrame:
    """(bytes, full): the bytes of all contents and urls, and whether they exceed most_bytes; one row."""
    size = F.coalesce(F.sum(F.octet_length(F.coalesce("content", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit("")))), F.lit(0))
    return cache.agg(size.alias("bytes")).withColumn("full", F.col("bytes") > most_bytes)


def evicted_if_full(cache: DataFrame, most_bytes: int, share: float = 0.1) -> DataFrame:
    """The oldest share of the cache if its bytes exceed most_bytes, else no row. The bytes are summed while this is called."""
    full = over_size(cache, most_bytes).first()["full"]
    return evicted(cache, share) if full else cache.limit(0)


def evicted(cache: DataFrame, share: float = 0.1) -> DataFrame:
    """The oldest share of the cache by (fetched_at, url), which goes when it is full; at least one row."""
    return oldest(cache, "fetched_at", "url", share, F.floor(F.col("fetched_at") / 3600))
