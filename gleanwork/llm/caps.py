"""Capping the records of dominant contributors by mergeable quality histograms.

Records of a contributor rank by score descending, null last, then id ascending. No contributor's
records are ever sorted as a whole: counts per bin are merged, the bin that holds the cap is found
from the counts, records of better bins stay, those of worse ones go, and only the borderline bin is
refined: first into its exact scores, then into ranges of ids, at last by a rank within one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.session import written

#: Bins between two whole numbers of score.
BINS = 256
#: Ids of one range of the last refinement; bounds what is ranked in one group.
RANGE = 4096


def url_host(url: Column) -> Column:
    """Host of url in lower case without user, port, one final dot and one leading www.; null if there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def source_kind(source_type: Column) -> Column:
    """source_type trimmed, in lower case, with - as _; null stays null."""
    return F.replace(F.lower(F.trim(source_type)), F.lit("-"), F.lit("_"))


def _refine(rows: DataFrame, by: Column) -> tuple[DataFrame, DataFrame]:
    """One histogram level: rows (KEY, id, ..., room) of contributors over their cap, split by the order of `by`.

    Returns the rows over the cap, and the rows of borderline bins with the room that is left for the bin.
    """
    binned = rows.withColumn("bin", by)
    counts = binned.groupBy(*KEY, "room", "bin").count()  # combined before the shuffle
    before = F.sum("count").over(Window.partitionBy(*KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(F.col("room") - F.coalesce(before, F.lit(0)), F.lit(0))
    over = counts.withColumn("left", left).where("left < count").select(*KEY, "bin", "left")
    hit = binned.drop("room").join(over, [*KEY, "bin"]).withColumnRenamed("left", "room").drop("bin")
    return hit.where("room = 0"), hit.where("room > 0")


KEY = ["contributor_kind", "g", "contributor"]


def over_cap(records: DataFrame, caps: DataFrame, group_col: str = "run_id", id_col: str = "row_id", url_col: str = "url", type_col: str = "source_type", score_col: str = "score") -> DataFrame:
    """(contributor_kind, id_col): the records beyond the cap of their contributor, for each row of caps separately.

    caps: (contributor_kind, max_records, max_share), a row for each kind, `domain` or `source_type`; a cap is
    max_records or max_share times the rows of the group, rounded down, whichever is less; null sets no
    cap, a negative one counts as 0. Records without a contributor of a kind are never over its cap but
    count in the group's rows. Null groups form one group. NaN counts as the best score, as in Spark's
    order. Ids must be unique; other columns play no part, whatever their names.
    """
    base = records.select(
        F.concat(F.when(F.col(group_col).isNull(), "n").otherwise("g"), F.coalesce(F.col(group_col).cast("string"), F.lit(""))).alias("g"),
        F.col(id_col).alias("id"),
        F.col(score_col).cast("double").alias("score"),
        url_host(F.col(url_col)).alias("domain"),
        source_kind(F.col(type_col)).alias("source_type"),
    )
    kinds = F.array(*(F.struct(F.lit(k).alias("contributor_kind"), F.col(k).alias("contributor")) for k in ("domain", "source_type")))
    long = base.select("g", "id", "score", F.inline(kinds)).where("contributor IS NOT NULL")
    groups = base.groupBy("g").agg(F.count("*").alias("n"))
    limits = caps.select("contributor_kind", F.least(F.col("max_records").cast("double"), F.lit(float("inf"))).alias("m"), F.col("max_share").cast("double").alias("share"))
    cap = F.least("m", F.floor(F.col("share") * F.col("n")).cast("double"))  # least skips nulls
    sizes = long.groupBy(*KEY).agg(F.count("*").alias("held")).join(groups, "g").join(limits, "contributor_kind")
    sizes = sizes.withColumn("room", F.greatest(F.coalesce(cap, F.lit(float("inf"))), F.lit(0.0))).where("held > room")
    rows = long.join(sizes.select(*KEY, F.col("room").cast("long")), KEY)
    order = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("s"))
    coarse = F.struct("order.none", F.floor(F.least(F.greatest(F.coalesce("order.s", F.lit(0.0)), F.lit(-1e12)), F.lit(1e12)) * BINS).alias("s"))
    rows = rows.select(*KEY, "id", "room", F.when(F.isnan("score"), F.struct(F.lit(False).alias("none"), F.lit(float("-inf")).alias("s"))).otherwise(order).alias("order"))
    gone, border = _refine(written(rows, "caps-rows"), coarse)
    gone2, border = _refine(written(border, "caps-bin"), F.col("order"))
    border = written(border, "caps-score")  # of each contributor, the records of one score
    gone3, border = _refine(border, F.floor(F.col("id") / RANGE))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))  # at most RANGE ids of a contributor are left
    gone4 = border.withColumn("k", rank).where("k > room")
    out = [d.select("contributor_kind", F.col("id").alias(id_col)) for d in (gone, gone2, gone3, gone4)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def capped(records: DataFrame, over: DataFrame, id_col: str = "row_id") -> DataFrame:
    """The rows of records with every contributor held to its cap: those that over_cap names for no kind."""
    gone = over.select(F.col(id_col).alias("gone_id")).distinct()
    return records.join(gone, records[id_col] == F.col("gone_id"), "left_anti")
