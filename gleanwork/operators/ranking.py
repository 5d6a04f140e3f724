"""Ranks within groups of any size, without sorting a group as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one range of rows that are equal in value; bounds what is ranked in one group.
RANGE = 4096

_STEP = "cast(9223372036854775808 as decimal(20,0))"  # 2 to the 63rd


def packed(order: list[str] | tuple[str, ...], missing: int) -> Column:
    """One or two columns of whole numbers that aren't negative as one fixed-width number that orders as they do, so that hashing aggregates it.

    missing stands for null in all columns but the last, an id that must not be null.
    """
    out = F.lit(0).cast("decimal(38,0)")
    for c in order:
        out = (out * F.expr(_STEP) + (F.col(c) if c == order[-1] else F.coalesce(F.col(c), F.lit(missing)))).cast("decimal(38,0)")
    return out


def unpacked(rank: Column) -> Column:
    """The last column of a packed order."""
    return F.pmod(rank, F.expr(_STEP)).cast("long")


def _before(counts: DataFrame, keys: list[str], order: list[str]) -> Column:
    return F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def numbered(df: DataFrame, keys: list[str], bucket: Column, value: Column, id_col: str, name: str = "n") -> DataFrame:
    """df with name: 1, 2, ... by (value, id_col) within each group of keys (null keys form groups too); ids are whole numbers.

    bucket must not decrease along value. Rows are counted by bucket, and within it by value and range of ids; each
    such part is numbered by itself and shifted by the counts before it, so neither a large group nor one of equal
    values is sorted as a whole.
    """
    b = df.withColumns({"_b": bucket, "_v": value, "_i": F.floor(F.col(id_col) / RANGE)})
    fine = b.groupBy(*keys, "_b", "_v", "_i").count()
    coarse = fine.groupBy(*keys, "_b").agg(F.sum("count").alias("count"))
    parts = [*keys, "_b", "_v", "_i"]
    first = coarse.select(*keys, "_b", _before(coarse, keys, ["_b"]).alias("_first"))
    within = fine.select(*parts, _before(fine, [*keys, "_b"], ["_v", "_i"]).alias("_within"))
    shift = within.alias("w").join(first.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate([*keys, "_b"])), "_first"), _same([*keys, "_b"], [f"_f{i}" for i in range(len(keys) + 1)]))
    shift = shift.select(*(F.col(p).alias(f"_s{i}") for i, p in enumerate(parts)), (F.col("_first") + F.col("_within")).alias("_shift"))
    local = b.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy(id_col)))
    drop = ["_b", "_v", "_i", "_n", "_shift", *(f"_s{i}" for i in range(len(parts)))]
    return local.join(shift, _same(parts, [f"_s{i}" for i in range(len(parts))])).withColumn(name, F.col("_n") + F.col("_shift")).drop(*drop)


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 16) -> DataFrame:
    """(keys, a column for each of shares): nearest-rank percentiles of value within each group, nulls aside.

    Histograms of `bins` bins between two whole numbers find the bin of each rank; only equal values of that bin are
    counted, so no group is sorted or held as a whole. Null keys form groups too.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) * bins).alias("_b"))
    counts = rows.groupBy(*keys, "_b").count()
    by = Window.partitionBy(*keys)
    cut = counts.select(*keys, "_b", _before(counts, keys, ["_b"]).alias("_before"), "count", F.sum("count").over(by).alias("_all"))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.greatest(F.ceil(F.col("_all") * s), F.lit(1)).alias("rank")) for n, s in shares.items())))
    border = cut.select("*", wanted.alias("w")).where("w.rank > _before AND w.rank <= _before + count")
    border = border.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_bb"), F.col("w.name").alias("_name"), (F.col("w.rank") - F.col("_before")).alias("_rank"))
    exact = rows.groupBy(*keys, "_b", "_v").count()
    near = exact.join(border, _same([*keys, "_b"], [*(f"_k{i}" for i in range(len(keys))), "_bb"]))
    end = F.sum("count").over(Window.partitionBy(*keys, "_b", "_name").orderBy("_v"))
    found = near.withColumn("_end", end).where("_end >= _rank").groupBy(*keys, "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in shares))


def oldest(df: DataFrame, order: str, tie: str, share: float, bucket: Column) -> DataFrame:
    """The floor(share * rows) first rows of df by (order, tie), at least one if df has rows.

    bucket must not decrease along order. Counts of buckets find the bucket in which the border lies; only its rows
    are ranked.
    """
    b = df.withColumn("_b", bucket)
    counts = b.groupBy("_b").count()
    whole = Window.partitionBy()
    running = counts.select("_b", "count", F.sum("count").over(whole.orderBy("_b")).alias("_end"), F.sum("count").over(whole).alias("_all"))  # a row for each bucket
    want = F.greatest(F.floor(F.col("_all") * share), F.lit(1))
    border = running.select("_b", (want - (F.col("_end") - F.col("count"))).alias("_room"), "count").where("_room > 0")
    near = b.join(border, "_b")
    within = near.where("_room >= count").drop("_b", "_room", "count")
    ranked = near.where("_room < count").withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(order, tie)))
    return within.unionByName(ranked.where("_n <= _room").drop("_b", "_room", "count", "_n"))
