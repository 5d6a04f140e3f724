"""Filling windows of fixed capacity with documents: optimal length buckets and token-budget batches.

1. A global histogram of lengths (at most `capacity` bins, whatever the corpus) is taken after documents
   longer than the capacity were cut into full parts and a rest.
2. Dynamic programming over the histogram chooses bucket boundaries of least padding.
3. Token-budget batches form inside the buckets, largest first: a batch takes as many items of its bucket as its
   budget allows, counted at the bucket's upper bound, and what room is left over takes items of smaller
   buckets, which alone could fill it (with inside=True it stays empty). Each batch shape is used as often as its
   buckets last, so a plan has few shapes.
4. Items are numbered within their bucket in salted groups and looked up in the plan.

Only the histogram and the plan pass the driver; both are bounded by the capacity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.session import written

#: Rows that one group of the numbering holds on average.
GROUP_ROWS = 100_000


def best_buckets(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` ranges of lengths with the least padding sum(n * (upper - length)).

    counts[i] is the number of items of length i (counts[0] is ignored). The usual recurrence over the
    distinct lengths; the best split point moves to the right with the length, so divide and conquer
    finds each layer in O(m log m).
    """
    lengths = np.flatnonzero(counts[1:]) + 1
    m = len(lengths)
    if m <= buckets:
        return lengths.tolist()
    n = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(np.float64)

    def cost(i, j):  # lengths i..j-1 in one bucket
        return lengths[j - 1] * (n[j] - n[i]) - (s[j] - s[i])

    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(buckets):
        new, arg = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[0] = 0
        stack = [(1, m, 0, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            k = int(np.argmin(total))
            new[mid], arg[mid] = total[k], i[k]
            stack += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        back.append(arg)
        best = new
    bounds, j = [], m
    for arg in reversed(back):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(arg[j])
    return sorted(bounds)


def batch_plan(bounds: list[int], counts: list[int], capacity: int, inside: bool = False) -> list[tuple[int, int, int, int, int]]:
    """Runs (bucket, first item number, items, items per container, first container), item numbers from 0.

    inside: batches hold items of one bucket only, so that room beside items longer than half the capacity is lost. Container c of a run holds items first + per*(c - container) .. + per - 1 of the bucket.
    """
    left, used, container, runs = list(counts), [0] * len(bounds), 0, []
    while any(left):
        room, shape = capacity, []
        for b in range(len(bounds) - 1, -1, -1):
            take = min(left[b], room // bounds[b])
            if take:
                shape.append((b, take))
                room -= take * bounds[b]
                if inside:
                    break
        times = min(left[b] // take for b, take in shape)
        for b, take in shape:
            runs.append((b, used[b], take * times, take, container))
            used[b] += take * times
            left[b] -= take * times
        container += times
    return runs


def pack(sizes: DataFrame, capacities: list[tuple[str, int]], id_col: str = "doc_id", size_col: str = "n_tokens", buckets: int = 128, inside: bool = False) -> DataFrame:
    """(window_name, id_col, part_no, start_token, n_tokens, bucket_tokens, container_id), a row for each part of each item.

    sizes: (id_col, size_col), a row for each item; ids may repeat, each row is an item of its own.
    capacities: a bounded list of (name, capacity); those that are null or below 1 give no rows. An item longer
    than the capacity is cut into full parts, which have a container each, and a rest; any other stays
    whole. An item of null or no size has one row with size 0 and no container: it needs no room. inside: as
    batch_plan takes it. The histogram is taken while this is called.
    """
    spark = sizes.sparkSession
    columns = ["window_name", id_col, "part_no", "start_token", "n_tokens", "bucket_tokens", "container_id"]
    windows = [(name, int(capacity)) for name, capacity in capacities if capacity is not None and capacity >= 1]
    if not windows:
        kind = sizes.schema[id_col].dataType
        fields = [T.StructField("window_name", T.StringType()), T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in columns[2:])]
        return spark.createDataFrame([], T.StructType(fields))
    items = sizes.select(F.col(id_col), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("_pos"))
    items = written(items, "packing-sizes")  # the texts are encoded once for all capacities
    each = F.array(*(F.struct(F.lit(name).alias("window_name"), F.lit(capacity).cast("long").alias("capacity")) for name, capacity in windows))
    sized = items.select(id_col, "_pos", "size", F.inline(each))
    full = F.floor(F.col("size") / F.col("capacity"))
    rest = sized.select("window_name", id_col, "_pos", full.alias("part_no"), (full * F.col("capacity")).alias("start_token"), (F.col("size") % F.col("capacity")).alias("n_tokens"), "size")
    rest = rest.where("n_tokens > 0 OR size = 0").drop("size")
    whole = sized.where("size >= capacity").select("window_name", id_col, "_pos", "capacity", F.explode(F.sequence(F.lit(0), full - 1)).alias("part_no"))
    whole = whole.select("window_name", id_col, "_pos", "part_no", (F.col("part_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))

    counts = {name: np.zeros(capacity, np.int64) for name, capacity in windows}  # a rest is shorter than the capacity
    for r in rest.where("n_tokens > 0").groupBy("window_name", "n_tokens").count().collect():
        counts[r[0]][r[1]] = r[2]
    lengths, plan, containers = [], [], []
    for name, capacity in windows:
        held = counts[name]
        bounds = best_buckets(held, buckets)
        runs = batch_plan(bounds, [int(held[a + 1 : b + 1].sum()) for a, b in zip([0, *bounds[:-1]], bounds)], capacity, inside)
        lengths += [(name, n, int(b), int(bounds[b])) for n in np.flatnonzero(held).tolist() for b in [np.searchsorted(bounds, n)]]
        plan += [(name, *run) for run in runs]
        containers.append((name, max([0, *(c + n // per for _, _, n, per, c in runs)])))
    # as many rows as distinct lengths below the capacities, respectively runs of the plan
    by_length = F.broadcast(spark.createDataFrame(lengths, "window_name string, n_tokens long, bucket int, bucket_tokens long"))
    runs = F.broadcast(spark.createDataFrame(plan, "w string, b int, first long, items long, per long, container long"))
    planned = F.broadcast(spark.createDataFrame(containers, "window_name string, containers long"))

    filled = rest.where("n_tokens > 0").join(by_length, ["window_name", "n_tokens"])
    filled = _numbered(filled, ["window_name", "bucket"], sum(int(c.sum()) for c in counts.values()))
    within = (F.col("window_name") == F.col("w")) & (F.col("bucket") == F.col("b")) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("items"))
    placed = filled.join(runs, within).withColumn("container_id", F.col("container") + F.floor((F.col("k") - F.col("first")) / F.col("per")))
    # full parts have containers behind those of the plan
    own = _numbered(whole, ["window_name"], whole.count()).join(planned, "window_name")
    own = own.withColumn("container_id", F.col("k") + F.col("containers")).withColumn("bucket_tokens", F.col("n_tokens"))
    none = rest.where("n_tokens = 0").withColumn("bucket_tokens", F.lit(None).cast("long")).withColumn("container_id", F.lit(None).cast("long"))
    return placed.select(columns).unionByName(own.select(columns)).unionByName(none.select(columns))


def _numbered(parts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """parts with k: 0, 1, ... within each group of keys, counted in salted groups of GROUP_ROWS rows on average.

    The salt is of the item's place in the written table, so neither null nor repeated ids fall together.
    """
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("_pos", "part_no"), F.lit(max(1, rows // GROUP_ROWS))))
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shift = salted.groupBy(*keys, "salt").count().select(*keys, "salt", F.coalesce(before, F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("_pos", "part_no")) - 1
    return salted.withColumn("k", local).join(shift, [*keys, "salt"]).withColumn("k", F.col("k") + F.col("shift"))


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(window_name, containers, tokens, room, fill): how well each window's containers are filled.

    fill is tokens / room, null where there is no container.
    """
    used = packed.where("container_id IS NOT NULL").groupBy("window_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    used = used.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    out = capacities.select("window_name", "capacity_tokens").join(used, "window_name", "left").na.fill(0, ["containers", "tokens"])
    room = F.col("containers") * F.col("capacity_tokens")
    return out.select("window_name", "containers", "tokens", room.alias("room"), F.when(room > 0, F.col("tokens") / room).alias("fill"))
