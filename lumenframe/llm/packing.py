"""Problem 7: filling fixed-capacity containers by large-item matching.

Only the sizes matter for a packing, and there are at most ``capacity`` different ones. So the sizes are counted in
Spark, the packing is planned on the driver over that bounded histogram for whole classes of equal containers, and the
plan, ranges of ranks within a size, is joined back to the ranked items. No item is ever collected.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items of one size are ranked in independent parts of about this many.
PART_ROWS = 50_000


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(size, rank_from, rank_to, first_bin, per_bin)``: the items of that size and rank go to consecutive bins.

    Large-item matching: items above a third of the capacity, at most two of which fit a bin, are paired greedily, each
    largest one with the largest partner that fits. The smaller ones follow in falling size, each into the bin with the smallest
    gap that holds it (best fit), then into new bins. Bins of the same content are handled as one class.
    """
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    taken = dict.fromkeys(left, 0)
    moves: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of bins

    def put(size: int, first: int, many: int, per: int) -> None:
        moves.append((size, taken[size], taken[size] + many * per, first, per))
        taken[size] += many * per
        left[size] -= many * per

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - size) - 1
        while at >= 0 and not left[large[at]]:
            del large[at]
            at -= 1
        if at < 0:
            many, partner = left[size], None
        elif large[at] == size:
            many, partner = left[size] // 2, size
            if not many:
                many, partner = 1, next((s for s in reversed(large[:at]) if left[s]), None)
        else:
            partner = large[at]
            many = min(left[size], left[partner])
        put(size, bins, many, 1)
        gap = capacity - size
        if partner is not None:
            put(partner, bins, many, 1)
            gap -= partner
        gaps.setdefault(gap, []).append((bins, many))
        bins += many
    open_gaps = sorted(gaps)
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                per = capacity // size
                many, rest = divmod(left[size], per)
                if many:
                    put(size, bins, many, per)
                    new, first = capacity - per * size, bins
                    bins += many
                else:
                    put(size, bins, 1, rest)
                    new, first, many = capacity - rest * size, bins, 1
                    bins += 1
            else:
                gap = open_gaps[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
                per = min(gap // size, left[size])
                use = min(many, left[size] // per)
                if use < many:
                    gaps.setdefault(gap, []).append((first + use, many - use))
                    if len(gaps[gap]) == 1:
                        bisect.insort(open_gaps, gap)
                put(size, first, use, per)
                new, many = gap - per * size, use
            if new:
                gaps.setdefault(new, []).append((first, many))
                if len(gaps[new]) == 1:
                    bisect.insort(open_gaps, new)
    return moves


def ranked(items: DataFrame, key: str, order: Column, parts: DataFrame) -> DataFrame:
    """``rank`` from 0 within each ``key``, in an arbitrary but fixed order, without one task holding a whole key.

    ``parts (key, parts)`` says in how many hash parts a key is ranked. Ranks are counted per part and shifted by the sizes
    of the parts before, from a small pre-aggregated table.
    """
    parted = items.join(F.broadcast(parts), key).withColumn("__part", F.pmod(F.xxhash64(order, F.lit(3)), F.col("parts"))).drop("parts")
    sizes = parted.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = parted.withColumn("__own", F.row_number().over(Window.partitionBy(key, "__part").orderBy(order)) - 1)
    return own.join(sizes, [key, "__part"]).withColumn("rank", (F.col("__own") + F.col("__start")).cast("bigint")).drop("__part", "__own", "__start")


def pieces(docs: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``(id, piece, start, size)``: an item no larger than the capacity is one piece; a larger one is cut into full pieces and a rest."""
    last = F.ceil(F.col(size_col) / F.lit(capacity)) - 1
    cut = docs.where(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("total"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("total") - start).cast("bigint").alias("size"))


def pack(docs: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``(bin, id, piece, start, size)``: every piece of every item of positive size in exactly one container.

    Repeated ids count once; items of null, zero or negative size and null ids need no container. Items larger than
    the capacity fill whole containers and leave one smaller piece. The plan has a few rows per different size, at
    most some times ``capacity`` in all, and is broadcast. An empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    items = pieces(docs.select(id_col, size_col).where(F.col(id_col).isNotNull()).dropDuplicates([id_col]), id_col, size_col, capacity)
    counts = {r[0]: r[1] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_bins(counts, capacity), T.StructType([T.StructField(c, T.LongType()) for c in ("size", "rank_from", "rank_to", "first_bin", "per_bin")]))
    parts = spark.createDataFrame([(s, -(-n // PART_ROWS)) for s, n in counts.items()], T.StructType([T.StructField(c, T.LongType()) for c in ("size", "parts")]))
    placed = ranked(items, "size", F.struct("id", "piece"), parts).join(F.broadcast(plan), "size").where("rank >= rank_from and rank < rank_to")
    return placed.select((F.col("first_bin") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_bin"))).cast("bigint").alias("bin"), "id", "piece", "start", "size")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """``(bins, pieces, tokens, unused_share, overfull)`` of a packing."""
    each = packed.groupBy("bin").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    total = each.agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.count_if(F.col("used") > capacity).alias("overfull"))
    return total.select("bins", "pieces", "tokens", (1 - F.try_divide(F.col("tokens"), F.col("bins") * F.lit(capacity))).alias("unused_share"), "overfull")


def violations(docs: DataFrame, packed: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``(what, n)``: what must not occur in a packing, counted.

    overfull: containers above the capacity; split_small: items in several pieces that fit one container; incomplete:
    items whose pieces don't add up to them; torn: pieces that don't start where the one before ends; skipped: container numbers without content.
    """
    named = lambda df, what: df.select(F.lit(what).alias("what"), F.col("n").cast("bigint").alias("n"))
    bins = packed.groupBy("bin").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("over"), (F.coalesce(F.max("bin") + 1, F.lit(0)) - F.count(F.lit(1))).alias("gap"))
    wanted = docs.where(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).select(F.col(id_col).alias("id"), F.col(size_col).alias("whole")).dropDuplicates(["id"])
    got = packed.groupBy("id").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("pieces"))
    items = wanted.join(got, "id", "full").agg(F.count_if((F.col("whole") <= capacity) & (F.col("pieces") > 1)).alias("split"), F.count_if(~F.col("whole").eqNullSafe(F.col("total"))).alias("missing"))
    end = F.lag(F.col("start") + F.col("size")).over(Window.partitionBy("id").orderBy("piece"))
    torn = packed.withColumn("end", F.coalesce(end, F.lit(0))).agg(F.count_if(F.col("start") != F.col("end")).alias("n"))
    out = named(torn, "torn")
    for df, column, what in ((bins, "over", "overfull"), (bins, "gap", "skipped"), (items, "split", "split_small"), (items, "missing", "incomplete")):
        out = out.unionByName(named(df.withColumnRenamed(column, "n"), what))
    return out
