"""Problem 2: consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import Written


def matching_pairs(matches: DataFrame, max_bits: int = 8, min_cosine: float = 0.92) -> DataFrame:
    """Distinct undirected links ``(a, b)``, a < b, of the comparisons that are matches.

    A row with a missing id, a missing or NaN result, an unknown method or two equal ids is no link.
    """
    hit = ((F.col("method") == "phash") & (F.col("distance") <= max_bits)) | (
        (F.col("method") == "semantic") & (F.col("cosine") >= min_cosine) & ~F.isnan("cosine")
    )
    a, b = F.col("clip_a").cast("bigint"), F.col("clip_b").cast("bigint")
    return matches.where(hit & a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _digest(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def hash_to_min(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Connected components of ``links``: one row ``(id, group_id)`` per linked id, group_id the smallest id of the group.

    Hash-to-min: every vertex v holds a set C(v); in a round it sends C(v) to the smallest member and that member to all
    others. The sets are kept as rows ``(v, u)``, never as collected arrays, so a group of any size stays distributed; the
    minimum is pre-aggregated on the map side and AQE splits the join partition of a hot vertex. Each round is written
    to the shared folder, so a lost executor costs only the running round. Nulls and self-links give no rows; an empty
    input gives an empty result; repeated and turned links count once.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    once = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("v"), F.greatest(x, y).alias("u")).distinct()
    now = Written(once.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.v", "e.u"), "links")
    state = _digest(now.df)
    for _ in range(max_rounds):
        if not state[0]:
            break
        least = now.df.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        sent = now.df.join(least, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        ).unionByName(least.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")))
        after = Written(sent.select("e.v", "e.u").where("v <> u").distinct(), "links")
        now.drop()
        now, before, state = after, state, _digest(after.df)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.df.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("m")).select("id", F.least("id", "m").alias("group_id"))
