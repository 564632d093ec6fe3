"""Problem 5: capping the records of dominant contributors, stratum by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A hot contributor's records are ranked in this many independent parts before the final ranking.
SALTS = 64


def quotas(cells: DataFrame, contributor: str, stratum: str, cap: Column, weighting: str = "size") -> DataFrame:
    """Slots per (contributor, stratum) from the counts ``n`` in ``cells``.

    The cap is split in proportion to the weights (the stratum's size, or equal ones). A stratum too small for its part
    is kept whole and its spare slots go to the others; the fractions left are settled by largest remainder, ties by
    stratum. Everything is a window over the pre-aggregated counts, never over the records.
    """
    weight = F.col("n").cast("double") if weighting == "size" else F.lit(1.0)
    fill = Window.partitionBy(contributor).orderBy(F.col("n") / F.col("w"), F.col(stratum).asc_nulls_first())
    after, before = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing), fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(contributor)
    x = cells.withColumn("w", weight).withColumn("cap", F.least(cap.cast("double"), F.sum("n").over(whole).cast("double")))
    x = x.withColumn("level", (F.col("cap") - F.coalesce(F.sum("n").over(before), F.lit(0))) / F.sum("w").over(after))
    x = x.withColumn("full", F.col("n") <= F.col("w") * F.col("level") + 1e-9)
    x = x.withColumn("free", F.greatest(F.lit(0.0), F.col("cap") - F.sum(F.when(F.col("full"), F.col("n")).otherwise(0)).over(whole)))
    x = x.withColumn("open_w", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole))
    x = x.withColumn("part", F.when(F.col("full"), F.col("n").cast("double")).otherwise(F.col("free") * F.col("w") / F.col("open_w")))
    x = x.withColumn("base", F.floor(F.col("part") + 1e-9))
    x = x.withColumn("spare", F.round(F.col("cap") - F.sum("base").over(whole)))
    rest = Window.partitionBy(contributor).orderBy((F.col("part") - F.col("base")).desc(), F.col(stratum).asc_nulls_first())
    return x.withColumn("slots", F.col("base") + F.when((F.row_number().over(rest) <= F.col("spare")) & ~F.col("full"), 1).otherwise(0)).select(contributor, stratum, F.col("slots").cast("bigint").alias("slots"))


def cap_contributors(df: DataFrame, contributor: str, quality: str, tie: str, cap: int, stratum: str | None = None, weighting: str = "size") -> DataFrame:
    """The records kept when each contributor keeps at most ``cap``; ``df``'s columns plus ``kept_rank``.

    ``tie`` identifies a record: rows with the same id count once, a null id gives no row. Within a stratum the highest
    ``quality`` comes first, equal ones by smaller ``tie``, null and NaN last. A null contributor is a contributor of
    its own, a null stratum a stratum of its own; without
    ``stratum`` all records of a contributor are one stratum, which the apportionment gives the whole cap. The ranking runs in two steps (per hash part of a contributor, then
    over at most ``SALTS * cap`` rows of it), so that no task ever holds all records of a dominant contributor.
    """
    if cap < 0:
        raise ValueError("cap must not be negative")
    names = df.columns
    good = F.when(F.isnan(quality), None).otherwise(F.col(quality).cast("double"))
    st = F.col(stratum) if stratum else F.lit(0)
    x = df.where(F.col(tie).isNotNull()).dropDuplicates([tie]).withColumns({"__c": F.coalesce(F.concat(F.lit("="), F.col(contributor).cast("string")), F.lit("null")), "__s": st, "__q": good})
    order = [F.col("__q").desc_nulls_last(), F.col(tie).asc()]
    first = Window.partitionBy("__c", "__s", "__salt").orderBy(*order)
    last = Window.partitionBy("__c", "__s").orderBy(*order)
    few = x.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(SALTS))).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= cap).drop("__salt", "__r")
    few = few.withColumn("kept_rank", F.row_number().over(last)).where(F.col("kept_rank") <= cap)
    cells = x.groupBy("__c", "__s").agg(F.count(F.lit(1)).alias("n"))
    q = quotas(cells, "__c", "__s", F.lit(cap), weighting).select(F.col("__c").alias("__qc"), F.col("__s").alias("__qs"), "slots")
    return few.join(q, (F.col("__c") == F.col("__qc")) & F.col("__s").eqNullSafe(F.col("__qs"))).where(F.col("kept_rank") <= F.col("slots")).select(*names, "kept_rank")


def capped_out(df: DataFrame, contributor: str, quality: str, tie: str, cap: int, stratum: str | None = None) -> DataFrame:
    """The ids (column ``tie``) of the records that ``cap_contributors`` does not keep, each once."""
    kept = cap_contributors(df.select(*dict.fromkeys([contributor, quality, tie, *([stratum] if stratum else [])])), contributor, quality, tie, cap, stratum)
    return df.where(F.col(tie).isNotNull()).select(tie).distinct().join(kept.select(tie), tie, "left_anti")
