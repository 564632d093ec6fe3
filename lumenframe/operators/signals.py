"""Binning, normalising and filling of keyed series. Series are keyed, so every window and group runs per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_signals(clips: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``(key, sec, name, value)``: per-second arrays in long form; null arrays give no rows, null elements stay."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("array<double>").alias("a")) for n in names])
    x = clips.select(F.col(key), F.explode(parts).alias("p")).where("p.a is not null")
    return x.select(key, F.col("p.name").alias("name"), F.posexplode("p.a").alias("sec", "value")).select(key, "sec", "name", "value")


def bin_fixed(series: DataFrame, key: str, pos: str, value: str, bins: int, how: str = "mean") -> DataFrame:
    """``(key, bin, value)`` with exactly ``bins`` rows per key.

    A bin holds ``max(1, len // bins)`` samples; what lies beyond the last bin is dropped and bins without samples are
    0. ``mean`` divides by the bin width even when a bin has fewer samples; ``max`` takes the largest. ``pos`` counts from 0.
    """
    size = series.groupBy(key).agg((F.max(pos) + 1).alias("n"))
    width = F.greatest(F.lit(1), F.floor(F.col("n") / bins))
    placed = series.join(size, key).withColumn("bin", F.floor(F.col(pos) / width).cast("int")).withColumn("w", width).where(F.col("bin") < bins)
    agg = F.sum(value) / F.first("w") if how == "mean" else F.max(value)
    full = size.select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return full.join(placed.groupBy(key, "bin").agg(agg.alias("v")), [key, "bin"], "left").select(key, "bin", F.coalesce("v", F.lit(0.0)).alias("value"))


def bin_every(series: DataFrame, key: str, pos: str, value: str, width: int = 2) -> DataFrame:
    """``(key, bin, value)``: mean of every ``width`` samples; an empty bin within the series is 0."""
    x = series.withColumn("bin", F.floor(F.col(pos) / width).cast("int"))
    got = x.groupBy(key, "bin").agg(F.avg(value).alias("v"))
    full = got.groupBy(key).agg(F.max("bin").alias("top")).select(key, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"))
    return full.join(got, [key, "bin"], "left").select(key, "bin", F.coalesce("v", F.lit(0.0)).alias("value"))


def tumbling_mean(series: DataFrame, key: str, t: Column, value: str, width_s: float) -> DataFrame:
    """``(key, bin, mean, norm)``: mean per window ``[i*w, (i+1)*w)`` of irregular samples, and its share of the key's largest mean."""
    x = series.withColumn("bin", F.floor(t / width_s)).groupBy(key, "bin").agg(F.avg(value).alias("mean"))
    top = x.groupBy(key).agg(F.max("mean").alias("top"))
    return x.join(top, key).select(key, "bin", "mean", F.when(F.col("top") > 0, F.col("mean") / F.col("top")).otherwise(F.col("mean")).alias("norm"))


def downsample(curve: Column, n: int = 50) -> Column:
    """Array of ``n`` clamped means over a fractional step; a curve of at most ``n`` points keeps its points, clamped."""
    size = F.size(curve)
    step = size / F.lit(float(n))

    def bucket(i: Column) -> Column:
        low = F.floor(i * step).cast("int")
        high = F.greatest(low + 1, F.floor((i + 1) * step).cast("int"))
        part = F.slice(curve, low + 1, high - low)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)))

    short = F.transform(curve, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.when(size <= n, short).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bucket))


def fill_and_smooth(values: Column, first: float = 0.5, alpha: float = 0.4) -> Column:
    """Array with nulls replaced by the last known value (``first`` before any), smoothed as ``alpha * x + (1 - alpha) * previous``."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(first).alias("last"), F.lit(None).cast("double").alias("ema"))

    def step(acc: Column, x: Column) -> Column:
        now = F.coalesce(x.cast("double"), acc["last"])
        ema = F.when(acc["ema"].isNull(), now).otherwise(now * alpha + acc["ema"] * (1 - alpha))
        return F.struct(F.array_append(acc["out"], ema).alias("out"), now.alias("last"), ema.alias("ema"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def ordered(df: DataFrame, key: str, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with its 0-based place within ``key``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def upper_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median)``: element ``n // 2`` of each key's ascending values; nulls and NaN don't count, a key without values has no row.

    Two mergeable quantiles enclose the median; only the values between them are counted, each once, and ordered. So a key of
    any size is exact without being in one place.
    """
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.col(value).alias("__v"))
    q = F.percentile_approx("__v", [0.49, 0.51], 10_000)
    bounds = x.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), q.alias("__q"))
    near = x.join(bounds, key).withColumns({"__low": F.col("__v") < F.col("__q")[0], "__mid": F.when(F.col("__v").between(F.col("__q")[0], F.col("__q")[1]), F.col("__v"))})
    each = near.where(F.col("__low") | F.col("__mid").isNotNull()).groupBy(key, "__n", "__mid").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(key).orderBy(F.col("__mid").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.withColumn("__upto", upto).where(F.col("__upto") > F.floor(F.col("__n") / 2)).where("__mid is not null").groupBy(key).agg(F.min("__mid").alias("median"))
