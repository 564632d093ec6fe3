"""Joins the engine adds to Spark's own: interval, nearest and tolerance joins as bucketed equi-joins, keyed per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import BROADCAST_ROWS


def without_banned(df: DataFrame, banned: DataFrame, keys: list[str], banned_key: str) -> DataFrame:
    """``df`` without the rows one of whose ``keys`` is banned; null keys match nothing."""
    gone = banned.where(F.col(banned_key).isNotNull()).select(F.col(banned_key).alias("__ban")).distinct()
    for key in keys:
        df = df.join(gone, F.col(key) == F.col("__ban"), "left_anti")
    return df


def any_in_closed(points: Column, low: Column, high: Column) -> Column:
    """Whether an array has a point in the closed interval; false for null."""
    return F.coalesce(F.exists(points, lambda p: (p >= low) & (p <= high)), F.lit(False))


def first_section(times: DataFrame, sections: DataFrame, key: str, t: str, default: str = "verse", bucket_s: float = 16.0) -> DataFrame:
    """``times`` with ``kind`` of the first section (by ``section_pos``) of the same key whose ``[start_s, end_s)`` holds ``t``, else the default.

    The sections that touch a bucket of time are one array, so the join is an equi-join on (key, bucket) that finds at most one
    row for each of ``times``: repeated rows stay, and no row of ``times`` is part of a key.
    """
    top = F.greatest(F.floor(F.col("start_s") / bucket_s), F.ceil(F.col("end_s") / bucket_s) - 1)
    laid = sections.where("end_s > start_s").select(F.col(key).alias("__k"), F.explode(F.sequence(F.floor(F.col("start_s") / bucket_s), top)).alias("__b"), F.struct("section_pos", "start_s", "end_s", "kind").alias("s"))
    cells = laid.groupBy("__k", "__b").agg(F.array_sort(F.collect_list("s")).alias("__s"))
    hit = times.join(cells, (F.col(key) == F.col("__k")) & (F.floor(F.col(t) / bucket_s) == F.col("__b")), "left")
    found = F.filter("__s", lambda s: (s["start_s"] <= F.col(t)) & (F.col(t) < s["end_s"]))
    return hit.select(*[F.col(c) for c in times.columns], F.coalesce(F.try_element_at(found, F.lit(1))["kind"], F.lit(default)).alias("kind"))


def nearest_mark(times: DataFrame, marks: DataFrame, key: str, t: str, mark: str, within: float) -> DataFrame:
    """``times`` with ``near``: the nearest mark of the key strictly within ``within``; an earlier mark (or the same moment as later) wins a tie, null without one.

    The distinct marks around a bucket of time (eight times ``within`` wide, with its neighbours) are one array, found by an
    equi-join on (key, bucket); a long series is many buckets, and repeated rows of ``times`` stay.
    """
    wide = 8 * within
    m = marks.where(F.col(mark).isNotNull()).select(F.col(key).alias("__k"), F.explode(F.array(*[F.floor(F.col(mark) / wide) + k for k in (-1, 0, 1)])).alias("__b"), F.col(mark).alias("m"))
    cells = m.groupBy("__k", "__b").agg(F.collect_set("m").alias("__m"))
    hit = times.join(cells, (F.col(key) == F.col("__k")) & (F.floor(F.col(t) / wide) == F.col("__b")), "left")
    close = F.filter("__m", lambda m: F.abs(m - F.col(t)) < within)
    best = F.array_min(F.transform(close, lambda m: F.struct(F.abs(m - F.col(t)).alias("gap"), (m >= F.col(t)).alias("later"), m.alias("m"))))
    return hit.select(*[F.col(c) for c in times.columns], best["m"].alias("near"))


def near_any(times: DataFrame, marks: DataFrame, key: str, t: str, mark: str, tolerance: float) -> DataFrame:
    """The ``times`` with a mark of the key closer than ``tolerance`` (strict), by an equi-join on buckets."""
    m = marks.where(F.col(mark).isNotNull()).select(F.col(key).alias("__k"), F.col(mark).alias("__m"), F.explode(F.array(*[F.floor(F.col(mark) / tolerance) + k for k in (-1, 0, 1)])).alias("__b"))
    return times.join(m, (times[key] == m["__k"]) & (F.floor(times[t] / tolerance) == m["__b"]) & (F.abs(times[t] - m["__m"]) < tolerance), "left_semi")


def zip_by_place(left: DataFrame, right: DataFrame, key: str, left_order: list, right_order: list) -> DataFrame:
    """Rows of equal place within the key; the longer side's rest is left out."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "place"])


def at_second(curve: Column, t: Column) -> Column:
    """``curve[min(int(t), n - 1)]``; null for an empty curve."""
    return F.try_element_at(curve, (F.least(F.floor(t).cast("int"), F.size(curve) - 1) + 1).cast("int"))


def without_similar_labels(df: DataFrame, taken: DataFrame, label: str) -> DataFrame:
    """Rows whose label neither contains nor is contained in a taken one, case-insensitively; a null label is like none.

    A small registry (counted) is broadcast; a larger one is joined on equal texts, each label laid out into its substrings.
    """
    t = taken.select(F.lower(F.col(label)).alias("__t")).where("__t is not null").distinct()
    low = F.lower(F.col(label))
    if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(t), low.contains(F.col("__t")) | F.col("__t").contains(low), "left_anti")

    def parts(text: Column) -> Column:
        n = F.length(text)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k))))))

    labels = df.select(low.alias("__l")).where("__l is not null").distinct()
    inside = labels.join(labels.select("__l", F.explode(parts(F.col("__l"))).alias("__t")).join(t, "__t").select("__l").distinct(), "__l", "left_semi")
    around = labels.join(t.select(F.explode(parts(F.col("__t"))).alias("__l")).distinct(), "__l", "left_semi")
    return df.join(inside.unionByName(around).distinct(), low == F.col("__l"), "left_anti")
