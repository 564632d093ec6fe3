"""Sessions, bursts, runs and song sections, by windows over lags per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the section detector, in seconds and ratios.
INTRO_MAX, OUTRO_MAX, OUTRO_MIN, DROP_RATIO, DROP_RISE, RISE_WINDOW, BUILD_MAX, BUILD_MIN = 12, 12, 4, 1.4, 0.5, 4, 8, 4


def islands(df: DataFrame, keys: list[str], order: list[Column | str], starts: Column, name: str = "island") -> DataFrame:
    """``df`` with the running number of the island each row is in; ``starts`` says where a new one begins (null counts as yes)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sessions(df: DataFrame, keys: list[str], t: str, tie: str, gap_s: float) -> DataFrame:
    """``df`` with ``session`` from 1 per key: rows at most ``gap_s`` apart are chained; ``t`` is in seconds."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    return islands(df, keys, [t, tie], F.col(t) - F.lag(t).over(w) > gap_s, "session")


def suppress_bursts(sources: DataFrame, scope: str, source: str, t: str, score: str, window_s: float = 3.0, limit: float = 0.5) -> DataFrame:
    """``sources`` (one row per source with its best score) with ``suppressed``.

    Within a scope, sources at most ``window_s`` after the one before are a burst and only its best stays, the earliest of equal ones.
    If more than ``limit`` of at least three timed sources would go, the times are taken for bogus and nothing is suppressed. Untimed sources
    always stay; ``window_s <= 0`` suppresses nothing.
    """
    if window_s <= 0:
        return sources.withColumn("suppressed", F.lit(False))
    timed = sessions(sources.where(F.col(t).isNotNull() & ~F.isnan(t)), [scope], t, source, window_s)
    best = Window.partitionBy(scope, "session").orderBy(F.col(score).desc(), F.col(t), F.col(source))
    timed = timed.withColumn("lost", F.row_number().over(best) > 1)
    total = timed.groupBy(scope).agg((F.count_if("lost") / F.count(F.lit(1)) > limit).alias("many"), F.count(F.lit(1)).alias("n"))
    gone = timed.join(total, scope).where("lost and not (n >= 3 and many)").select(scope, source, F.lit(True).alias("gone"))
    return sources.join(gone, [scope, source], "left").withColumn("suppressed", F.coalesce("gone", F.lit(False))).drop("gone")


def run_lengths(df: DataFrame, key: str, pos: str, label: str, value: str) -> DataFrame:
    """``(key, start, end, label, top)``: runs of equal labels in order of ``pos``, end exclusive, with their largest value."""
    w = Window.partitionBy(key).orderBy(pos)
    x = islands(df, [key], [pos], ~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(pos).over(w).isNull())
    return x.groupBy(key, "island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first(label).alias("label"), F.max(value).alias("top")).drop("island")


def labelled_seconds(curve: DataFrame, key: str) -> DataFrame:
    """``(key, sec, e, label)`` of gap-free energy curves ``(key, sec, e)``.

    outro: the tail below the upper median, at most 12 s and at least 4; intro: the head below it, at most 12 s; drop: energy of 1.4
    medians that rose by half over the mean of the 4 s before, merged over gaps of up to 2 s; build: the strictly
    rising 4 to 8 s before a drop; all else verse. The curve of one song is short, so it is one window partition.
    """
    w, whole = Window.partitionBy(key).orderBy("sec"), Window.partitionBy(key)
    ranked = curve.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("e", "sec"))).withColumn("n", F.count(F.lit(1)).over(whole))
    x = ranked.withColumn("median", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("e"))).over(whole)).drop("r")
    loud = F.when(F.col("e") >= F.col("median"), F.col("sec"))
    x = x.withColumns({"intro_end": F.least(F.min(loud).over(whole), F.lit(INTRO_MAX), F.col("n")), "tail": F.least(F.col("n") - 1 - F.max(loud).over(whole), F.lit(OUTRO_MAX)), "emax": F.max("e").over(whole)})
    x = x.withColumn("outro_start", F.when(F.col("tail") >= OUTRO_MIN, F.col("n") - F.col("tail")).otherwise(F.col("n")))
    prior = F.coalesce(F.avg("e").over(w.rowsBetween(-RISE_WINDOW, -1)), F.col("e"))
    x = x.withColumns({"prior": prior, "flat": F.coalesce(F.lead("e").over(w) - F.col("e") <= 0, F.lit(True))})
    inside = (F.col("sec") >= F.col("intro_end")) & (F.col("sec") < F.col("outro_start"))
    x = x.withColumn("drop", inside & (F.col("e") >= F.col("median") * DROP_RATIO) & (F.col("prior") > 0) & ((F.col("e") - F.col("prior")) / F.greatest(F.col("prior"), F.lit(1e-6)) >= DROP_RISE))
    x = x.withColumns({"before": F.last(F.when(F.col("drop"), F.col("sec")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next": F.first(F.when(F.col("drop"), F.col("sec")), ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    x = x.withColumn("in_drop", F.col("drop") | (F.col("before").isNotNull() & F.col("next").isNotNull() & (F.col("next") - F.col("before") <= 3)))
    x = x.withColumns({"opens": F.col("in_drop") & ~F.coalesce(F.lag("in_drop").over(w), F.lit(False)), "stop": F.coalesce(F.last(F.when(F.col("flat"), F.col("sec")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))})
    first = F.greatest(F.col("intro_end"), F.col("sec") - BUILD_MAX, F.col("stop") + 1)
    x = x.withColumn("b0", F.when(F.col("opens") & (F.col("sec") - first >= BUILD_MIN), first))
    ahead = w.rowsBetween(1, BUILD_MAX)
    x = x.withColumn("in_build", F.coalesce(F.min("b0").over(ahead) <= F.col("sec"), F.lit(False)))
    label = F.when(F.col("emax") <= 0, "verse").when(F.col("sec") >= F.col("outro_start"), "outro").when(F.col("in_drop"), "drop").when(F.col("in_build"), "build").when(F.col("sec") < F.col("intro_end"), "intro").otherwise("verse")
    return x.select(key, "sec", "e", label.alias("label"), "emax")


def sections(curve: DataFrame, key: str, durations: DataFrame | None = None) -> DataFrame:
    """``(key, section_pos, kind, start_s, end_s, intensity)``: runs of the labels, with the run's largest energy over the song's.

    The last section ends at the key's ``duration_s`` in ``durations`` where that lies beyond its start, else at a whole second.
    """
    x = labelled_seconds(curve, key)
    top = x.groupBy(key).agg(F.first("emax").alias("emax"))
    r = run_lengths(x, key, "sec", "label", "e").join(top, key)
    pos = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    end = F.col("end").cast("double")
    if durations is not None:
        r = r.join(durations.select(key, F.col("duration_s").alias("__d")), key, "left")
        last = F.lead("start").over(Window.partitionBy(key).orderBy("start")).isNull()
        end = F.when(last & (F.col("__d") > F.col("start")), F.col("__d")).otherwise(end)
    return r.select(key, pos.alias("section_pos"), F.col("label").alias("kind"), F.col("start").cast("double").alias("start_s"), end.alias("end_s"), F.when(F.col("emax") > 0, F.col("top") / F.col("emax")).otherwise(0.0).alias("intensity"))


def pair_adjacent(df: DataFrame, keys: list[str], order: list[str], eligible: Column) -> DataFrame:
    """``df`` with ``pair``: rows matched greedily with the next one where ``eligible`` (a condition on a row and, by ``lead``, its
    successor) holds; each row is in one pair at most, unmatched rows have null. In a run of eligible links every other one is taken.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("__link", F.coalesce(eligible, F.lit(False)))
    x = islands(x, keys, order, ~F.coalesce(F.lag("__link").over(w), F.lit(False)), "__run")
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(*order)))
    first = (F.col("__n") % 2 == 1) & F.col("__link")
    x = x.withColumn("__first", first).withColumn("__no", F.sum(F.when(F.col("__first"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    paired = F.col("__first") | ((F.col("__n") % 2 == 0))
    return x.withColumn("pair", F.when(paired, F.col("__no"))).drop("__link", "__run", "__n", "__first", "__no")


def moment_budget(duration: Column, cap: int) -> Column:
    """Moments a source may give: 1 for short ones, else one per ten seconds, at most ``cap``."""
    if cap <= 1:
        return F.lit(1)
    return F.when(duration.isNull() | F.isnan(duration) | (duration <= 4), 1).otherwise(F.greatest(F.lit(1), F.least(F.ceil(duration / 10), F.lit(cap))).cast("int"))
