"""From candidates to the entries of plans: cut points, slots, allocation under caps, assembly, and the levers that fill a short plan.

Everything is keyed by plan. A plan has at most as many entries as its song has beats, so the windows over one plan are small; the
candidates of a plan may be many and are trimmed per source, and to the number of slots, before they are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import array_mean, present, upper_median
from lumenframe.operators import edits, timeline
from lumenframe.session import Written

# Beats per cut of each pace, fallback length, tolerated share of open slots, ceiling of a raised cap, defaults of a frame.
PACES = {"fast": 1, "medium": 2, "slow": 4}
FALLBACK_S, UNDERFILL, MAX_CAP, WIDTH, HEIGHT = 90.0, 0.20, 3, 1920, 1080
DOWNBEAT_S, SHAKY = 0.1, 1.2
ACTION = ("high_accel_jump", "motion_peak", "hilight_tag")


def usable(x: Column) -> Column:
    """``x`` where it is a number above zero, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0), x)


def target_length(song_s: Column, wanted_s: Column | None = None) -> Column:
    """Length of a plan: the song's, or 90 s for a song without a usable one; at most what is wanted."""
    song = F.coalesce(usable(song_s), F.lit(FALLBACK_S))
    return song if wanted_s is None else F.least(song, F.coalesce(wanted_s, song))


def raised_cap(sources: Column, slots: Column, cap: int = 1, most: int = MAX_CAP) -> Column:
    """Cap per source without budgets: a cap of 1 that leaves more than a fifth of the slots open is raised to what fills them, up to ``most``."""
    if cap != 1:
        return F.lit(cap)
    short = (sources > 0) & (sources < slots) & ((slots - sources) / slots > UNDERFILL)
    return F.when(short, F.least(F.lit(most), F.ceil(slots / sources)).cast("int")).otherwise(1)


def cut_points(beats: DataFrame, songs: DataFrame, plan: str, pace: str = "medium") -> DataFrame:
    """``(plan, slot, t, next_t)``: the slots between cut points; the last one ends at the target.

    ``beats (plan, i, t[, factor])`` and ``songs (plan, intro_end_s, target_s)``. A pace takes every so many beats from the end
    of the intro on, or of all beats when none lies there; ``auto`` takes the beats that ``auto_cuts`` keeps by their factor, or every second one when it keeps none.
    """
    x = beats.join(songs.select(plan, "intro_end_s", "target_s"), plan)
    after = F.col("t") >= F.col("intro_end_s")
    within = after & (F.col("t") < F.col("target_s"))
    order = Window.partitionBy(plan).orderBy("i")
    if pace == "auto":
        kept = timeline.auto_cuts(x.where(within).select(plan, "i", "t", "factor"), plan)
        second = x.where(within).withColumn("__r", F.row_number().over(order)).where("__r % 2 = 1").select(plan, "i", "t")
        cuts = kept.unionByName(second.join(kept.select(plan).distinct(), plan, "left_anti"))
    else:
        x = x.withColumn("__any", F.max(after).over(Window.partitionBy(plan)))
        x = x.where(after | ~F.col("__any")).withColumn("__r", F.row_number().over(order) - 1)
        cuts = x.where((F.col("__r") % PACES.get(pace, 2) == 0) & (F.col("t") < F.col("target_s"))).select(plan, "i", "t")
    w = Window.partitionBy(plan).orderBy("i")
    cuts = cuts.join(songs.select(plan, "target_s"), plan)
    return cuts.select(plan, (F.row_number().over(w) - 1).alias("slot"), "t", F.coalesce(F.lead("t").over(w), "target_s").alias("next_t"))


def allocate(cands: DataFrame, slots: DataFrame, plan: str, source: str, score: str, pos: str, budget: Column | int = 1, cap: int = 1) -> DataFrame:
    """``cands`` that win a slot, with ``pick`` (from 0, best first) and ``open_slots``: the k-th best candidate for the k-th slot of 0.4 s or more.

    A source gives at most its budget and at most ``cap``; a cap of 1 that fills less than 85 % of the slots is raised to 2 where that
    fills more. This is what greedy picking gives without sections and diversity. ``slots (plan, slot, t, next_t)``.
    """
    n = slots.groupBy(plan).agg(F.count(F.lit(1)).alias("__all"), F.count_if(F.col("next_t") - F.col("t") >= timeline.MIN_SLOT).alias("__open"))
    most = n.agg(F.max("__open")).first()[0] or 0
    long = cands.where((F.col("end_s") - F.col("start_s") >= timeline.MIN_SLOT) & F.col(score).isNotNull() & ~F.isnan(score))
    top = cap + 1 if cap == 1 else cap
    rank = F.row_number().over(Window.partitionBy(plan, source).orderBy(F.col(score).desc(), F.col(pos)))
    own = long.withColumn("__own", rank).where(F.col("__own") <= top).where(F.col("__own") <= (F.lit(budget) if isinstance(budget, int) else budget))
    own = Written(own, "own").df  # at most a few rows a source, read three times
    order = [F.col(score).desc(), F.col(pos)]
    strict = own.where(F.col("__own") <= cap)
    have = own.groupBy(plan).agg(F.count_if(F.col("__own") <= cap).alias("__strict"), F.count(F.lit(1)).alias("__loose"))
    n = n.join(have, plan).withColumn("__strict", F.least("__strict", "__open")).withColumn("__loose", F.least("__loose", "__open"))
    raised = (F.col("__strict") < F.floor(F.col("__all") * timeline.FILL_RATIO)) & (F.col("__loose") > F.col("__strict")) & F.lit(cap == 1)
    n = n.select(plan, F.col("__open").alias("open_slots"), F.col("__all").alias("all_slots"), raised.alias("__raised"))
    place = F.row_number().over(Window.partitionBy(plan).orderBy(*order)) - 1
    one = strict.withColumn("pick", place).where(F.col("pick") < most).join(n.where("not __raised"), plan)
    two = own.withColumn("pick", place).where(F.col("pick") < most).join(n.where("__raised"), plan)
    return one.unionByName(two).where("pick < open_slots").drop("__own", "__raised")


def bound_to_beats(ordered: DataFrame, slots: DataFrame, plan: str, pos: str = "pos") -> DataFrame:
    """``ordered`` entries with ``beat_s`` and ``gap_s`` of the open slot of the same place."""
    w = Window.partitionBy(plan).orderBy("slot")
    open_ = slots.where(F.col("next_t") - F.col("t") >= timeline.MIN_SLOT).select(plan, (F.row_number().over(w) - 1).alias(pos), F.col("t").alias("beat_s"), (F.col("next_t") - F.col("t")).alias("gap_s"))
    return ordered.join(open_, [plan, pos])


def _window(name: str) -> Column:
    """The entry's part of a per-second array."""
    return F.slice(name, F.col("start_i") + 1, F.col("end_i") - F.col("start_i"))


def assemble(x: DataFrame, speed_ramp: bool = True, stabilize: bool = False) -> DataFrame:
    """``x`` with the derived columns of plan entries.

    ``x`` holds the moment (start_s, end_s, reasons, src_fps), its clip (duration_s, tags_ms, voice, gyro, exposure, width, height, and faces if known), its slot (beat_s, gap_s, kind,
    drop_start, downbeat) and ``target_luma``. Added or replaced are speed, speed_start, speed_end, start_s (a tagged moment lies at 40 % of its slot), end_s, start_i,
    end_i, audio_interest, luma_offset, stabilize, source_width, source_height and out_duration_s.
    """
    duration = F.coalesce(usable(F.col("duration_s")), F.col("end_s"))
    speeds = timeline.decide_speed(F.col("kind"), F.col("src_fps"), F.col("beat_s"), F.col("drop_start"), F.coalesce("downbeat", F.lit(False)), F.coalesce(F.arrays_overlap("reasons", F.array(*map(F.lit, ACTION))), F.lit(False)))
    flat = F.struct(F.lit(1.0).alias("speed_start"), F.lit(1.0).alias("speed_end"))
    x = x.withColumn("__v", speeds if speed_ramp else flat).withColumns({"speed_start": F.col("__v.speed_start"), "speed_end": F.col("__v.speed_end"), "__need": F.col("gap_s") * F.col("__v.speed_start"), "__dur": duration})
    tagged = F.coalesce(F.array_contains("reasons", "hilight_tag"), F.lit(False))
    x = x.withColumn("start_s", F.when(tagged, edits.anchored(F.col("start_s"), F.col("end_s"), F.col("tags_ms"), F.col("__need"), F.col("__dur"))).otherwise(F.col("start_s")))
    x = x.withColumn("end_s", F.least(F.col("__dur"), F.col("start_s") + F.col("__need")))
    x = x.withColumn("start_i", F.floor("start_s").cast("int"))
    x = x.withColumn("end_i", F.greatest(F.col("start_i") + 1, F.floor(F.col("end_s") + 0.999).cast("int")))
    interest = F.coalesce(array_mean(_window("voice")), F.try_element_at(F.col("voice"), F.lit(1)), F.lit(0.0))
    g = _window("gyro")
    shaky = F.coalesce(upper_median(F.when(F.size(present(g)) > 0, g).otherwise(F.col("gyro"))) >= SHAKY, F.lit(False))
    calm = ~F.coalesce(F.array_contains("reasons", "gyro_spin"), F.lit(False))
    light = F.coalesce(array_mean(_window("exposure")), array_mean(F.col("exposure")))
    luma = F.coalesce(F.round(F.greatest(F.lit(-0.08), F.least(F.lit(0.08), (F.col("target_luma") - light) * 0.5)), 4), F.lit(0.0))
    x = x.withColumns({"speed": F.col("speed_start"), "out_duration_s": F.col("gap_s"), "audio_interest": interest, "stabilize": F.lit(stabilize) & calm & shaky, "luma_offset": luma, "source_width": F.coalesce("width", F.lit(WIDTH)), "source_height": F.coalesce("height", F.lit(HEIGHT))})
    if "faces" in x.columns:
        x = x.withColumn("faces", F.coalesce(_window("faces"), F.array().cast(x.schema["faces"].dataType)))
    return x.drop("__v", "__need", "__dur")


def filled(entries: DataFrame, plan: str, pos: str, slots: str, target: str, even: bool = True) -> DataFrame:
    """``entries`` with ``beat_s``, ``out_duration_s`` and ``fade_out_s`` after the levers against a short plan.

    With fewer entries than ``slots`` the target is spread evenly over them (``even``); a plan still below 85 % of the target is scaled, up to
    4 s an entry; one still half a second short has its last four entries lengthened, by a half at most. Beats are
    restamped where a lever moved them; the last entry fades.
    """
    whole, order = Window.partitionBy(plan), Window.partitionBy(plan).orderBy(pos)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = entries.withColumns({"__n": F.count(F.lit(1)).over(whole), "__k": F.row_number().over(order) - 1})
    spread = F.lit(even) & (F.col("__n") < F.col(slots))
    gap = F.col(target) / F.col("__n")
    x = x.withColumns({"beat_s": F.when(spread, F.col("__k") * gap).otherwise(F.col("beat_s")), "out_duration_s": F.when(spread, gap).otherwise(F.col("out_duration_s"))})
    x = x.withColumns({"__sum": F.sum("out_duration_s").over(whole), "__first": F.first("beat_s").over(order)})
    old, new = F.col("__sum") / F.col("__n"), F.least(F.lit(timeline.STILL_MAX), gap)
    scaled = (F.col("__sum") > 0) & (F.col("__sum") < F.col(target) * timeline.FILL_RATIO) & (new > old + 0.05)
    x = x.withColumn("__scaled", scaled).withColumn("out_duration_s", F.when(F.col("__scaled"), F.col("out_duration_s") * (new / old)).otherwise(F.col("out_duration_s")))
    x = x.withColumn("beat_s", F.when(F.col("__scaled"), F.col("__first") + F.coalesce(F.sum("out_duration_s").over(before), F.lit(0.0))).otherwise(F.col("beat_s")))
    tail = F.col("__k") >= F.col("__n") - timeline.TAIL_ROWS
    x = x.withColumns({"__short": F.col(target) - F.sum("out_duration_s").over(whole), "__tail": F.sum(F.when(tail, F.col("out_duration_s"))).over(whole)})
    moved = (F.col("__short") > 0.5) & (F.col("__tail") > 0) & tail
    mult = F.least(F.lit(timeline.TAIL_MAX), 1 + F.col("__short") / F.col("__tail"))
    x = x.withColumn("__moved", moved).withColumn("out_duration_s", F.when(F.col("__moved"), F.col("out_duration_s") * mult).otherwise(F.col("out_duration_s")))
    start = F.min(F.when(F.col("__moved"), F.col("beat_s"))).over(whole)
    x = x.withColumn("beat_s", F.when(F.col("__moved"), start + F.coalesce(F.sum(F.when(F.col("__moved"), F.col("out_duration_s"))).over(before), F.lit(0.0))).otherwise(F.col("beat_s")))
    x = x.withColumn("fade_out_s", F.when(F.col("__k") == F.col("__n") - 1, F.round(F.least(F.lit(1.0), F.col("out_duration_s") * 0.6), 3)))
    return x.drop("__n", "__k", "__sum", "__first", "__scaled", "__short", "__tail", "__moved")


def ramp_speeds(entry_start: Column, entry_end: Column) -> Column:
    """Speeds at both ends for rendering: ends within 0.05 of each other become their mean."""
    mean = (entry_start + entry_end) / 2
    close = F.abs(entry_start - entry_end) <= 0.05
    return F.struct(F.when(close, mean).otherwise(entry_start).alias("from"), F.when(close, mean).otherwise(entry_end).alias("to"))


def native_length(seconds: Column, speed_from: Column, speed_to: Column) -> Column:
    """Length that ``seconds`` of source have when played from one speed to the other."""
    slow = lambda s: 1 / F.greatest(s, F.lit(0.0001))
    return seconds * (slow(speed_from) + slow(speed_to)) / 2


def pad_length(slot: Column, native: Column) -> Column:
    """How long the last frame is held to fill the slot."""
    return F.greatest(F.lit(0.0), slot - native)


def audio_plan(interest: Column, speed: Column, total: Column, threshold: float = 0.35) -> Column:
    """Whether a cut is muted (less interest than the threshold, unless that is 0), its tempo within [0.5, 2], and the length of the tail fade of a result of ``total`` seconds."""
    muted = F.lit(threshold > 0) & (F.coalesce(interest, F.lit(1.0)) < threshold)
    return F.struct(muted.alias("muted"), F.greatest(F.lit(0.5), F.least(F.lit(2.0), speed)).alias("tempo"), F.greatest(F.lit(0.2), F.least(F.lit(1.5), total * 0.05)).alias("tail_fade"))


def crop_left(centres: Column, width: Column, height: Column, aspect: float) -> Column:
    """Left edge of the crop window per second, following the smoothed face centres (shares of the width; null takes the last known, 0.5 before any); null without any centre."""
    from lumenframe.operators.signals import fill_and_smooth

    crop = F.greatest(F.lit(2.0), F.least(width.cast("double"), F.round(height * F.lit(aspect))))
    half = crop / 2
    left = F.transform(fill_and_smooth(centres), lambda c: F.greatest(F.lit(0.0), F.least(width - crop, F.greatest(half, F.least(width - half, c * width)) - half)))
    return F.when(F.exists(centres, lambda c: c.isNotNull()), left)


def rendered(entries: DataFrame, done: DataFrame, plan: str, pos: str, duration: str) -> tuple[DataFrame, DataFrame]:
    """The entries whose rendering succeeded, renumbered in order, and ``(plan, total_s)`` of them. ``done (plan, pos, ok)``; an entry without a row failed."""
    kept = edits.renumbered(entries.join(done.where("ok").select(plan, pos).distinct(), [plan, pos], "left_semi"), plan, pos)
    return kept, kept.groupBy(plan).agg(F.sum(duration).alias("total_s"))
