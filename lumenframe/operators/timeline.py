"""Cut points, allocation of candidates to slots, ordering, stretching and transitions of plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Strides per section, shortest slot, diversity limits, stretch limits.
STRIDE = {"intro": 4, "verse": 2, "build": 1, "drop": 1, "outro": 2}
MIN_SLOT, SIMILAR_BITS, DIVERSITY = 0.4, 16, 2.0
FILL_RATIO, STILL_MAX, TAIL_ROWS, TAIL_MAX = 0.85, 4.0, 4, 1.5
PEAK_REASONS = ("high_accel_jump", "motion_peak", "hilight_tag", "audio_peak")


def band_factor(e: Column) -> Column:
    """Beats between cuts by energy."""
    return F.when(e >= 0.8, 2).when(e >= 0.55, 3).when(e >= 0.3, 4).otherwise(6)


def section_factor(kind: Column) -> Column:
    out = F.lit(2)
    for name, n in STRIDE.items():
        out = F.when(kind == name, n).otherwise(out)
    return out


def auto_cuts(beats: DataFrame, key: str, min_gap: float = 0.33) -> DataFrame:
    """``(key, i, t)`` of the beats kept from ``(key, i, t, factor)``: at least ``factor`` beats and ``min_gap`` seconds after the last kept one.

    Each decision depends on the one before, so the beats of one song are folded in order as an array (songs are short).
    """
    seq = F.array_sort(F.collect_list(F.struct("i", "t", "factor")))
    start = F.struct(F.lit(-1_000_000_000).cast("bigint").alias("i"), F.lit(-1e9).alias("t"), F.array().cast("array<struct<i:bigint,t:double>>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        keep = (b["i"] - a["i"] >= b["factor"]) & (b["t"] - a["t"] >= min_gap - 1e-9)
        return F.when(keep, F.struct(b["i"].cast("bigint").alias("i"), b["t"].cast("double").alias("t"), F.array_append(a["out"], F.struct(b["i"].cast("bigint").alias("i"), b["t"].cast("double").alias("t"))).alias("out"))).otherwise(a)

    x = beats.groupBy(key).agg(seq.alias("s"))
    return x.select(key, F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("k")).select(key, "k.i", "k.t")


def snap(cuts: Column, onsets: Column, within: float = 0.08, min_gap: float = 0.25) -> Column:
    """Cut times moved to the nearest onset strictly within reach, unless that crowds or passes the cut before. Both arrays ascend."""

    def step(out: Column, t: Column) -> Column:
        near = F.array_sort(F.transform(F.filter(onsets, lambda o: F.abs(o - t) < within), lambda o: F.struct(F.abs(o - t).alias("d"), (o >= t).alias("later"), o.alias("o"))))
        best = F.coalesce(F.try_element_at(near, F.lit(1))["o"], t)
        last = F.try_element_at(out, F.lit(-1))
        best = F.when(last.isNotNull() & (best - last < min_gap), t).otherwise(best)
        return F.array_append(out, F.when(last.isNull() | (best > last), best).otherwise(t))

    return F.aggregate(cuts, F.array().cast("array<double>"), step)


def top_per_source(cands: DataFrame, source: str, score: str, pos: str, k: Column | int) -> DataFrame:
    """The ``k`` best candidates of each source, ties by ``pos``."""
    r = F.row_number().over(Window.partitionBy(source).orderBy(F.col(score).desc(), F.col(pos)))
    return cands.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def fill_slots(cands: DataFrame, slots: int, source: str, score: str, pos: str, cap: int) -> DataFrame:
    """The k-th best candidate under the per-source cap for the k-th slot: ``slot`` from 0. What greedy picking gives without sections
    and diversity. Only the best ``slots`` rows are ordered globally."""
    best = top_per_source(cands, source, score, pos, cap).orderBy(F.col(score).desc(), F.col(pos)).limit(slots)
    return best.withColumn("slot", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(pos))) - 1)


def _can_win(cands: DataFrame, slots: DataFrame, plan: str, cap: int) -> DataFrame:
    """The candidates that any slot of their plan may pick: those whose best adjusted score reaches the worst of the candidates that are surely left.

    Of the ``slots * cap`` candidates with the best worst score, ``cap`` a source at most, one is still free at every slot, as a pick takes one
    source with it. So a plan with many candidates comes down to few before it is one task, and no pick is lost.
    """
    n = (slots.groupBy(plan).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) * cap
    values = F.coalesce(F.map_values("bias"), F.array().cast("array<double>"))
    x = cands.where((F.col("length_s") >= MIN_SLOT) & F.col("score").isNotNull() & ~F.isnan("score"))
    x = x.withColumns({"__low": F.col("score") + F.least(F.lit(0.0), F.array_min(values)) - DIVERSITY, "__high": F.col("score") + F.greatest(F.lit(0.0), F.array_max(values))})
    own = F.row_number().over(Window.partitionBy(plan, "source").orderBy(F.col("__low").desc(), "cand_pos"))
    best = F.row_number().over(Window.partitionBy(plan).orderBy(F.col("__low").desc(), "cand_pos"))
    sure = x.select(plan, "source", "cand_pos", "__low").withColumn("__own", own).where(F.col("__own") <= cap).withColumn("__k", best).where(F.col("__k") <= n)
    bar = sure.groupBy(plan).agg(F.when(F.count(F.lit(1)) == n, F.min("__low")).alias("__bar"))
    return x.join(bar, plan).where(F.col("__bar").isNull() | (F.col("__high") >= F.col("__bar"))).select(*cands.columns)


def greedy_allocation(cands: DataFrame, slots: DataFrame, plan: str, cap: int = 1) -> DataFrame:
    """``(plan, slot, cand_pos, adjusted)``: for each slot in order the unused candidate of the highest adjusted score whose source is under its cap.

    ``cands`` holds (plan, cand_pos, source, score, length_s, signature, bias map<string,double>), ``slots`` (plan, slot, gap_s,
    kind). A candidate loses 2 points when its signature is within 16 bits of one picked before; ``bias[kind]`` is added.
    Truly sequential, so each plan is one task, over the candidates that can win a slot at all.
    """
    schema = f"{plan} string, slot int, cand_pos bigint, adjusted double"

    def bits(a: list[int], b: list[int]) -> int:
        return min((x ^ y).bit_count() for x in a for y in b)

    def run(key: tuple, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        pool = c[(c.length_s >= MIN_SLOT) & c.score.notna()].sort_values(["score", "cand_pos"], ascending=[False, True]).to_dict("records")
        for r in pool:
            r["sig"] = [int(f, 16) for f in r["signature"].split(":")] if isinstance(r["signature"], str) and r["signature"] else None
            r["bias"] = dict(r["bias"]) if r["bias"] is not None else {}
            r["near"] = False
        used: dict[str, int] = {}
        out = []
        for slot in s.sort_values("slot").itertuples():
            if slot.gap_s < MIN_SLOT:
                continue
            best = None
            for r in pool:
                if used.get(r["source"], 0) >= cap:
                    continue
                v = r["score"] + (r["bias"].get(slot.kind) or 0.0) - (DIVERSITY if r["near"] else 0.0)
                if best is None or v > best[0]:
                    best = (v, r)
            if best is None:
                continue
            v, r = best
            pool.remove(r)
            used[r["source"]] = used.get(r["source"], 0) + 1
            out.append((key[0], slot.slot, r["cand_pos"], v))
            if r["sig"]:
                for o in pool:
                    o["near"] = o["near"] or bool(o["sig"] and bits(o["sig"], r["sig"]) <= SIMILAR_BITS)
        return pd.DataFrame(out, columns=[plan, "slot", "cand_pos", "adjusted"])

    slots = slots.select(*[F.col(c).alias(c) for c in slots.columns])  # own columns, also where both sides come from one table
    return _can_win(cands, slots, plan, cap).groupBy(plan).cogroup(slots.groupBy(plan)).applyInPandas(run, schema)


def chronological(df: DataFrame, plan: str, t: str, source: str, tie: str) -> DataFrame:
    """``df`` with ``pos`` by capture time, unknown last, then source."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(plan).orderBy(F.col(t).asc_nulls_last(), source, tie)) - 1)


def trailer_order(df: DataFrame, plan: str, t: str, source: str, score: str, tie: str, hook: bool = True, climax: bool = True) -> DataFrame:
    """``df`` with ``pos``: from eight rows on the best first, then by time, the best quarter of the rest last in falling score; ties by ``tie``."""
    x = chronological(df, plan, t, source, tie).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(plan)))
    x = x.withColumn("__rank", F.row_number().over(Window.partitionBy(plan).orderBy(F.col(score).desc(), tie)))
    first = 1 if hook else 0
    bucket = F.when((F.col("__n") < 8) | F.lit(not (hook or climax)), 1).when(F.lit(hook) & (F.col("__rank") == 1), 0)
    bucket = bucket.when(F.lit(climax) & (F.col("__rank") <= first + F.greatest(F.lit(1), F.floor(F.col("__n") / 4))), 2).otherwise(1)
    x = x.withColumn("__b", bucket)
    order = Window.partitionBy(plan).orderBy("__b", F.when(F.col("__b") == 1, F.col("pos")).otherwise(F.col("__rank")))
    return x.withColumn("pos", F.row_number().over(order) - 1).drop("__n", "__rank", "__b")


def stretch(entries: DataFrame, plan: str, pos: str, duration: str, target: str) -> DataFrame:
    """``entries`` with ``out_s`` and ``start_s``: scaled up to 4 s each while below 85 % of the target, then the last four by up to 1.5, and ``fade_s`` on the last.

    Totals per plan are aggregated once and joined back; the start is a running sum.
    """
    x = entries.withColumn("__r", F.row_number().over(Window.partitionBy(plan).orderBy(F.col(pos).desc())))
    t = x.groupBy(plan).agg(F.sum(duration).alias("__sum"), F.count(F.lit(1)).alias("__n"), F.max(target).alias("__goal"), F.sum(F.when(F.col("__r") <= TAIL_ROWS, F.col(duration))).alias("__tail"))
    old = F.col("__sum") / F.col("__n")
    new = F.least(F.lit(STILL_MAX), F.col("__goal") / F.col("__n"))
    t = t.withColumn("__scale", F.when((F.col("__sum") > 0) & (F.col("__sum") < F.col("__goal") * FILL_RATIO) & (new > old + 0.05), new / old).otherwise(1.0))
    short = F.col("__goal") - F.col("__sum") * F.col("__scale")
    t = t.withColumn("__mult", F.when((short > 0.5) & (F.col("__tail") > 0), F.least(F.lit(TAIL_MAX), 1 + short / (F.col("__tail") * F.col("__scale")))).otherwise(1.0))
    x = x.join(t.select(plan, "__scale", "__mult"), plan)
    x = x.withColumn("out_s", F.col(duration) * F.col("__scale") * F.when(F.col("__r") <= TAIL_ROWS, F.col("__mult")).otherwise(1.0))
    before = Window.partitionBy(plan).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("start_s", F.coalesce(F.sum("out_s").over(before), F.lit(0.0)))
    return x.withColumn("fade_s", F.when(F.col("__r") == 1, F.round(F.least(F.lit(1.0), F.col("out_s") * 0.6), 3))).drop("__r", "__scale", "__mult")


def decide_speed(kind: Column, fps: Column, t: Column, drop_start: Column, on_downbeat: Column, action: Column) -> Column:
    """Speeds at both ends of an entry: a lift in builds; for 90 frames a second or more a slow start in the first second of a drop, and on downbeats with action."""
    pair = lambda a, b: F.struct(F.lit(a).alias("speed_start"), F.lit(b).alias("speed_end"))
    return F.when(kind == "build", pair(1.0, 1.15)).when(fps.isNull() | (fps < 90), pair(1.0, 1.0)).when((t - drop_start >= 0) & (t - drop_start < 1.0), pair(0.4, 1.0)).when(on_downbeat & action, pair(0.4, 1.0)).otherwise(pair(1.0, 1.0))


def beat_gap(bpm: Column) -> Column:
    """Seconds between beats; half a second when the tempo isn't usable."""
    return F.when(bpm.isNotNull() & ~F.isnan(bpm) & (bpm > 0), 60.0 / bpm).otherwise(0.5)


def fit_transition(beats: Column | float, beat_gap: Column | float, slot: Column) -> Column:
    """Length of a transition of so many beats: from 0.12 to 0.9 s, and at most 0.4 of a slot of known length."""
    b = F.lit(beats) if isinstance(beats, float) else beats
    length = F.greatest(F.lit(0.12), F.least(F.lit(0.9), b * beat_gap))
    return F.when(slot > 0, F.least(length, slot * 0.4)).otherwise(length)


def auto_transitions(entries: DataFrame, plan: str, pos: str, score: str, slot: str, downbeat: str | None = None, beat_gap: Column | float = 0.5) -> DataFrame:
    """``entries`` with ``kind, duration_s, direction``: cuts; crossfades on marks; a whip on the best of each block of eight, three at most, never on the first.

    Marks are the rows on a downbeat at least four rows after the last mark (a fold over one plan's rows), without any every fourth row.
    """
    n = Window.partitionBy(plan)
    if downbeat is None:
        x = entries.withColumn("__mark", (F.col(pos) % 4 == 0) & (F.col(pos) >= 4))
    else:
        hits = F.array_sort(F.collect_list(F.when(F.col(downbeat) & (F.col(pos) >= 1), F.col(pos).cast("int"))))
        start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
        fold = lambda a, p: F.when(p - a["last"] >= 4, F.struct(p.alias("last"), F.array_append(a["out"], p).alias("out"))).otherwise(a)
        marks = entries.groupBy(plan).agg(F.aggregate(hits, start, fold, lambda a: a["out"]).alias("__marks"))
        x = entries.join(marks, plan).withColumn("__mark", F.when(F.size("__marks") > 0, F.array_contains("__marks", F.col(pos).cast("int"))).otherwise((F.col(pos) % 4 == 0) & (F.col(pos) >= 4))).drop("__marks")
    x = x.withColumn("__block", F.floor(F.col(pos) / 8))
    best = F.row_number().over(Window.partitionBy(plan, "__block").orderBy(F.col(score).desc(), pos)) == 1
    x = x.withColumn("__top", best & (F.col(pos) > 0))
    x = x.withColumn("__whip", F.col("__top") & (F.sum(F.when(F.col("__top"), 1).otherwise(0)).over(n.orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= 3))
    kind = F.when(F.col("__whip"), "whip").when(F.col("__mark"), "crossfade").otherwise("cut")
    length = F.when(kind == "whip", fit_transition(0.5, beat_gap, F.col(slot))).when(kind == "crossfade", fit_transition(0.4, beat_gap, F.col(slot))).otherwise(0.0)
    direction = F.when(kind == "whip", F.when(F.col(pos) % 2 == 0, "wipeleft").otherwise("wiperight"))
    return x.withColumns({"kind": kind, "duration_s": length, "direction": direction}).drop("__mark", "__block", "__top", "__whip")


def soft_transitions(entries: DataFrame, plan: str, pos: str, score: str, slot: str, reasons: str, energy: str, on_onset: str, on_downbeat: str, beat_gap: Column | float = 0.5) -> DataFrame:
    """``entries`` with ``kind, duration_s``: fades whose length follows the energy, cuts on onsets and on peaks that reach the plan's score cut-off."""
    n = Window.partitionBy(plan)
    x = entries.withColumns({"__n": F.count(F.lit(1)).over(n), "__r": F.row_number().over(n.orderBy(score, pos))})
    x = x.withColumn("__cut", F.max(F.when(F.col("__r") == F.greatest(F.lit(0), F.floor(F.col("__n") * 0.85) - 1) + 1, F.col(score))).over(n))
    hard = (F.col(pos) == 0) | F.col(on_onset) | (F.arrays_overlap(reasons, F.array(*map(F.lit, PEAK_REASONS))) & (F.col(score) >= F.col("__cut")))
    beats = F.when(F.col(on_downbeat) & (F.col(energy) >= 0.6), 1.3).when(F.col(energy) < 0.35, 1.7).when(F.col(energy) >= 0.75, 0.6).otherwise(0.9)
    hard = F.coalesce(hard, F.lit(False))
    return x.withColumns({"kind": F.when(hard, "cut").otherwise("crossfade"), "duration_s": F.when(hard, 0.0).otherwise(fit_transition(beats, beat_gap, F.col(slot)))}).drop("__n", "__r", "__cut")


def overlap_compensated(entries: DataFrame, plan: str, pos: str, duration: str, transition: str) -> DataFrame:
    """``entries`` with ``render_s``: the duration plus half of the own transition (not for the first) and half of the next one."""
    w = Window.partitionBy(plan).orderBy(pos)
    own = F.when(F.lag(pos).over(w).isNull(), 0.0).otherwise(F.coalesce(transition, F.lit(0.0)))
    return entries.withColumn("render_s", F.col(duration) + own / 2 + F.coalesce(F.lead(transition).over(w), F.lit(0.0)) / 2)


def fade_offsets(entries: DataFrame, plan: str, pos: str, duration: str, transition: str) -> DataFrame:
    """``(plan, segments array<struct<offset, length>>)``: rows joined at cuts into segments; each starts ``max(0, end so far - fade)``, a fold as the clamp is sequential."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(duration).alias("d"), F.col(transition).alias("t"))))
    start = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<struct<offset:double,length:double>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        fade = F.coalesce(r["t"], F.lit(0.0))
        new = (F.size(a["out"]) == 0) | (fade >= 0.05)
        offset = F.when(F.size(a["out"]) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), a["end"] - fade))
        last = F.try_element_at(a["out"], F.lit(-1))
        grown = F.concat(F.slice(a["out"], 1, F.greatest(F.lit(0), F.size(a["out"]) - 1)), F.array(F.struct(last["offset"].alias("offset"), (last["length"] + r["d"]).alias("length"))))
        return F.when(new, F.struct((offset + r["d"]).alias("end"), F.array_append(a["out"], F.struct(offset.alias("offset"), r["d"].alias("length"))).alias("out"))).otherwise(F.struct((a["end"] + r["d"]).alias("end"), grown.alias("out")))

    return entries.groupBy(plan).agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("segments"))
