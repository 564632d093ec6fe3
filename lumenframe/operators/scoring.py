"""Windows over clips and the transparent multi-signal score.

The rules are a list of (component, contribution, tag condition, tag), evaluated as columns; a score is the sum of the
contributions in rule order. A missing signal is not measured and its rule does not apply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.columns import array_mean, nearest_rank, present

MIN_CLIP_S, SHORT_CLIP_S, WINDOW_S = 0.3, 4.0, 2


@dataclass(frozen=True)
class Rule:
    component: str
    value: Column
    tag: str | None = None
    tagged: Column | None = None


def clip_windows(clips: DataFrame) -> DataFrame:
    """One row per window: ``start_i, end_i`` index the per-second arrays, ``start_s, end_s`` are the seconds.

    Windows of two seconds start every second; a clip of at most four seconds is one window that ends with the clip.
    Clips without a usable duration of 0.3 s or more have none.
    """
    n = F.floor("duration_s").cast("int")
    one = F.array(F.struct(F.lit(0).alias("start_i"), n.alias("end_i"), F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s")))
    many = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - WINDOW_S)), lambda s: F.struct(s.alias("start_i"), (s + WINDOW_S).alias("end_i"), s.cast("double").alias("start_s"), (s + WINDOW_S).cast("double").alias("end_s")))
    ok = F.col("duration_s").isNotNull() & ~F.isnan("duration_s") & (F.col("duration_s") >= MIN_CLIP_S)
    return clip_statistics(clips.where(ok)).withColumn("w", F.explode(F.when(F.col("duration_s") <= SHORT_CLIP_S, one).otherwise(many))).select("*", "w.*").drop("w")


def clip_statistics(clips: DataFrame) -> DataFrame:
    """``clips`` with what the rules need of whole arrays, computed once per clip and not once per window."""
    have = set(clips.columns)
    wanted = {
        "s_motion_max": ("motion", lambda c: F.array_max(c)),
        "s_audio_n": ("audio", lambda c: F.size(present(c))),
        "s_audio_p85": ("audio", lambda c: nearest_rank(c, 0.85)),
        "s_audio_mean": ("audio", array_mean),
        "s_gps_max": ("gps", lambda c: F.coalesce(F.array_max(c), F.lit(0.0))),
        "s_sharp_n": ("sharpness", lambda c: F.size(present(c))),
        "s_sharp_p30": ("sharpness", lambda c: nearest_rank(c, 0.30)),
    }
    return clips.withColumns({k: f(F.col(c)) for k, (c, f) in wanted.items() if c in have})


def window_values(name: str) -> list[Column]:
    """The window's seconds of a signal, null beyond its end: no window is longer than a short clip, so each is read by its place."""
    at = F.col("start_i")
    return [F.when(at + k < F.col("end_i"), F.try_element_at(F.col(name), at + (k + 1))) for k in range(int(SHORT_CLIP_S))]


def _sum(name: str) -> Column:
    total = F.lit(0.0)
    for v in window_values(name):
        total = total + F.coalesce(v, F.lit(0.0))
    return total


def window_mean(name: str) -> Column:
    """Sum of the window over its length in seconds, 0 for an empty window or a missing signal."""
    return F.when(F.col("end_i") > F.col("start_i"), _sum(name) / (F.col("end_i") - F.col("start_i"))).otherwise(0.0)


def window_max(name: str) -> Column:
    """The window's largest measured value, null without any."""
    return F.greatest(*window_values(name))


def _measured_mean(name: str) -> Column:
    """Mean of the window's measured seconds, null without any."""
    n = F.lit(0)
    for v in window_values(name):
        n = n + v.isNotNull().cast("int")
    return F.try_divide(_sum(name), n.cast("double"))


def _top(name: str) -> Column:
    return F.coalesce(window_max(name), F.lit(0.0))


def rules(columns: set[str]) -> list[Rule]:
    """The rules whose signals are among ``columns``, in order. Their limits, weights and tags are fixed values."""
    zero = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(0.0)
    motion, audio = window_mean("motion"), window_mean("audio")
    loud = (audio > 0.4) & (F.col("s_audio_n") >= 4) & (audio >= F.col("s_audio_p85")) & (audio >= 1.25 * F.col("s_audio_mean"))
    accl, gyro, gps = _top("accl"), _top("gyro"), _top("gps")
    gps_max = F.col("s_gps_max")
    tag = F.exists("tags_ms", lambda t: (t >= F.col("start_s") * 1000) & (t <= F.col("end_s") * 1000))
    sharp, light = _measured_mean("sharpness"), _measured_mean("exposure")
    dull = (F.col("s_sharp_n") >= 2) & (sharp <= F.col("s_sharp_p30"))
    poor = (light < 0.25) | (light > 0.85)
    out = [
        Rule("motion", zero(motion > 0, 1.0) * 1.5 * motion, "motion_peak", (motion > 0) & (motion > 0.7 * F.col("s_motion_max"))),
        Rule("audio", 1.0 * audio, "loud_audio", audio > 0.7),
        Rule("audio_peak", zero(loud, 1.5), "audio_peak", loud),
        Rule("accl_jump", F.when(accl > 15, 3.0).when(accl > 12, 1.5).otherwise(0.0), "high_accel_jump", accl > 15),
        Rule("gyro_spin", zero(gyro > 3.0, 1.5), "gyro_spin", gyro > 3.0),
        Rule("gps_speed", zero((gps_max > 0) & (gps > 0.8 * gps_max), 2.0), "speed_peak", (gps_max > 0) & (gps > 0.8 * gps_max)),
        Rule("hilight_tag", zero(tag, 10.0), "hilight_tag", tag),
    ]
    if "faces" in columns:
        face = F.exists(F.slice("faces", F.col("start_i") + 1, F.greatest(F.lit(0), F.col("end_i") - F.col("start_i"))), lambda f: f.isNotNull())
        out.append(Rule("face", zero(face, 0.5), "face_present", face))
    out += [Rule("blurry", zero(dull, -1.5), "blurry", dull), Rule("poor_exposure", zero(poor, -1.5), "poor_exposure", poor)]
    if "is_favorite" in columns:
        out.append(Rule("user_favorite", zero(F.col("is_favorite"), 2.0), "user_favorite", F.col("is_favorite")))
    return out


def score_windows(windows: DataFrame) -> DataFrame:
    """``windows`` with one column per component, ``score``, ``reasons`` and the sparse ``components`` map (zeros left out)."""
    applied = rules(set(windows.columns))
    x = windows.withColumns({f"c_{r.component}": r.value for r in applied})
    total = F.lit(0.0)
    for r in applied:
        total = total + F.col(f"c_{r.component}")
    tags = []
    for r in applied:
        tags.append(F.when(F.coalesce(r.tagged, F.lit(False)), F.lit(r.tag)))
        if r.component == "accl_jump":
            tags.append(F.when(F.col("c_accl_jump") == 1.5, F.lit("moderate_accel")))
    components = F.map_filter(F.create_map(*[y for r in applied for y in (F.lit(r.component), F.col(f"c_{r.component}"))]), lambda _, v: v != 0)
    return x.withColumns({"score": total, "reasons": F.array_compact(F.array(*tags)), "components": components})


# How much a section favours a component when moments are picked.
SECTION_WEIGHTS = {
    "drop": {"motion": 2.0, "accl_jump": 1.5, "hilight_tag": 1.0, "gps_speed": 1.0, "face": -0.5},
    "build": {"motion": 1.0, "accl_jump": 0.75},
    "verse": {"face": 1.5, "motion": 0.5},
    "intro": {"face": 0.5},
    "outro": {"face": 0.5},
}


def section_bias(components: Column, kind: str) -> Column:
    """What a section of ``kind`` adds to a candidate: the weighted components, each clamped to [-5, 5]."""
    out = F.lit(0.0)
    for name, weight in SECTION_WEIGHTS.get(kind, {}).items():
        out = out + F.coalesce(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.try_element_at(components, F.lit(name)))), F.lit(0.0)) * weight
    return out


def components_add_up(scored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The rows whose components don't add up to the score; empty when all is well."""
    total = F.aggregate(F.map_values("components"), F.lit(0.0), lambda a, x: a + x)
    return scored.where(F.abs(total - F.col("score")) > tolerance)
