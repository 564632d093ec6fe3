"""Presets, frame sizes and small labels."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import seeded_index

# The presets, the choices of the options menu, preview sizes, still variants and the narrow limit.
THEMES: dict[str, dict[str, Any]] = {
    "cinematic": {"lut": "cinematic", "music_db": -9.0, "no_speed_ramp": False, "transitions": "soft", "audio_mix": "ducked", "pace": "medium"},
    "punchy": {"lut": "punchy", "music_db": -6.0, "no_speed_ramp": False, "transitions": "auto", "audio_mix": "ducked", "pace": "fast"},
    "chill": {"lut": "chill", "music_db": -10.0, "no_speed_ramp": True, "transitions": "soft", "audio_mix": "ducked", "pace": "slow"},
    "nostalgic": {"lut": "nostalgic", "music_db": -10.0, "no_speed_ramp": False, "transitions": "soft", "audio_mix": "ducked", "pace": "medium"},
}
OPTIONS = {
    "audio_mix": ["ducked", "music_only", "clip_only"],
    "pace": ["auto", "slow", "medium", "fast"],
    "transitions": ["soft", "auto", "cut"],
    "aspect": ["16:9", "9:16", "1:1"],
    "resolution": ["1920x1080", "1080x1920", "1080x1080", "1280x720"],
}
PREVIEW = {"16:9": "854x480", "9:16": "480x854", "1:1": "480x480"}
PREVIEW_FPS = 24
VARIANTS = ["live", "live", "push", "pull", "pan_h", "fit_pad", "blurred_bg", "shake"]
NARROW = 0.85


def options_menu(spark: SparkSession) -> DataFrame:
    """``(option, place, choice)``: the choices of every option, the themes first in order of name."""
    rows = [("theme", i, t) for i, t in enumerate(sorted(THEMES))] + [(o, i, c) for o, all_ in OPTIONS.items() for i, c in enumerate(all_)]
    return spark.createDataFrame(rows, "option string, place int, choice string")


def with_theme(theme: str | None, current: Mapping[str, Any], defaults: Mapping[str, Any]) -> dict[str, Any]:
    """``current`` with the theme's values where a setting is still at its default; an unknown or no theme changes nothing."""
    preset = THEMES.get(theme or "", {})
    return {k: preset[k] if k in preset and v == defaults.get(k) else v for k, v in current.items()}


def with_preview(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Settings of a quick preview: small frames, few of them, no colour table and no reframing, when ``preview`` is set."""
    if not settings.get("preview"):
        return dict(settings)
    return dict(settings) | {"res": PREVIEW.get(settings.get("aspect"), PREVIEW["16:9"]), "fps": PREVIEW_FPS, "lut": None, "no_reframe": True}


def frame_size(aspect: Column, width: Column, height: Column) -> Column:
    """Width and height of the result: upright for 9:16 (1080 x 1920 for a square target), the shorter side for 1:1, else as they are."""
    low, high = F.least(width, height), F.greatest(width, height)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    return F.when((aspect == "9:16") & (low == high), size(F.lit(1080), F.lit(1920))).when(aspect == "9:16", size(low, high)).when(aspect == "1:1", size(low, low)).otherwise(size(width, height))


def still_variant(stem: Column, width: Column, height: Column, target_w: int, target_h: int) -> Column:
    """How a still is shown: padded when it is much narrower than the target, else one of eight choices by a hash of its stem."""
    narrow = (width > 0) & (height > 0) & (width / height < F.lit(target_w / target_h * NARROW))
    choice = F.element_at(F.array(*map(F.lit, VARIANTS)), (seeded_index(stem, len(VARIANTS)) + 1).cast("int"))
    return F.when(F.coalesce(narrow, F.lit(False)), "fit_pad").otherwise(choice)


def slug(text: Column) -> Column:
    """Lower case with runs of other characters than letters and digits as one underscore; ``camera`` when nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "camera").otherwise(out)


def byte_size(n: Column) -> Column:
    """Bytes as ``512 B``, ``1.50 KB`` and so on up to PB."""
    shown = lambda power, unit: F.concat(F.call_function("format_number", n / F.lit(1024.0**power), F.lit("0.00")), F.lit(f" {unit}"))
    out = shown(5, "PB")
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < F.lit(1024.0 ** (power + 1)), shown(power, unit)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def day_bounds(since: Column, until: Column, now: Column, whole_days: bool = True) -> Column:
    """``(low, high, folder)`` of a range of days written ``yyyy-MM-dd``: from midnight to the last microsecond of the last day, or to its
    midnight with ``whole_days`` off; without an end up to ``now``. Null when a day is invalid or the end lies before the start."""
    day = lambda c: F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    low, last = day(since), day(until)
    end = F.timestamp_add("MICROSECOND", F.lit(86_400_000_000 - 1), last) if whole_days else last
    high = F.when(until.isNull(), now).otherwise(end)
    folder = F.concat(F.date_format(low, "yyyy-MM-dd"), F.lit("_to_"), F.date_format(high, "yyyy-MM-dd"))
    return F.when(low.isNotNull() & high.isNotNull() & (high >= low), F.struct(low.alias("low"), high.alias("high"), folder.alias("folder")))
