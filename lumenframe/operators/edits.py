"""Edits of plans: each is a transform of the entries, keyed by plan; a new version of a plan gets a new content id."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that ``set`` may change.
SETTABLE = ("start_s", "end_s", "out_duration_s", "speed", "speed_start", "speed_end", "score", "luma_offset", "stabilize", "source")


def renumbered(entries: DataFrame, plan: str = "plan", pos: str = "pos") -> DataFrame:
    return entries.withColumn(pos, F.row_number().over(Window.partitionBy(plan).orderBy(pos)) - 1)


def exclude_source(entries: DataFrame, source) -> DataFrame:
    return renumbered(entries.where(~F.col("source").eqNullSafe(F.lit(source))))


def set_field(entries: DataFrame, pos: int, field: str, value) -> DataFrame:
    """Set one field of the entry at ``pos``; unknown fields are refused."""
    if field not in SETTABLE or field not in entries.columns:
        raise ValueError(f"unknown field {field!r}")
    return entries.withColumn(field, F.when(F.col("pos") == pos, F.lit(value)).otherwise(F.col(field)))


def swap(entries: DataFrame, pos: int, rank: int = 1) -> DataFrame:
    """Swap the entry at ``pos`` with the ``rank``-th best other entry of its plan (score, then position); without one nothing changes."""
    order = Window.partitionBy("plan").orderBy(F.when(F.col("pos") == pos, 1).otherwise(0), F.col("score").desc(), "pos")
    x = entries.withColumn("__k", F.row_number().over(order))
    x = x.withColumn("__o", F.max(F.when((F.col("__k") == rank) & (F.col("pos") != pos), F.col("pos"))).over(Window.partitionBy("plan")))
    x = x.withColumn("__has", F.max(F.when(F.col("pos") == pos, True)).over(Window.partitionBy("plan")))
    new = F.when(F.col("__o").isNull() | F.col("__has").isNull(), F.col("pos")).when(F.col("pos") == pos, F.col("__o")).when(F.col("pos") == F.col("__o"), F.lit(pos)).otherwise(F.col("pos"))
    return x.withColumn("pos", new.cast(dict(entries.dtypes)["pos"])).drop("__k", "__o", "__has")


def pin(entries: DataFrame, pos: int, source, start_s: float, end_s: float) -> DataFrame:
    """Replace source and window of the entry at ``pos``; its score and reasons stay."""
    at = F.col("pos") == pos
    return entries.withColumns({k: F.when(at, F.lit(v)).otherwise(F.col(k)) for k, v in (("source", source), ("start_s", start_s), ("end_s", end_s))})


#: Type of the titles of a plan.
TITLES = "array<struct<kind:string,text:string,duration_s:double,at_s:double>>"


def add_title(plans: DataFrame, kind: str = "intro", text: str = "", duration_s: float = 2.0, at_s: float | None = None) -> DataFrame:
    """``plans`` with one more title in ``titles``; null titles count as none."""
    row = F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"), F.lit(float(duration_s)).alias("duration_s"), F.lit(at_s).cast("double").alias("at_s"))
    return plans.withColumn("titles", F.array_append(F.coalesce("titles", F.array().cast(TITLES)), row))


def set_header(plans: DataFrame, path: str, value, header: str = "header") -> DataFrame:
    """Set a dotted path of the ``header`` struct; a path that isn't there is refused."""
    at = plans.schema[header].dataType
    for name in path.split("."):
        if not hasattr(at, "names") or name not in at.names:
            raise ValueError(f"unknown path {path!r}")
        at = at[name].dataType
    return plans.withColumn(header, F.col(header).withField(path, F.lit(value).cast(at)))


def set_path(entries: DataFrame, path: str, value) -> DataFrame:
    """``entries[3].speed``: one field of the entry at a position; other forms are refused."""
    found = re.fullmatch(r"entries\[(\d+)\]\.(\w+)", path)
    if not found:
        raise ValueError(f"unknown path {path!r}")
    return set_field(entries, int(found[1]), found[2], value)


OPS = {"set_path": set_path, "exclude_source": exclude_source, "set": set_field, "swap": swap, "pin": pin}


def apply(entries: DataFrame, ops: Sequence[tuple[str, dict]]) -> DataFrame:
    """The edits from left to right; an unknown one is refused. Positions are renumbered from 0 first."""
    out = renumbered(entries)
    for name, args in ops:
        if name not in OPS:
            raise ValueError(f"unknown edit {name!r}")
        out = OPS[name](out, **args)
    return out


def version_id(plan_id: str, ops: Sequence[tuple[str, dict]]) -> str:
    """Content id of an edited plan."""
    return hashlib.sha1((plan_id + json.dumps([[n, a] for n, a in ops], sort_keys=True)).encode()).hexdigest()[:12]


def anchored(start: Column, end: Column, tags_ms: Column, need: Column, duration: Column) -> Column:
    """Start of a moment so that its first tag lies at 40 % of the needed time; unchanged without a tag in the window."""
    tag = F.try_element_at(F.filter(F.transform(tags_ms, lambda t: t / 1000.0), lambda t: (t >= start) & (t <= end)), F.lit(1))
    return F.when(tag.isNull() | (need <= 0), start).otherwise(F.greatest(F.lit(0.0), F.least(tag - need * 0.4, F.greatest(F.lit(0.0), duration - need))))


def titles(total: Column, length: float = 3.0, at: float = 5.0) -> Column:
    """Start times of the intro, outro and a placed title."""
    row = lambda k, v: F.struct(F.lit(k).alias("kind"), v.cast("double").alias("at_s"))
    return F.array(row("intro", F.lit(0.0)), row("outro", F.greatest(F.lit(0.0), total - length)), row("at", F.lit(at)))
