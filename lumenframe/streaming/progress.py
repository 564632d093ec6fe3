"""Progress blocks, weighted progress and windowed events: batch forms and their streaming twins."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Share of each stage in the whole, in per cent, and the keys of progress lines that hold numbers.
STAGE_WEIGHTS = {"analyze": 1.0, "score": 1.0, "prerender": 75.0, "assemble": 18.0, "mux": 5.0}
INTEGERS = ["frame", "fps", "bitrate", "total_size", "out_time_us", "out_time_ms", "dup_frames", "drop_frames"]
NUMBERS = ["speed"]


def progress_blocks(lines: DataFrame, job: str, seq: str, line: str) -> DataFrame:
    """``(job, block, fields map<string,string>)`` of ``key=value`` lines: a block ends with its ``progress=`` line; a block without one at the end counts too."""
    w = Window.partitionBy(job).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    x = lines.where(F.col(line).contains("=")).withColumn("block", F.coalesce(F.sum(F.when(F.col(line).startswith("progress="), 1).otherwise(0)).over(w), F.lit(0)))
    x = x.withColumns({"k": F.trim(F.substring_index(line, "=", 1)), "v": F.trim(F.regexp_replace(line, "^[^=]*=", ""))})
    x = x.groupBy(job, "block", "k").agg(F.max_by("v", seq).alias("v"))
    return x.groupBy(job, "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))


def typed_fields(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``integers``, ``numbers`` and ``texts``: the fields by the kind of their key; ``N/A``, empty and unreadable values are null.

    Integers that are written as decimals are cut; a number may end in ``x``.
    """
    known = lambda v: F.when(~v.isin("N/A", ""), v)
    part = lambda keep: F.filter(F.map_entries("fields"), lambda e: keep(e["key"]))
    typed = lambda entries, value: F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(known(e["value"])).alias("value"))))
    whole = lambda v: F.coalesce(v.try_cast("bigint"), F.when(F.abs(v.try_cast("double")) < 9e18, v.try_cast("double")).cast("bigint"))
    return blocks.withColumns({
        "integers": typed(part(lambda k: k.isin(INTEGERS)), whole),
        "numbers": typed(part(lambda k: k.isin(NUMBERS)), lambda v: F.regexp_replace(v, "x+$", "").try_cast("double")),
        "texts": typed(part(lambda k: ~k.isin(INTEGERS + NUMBERS)), lambda v: v),
    })


def progress_block_stream(lines: DataFrame, job: str, seq: str, line: str) -> DataFrame:
    """Streaming twin of ``progress_blocks``: ``(job, fields)`` of each block when its ``progress=`` line has come; what was read of the next one is kept as state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block = json.loads(state.get[0]) if state.exists else {}
        done = []
        for text in pd.concat(list(batches)).sort_values(seq)[line]:
            if not text or "=" not in text:
                continue
            name, _, value = (x.strip() for x in text.partition("="))
            block[name] = value
            if name == "progress":
                done.append(json.dumps(block))
                block = {}
        state.update((json.dumps(block),))
        yield pd.DataFrame({job: [key[0]] * len(done), "fields": done})

    kind = dict(lines.dtypes)[job]
    out = lines.groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, fields string", "block string", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("fields", F.from_json("fields", "map<string,string>"))


def overall(stage: Column, index: Column, total: Column, fraction: Column) -> Column:
    """Progress in per cent over all stages; a fraction beyond [0, 1] counts as its end, an unknown stage as 0."""
    out, done = F.lit(0.0), 0.0
    within = (F.greatest(index, F.lit(1)) - 1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))) / F.greatest(total, F.lit(1))
    for name, weight in STAGE_WEIGHTS.items():
        out = F.when(stage == name, F.lit(done) + F.lit(weight) * within).otherwise(out)
        done += weight
    return F.least(out, F.lit(100.0))


def monotone_progress(ticks: DataFrame, job: str, seq: str, value: str) -> DataFrame:
    """``ticks`` with ``shown``: the largest value so far."""
    w = Window.partitionBy(job).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ticks.withColumn("shown", F.max(value).over(w))


def eta(elapsed: Column, percent: Column) -> Column:
    """Seconds left as ``elapsed / p * (1 - p)``, unknown up to 1 %."""
    p = percent / 100
    return F.when(percent > 1, elapsed / p * (1 - p))


def monotone_progress_stream(ticks: DataFrame, job: str, value: str) -> DataFrame:
    """Streaming twin of ``monotone_progress``: ``(job, shown)`` after each batch, the largest value a job has reached."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else float("-inf")
        for b in batches:
            top = max(top, float(b[value].max()))
        state.update((top,))
        yield pd.DataFrame({job: [key[0]], "shown": [top]})

    kind = dict(ticks.dtypes)[job]
    return ticks.groupBy(job).applyInPandasWithState(keep, f"{job} {kind}, shown double", "top double", "update", GroupStateTimeout.NoTimeout)


def tumbling_events(events: DataFrame, t: str, kind: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per window and kind; with ``late`` (streams) rows later than the watermark are dropped and
    zone-less times are taken in the session's zone."""
    x = events.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late) if late else events
    return x.groupBy(F.window(t, width).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def session_events(events: DataFrame, t: str, key: str, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """Sessions per key: rows at most ``gap`` apart."""
    x = events.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late) if late else events
    return x.groupBy(F.session_window(t, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("start"), F.max(t).alias("stop")).select(key, "start", "stop", "n")
