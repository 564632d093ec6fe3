"""Queries over the events as keyed series, and song sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import segments, signals
from lumenframe.session import table
from lumenframe.streaming import progress

_T = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1000000.0D"


def events_of(spark: SparkSession, d: str) -> DataFrame:
    """Events with ``t``, seconds since the first day, and ``pos`` per user."""
    e = table(spark, d, "events").withColumn("t", F.expr(_T))
    return signals.ordered(e, "user_id", "ts", "event_id")


def bin_mean_fixed(spark: SparkSession, d: str) -> DataFrame:
    return signals.bin_fixed(events_of(spark, d), "user_id", "pos", "value", 8).select("user_id", "bin", F.round("value", 6).alias("value"))


def bin_max_fixed(spark: SparkSession, d: str) -> DataFrame:
    return signals.bin_fixed(events_of(spark, d), "user_id", "pos", "value", 8, "max").select("user_id", "bin", F.round("value", 6).alias("value"))


def bin_pairs(spark: SparkSession, d: str) -> DataFrame:
    return signals.bin_every(events_of(spark, d), "user_id", "pos", "value").select("user_id", "bin", F.round("value", 6).alias("value"))


def tumbling_mean_norm(spark: SparkSession, d: str) -> DataFrame:
    x = signals.tumbling_mean(table(spark, d, "events").withColumn("t", F.expr(_T)), "user_id", F.col("t"), "value", 86400.0)
    return x.select("user_id", F.col("bin").cast("bigint").alias("bin"), F.round("mean", 6).alias("mean"), F.round("norm", 6).alias("norm"))


def song_lengths(spark: SparkSession, d: str) -> DataFrame:
    """``(song, duration_s, n)``: each event type as a song whose seconds are the hours up to its last event, and their number."""
    hours = F.max(F.expr(_T) / 3600)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("song")).agg(hours.alias("duration_s"), (F.floor(hours) + 1).alias("n"))


def energy(spark: SparkSession, d: str) -> DataFrame:
    """One curve per event type: hourly sums over the largest, without gaps."""
    x = table(spark, d, "events").withColumn("sec", F.floor(F.expr(_T) / 3600)).groupBy(F.col("event_type").alias("song"), "sec").agg(F.sum("value").alias("v"))
    songs = x.groupBy("song").agg(F.max("sec").alias("top")).select("song", F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("sec"))
    full = songs.join(x, ["song", "sec"], "left").select("song", "sec", F.coalesce("v", F.lit(0.0)).alias("v"))
    top = full.groupBy("song").agg(F.max("v").alias("top"))
    return full.join(top, "song").select("song", "sec", F.round(F.col("v") / F.col("top"), 9).alias("e"))


def downsample_curve(spark: SparkSession, d: str) -> DataFrame:
    curve = energy(spark, d).groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct("sec", "e"))), lambda x: x["e"]).alias("c"))
    return curve.select("song", F.posexplode(signals.downsample(F.col("c"), 50)).alias("bucket", "value")).select("song", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value"))


def locf_ema(spark: SparkSession, d: str) -> DataFrame:
    """Acceleration of each clip, smoothed; a second that wasn't measured has the last known value."""
    c = table(spark, d, "clips").dropDuplicates(["clip_id"]).where("accl is not null")
    return c.select("clip_id", F.posexplode(signals.fill_and_smooth(F.col("accl"))).alias("sec", "value")).select("clip_id", F.col("sec").cast("bigint").alias("sec"), F.round("value", 5).alias("value"))


def long_signals(spark: SparkSession, d: str) -> DataFrame:
    x = signals.long_signals(table(spark, d, "clips").dropDuplicates(["clip_id"]), "clip_id", ["motion", "audio", "voice"])
    return x.groupBy("clip_id", "name").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    s = segments.sessions(table(spark, d, "events").withColumn("t", F.expr(_T)), ["user_id"], "t", "event_id", 3600.0)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.round(F.max("t") - F.min("t"), 3).alias("length_s"))


def run_length_sections(spark: SparkSession, d: str) -> DataFrame:
    x = events_of(spark, d).select("user_id", "pos", "event_type", "value")
    return segments.run_lengths(x, "user_id", "pos", "event_type", "value").select("user_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("label"), "top")


def detect_sections(spark: SparkSession, d: str) -> DataFrame:
    return segments.sections(energy(spark, d), "song", song_lengths(spark, d)).select("song", F.col("section_pos").cast("bigint").alias("section_pos"), "kind", "start_s", "end_s", F.round("intensity", 6).alias("intensity"))


def pair_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of one user paired when at most two hours apart and next to each other."""
    e = table(spark, d, "events").withColumn("t", F.expr(_T)).withColumn("next_t", F.expr("lead(t) over (partition by user_id order by ts, event_id)")).withColumn("next_type", F.expr("lead(event_type) over (partition by user_id order by ts, event_id)"))
    ok = (F.col("event_type") == F.col("next_type")) & (F.col("next_t") - F.col("t") <= 43200)
    return segments.pair_adjacent(e, ["user_id"], ["ts", "event_id"], ok).where("pair is not null").select("user_id", "event_id", "pair")


def progress_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Events as ticks of a job per user: the type stands for the stage, the value for the fraction."""
    stage = F.expr("case event_type when 'view' then 'analyze' when 'click' then 'score' when 'purchase' then 'prerender' when 'signup' then 'assemble' else 'mux' end")
    x = events_of(spark, d).withColumn("stage", stage)
    x = x.withColumn("percent", progress.overall(F.col("stage"), F.col("pos") % 5, F.lit(5), F.col("value") / 50 - 0.2))
    x = progress.monotone_progress(x, "user_id", "pos", "percent")
    return x.select("user_id", "event_id", F.round("percent", 6).alias("percent"), F.round("shown", 6).alias("shown"), F.round(progress.eta(F.col("t"), F.col("shown")), 3).alias("eta_s"))


def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    x = progress.tumbling_events(table(spark, d, "events"), "ts", "event_type", "value", "6 hours")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (bin_mean_fixed, bin_max_fixed, bin_pairs, tumbling_mean_norm, downsample_curve, locf_ema, long_signals, sessions, run_length_sections, detect_sections, pair_adjacent, progress_weighted, tumbling_events)}

_E = "ev as (select *, epoch(ts - timestamp '2024-01-01 00:00:00') as t, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)"
_BIN = f"""with {_E}, s as (select user_id, max(pos) + 1 as n from ev group by 1), p as (select ev.user_id, pos // greatest(1, n // 8) as bin, value, greatest(1, n // 8) as w from ev join s using (user_id)),
g as (select user_id, bin, {{agg}} as v from p where bin < 8 group by user_id, bin, w) select f.user_id, f.bin, round(coalesce(g.v, 0), 6) as value from (select user_id, unnest(range(0, 8)) as bin from s) f left join g using (user_id, bin)"""
ENERGY_SQL = """h as (select event_type as song, cast(floor(epoch(ts - timestamp '2024-01-01 00:00:00') / 3600) as bigint) as sec, sum(value) as v from events group by 1, 2),
fu as (select s.song, s.sec, coalesce(h.v, 0) as v from (select song, unnest(range(0, top + 1)) as sec from (select song, max(sec) as top from h group by 1)) s left join h using (song, sec)),
en as (select song, sec, round(v / max(v) over (partition by song), 9) as e from fu)"""
SECTIONS_SQL = f"""{ENERGY_SQL}, rk as (select *, row_number() over (partition by song order by e, sec) as r, count(*) over (partition by song) as n from en),
md as (select *, max(case when r = n // 2 + 1 then e end) over (partition by song) as med from rk),
io as (select song, sec, e, n, med, least(min(case when e >= med then sec end) over (partition by song), 12, n) as ie, least(n - 1 - max(case when e >= med then sec end) over (partition by song), 12) as tl, max(e) over (partition by song) as emax,
  coalesce(avg(e) over (partition by song order by sec rows between 4 preceding and 1 preceding), e) as pm, coalesce(lead(e) over (partition by song order by sec) - e <= 0, true) as flat from md),
dr as (select *, case when tl >= 4 then n - tl else n end as os from io),
d1 as (select *, sec >= ie and sec < os and e >= med * 1.4 and pm > 0 and (e - pm) / greatest(pm, 1e-6) >= 0.5 as dp from dr),
sp as (select song, sec, sum(nw) over (partition by song order by sec) as g from (select song, sec, case when sec - lag(sec) over (partition by song order by sec) <= 3 then 0 else 1 end as nw from d1 where dp)),
spans as (select song, min(sec) as s0, max(sec) + 1 as s1 from sp group by song, g),
bd as (select s.song, s.s0, greatest(max(d.ie), s.s0 - 8, coalesce(max(case when d.flat and d.sec < s.s0 then d.sec end), -1) + 1) as b0 from spans s join d1 d using (song) group by s.song, s.s0),
lb as (select d.song, d.sec, d.e, d.emax, case when d.emax <= 0 then 'verse' when d.sec >= d.os then 'outro' when exists (select 1 from spans s where s.song = d.song and d.sec >= s.s0 and d.sec < s.s1) then 'drop'
  when exists (select 1 from bd b where b.song = d.song and b.s0 - b.b0 >= 4 and d.sec >= b.b0 and d.sec < b.s0) then 'build' when d.sec < d.ie then 'intro' else 'verse' end as label from d1 d),
rn as (select *, sum(case when label = pl then 0 else 1 end) over (partition by song order by sec) as g from (select *, lag(label) over (partition by song order by sec) as pl from lb)),
du as (select event_type as song, max(epoch(ts - timestamp '2024-01-01 00:00:00')) / 3600 as dur from events group by 1),
s9 as (select song, row_number() over (partition by song order by min(sec)) - 1 as section_pos, min(label) as kind, min(sec)::double as start_s, (max(sec) + 1)::double as end_s, case when max(emax) > 0 then max(e) / max(emax) else 0 end as intensity from rn group by song, g),
se as (select song, section_pos, kind, start_s, case when lead(start_s) over (partition by song order by start_s) is null and dur > start_s then dur else end_s end as end_s, intensity from s9 join du using (song))"""

SQL = {
    "bin_mean_fixed": _BIN.format(agg="sum(value) / w"),
    "bin_max_fixed": _BIN.format(agg="max(value)"),
    "bin_pairs": f"with {_E} select user_id, pos // 2 as bin, round(avg(value), 6) as value from ev group by 1, 2",
    "tumbling_mean_norm": f"with {_E}, g as (select user_id, cast(floor(t / 86400) as bigint) as bin, avg(value) as mean from ev group by 1, 2) select user_id, bin, round(mean, 6) as mean, round(case when max(mean) over (partition by user_id) > 0 then mean / max(mean) over (partition by user_id) else mean end, 6) as norm from g",
    "downsample_curve": f"with {ENERGY_SQL}, b as (select song, n / 50.0::double as w, unnest(range(0, 50)) as bucket from (select song, count(*) as n from en group by 1)) select b.song, b.bucket, round(greatest(0, least(1, avg(en.e))), 6) as value from b join en on en.song = b.song and en.sec >= floor(b.bucket * w) and en.sec < greatest(floor(b.bucket * w) + 1, floor((b.bucket + 1) * w)) group by 1, 2",
    "locf_ema": """with c as (select * from (select *, row_number() over (partition by clip_id) as rn_ from clips) where rn_ = 1 and accl is not null), e as (select clip_id, unnest(accl) as v, unnest(range(0, len(accl))) as sec from c),
      x as (select clip_id, sec, coalesce(last_value(v ignore nulls) over (partition by clip_id order by sec), 0.5) as v from e)
      select a.clip_id, a.sec, round(sum(case when b.sec = 0 then pow(0.6, a.sec) else 0.4 * pow(0.6, a.sec - b.sec) end * b.v), 5) as value from x a join x b on b.clip_id = a.clip_id and b.sec <= a.sec group by 1, 2""",
    "long_signals": "with c as (select * from (select *, row_number() over (partition by clip_id) as rn_ from clips) where rn_ = 1), l as (select clip_id, 'motion' as name, unnest(motion) as v from c union all select clip_id, 'audio', unnest(audio) from c union all select clip_id, 'voice', unnest(voice) from c) select clip_id, name, count(v) as n, round(avg(v), 6) as mean from l group by 1, 2",
    "sessions": f"with {_E}, s as (select *, sum(case when t - p <= 3600 then 0 else 1 end) over (partition by user_id order by t, event_id) as session from (select *, lag(t) over (partition by user_id order by t, event_id) as p from ev)) select user_id, session, count(*) as n, min(event_id) as first_event, round(max(t) - min(t), 3) as length_s from s group by 1, 2",
    "run_length_sections": f"with {_E}, s as (select *, sum(case when event_type = p then 0 else 1 end) over (partition by user_id order by pos) as g from (select *, lag(event_type) over (partition by user_id order by pos) as p from ev)) select user_id, min(pos) as start, max(pos) + 1 as \"end\", min(event_type) as label, max(value) as top from s group by user_id, g",
    "detect_sections": f"with {SECTIONS_SQL} select song, section_pos, kind, start_s, end_s, round(intensity, 6) as intensity from se",
    "pair_adjacent": f"""with {_E}, l as (select *, coalesce(event_type = lead(event_type) over w and lead(t) over w - t <= 43200, false) as lk from ev window w as (partition by user_id order by ts, event_id)),
      r as (select *, sum(case when plk then 0 else 1 end) over (partition by user_id order by ts, event_id) as run from (select *, coalesce(lag(lk) over (partition by user_id order by ts, event_id), false) as plk from l)),
      n as (select *, row_number() over (partition by user_id, run order by ts, event_id) as k from r), f as (select *, sum(case when k % 2 = 1 and lk then 1 else 0 end) over (partition by user_id order by ts, event_id) as no from n)
      select user_id, event_id, no as pair from f where (k % 2 = 1 and lk) or k % 2 = 0""",
    "progress_weighted": f"""with {_E}, p as (select *, (greatest(pos % 5, 1) - 1 + greatest(0.0, least(1.0, value / 50 - 0.2))) / 5 as wi from ev), q as (select *, least(100.0, case event_type when 'view' then wi when 'click' then 1 + wi when 'purchase' then 2 + 75 * wi when 'signup' then 77 + 18 * wi else 95 + 5 * wi end) as pc from p),
      s as (select *, max(pc) over (partition by user_id order by pos) as sh from q) select user_id, event_id, round(pc, 6) as percent, round(sh, 6) as shown, round(case when sh > 1 then t / (sh / 100) * (1 - sh / 100) end, 3) as eta_s from s""",
    "tumbling_events": "select strftime(time_bucket(interval '6 hours', ts, timestamp '2024-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
