"""Queries from candidates to the entries of plans: one plan per folder, cut to one of the songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import array_mean, seeded_index
from lumenframe.operators import edits, graph, planning, segments, signals, timeline
from lumenframe.plans.relations import _BEATS, _C, _DUP, _K, _beats, _bursts, _cands, _clips, dup_components
from lumenframe.plans.series import SECTIONS_SQL, energy, song_lengths
from lumenframe.plans.timeline import _LINES
from lumenframe.session import Written, table

_CLIP = ["file", "folder", "clip_id", "captured_at", "duration_s"]


def _songs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``(song, number, duration_s, intro_end_s)`` of the few songs, and ``(song, sections)`` as arrays."""
    s = segments.sections(energy(spark, d), "song", song_lengths(spark, d))
    s = s.groupBy("song").agg(F.array_sort(F.collect_list(F.struct("section_pos", "kind", "start_s", "end_s"))).alias("sections"))
    s = Written(s, "sections").df
    intro = F.try_element_at("sections", F.lit(1))
    songs = song_lengths(spark, d).join(s, "song").select("song", "duration_s", F.when(intro["kind"] == "intro", intro["end_s"]).otherwise(0.0).alias("intro_end_s"))
    return songs.withColumn("number", F.expr("row_number() over (order by song) - 1")), s


def _plans(spark: SparkSession, d: str, songs: DataFrame) -> DataFrame:
    """``(folder, song, intro_end_s, target_s)``: which song each folder's plan is cut to, and its length."""
    n = songs.count()
    f = table(spark, d, "clips").where("folder is not null").select("folder").distinct()
    f = f.withColumns({"number": seeded_index(F.col("folder"), n), "wanted": (40 + 20 * seeded_index(F.col("folder"), 7)).cast("double")})
    return f.join(songs, "number").select("folder", "song", "intro_end_s", planning.target_length(F.col("duration_s"), F.when(F.col("wanted") < 150, F.col("wanted"))).alias("target_s"))


def _slots(spark: SparkSession, d: str, plans: DataFrame, pace: str = "medium") -> DataFrame:
    longest = plans.agg(F.max("target_s")).first()[0] or 0.0
    beats = _beats(spark, d).where(F.col("t") < longest)
    if pace == "auto":
        curve = energy(spark, d).select("song", F.col("sec").alias("s"), timeline.band_factor(F.col("e")).alias("factor"))
        beats = beats.withColumn("s", F.floor("t")).join(curve, ["song", "s"]).drop("s")
    return planning.cut_points(plans.select("folder", "song").join(beats, "song").drop("song"), plans, "folder", pace)


def plan_slots(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the plans at a slow pace."""
    plans = _plans(spark, d, _songs(spark, d)[0])
    x = _slots(spark, d, plans, "slow")
    return x.select("folder", F.col("slot").cast("bigint").alias("slot"), F.round("t", 6).alias("t"), F.round("next_t", 6).alias("next_t"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    """The scored candidates with their clip, without those of clips that a burst or a better near-duplicate suppresses."""
    gone = _bursts(spark, d).where("suppressed").select("file")
    c = _cands(spark, d).where("score is not null and not isnan(score)").join(_clips(spark, d).select(*_CLIP).hint("merge"), "file").join(gone.hint("merge"), "file", "left_anti")
    c = c.join(Written(dup_components(spark, d).select("clip_id", "root"), "roots").df.hint("merge"), "clip_id", "left")
    return graph.keep_best(c, "root", "score", "cand_pos", "file")


def _picked(spark: SparkSession, d: str, plans: DataFrame, slots: DataFrame) -> DataFrame:
    """The candidates that win slots: up to two moments a clip by its length, each clip once unless that leaves the plan short."""
    kept = _survivors(spark, d).select("folder", "file", "cand_pos", "score", "start_s", "end_s", "reasons", "src_fps", "captured_at", "duration_s")
    return planning.allocate(kept, slots, "folder", "file", "score", "cand_pos", segments.moment_budget(F.col("duration_s"), 2))


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    songs, sections = _songs(spark, d)
    plans = Written(_plans(spark, d, songs), "plans").df
    slots = Written(_slots(spark, d, plans), "slots").df
    picks = _picked(spark, d, plans, slots).withColumn("captured_at", F.when(F.col("captured_at").between(1, 4e9), F.col("captured_at")))
    x = planning.bound_to_beats(timeline.trailer_order(picks, "folder", "captured_at", "file", "score", "cand_pos").drop("duration_s"), slots, "folder")
    x = Written(x, "placed").df  # a plan of all steps at once would fill much of the driver's memory
    clips = _clips(spark, d)
    luma = signals.upper_medians(clips.select("folder", array_mean(F.col("exposure")).alias("mean")), "folder", "mean").withColumnRenamed("median", "target_luma")
    x = x.join(clips.select("file", "duration_s", "tags_ms", "voice", "gyro", "exposure", "width", "height").hint("merge"), "file").join(plans, "folder").join(sections, "song").join(luma, "folder", "left")
    at = lambda s: (s["start_s"] <= F.col("beat_s")) & (F.col("beat_s") < s["end_s"])
    opening = lambda s: (s["kind"] == "drop") & (s["start_s"] <= F.col("beat_s")) & (F.col("beat_s") - s["start_s"] < 1.0)
    beat = F.col("beat_s") / 2.8
    x = x.withColumns({"kind": F.coalesce(F.try_element_at(F.filter("sections", at), F.lit(1))["kind"], F.lit("verse")), "drop_start": F.try_element_at(F.filter("sections", opening), F.lit(1))["start_s"], "downbeat": F.abs(beat - F.round(beat)) * 2.8 < planning.DOWNBEAT_S})
    return planning.filled(planning.assemble(x, stabilize=True), "folder", "pos", "all_slots", "target_s")


def plan_entries(spark: SparkSession, d: str) -> DataFrame:
    """The entries of every plan, from the candidates: bursts and near-duplicates suppressed, moments budgeted and allocated, ordered as a trailer, bound to beats, assembled and stretched."""
    names = ("start_s", "end_s", "out_duration_s", "beat_s", "score", "audio_interest", "luma_offset")
    return _assembled(spark, d).select("folder", F.col("pos").cast("bigint").alias("pos"), "cand_pos", *[F.round(c, 5).alias(c) for c in names], "speed_start", "speed_end", "stabilize", "source_width", "source_height", "fade_out_s")


def render_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Per order line as an entry: collapsed ramps, the native length, the padding, muting, tempo and tail fade."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("src"), (1 - F.col("l_discount")).alias("a"), (1 + F.col("l_tax") - 0.02).alias("b"), (F.col("l_partkey") % 100 / 100.0).alias("interest"))
    x = x.withColumn("r", planning.ramp_speeds(F.col("a"), F.col("b"))).withColumn("native", planning.native_length(F.col("src"), F.col("r.from"), F.col("r.to")))
    x = x.withColumn("p", planning.audio_plan(F.col("interest"), F.col("a") * 0.55, F.col("src") * 10))
    return x.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in ((F.col("r.from"), "speed_from"), (F.col("r.to"), "speed_to"), (F.col("native"), "native_s"), (planning.pad_length(F.lit(2.5), F.col("native")), "pad_s"), (F.col("p.tempo"), "tempo"), (F.col("p.tail_fade"), "tail_fade_s"))], F.col("p.muted").alias("muted"))


def crop_path(spark: SparkSession, d: str) -> DataFrame:
    """Crop windows of upright frames that follow the exposure of a clip as if it were a face's place."""
    c = _clips(spark, d).where("width > 0 and height > 0 and exposure is not null").select("clip_id", "width", "height", F.transform("exposure", lambda e: F.when(e < 0.6, e)).alias("centres"))
    left = planning.crop_left(F.col("centres"), F.col("width"), F.col("height"), 9 / 16)
    return c.select("clip_id", F.posexplode(left).alias("sec", "x")).select("clip_id", F.col("sec").cast("bigint").alias("sec"), F.round("x", 3).alias("x"))


def target_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Plan lengths when each clip's duration is a song's, which may be missing or not a number, and its place what is wanted."""
    c = _clips(spark, d)
    return c.select("clip_id", planning.target_length(F.col("duration_s"), F.when(F.col("clip_pos") % 3 == 0, F.col("clip_pos").cast("double"))).alias("target_s"))


def raised_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps per source of each folder when 200 slots are to be filled without budgets."""
    n = _clips(spark, d).groupBy("folder").agg(F.count(F.lit(1)).alias("sources"))
    return n.select("folder", planning.raised_cap(F.col("sources"), F.lit(200)).cast("bigint").alias("cap"))


def rendered_entries(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each order that were rendered (not returned), renumbered."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.expr(_LINES).alias("pos"), F.col("l_quantity").alias("out_s"), "l_returnflag")
    kept, total = planning.rendered(x.drop("l_returnflag"), x.select("plan", "pos", (F.col("l_returnflag") != "R").alias("ok")), "plan", "pos", "out_s")
    return kept.join(total, "plan").select("plan", F.col("pos").cast("bigint").alias("pos"), "out_s", F.round("total_s", 4).alias("total_s"))


def edited_header(spark: SparkSession, d: str) -> DataFrame:
    """Plan headers of the customers with two titles added and two fields set, one of them nested."""
    h = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"), F.struct(F.lit(-8.0).alias("music_db"), F.struct(F.col("c_acctbal").alias("target_s"), F.lit("medium").alias("pace")).alias("options")).alias("header"), F.array().cast(edits.TITLES).alias("titles"))
    h = edits.set_header(edits.set_header(h, "music_db", -12.0), "options.pace", "slow")
    h = edits.add_title(edits.add_title(h, "intro", "Hello"), "outro", "Bye", 3.0, 9.0)
    return h.select("plan", "header.music_db", "header.options.target_s", "header.options.pace", F.array_join(F.transform("titles", lambda t: F.concat_ws("|", t["kind"], t["text"], t["duration_s"].cast("string"), F.coalesce(t["at_s"].cast("string"), F.lit("-")))), ";").alias("titles"))


QUERIES = {f.__name__: f for f in (plan_slots, plan_entries, render_arithmetic, crop_path, target_lengths, raised_caps, rendered_entries, edited_header)}

_SEED = "(('0x' || substr(sha1({x}), 1, 8))::UBIGINT % {n})"
_PL = f"""{SECTIONS_SQL}, {_BEATS}, sn as (select du.song, dur, coalesce(max(case when section_pos = 0 and kind = 'intro' then end_s end), 0.0) as intro_end, row_number() over (order by du.song) - 1 as number from du join se on se.song = du.song group by du.song, dur),
pl as (select f.folder, sn.song, sn.intro_end, least(case when dur > 0 then dur else 90 end, case when w < 150 then w else 1e9 end) as target
  from (select distinct folder, {_SEED.format(x='folder', n='(select count(*) from sn)')} as number, 40.0::double + 20 * {_SEED.format(x='folder', n=7)} as w from clips where folder is not null) f join sn on sn.number = f.number),
pb as (select pl.folder, pl.target, be.i, be.t, be.t >= pl.intro_end as aft, max(case when be.t >= pl.intro_end and be.t < (select max(target) from pl) then 1 else 0 end) over (partition by pl.folder) as anya from pl join be on be.song = pl.song where be.t < (select max(target) from pl)),
pr as (select *, row_number() over (partition by folder order by i) - 1 as r from pb where aft or anya = 0)"""
_SL = "sl as (select folder, row_number() over (partition by folder order by i) - 1 as slot, t, coalesce(lead(t) over (partition by folder order by i), target) as next_t from pr where r % {n} = 0 and t < target)"

SQL = {
    "plan_slots": f"with {_PL}, {_SL.format(n=4)} select folder, slot, round(t, 6) as t, round(next_t, 6) as next_t from sl",
    "plan_entries": f"""with recursive {_DUP}, {_K}, {_PL}, {_SL.format(n=2)}, bs as (select file, max(score) as score from k where not isnan(score) group by 1),
      b0 as (select c.folder, c.source, c.file, case when captured_at between 1 and 4e9 then captured_at end as t, bs.score from c join bs on bs.file = c.file),
      b1 as (select *, sum(case when t - p <= 86400 then 0 else 1 end) over (partition by folder order by t, source) as ses from (select *, lag(t) over (partition by folder order by t, source) as p from b0 where t is not null)),
      b2 as (select *, row_number() over (partition by folder, ses order by score desc, t, source) > 1 as lost from b1), b3 as (select folder, count(*) as n, avg(case when lost then 1.0 else 0 end) as sh from b2 group by 1),
      cd as (select k.*, c.folder, c.clip_id, case when c.captured_at between 1 and 4e9 then c.captured_at end as cap_at, c.duration_s, ro.root from k join c on c.file = k.file left join ro on ro.id = c.clip_id
        where k.score is not null and not isnan(k.score) and k.file not in (select file from b2 join b3 using (folder) where lost and not (n >= 3 and sh > 0.5))),
      kb as (select * from (select *, first_value(file) over (partition by root order by score desc, cand_pos) as o from cd) where root is null or file = o),
      ow as (select * from (select *, row_number() over (partition by folder, file order by score desc, cand_pos) as own, case when duration_s is null or isnan(duration_s) or duration_s <= 4 then 1 else least(2, greatest(1, ceil(duration_s / 10))) end as budget from kb where end_s - start_s >= 0.4) where own <= 2 and own <= budget),
      ns as (select folder, count(*) as alls, count(*) filter (where next_t - t >= 0.4) as opens from sl group by 1), nh as (select folder, count(*) filter (where own = 1) as st, count(*) as lo from ow group by 1),
      nn as (select folder, alls, opens, least(st, opens) < floor(alls * 0.85) and least(lo, opens) > least(st, opens) as raised from ns join nh using (folder)),
      pk as (select *, row_number() over (partition by ow.folder order by score desc, cand_pos) - 1 as pick from ow join nn using (folder) where raised or own = 1), p1 as (select * from pk where pick < opens),
      ch as (select *, row_number() over (partition by folder order by cap_at nulls last, file, cand_pos) as cp, count(*) over (partition by folder) as n, row_number() over (partition by folder order by score desc, cand_pos) as r from p1),
      bk as (select *, case when n < 8 then 1 when r = 1 then 0 when r <= 1 + greatest(1, n // 4) then 2 else 1 end as b from ch), tr as (select *, row_number() over (partition by folder order by b, case when b = 1 then cp else r end) - 1 as pos from bk),
      os as (select folder, t as beat, next_t - t as gap, row_number() over (partition by folder order by slot) - 1 as pos from sl where next_t - t >= 0.4),
      lm as (select folder, mean as target_luma from (select folder, mean, row_number() over (partition by folder order by mean) as r, count(*) over (partition by folder) as n from (select folder, list_avg(list_filter(exposure, lambda x: x is not null)) as mean from c) where mean is not null and not isnan(mean)) where r = n // 2 + 1),
      e0 as (select tr.folder, tr.pos, tr.cand_pos, tr.score, tr.reasons, tr.src_fps, tr.start_s, tr.end_s, tr.alls, pl.target, pl.song, os.beat, os.gap, c.tags_ms, c.voice, c.gyro, c.exposure, c.width, c.height, lm.target_luma, case when c.duration_s > 0 and not isnan(c.duration_s) then c.duration_s else tr.end_s end as dur
        from tr join os using (folder, pos) join c on c.file = tr.file join pl on pl.folder = tr.folder left join lm on lm.folder = tr.folder),
      e1 as (select *, (select kind from se where se.song = e0.song and se.start_s <= beat and beat < se.end_s order by section_pos limit 1) as kind, exists (select 1 from se where se.song = e0.song and se.kind = 'drop' and se.start_s <= beat and beat - se.start_s < 1) as slam from e0),
      e2 as (select *, case when kind = 'build' then 1.0 when src_fps is null or src_fps < 90 then 1.0 when slam then 0.4 when abs(beat / 2.8 - round(beat / 2.8)) * 2.8 < 0.1 and coalesce(list_has_any(reasons, ['high_accel_jump', 'motion_peak', 'hilight_tag']), false) then 0.4 else 1.0 end as s0, case when kind = 'build' then 1.15 else 1.0 end as s1 from e1),
      e3 as (select *, gap * s0 as need, list_filter(list_transform(tags_ms, lambda t: t / 1000.0), lambda t: t >= start_s and t <= end_s)[1] as tag from e2),
      e4 as (select *, case when coalesce(list_contains(reasons, 'hilight_tag'), false) and tag is not null and need > 0 then greatest(0, least(tag - 0.4 * need, greatest(0, dur - need))) else start_s end as st from e3),
      e5 as (select *, least(dur, st + need) as en_, cast(floor(st) as int) as lo, greatest(cast(floor(st) as int) + 1, cast(floor(least(dur, st + need) + 0.999) as int)) as hi from e4),
      e6 as (select *, list_filter(voice[lo + 1:hi], lambda x: x is not null) as vw, list_filter(gyro[lo + 1:hi], lambda x: x is not null) as gw, list_filter(exposure[lo + 1:hi], lambda x: x is not null) as xw, list_filter(gyro, lambda x: x is not null) as ga, list_filter(exposure, lambda x: x is not null) as xa from e5),
      e7 as (select *, list_sort(case when len(gw) > 0 then gw else ga end) as so, coalesce(list_avg(xw), list_avg(xa)) as light, row_number() over (partition by folder order by pos) - 1 as kk, count(*) over (partition by folder) as n from e6),
      f0 as (select *, case when n < alls then kk * (target / n) else beat end as bt, case when n < alls then target / n else gap end as od from e7), f1 as (select *, sum(od) over (partition by folder) as sm, first_value(bt) over (partition by folder order by pos) as fb from f0),
      f2 as (select *, sm > 0 and sm < target * 0.85 and least(4.0, target / n) > sm / n + 0.05 as sc from f1), f3 as (select *, case when sc then od * (least(4.0, target / n) / (sm / n)) else od end as od2 from f2),
      f4 as (select *, case when sc then fb + coalesce(sum(od2) over (partition by folder order by pos rows between unbounded preceding and 1 preceding), 0) else bt end as bt2, target - sum(od2) over (partition by folder) as sho, sum(case when kk >= n - 4 then od2 end) over (partition by folder) as tl from f3),
      f5 as (select *, sho > 0.5 and tl > 0 and kk >= n - 4 as mv from f4), f6 as (select *, case when mv then od2 * least(1.5, 1 + sho / tl) else od2 end as od3 from f5),
      f7 as (select *, case when mv then min(case when mv then bt2 end) over (partition by folder) + coalesce(sum(case when mv then od3 end) over (partition by folder order by pos rows between unbounded preceding and 1 preceding), 0) else bt2 end as bt3 from f6)
      select folder, pos, cand_pos, round(st, 5) as start_s, round(en_, 5) as end_s, round(od3, 5) as out_duration_s, round(bt3, 5) as beat_s, round(score, 5) as score, round(coalesce(list_avg(vw), voice[1], 0), 5) as audio_interest,
        round(coalesce(round(greatest(-0.08, least(0.08, (target_luma - light) * 0.5)), 4), 0), 5) as luma_offset, s0 as speed_start, s1 as speed_end, not coalesce(list_contains(reasons, 'gyro_spin'), false) and coalesce(so[len(so) // 2 + 1] >= 1.2, false) as stabilize,
        coalesce(width, 1920) as source_width, coalesce(height, 1080) as source_height, case when kk = n - 1 then round(least(1.0, od3 * 0.6), 3) end as fade_out_s from f7""",
    "render_arithmetic": """with x as (select l_orderkey, l_linenumber, l_quantity / 10 as src, 1 - l_discount as a, 1 + l_tax - 0.02 as b, (l_partkey % 100) / 100.0 as interest from lineitem),
      y as (select *, case when abs(a - b) <= 0.05 then (a + b) / 2 else a end as s0, case when abs(a - b) <= 0.05 then (a + b) / 2 else b end as s1 from x), z as (select *, src * (1 / greatest(s0, 0.0001) + 1 / greatest(s1, 0.0001)) / 2 as nat from y)
      select l_orderkey, l_linenumber, round(s0, 6) as speed_from, round(s1, 6) as speed_to, round(nat, 6) as native_s, round(greatest(0, 2.5 - nat), 6) as pad_s, round(greatest(0.5, least(2.0, a * 0.55)), 6) as tempo, round(greatest(0.2, least(1.5, src * 10 * 0.05)), 6) as tail_fade_s, interest < 0.35 as muted from z""",
    "crop_path": f"""with {_C}, e as (select clip_id, width::double as w, greatest(2, least(width::double, round(height * 0.5625::double))) as cr, unnest(exposure) as v, unnest(range(0, len(exposure))) as sec from c where width > 0 and height > 0 and exposure is not null and len(list_filter(exposure, lambda x: x < 0.6)) > 0),
      x as (select *, coalesce(last_value(case when v < 0.6 then v end ignore nulls) over (partition by clip_id order by sec), 0.5) as u from e),
      y as (select a.clip_id, a.sec, a.w, a.cr, sum(case when b.sec = 0 then pow(0.6, a.sec) else 0.4 * pow(0.6, a.sec - b.sec) end * b.u) as m from x a join x b on b.clip_id = a.clip_id and b.sec <= a.sec group by 1, 2, 3, 4)
      select clip_id, sec, round(greatest(0, least(w - cr, greatest(cr / 2, least(w - cr / 2, m * w)) - cr / 2)), 3) as x from y""",
    "target_lengths": f"with {_C}, x as (select clip_id, clip_pos, case when duration_s > 0 and not isnan(duration_s) then duration_s else 90 end as s from c) select clip_id, case when clip_pos % 3 = 0 then least(s, clip_pos) else s end::double as target_s from x",
    "raised_caps": f"with {_C}, n as (select folder, count(*) as n from c group by 1) select folder, case when n < 200 and (200 - n) / 200.0 > 0.2 then least(3, ceil(200.0 / n)) else 1 end::bigint as cap from n",
    "rendered_entries": f"with y as (select *, {_LINES} as place from lineitem), x as (select * from y where l_returnflag <> 'R') select l_orderkey as plan, row_number() over (partition by l_orderkey order by place) - 1 as pos, l_quantity as out_s, round(sum(l_quantity) over (partition by l_orderkey), 4) as total_s from x",
    "edited_header": "select c_custkey as plan, -12.0::double as music_db, c_acctbal as target_s, 'slow' as pace, 'intro|Hello|2.0|-;outro|Bye|3.0|9.0' as titles from customer",
}
