"""Queries of cut points, allocation, ordering, stretching, transitions and plan edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import array_mean, luma_offset as luma, present, upper_median
from lumenframe.operators import edits, joins, scoring, segments, signals, timeline
from lumenframe.plans.relations import _BEATS, _C, _K, _ON, _beats, _cands, _clips, _onsets
from lumenframe.plans.series import ENERGY_SQL, SECTIONS_SQL, energy, song_lengths
from lumenframe.session import table

SLOTS, SLOT_S, PER_SOURCE = 240, 0.5, 3
_LINES = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"


def _place():
    return F.expr(_LINES)



def plan_topk_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Orders as candidates of their customers: at most three each, the best 240 on a grid of half-second slots."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    best = timeline.fill_slots(o, SLOTS, "o_custkey", "o_totalprice", "o_orderkey", PER_SOURCE)
    return best.select(F.col("slot").cast("bigint").alias("slot"), (F.col("slot") * SLOT_S).alias("beat_s"), F.lit(SLOT_S).alias("out_s"), F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("cand_pos"), F.col("o_totalprice").alias("score"))


def topk_per_source(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return timeline.top_per_source(o, "o_custkey", "o_totalprice", "o_orderkey", PER_SOURCE)


def stride_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth beat from the eighth second on."""
    x = _beats(spark, d).where("t >= 8").withColumn("r", F.expr("row_number() over (partition by song order by i)"))
    return x.where("(r - 1) % 4 = 0").select("song", "i", "t")


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    b = _beats(spark, d).where("t >= 8").withColumn("sec", F.floor("t"))
    return b.join(energy(spark, d), ["song", "sec"]).select("song", "i", "t", timeline.band_factor(F.col("e")).alias("factor"))


def auto_cuts(spark: SparkSession, d: str) -> DataFrame:
    return timeline.auto_cuts(_cuts(spark, d), "song")


def section_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Cuts whose distance follows the section a beat lies in."""
    s = segments.sections(energy(spark, d), "song", song_lengths(spark, d))
    b = joins.first_section(_beats(spark, d).where("t >= 8"), s, "song", "t")
    return timeline.auto_cuts(b.select("song", "i", "t", timeline.section_factor(F.col("kind")).alias("factor")), "song")


def transition_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of a dissolve when a clip's frame rate is the tempo and its duration the slot."""
    slot = F.when(F.col("duration_s") > 0, F.col("duration_s") / 20)
    return _clips(spark, d).select("clip_id", F.round(timeline.fit_transition(0.9, timeline.beat_gap(F.col("fps")), slot), 6).alias("length_s"))


def snapped_cuts(spark: SparkSession, d: str) -> DataFrame:
    c = timeline.auto_cuts(_cuts(spark, d), "song").groupBy("song").agg(F.array_sort(F.collect_list("t")).alias("cuts"))
    o = _onsets(spark, d).groupBy("song").agg(F.array_sort(F.collect_list("onset")).alias("onsets"))
    return c.join(o, "song").select("song", F.posexplode(timeline.snap(F.col("cuts"), F.col("onsets"))).alias("pos", "t")).select("song", F.col("pos").cast("bigint").alias("pos"), "t")


def moment_budget(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("clip_id", segments.moment_budget(F.col("duration_s"), 8).cast("bigint").alias("budget"))


def _folder_cands(spark: SparkSession, d: str) -> DataFrame:
    c = _clips(spark, d).select("file", "folder", "clip_id", "signature", "captured_at", "duration_s")
    return _cands(spark, d).where("score is not null and not isnan(score)").join(c, "file")


def greedy_diverse_allocation(spark: SparkSession, d: str) -> DataFrame:
    """One plan of 40 slots per folder: the best moment of each source, section bias and diversity."""
    x = timeline.top_per_source(_folder_cands(spark, d), "file", "score", "cand_pos", 1)
    bias = F.create_map(*[y for k in scoring.SECTION_WEIGHTS for y in (F.lit(k), scoring.section_bias(F.col("components"), k))])
    sig = F.when(F.lower("signature").rlike(r"\A[0-9a-f]{16}(:[0-9a-f]{16})*\z"), F.lower("signature"))
    c = x.select("folder", "cand_pos", F.col("file").alias("source"), "score", (F.col("end_s") - F.col("start_s")).alias("length_s"), sig.alias("signature"), bias.alias("bias"))
    kinds = F.array(*map(F.lit, ("intro", "verse", "build", "drop", "outro")))
    s = c.select("folder").distinct().select("folder", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("slot")).withColumn("gap_s", F.lit(0.5)).withColumn("kind", F.element_at(kinds, (F.floor(F.col("slot") / 8) + 1).cast("int")))
    return timeline.greedy_allocation(c, s, "folder")


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """The 24 best clips of each folder, one moment each."""
    x = timeline.top_per_source(_folder_cands(spark, d), "file", "score", "cand_pos", 1).withColumn("captured_at", F.when(F.col("captured_at").between(1, 4e9), F.col("captured_at")))
    return timeline.top_per_source(x, "folder", "score", "cand_pos", 24)


def chronological_trailer(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.trailer_order(_picks(spark, d), "folder", "captured_at", "file", "score", "cand_pos")
    return x.select("folder", F.col("pos").cast("bigint").alias("pos"), "cand_pos")


def stretch_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as entries of a tenth of their quantity in seconds, towards 20 s."""
    x = table(spark, d, "lineitem").select("l_orderkey", _place().alias("pos"), (F.col("l_quantity") / 10).alias("dur"), F.lit(20.0).alias("goal"))
    s = timeline.stretch(x, "l_orderkey", "pos", "dur", "goal")
    return s.select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), F.round("out_s", 6).alias("out_s"), F.round("start_s", 6).alias("start_s"), "fade_s")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.trailer_order(_picks(spark, d), "folder", "captured_at", "file", "score", "cand_pos")
    return x.select("folder", "pos", "cand_pos", "score", "reasons", (F.col("end_s") - F.col("start_s")).alias("slot"), (F.col("cand_pos") % 3 == 0).alias("beat"), (F.col("cand_pos") % 7 == 0).alias("onset"), (F.pmod("cand_pos", F.lit(100)) / 100.0).alias("e"))


def auto_transitions(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.auto_transitions(_entries(spark, d), "folder", "pos", "score", "slot", "beat")
    return x.select("folder", F.col("pos").cast("bigint").alias("pos"), "kind", F.round("duration_s", 6).alias("duration_s"), "direction")


def soft_transitions(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.soft_transitions(_entries(spark, d), "folder", "pos", "score", "slot", "reasons", "e", "onset", "beat")
    return x.select("folder", F.col("pos").cast("bigint").alias("pos"), "kind", F.round("duration_s", 6).alias("duration_s"))


def overlap_compensation(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.auto_transitions(_entries(spark, d), "folder", "pos", "score", "slot", "beat")
    return timeline.overlap_compensated(x, "folder", "pos", "slot", "duration_s").select("folder", F.col("pos").cast("bigint").alias("pos"), F.round("render_s", 6).alias("render_s"))


def fade_segments(spark: SparkSession, d: str) -> DataFrame:
    x = timeline.auto_transitions(_entries(spark, d), "folder", "pos", "score", "slot", "beat")
    s = timeline.fade_offsets(x, "folder", "pos", "slot", "duration_s").select("folder", F.posexplode("segments").alias("seg", "s"))
    return s.select("folder", F.col("seg").cast("bigint").alias("seg"), F.round("s.offset", 6).alias("offset_s"), F.round("s.length", 6).alias("length_s"))


def speed_decision(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("cand_pos") % 5 == 0, "build").otherwise("drop")
    t, drop = F.pmod("cand_pos", F.lit(40)) * 0.25, F.lit(5.0)
    v = timeline.decide_speed(kind, F.col("src_fps"), t, drop, F.col("cand_pos") % 3 == 0, F.arrays_overlap("reasons", F.array(F.lit("accl_jump"), F.lit("motion"))))
    return _cands(spark, d).select("cand_pos", v.alias("v")).select("cand_pos", "v.speed_start", "v.speed_end")


def reanchor(spark: SparkSession, d: str) -> DataFrame:
    """Moments with a tag in their window start so that the tag lies at 40 % of a two-second slot."""
    c = _cands(spark, d).select("cand_pos", "file", "start_s", "end_s").join(_clips(spark, d).where("duration_s > 0 and not isnan(duration_s)").select("file", "tags_ms", "duration_s"), "file")
    return c.select("cand_pos", F.round(edits.anchored(F.col("start_s"), F.col("end_s"), F.col("tags_ms"), F.lit(2.0), F.col("duration_s")), 6).alias("start_s"))


def luma_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Brightness corrections towards the upper median of the folder."""
    c = _clips(spark, d).select("folder", "clip_id", array_mean(F.col("exposure")).alias("mean"))
    r = signals.upper_medians(c, "folder", "mean").withColumnRenamed("median", "target")
    return c.join(r, "folder", "left").select("clip_id", F.round(luma(F.col("mean"), F.col("target")), 3).alias("offset"))


def audio_interest(spark: SparkSession, d: str) -> DataFrame:
    c = _cands(spark, d).select("cand_pos", "file", "start_s", "end_s").join(_clips(spark, d).select("file", "voice", "gyro"), "file")
    lo = F.floor("start_s").cast("int")
    hi = F.greatest(lo + 1, F.floor(F.col("end_s") + 0.999).cast("int"))
    part = F.slice("voice", lo + 1, hi - lo)
    interest = F.coalesce(array_mean(part), F.try_element_at(F.col("voice"), F.lit(1)), F.lit(0.0))
    g = F.slice("gyro", lo + 1, hi - lo)
    shaky = F.coalesce(upper_median(F.when(F.size(present(g)) > 0, g).otherwise(F.col("gyro"))) >= 1.2, F.lit(False))
    return c.select("cand_pos", F.round(interest, 6).alias("audio_interest"), shaky.alias("stabilize"))


def plan_edits(spark: SparkSession, d: str) -> DataFrame:
    """On every order as a plan: drop a supplier, set the second line's speed, swap the first line with the best other, pin the last."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), _place().alias("pos"), F.col("l_suppkey").alias("source"), F.col("l_extendedprice").alias("score"), F.lit(0.0).alias("start_s"), F.col("l_quantity").alias("end_s"), F.lit(1.0).alias("speed"))
    ops = [("exclude_source", {"source": 7}), ("set", {"pos": 1, "field": "speed", "value": 0.5}), ("swap", {"pos": 0, "rank": 1}), ("pin", {"pos": 0, "source": 1, "start_s": 2.0, "end_s": 3.0})]
    return edits.apply(x, ops).select("plan", F.col("pos").cast("bigint").alias("pos"), "source", "score", "start_s", "end_s", "speed")


def title_times(spark: SparkSession, d: str) -> DataFrame:
    """When the titles of each order appear: at its start, its end, and a moment of its own."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    return x.select("l_orderkey", F.explode(edits.titles(F.col("total"))).alias("t")).select("l_orderkey", "t.kind", "t.at_s")


QUERIES = {f.__name__: f for f in (plan_topk_per_source, topk_per_source, stride_cuts, auto_cuts, section_cuts, transition_lengths, snapped_cuts, moment_budget, greedy_diverse_allocation, chronological_trailer, stretch_timeline, auto_transitions, soft_transitions, overlap_compensation, fade_segments, speed_decision, reanchor, luma_offsets, audio_interest, plan_edits, title_times)}

_CUT = f"""{ENERGY_SQL}, {_BEATS}, bf as (select be.song, be.i, be.t, case when en.e >= 0.8 then 2 when en.e >= 0.55 then 3 when en.e >= 0.3 then 4 else 6 end as f from be join en on en.song = be.song and en.sec = cast(floor(be.t) as bigint) where be.t >= 8),
wk(song, i, li, lt, kept) as (select distinct song, 11::bigint, -1000000000::bigint, -1e9::double, false from bf union all
  select b.song, b.i, case when b.i - w.li >= b.f and b.t - w.lt >= 0.33 - 1e-9 then b.i else w.li end, case when b.i - w.li >= b.f and b.t - w.lt >= 0.33 - 1e-9 then b.t else w.lt end, b.i - w.li >= b.f and b.t - w.lt >= 0.33 - 1e-9 from wk w join bf b on b.song = w.song and b.i = w.i + 1)"""
_FC = f"{_K}, {_C}, fc as (select k.*, c.folder, c.captured_at from k join c on k.file = c.file where k.score is not null and not isnan(k.score)), t1 as (select * from (select *, row_number() over (partition by file order by score desc, cand_pos) as r1 from fc) where r1 = 1), pk as (select * replace (case when captured_at between 1 and 4e9 then captured_at end as captured_at) from (select *, row_number() over (partition by folder order by score desc, cand_pos) as r2 from t1) where r2 <= 24)"
_TR = f"""{_FC}, ch as (select *, row_number() over (partition by folder order by captured_at nulls last, file, cand_pos) as cp, count(*) over (partition by folder) as n from pk), rk as (select *, row_number() over (partition by folder order by score desc, cand_pos) as r from ch),
bk as (select *, case when n < 8 then 1 when r = 1 then 0 when r <= 1 + greatest(1, n // 4) then 2 else 1 end as b from rk), tr as (select *, row_number() over (partition by folder order by b, case when b = 1 then cp else r end) - 1 as pos from bk),
en as (select folder, pos, cand_pos, score, reasons, end_s - start_s as slot, cand_pos % 3 = 0 as beat, cand_pos % 7 = 0 as onset, (cand_pos % 100) / 100.0 as e from tr)"""
_AT = f"""{_TR}, mk(folder, pos, last, mark) as (select distinct folder, 0::bigint, 0::bigint, false from en union all select e.folder, e.pos, case when e.beat and e.pos - m.last >= 4 then e.pos else m.last end, e.beat and e.pos - m.last >= 4 from mk m join en e on e.folder = m.folder and e.pos = m.pos + 1),
mm as (select *, max(mark) over (partition by folder) as anym from mk), bb as (select e.*, case when mm.anym then mm.mark else e.pos % 4 = 0 and e.pos >= 4 end as mark, row_number() over (partition by e.folder, e.pos // 8 order by score desc, e.pos) = 1 and e.pos > 0 as top from en e join mm on mm.folder = e.folder and mm.pos = e.pos),
wp as (select *, top and sum(case when top then 1 else 0 end) over (partition by folder order by pos) <= 3 as whip from bb),
att as (select *, case when whip then 'whip' when mark then 'crossfade' else 'cut' end as kind, case when whip then least(0.25, slot * 0.4) when mark then least(0.2, slot * 0.4) else 0 end as td, case when whip then case when pos % 2 = 0 then 'wipeleft' else 'wiperight' end end as direction from wp)"""

SQL = {
    "plan_topk_per_source": "with t as (select o_orderkey, o_custkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3), s as (select *, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as slot from t) select slot, slot * 0.5 as beat_s, 0.5 as out_s, o_custkey as source, o_orderkey as cand_pos, o_totalprice as score from s where slot < 240",
    "topk_per_source": "select o_orderkey, o_custkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3",
    "stride_cuts": f"with {_BEATS} select song, i, t from (select *, row_number() over (partition by song order by i) as r from be where t >= 8) where (r - 1) % 4 = 0",
    "auto_cuts": f"with recursive {_CUT} select song, i, lt as t from wk where kept",
    "section_cuts": f"""with recursive {SECTIONS_SQL}, {_BEATS}, bf as (select be.song, be.i, be.t, case coalesce((select kind from se where se.song = be.song and se.start_s <= be.t and be.t < se.end_s order by section_pos limit 1), 'verse') when 'intro' then 4 when 'verse' then 2 when 'build' then 1 when 'drop' then 1 else 2 end as f from be where be.t >= 8),
      {_CUT[_CUT.index('wk(song'):]} select song, i, lt as t from wk where kept""",
    "transition_lengths": f"""with {_C}, x as (select clip_id, greatest(0.12, least(0.9, 0.9 * case when fps > 0 and not isnan(fps) then 60.0 / fps else 0.5 end)) as l, case when duration_s > 0 then duration_s / 20 end as s from c) select clip_id, round(case when s > 0 then least(l, s * 0.4) else l end, 6) as length_s from x""",
    "snapped_cuts": f"""with recursive {_CUT}, {_ON.replace(ENERGY_SQL + ", ", "")}, cu as (select song, lt as t, row_number() over (partition by song order by lt) - 1 as pos from wk where kept),
      nb as (select cu.song, cu.pos, cu.t, coalesce(arg_min(o.onset, abs(o.onset - cu.t) * 1e6 + case when o.onset >= cu.t then 1e-3 else 0 end), cu.t) as best from cu left join ons o on o.song = cu.song and abs(o.onset - cu.t) < 0.08 group by 1, 2, 3),
      sn(song, pos, got) as (select song, pos, best from nb where pos = 0 union all
        select n.song, n.pos, case when n.best - s.got >= 0.25 and n.best > s.got then n.best else n.t end from sn s join nb n on n.song = s.song and n.pos = s.pos + 1)
      select song, pos, got as t from sn where song in (select song from ons)""",
    "moment_budget": f"with {_C} select clip_id, case when duration_s is null or isnan(duration_s) or duration_s <= 4 then 1 else greatest(1, least(ceil(duration_s / 10), 8)) end::bigint as budget from c",
    "chronological_trailer": f"with {_TR} select folder, pos, cand_pos from tr",
    "stretch_timeline": f"""with y as (select *, {_LINES} as pos from lineitem), x as (select l_orderkey, pos, l_quantity / 10 as dur, row_number() over (partition by l_orderkey order by pos desc) as r from y), t as (select l_orderkey, sum(dur) as s, count(*) as n, sum(case when r <= 4 then dur end) as tl from x group by 1),
      u as (select *, case when s > 0 and s < 17 and least(4.0, 20.0 / n) > s / n + 0.05 then least(4.0, 20.0 / n) / (s / n) else 1 end as sc from t), v as (select *, case when 20 - s * sc > 0.5 and tl > 0 then least(1.5, 1 + (20 - s * sc) / (tl * sc)) else 1 end as mu from u),
      o as (select x.l_orderkey, pos, r, dur * sc * case when r <= 4 then mu else 1 end as os from x join v using (l_orderkey))
      select l_orderkey, pos, round(os, 6) as out_s, round(coalesce(sum(os) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0), 6) as start_s, case when r = 1 then round(least(1.0, os * 0.6), 3) end as fade_s from o""",
    "auto_transitions": f"with recursive {_AT} select folder, pos, kind, round(td, 6) as duration_s, direction from att",
    "overlap_compensation": f"with recursive {_AT} select folder, pos, round(slot + case when pos > 0 then td else 0 end / 2 + coalesce(lead(td) over (partition by folder order by pos), 0) / 2, 6) as render_s from att",
    "fade_segments": f"""with recursive {_AT}, fs(folder, pos, stop, seg, off_, len_) as (select folder, pos, slot, 0::bigint, 0.0::double, slot from att where pos = 0 union all
        select a.folder, a.pos, case when a.td >= 0.05 then greatest(0, f.stop - a.td) else f.stop end + a.slot, f.seg + case when a.td >= 0.05 then 1 else 0 end,
          case when a.td >= 0.05 then greatest(0, f.stop - a.td) else f.off_ end, case when a.td >= 0.05 then a.slot else f.len_ + a.slot end from fs f join att a on a.folder = f.folder and a.pos = f.pos + 1)
      select folder, seg, round(max(off_), 6) as offset_s, round(max(len_), 6) as length_s from fs group by 1, 2""",
    "soft_transitions": f"""with {_TR}, r as (select *, count(*) over (partition by folder) as n, row_number() over (partition by folder order by score, pos) as r from en), q as (select *, max(case when r = greatest(0, cast(floor(n * 0.85) as int) - 1) + 1 then score end) over (partition by folder) as ct from r),
      h as (select *, coalesce(pos = 0 or onset or (list_has_any(reasons, ['high_accel_jump', 'motion_peak', 'hilight_tag', 'audio_peak']) and score >= ct), false) as hard, case when beat and e >= 0.6 then 1.3 when e < 0.35 then 1.7 when e >= 0.75 then 0.6 else 0.9 end as bt from q)
      select folder, pos, case when hard then 'cut' else 'crossfade' end as kind, round(case when hard then 0 else least(greatest(0.12, least(0.9, bt * 0.5)), slot * 0.4) end, 6) as duration_s from h""",
    "speed_decision": f"""with {_K}, s as (select cand_pos, case when cand_pos % 5 = 0 then 'b' when src_fps is null or src_fps < 90 then 'n' when (cand_pos % 40) * 0.25 >= 5 and (cand_pos % 40) * 0.25 < 6 then 'r' when cand_pos % 3 = 0 and coalesce(list_has_any(reasons, ['accl_jump', 'motion']), false) then 'r' else 'n' end as m from k)
      select cand_pos, case m when 'r' then 0.4 else 1.0 end as speed_start, case m when 'b' then 1.15 else 1.0 end as speed_end from s""",
    "reanchor": f"""with {_K}, {_C}, j as (select k.cand_pos, k.start_s, c.duration_s, list_filter(list_transform(c.tags_ms, lambda t: t / 1000.0), lambda t: t >= k.start_s and t <= k.end_s)[1] as tag from k join c on k.file = c.file where c.duration_s > 0 and not isnan(c.duration_s))
      select cand_pos, round(case when tag is null then start_s else greatest(0, least(tag - 0.8, greatest(0, duration_s - 2))) end, 6) as start_s from j""",
    "luma_offsets": f"""with {_C}, m as (select folder, clip_id, list_avg(list_filter(exposure, lambda x: x is not null)) as mean from c), r as (select folder, mean as target from (select *, row_number() over (partition by folder order by mean, clip_id) as r, count(*) over (partition by folder) as n from m where mean is not null) where r = n // 2 + 1)
      select clip_id, case when mean is not null and target is not null then round(round(greatest(-0.08, least(0.08, (target - mean) * 0.5)), 4), 3) end as offset from m left join r using (folder)""",
    "audio_interest": f"""with {_K}, {_C}, j as (select k.cand_pos, c.voice, c.gyro, cast(floor(k.start_s) as int) as lo, greatest(cast(floor(k.start_s) as int) + 1, cast(floor(k.end_s + 0.999) as int)) as hi from k join c on k.file = c.file),
      g as (select *, list_filter(gyro[lo + 1:hi], lambda x: x is not null) as gw, list_filter(voice[lo + 1:hi], lambda x: x is not null) as vw, list_filter(gyro, lambda x: x is not null) as ga from j), s as (select *, list_sort(case when len(gw) > 0 then gw else ga end) as so from g)
      select cand_pos, round(coalesce(list_avg(vw), voice[1], 0), 6) as audio_interest, coalesce(so[len(so) // 2 + 1] >= 1.2, false) as stabilize from s""",
    "plan_edits": f"""with z as (select *, {_LINES} as p0 from lineitem), a as (select l_orderkey as plan, row_number() over (partition by l_orderkey order by p0) - 1 as pos, l_suppkey as source, l_extendedprice as score, 0.0::double as start_s, l_quantity as end_s from z where l_suppkey <> 7),
      b as (select *, case when pos = 1 then 0.5 else 1.0 end as speed from a), r as (select *, row_number() over (partition by plan order by case when pos = 0 then 1 else 0 end, score desc, pos) as k, count(*) over (partition by plan) as n from b),
      p as (select *, max(case when k = 1 and pos <> 0 then pos end) over (partition by plan) as other from r), s as (select plan, case when other is null then pos when pos = 0 then other when pos = other then 0 else pos end as pos, source, score, start_s, end_s, speed from p)
      select plan, pos, case when pos = 0 then 1 else source end as source, score, case when pos = 0 then 2.0 else start_s end as start_s, case when pos = 0 then 3.0 else end_s end as end_s, speed from s""",
    "title_times": "with t as (select l_orderkey, sum(l_quantity) as total from lineitem group by 1) select l_orderkey, 'intro' as kind, 0.0 as at_s from t union all select l_orderkey, 'outro', greatest(0, total - 3.0) from t union all select l_orderkey, 'at', 5.0 from t",
}
