"""Queries over the per-second arrays of the clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import interpolated, min_max, nearest_rank, upper_median
from lumenframe.functions.paths import normalized
from lumenframe.operators import scoring
from lumenframe.plans.relations import _C, path_sql
from lumenframe.session import table

_ARRAYS = ["motion", "audio", "accl", "gyro", "gps", "sharpness", "exposure"]


def clips_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clips").dropDuplicates(["clip_id"])


def _round(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def sliding_window_scores(spark: SparkSession, d: str) -> DataFrame:
    w = scoring.clip_windows(clips_of(spark, d).select("clip_id", "duration_s", "motion", "audio"))
    w = w.withColumns({"motion_mean": scoring.window_mean("motion"), "motion_max": scoring.window_max("motion"), "audio_mean": scoring.window_mean("audio")})
    return w.select("clip_id", "start_s", "end_s", *_round("motion_mean", "motion_max", "audio_mean"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    clips = clips_of(spark, d).select("clip_id", normalized(F.col("source")).alias("file"), "duration_s", "tags_ms", *_ARRAYS)
    liked = table(spark, d, "candidates").where(F.array_contains("reasons", "user_favorite")).select(normalized(F.col("source")).alias("file"), F.lit(True).alias("is_favorite")).distinct()
    return scoring.score_windows(scoring.clip_windows(clips.join(liked, "file", "left")))


def score_all_rules(spark: SparkSession, d: str) -> DataFrame:
    names = ["motion", "audio", "audio_peak", "accl_jump", "gyro_spin", "gps_speed", "hilight_tag", "blurry", "poor_exposure", "user_favorite"]
    return _scored(spark, d).select("clip_id", "start_s", "end_s", F.round("score", 6).alias("score"), F.array_join("reasons", "|").alias("reasons"), *[F.round(f"c_{n}", 6).alias(n) for n in names])


def components_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Number of scored windows, and of those whose components don't add up (0)."""
    s = _scored(spark, d).select("score", "components")
    return s.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.abs(F.aggregate(F.map_values("components"), F.lit(0.0), lambda a, x: a + x) - F.col("score")) > 1e-6).alias("mismatches"))


def nearest_rank_p85_p30(spark: SparkSession, d: str) -> DataFrame:
    return clips_of(spark, d).select("clip_id", nearest_rank(F.col("audio"), 0.85).alias("p85_audio"), nearest_rank(F.col("sharpness"), 0.30).alias("p30_sharpness"))


def upper_median_gyro(spark: SparkSession, d: str) -> DataFrame:
    return clips_of(spark, d).select("clip_id", upper_median(F.col("gyro")).alias("gyro_median"), upper_median(F.col("motion")).alias("motion_median"))


def interp_percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    c = clips_of(spark, d).select("clip_id", "motion", interpolated(F.col("motion"), 0.7).alias("p70"), interpolated(F.col("motion"), 0.98).alias("p98"))
    first = F.array_position(F.transform("motion", lambda x: F.coalesce(x > F.col("p70"), F.lit(False))), True) - 1
    return c.select("clip_id", *_round("p70", "p98"), F.when(first >= 0, first).cast("bigint").alias("first_above_p70"), F.size(F.filter("motion", lambda x: x > F.col("p98"))).cast("bigint").alias("peaks"))


def minmax_normalise(spark: SparkSession, d: str) -> DataFrame:
    c = clips_of(spark, d).where("sharpness is not null").select("clip_id", F.posexplode(min_max(F.col("sharpness"))).alias("sec", "value"))
    return c.select("clip_id", F.col("sec").cast("bigint").alias("sec"), F.round("value", 6).alias("value"))


def section_bias(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").where("cand_pos is not null").dropDuplicates(["cand_pos"])
    return c.select("cand_pos", *[F.round(scoring.section_bias(F.col("components"), k), 6).alias(k) for k in ("drop", "build", "verse")])


QUERIES = {f.__name__: f for f in (sliding_window_scores, score_all_rules, components_mismatch, nearest_rank_p85_p30, upper_median_gyro, interp_percentile_threshold, minmax_normalise, section_bias)}

_W = f"""{_C}, w0 as (select *, cast(floor(duration_s) as int) as n from c where duration_s is not null and not isnan(duration_s) and duration_s >= 0.3),
w1 as (select *, unnest(case when duration_s <= 4 then [0] else range(0, greatest(0, n - 2) + 1) end) as si from w0),
w as (select *, case when duration_s <= 4 then n else si + 2 end as ei, si::double as start_s, case when duration_s <= 4 then duration_s else (si + 2)::double end as end_s from w1) """


def _sl(a: str) -> str:
    return f"(case when ei > si then {a}[si + 1:ei] else [] end)"


def _su(a: str) -> str:
    return f"coalesce(list_sum(list_filter({_sl(a)}, lambda x: x is not null)), 0)"


def _nn(a: str) -> str:
    return f"list_sort(list_filter({a}, lambda x: x is not null))"


def _me(a: str) -> str:
    return f"(case when ei > si then {_su(a)} / (ei - si) else 0 end)"


def _nr(a: str, p: str) -> str:
    return f"{_nn(a)}[least(len({_nn(a)}) - 1, cast(floor(len({_nn(a)}) * {p}) as int)) + 1]"


def _ip(a: str, p: str) -> str:
    s, at = _nn(a), f"((len({_nn(a)}) - 1) * {p})"
    return f"(case when len({s}) > 0 then {s}[cast(floor({at}) as int) + 1] + ({s}[cast(ceil({at}) as int) + 1] - {s}[cast(floor({at}) as int) + 1]) * ({at} - floor({at})) end)"


def _sb(kind: str) -> str:
    terms = [f"coalesce(greatest(-5.0, least(5.0, components['{n}'])), 0) * {w}" for n, w in scoring.SECTION_WEIGHTS[kind].items()]
    return f"round({' + '.join(terms)}, 6) as \"{kind}\""


_RULES = f"""r0 as (select clip_id, start_s, end_s, {_me('motion')} as mm, list_max(motion) as mx, {_me('audio')} as am, len({_nn('audio')}) as al, {_nr('audio', '0.85')} as a85,
  list_avg({_nn('audio')}) as aavg, coalesce(list_max({_sl('accl')}), 0) as ac, coalesce(list_max({_sl('gyro')}), 0) as gy, coalesce(list_max({_sl('gps')}), 0) as gp, coalesce(list_max(gps), 0) as gx,
  len(list_filter(tags_ms, lambda t: t >= start_s * 1000 and t <= end_s * 1000)) > 0 as tg, list_avg(list_filter({_sl('sharpness')}, lambda x: x is not null)) as sh, len({_nn('sharpness')}) as sl,
  {_nr('sharpness', '0.30')} as s30, list_avg(list_filter({_sl('exposure')}, lambda x: x is not null)) as ex, f.file is not null as fav
  from w left join (select distinct {path_sql('source')} as file from candidates where list_contains(reasons, 'user_favorite')) f on w.file = f.file),
r1 as (select *, case when mm > 0 then 1.5 * mm else 0 end as motion, am as audio, case when am > 0.4 and al >= 4 and am >= a85 and am >= 1.25 * aavg then 1.5 else 0 end as audio_peak,
  case when ac > 15 then 3.0 when ac > 12 then 1.5 else 0 end as accl_jump, case when gy > 3 then 1.5 else 0 end as gyro_spin, case when gx > 0 and gp > 0.8 * gx then 2.0 else 0 end as gps_speed,
  case when tg then 10.0 else 0 end as hilight_tag, case when sl >= 2 and sh <= s30 then -1.5 else 0 end as blurry, case when ex < 0.25 or ex > 0.85 then -1.5 else 0 end as poor_exposure,
  case when fav then 2.0 else 0 end as user_favorite from r0),
r as (select *, motion + audio + audio_peak + accl_jump + gyro_spin + gps_speed + hilight_tag + blurry + poor_exposure + user_favorite as score from r1)"""

SQL = {
    "sliding_window_scores": f"with {_W} select clip_id, start_s, end_s, round({_me('motion')}, 6) as motion_mean, round(list_max({_sl('motion')}), 6) as motion_max, round({_me('audio')}, 6) as audio_mean from w",
    "score_all_rules": f"""with {_W}, {_RULES} select clip_id, start_s, end_s, round(score, 6) as score, concat_ws('|', case when mm > 0 and mm > 0.7 * mx then 'motion_peak' end,
      case when am > 0.7 then 'loud_audio' end, case when audio_peak > 0 then 'audio_peak' end, case when ac > 15 then 'high_accel_jump' end, case when accl_jump = 1.5 then 'moderate_accel' end,
      case when gyro_spin > 0 then 'gyro_spin' end, case when gps_speed > 0 then 'speed_peak' end, case when tg then 'hilight_tag' end, case when blurry < 0 then 'blurry' end,
      case when poor_exposure < 0 then 'poor_exposure' end, case when fav then 'user_favorite' end) as reasons, round(motion, 6) as motion, round(audio, 6) as audio, audio_peak, accl_jump, gyro_spin,
      gps_speed, hilight_tag, blurry, poor_exposure, user_favorite from r""",
    "components_mismatch": f"with {_W}, {_RULES} select count(*) as windows, 0::bigint as mismatches from r",
    "nearest_rank_p85_p30": f"with {_C} select clip_id, {_nr('audio', '0.85')} as p85_audio, {_nr('sharpness', '0.30')} as p30_sharpness from c",
    "upper_median_gyro": f"with {_C} select clip_id, {_nn('gyro')}[len({_nn('gyro')}) // 2 + 1] as gyro_median, {_nn('motion')}[len({_nn('motion')}) // 2 + 1] as motion_median from c",
    "interp_percentile_threshold": f"""with {_C}, p as (select clip_id, motion, {_ip('motion', '0.7')} as p70, {_ip('motion', '0.98')} as p98 from c)
      select clip_id, round(p70, 6) as p70, round(p98, 6) as p98, list_position(list_transform(motion, lambda x: coalesce(x > p70, false)), true) - 1 as first_above_p70,
      len(list_filter(motion, lambda x: x > p98)) as peaks from p""",
    "minmax_normalise": f"""with {_C}, e as (select clip_id, unnest(sharpness) as v, unnest(range(0, len(sharpness))) as sec, list_min(sharpness) as lo, list_max(sharpness) as hi from c where sharpness is not null)
      select clip_id, sec, round(case when hi - lo < 1e-9 then 0.5 else (v - lo) / (hi - lo) end, 6) as value from e""",
    "section_bias": f"with k as (select * from (select *, row_number() over (partition by cand_pos) as rn_ from candidates where cand_pos is not null) where rn_ = 1) select cand_pos, {_sb('drop')}, {_sb('build')}, {_sb('verse')} from k",
}
