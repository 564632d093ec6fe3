"""Queries of listings, content keys, caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import base_name, camera_name_time, name_time, seeded_index, stem
from lumenframe.operators import timeline
from lumenframe.plans.relations import _C, _K, _cands, _clips
from lumenframe.session import table
from lumenframe.sources import catalog


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The clips' files and the stills they came from, as a listing."""
    c = _clips(spark, d)
    return c.select(F.col("source").alias("path")).unionByName(c.where("origin is not null").select(F.col("origin").alias("path"))).where("path is not null").distinct()


def path_filters(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return f.select("path", catalog.kind_of(F.col("path")).alias("kind"), catalog.under_skipped(F.col("path"), ["stills"]).alias("skipped"), catalog.prior_output(F.col("path"), ["VID_1"]).alias("prior"), base_name(F.col("path")).startswith(".").alias("hidden"))


def discovered(spark: SparkSession, d: str) -> DataFrame:
    x = catalog.discover(_files(spark, d), "path")
    return x.select("path", F.col("pos").cast("bigint").alias("pos"))


def anti_stem(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stills_without_motion(_files(spark, d), "path").select("path")


def listing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.listing(_files(spark, d), "path").select("folder_path", "stem", "label", "files")


def picker_sources(spark: SparkSession, d: str) -> DataFrame:
    """The files as a picker lists them; clips with a low place are not selected."""
    c = _clips(spark, d)
    at = F.when(F.col("captured_at").between(1, 4e9), F.col("captured_at")).alias("at")
    f = c.select(F.col("source").alias("path"), at).unionByName(c.where("origin is not null").select(F.col("origin").alias("path"), at)).where("path is not null").groupBy("path").agg(F.min("at").alias("at"))
    out = c.where("clip_pos < 3").select(F.col("source").alias("path"))
    return catalog.sources(f, "path", "at", out).select("path", "kind", "selected", F.col("pos").cast("bigint").alias("pos"))


def sources_union(spark: SparkSession, d: str) -> DataFrame:
    """Videos, then stills, then audio-like rest, each in path order."""
    f = _files(spark, d).withColumn("kind", catalog.kind_of(F.col("path")))
    return catalog.ordered_union([f.where("kind = 'video'"), f.where("kind = 'still'"), f.where("kind not in ('video', 'still')")], ["path"])


def first_sources(spark: SparkSession, d: str) -> DataFrame:
    """The files of the candidates in the order in which they first appear."""
    return catalog.first_seen(_cands(spark, d).select("file", "cand_pos"), "file", "cand_pos")


def cache_recombined(spark: SparkSession, d: str) -> DataFrame:
    """Clips in their places with the cached number of candidates, or one computed from the length of the clip."""
    items = _clips(spark, d).select("file", "folder", "clip_pos", "duration_s")
    done = _cands(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    hit, miss = catalog.split_by_cache(items.select("file", "duration_s"), done, "file")
    computed = miss.where("duration_s > 0 and not isnan(duration_s)").select("file", F.floor("duration_s").alias("n"))
    return catalog.recombined(items, hit.select("file", "n"), computed, "file", "clip_pos").select("file", "clip_pos", "n")


def content_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the songs, stills, features and plans that the clips stand for."""
    key = lambda n, *p: catalog.content_key(*p, length=n)
    ns, sec = F.unix_micros(F.col("analyzed_at").cast("timestamp")) * 1000, F.floor(F.unix_micros(F.col("analyzed_at").cast("timestamp")) / 1_000_000)
    plan = key(12, F.col("folder"), F.col("source"), F.lit("chill"), F.lit(""), F.lit("16:9"), F.lit(0))
    return _clips(spark, d).where("source is not null and analyzed_at is not null").select("clip_id", F.sha1(F.concat(F.col("source"), F.lit("-"), ns.cast("string"))).alias("song"), key(16, F.col("source"), F.col("clip_pos"), sec, F.lit("2.5"), F.lit("1920x1080")).alias("still"), key(40, F.lit("v3"), F.col("source"), ns, F.col("clip_pos")).alias("feature"), plan.alias("plan"))


def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Longest common folder of the clips of each recording folder, from distinct counts per depth."""
    x = _clips(spark, d).where("source is not null").select("folder", F.posexplode(F.split("source", "/")).alias("depth", "part"), F.size(F.split("source", "/")).alias("n"))
    g = x.groupBy("folder", "depth").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    total = g.groupBy("folder").agg(F.max("c").alias("all"), F.min("n").alias("shortest"))
    j = g.join(total, "folder").withColumn("same", (F.col("low") == F.col("high")) & (F.col("c") == F.col("all")) & (F.col("depth") < F.col("shortest") - 1))
    first_bad = j.groupBy("folder").agg(F.min(F.when(~F.col("same"), F.col("depth"))).alias("stop"))
    parts = j.join(first_bad, "folder").where("stop is null or depth < stop").groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("depth", "low"))).alias("p"))
    return parts.select("folder", F.array_join(F.transform("p", lambda s: s["low"]), "/").alias("root"))


def content_key(spark: SparkSession, d: str) -> DataFrame:
    c = _clips(spark, d)
    return c.select("clip_id", catalog.content_key(F.lit("v3"), F.col("source"), F.col("clip_pos"), F.col("width")).alias("key"))


def folder_key(spark: SparkSession, d: str) -> DataFrame:
    return catalog.folder_key(_clips(spark, d).where("folder is not null"), "folder", F.concat_ws("|", base_name(F.col("source")), F.col("clip_pos").cast("string")))


def variant_pick(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("clip_id", seeded_index(stem(F.col("source")), 8).alias("variant"))


def filename_ts(spark: SparkSession, d: str) -> DataFrame:
    """File names that the documents mention, and the moments in them."""
    names = table(spark, d, "documents").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"(VID_\d{8}_\d{6}|IMG-\d{8}-WA\d+|GX\d{6})"), F.lit(1))).alias("name")).distinct()
    return names.select("name", F.date_format(F.coalesce(name_time(F.col("name")), camera_name_time(F.col("name"))), "yyyy-MM-dd HH:mm:ss").alias("moment"))


def cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Clips with candidates are in the cache."""
    done = _cands(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    hit, miss = catalog.split_by_cache(_clips(spark, d).select("clip_id", "file"), done, "file")
    return hit.select("clip_id", F.lit("hit").alias("state"), "n").unionByName(miss.select("clip_id", F.lit("miss").alias("state"), F.lit(0).cast("bigint").alias("n")))


def copy_classify(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files named by author and hundreds of characters, against the smallest English one of the name."""
    name = F.concat_ws("/", F.coalesce("author", F.lit("")), F.floor(F.col("n_chars") / 100).cast("string"))
    x = table(spark, d, "documents").where("n_chars is not null").select("doc_id", name.alias("name"), F.col("n_chars").alias("size"), "lang")
    there = x.where("lang = 'en'").groupBy("name").agg(F.min("size").alias("size"))
    return catalog.copy_actions(x, there, "name", "size").select("doc_id", "action")


def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars", F.col("doc_id").cast("double").alias("used_at"))
    return catalog.evict(x, 300_000, "n_chars", "used_at", "doc_id").select("doc_id", "kept")


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("n_chars is not null")
    hits = F.count_if(F.col("lang") == "en")
    return x.groupBy("source").agg(hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"), F.sum("n_chars").alias("bytes"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.round(100.0 * hits / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("hit_percent"))


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Cuts, sources, repeats and unused clips per folder when each source gives at most three moments."""
    best = timeline.top_per_source(_cands(spark, d).where("score is not null and not isnan(score)"), "file", "score", "cand_pos", 3)
    per = best.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    x = _clips(spark, d).select("folder", "file").join(per, "file", "left")
    used = F.count_if(F.col("n").isNotNull())
    return x.groupBy("folder").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cuts"), used.alias("sources_used"), (F.count(F.lit(1)) - used).alias("unused"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("average"))


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("plan"))
    return x.agg(F.count(F.lit(1)).alias("n_cuts"), F.countDistinct("o_orderpriority").alias("sources_used"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def recents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("path"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("at"))
    return catalog.recents(e, "user_id", "path", "at").select("user_id", "path", F.col("place").cast("bigint").alias("place"))


def layered_config(spark: SparkSession, d: str) -> DataFrame:
    """Settings resolved over the builtin, environment, theme and command-line layers."""
    got = catalog.layered(["pace", "source_cap", "length_s", "lut"], {"pace": "medium", "source_cap": 1, "length_s": 90}, {"pace": "slow", "other": 1}, {"pace": None, "lut": "chill"}, {"length_s": 60})
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in got.items()], "name string, value string")


QUERIES = {f.__name__: f for f in (path_filters, discovered, anti_stem, listing, picker_sources, sources_union, first_sources, cache_recombined, content_keys, common_prefix, content_key, folder_key, variant_pick, filename_ts, cache_split, copy_classify, lru_evict, cache_stats, coverage_report, plan_summary, recents, layered_config)}

_F = f"{_C}, f as (select distinct path from (select source as path from c union all select origin from c where origin is not null) where path is not null), b as (select path, split_part(path, '/', -1) as name from f), x as (select *, lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) as ext, regexp_replace(name, '(.)\\.[^.]*$', '\\1') as stem, regexp_replace(path, '/[^/]*$', '') as folder_path from b), k as (select *, case when ext in ('.mp4', '.mov', '.m4v', '.insv', '.lrv') then 'video' when ext in ('.heic', '.heif', '.jpg', '.jpeg', '.png') then 'still' when ext in ('.mp3', '.wav', '.m4a', '.flac', '.aac', '.ogg') then 'audio' else 'other' end as kind from x)"
_SEEN = "not starts_with(name, '.') and not list_has_any(string_split(path, '/')[1:-2], ['__pycache__', '.git', 'node_modules', '.cache', 'lumenframe_workdir'])"

SQL = {
    "path_filters": f"with {_F} select path, kind, list_has_any(string_split(path, '/')[1:-2], ['stills']) as skipped, ext in ('.mp4', '.mov') and contains(lower(name), 'vid_1') as prior, starts_with(name, '.') as hidden from k",
    "discovered": f"with {_F} select path, row_number() over (partition by folder_path order by path) - 1 as pos from k where kind = 'video' and {_SEEN} and not (ext in ('.mp4', '.mov') and (contains(lower(name), 'lumenframe') or contains(lower(name), 'highlight_reel') or contains(lower(name), 'recap')))",
    "anti_stem": f"with {_F} select path from k where kind = 'still' and {_SEEN} and stem not in (select stem from k where ext = '.mov' and {_SEEN})",
    "listing": f"with {_F} select folder_path, lower(stem) as stem, case when count(*) filter (where kind = 'video') > 0 and count(*) filter (where kind = 'still') > 0 then 'live' when count(*) filter (where kind = 'video') > 0 then 'video' else 'still' end as label, count(*) as files from k where kind in ('video', 'still') group by 1, 2",
    "picker_sources": f"""with {_F}, t as (select path, min(at_) as at_ from (select source as path, case when captured_at between 1 and 4e9 then captured_at end as at_ from c union all select origin, case when captured_at between 1 and 4e9 then captured_at end from c where origin is not null) group by 1),
      v as (select * from k where kind in ('video', 'still') and {_SEEN}), p as (select stem from v group by 1 having bool_or(ext = '.mov') and bool_or(kind = 'still')),
      s as (select v.*, v.stem in (select stem from p) as pair from v where not (ext in ('.mp4', '.mov') and (contains(lower(name), 'lumenframe') or contains(lower(name), 'highlight_reel') or contains(lower(name), 'recap'))))
      select path, case when pair and ext = '.mov' then 'live_photo' else kind end as kind, path not in (select source from c where clip_pos < 3 and source is not null) as selected, row_number() over (partition by folder_path order by at_ nulls last, name, path) - 1 as pos from s join t using (path) where not (pair and kind = 'still')""",
    "sources_union": f"with {_F} select case kind when 'video' then 0 when 'still' then 1 else 2 end as part, kind, path from k",
    "first_sources": f"with {_K} select file, min(cand_pos) as cand_pos from k where file is not null group by 1",
    "cache_recombined": f"with {_K}, {_C}, n as (select file, count(*) as n from k group by 1) select c.file, clip_pos, coalesce(n.n, cast(floor(duration_s) as bigint)) as n from c left join n using (file) where n.n is not null or (duration_s > 0 and not isnan(duration_s))",
    "content_keys": f"""with {_C}, x as (select *, epoch_us(analyzed_at) * 1000 as ns, epoch_us(analyzed_at) // 1000000 as sec from c where source is not null and analyzed_at is not null)
      select clip_id, sha1(source || '-' || ns) as song, substr(sha1(concat_ws('|', source, coalesce(clip_pos::varchar, ''), sec, '2.5', '1920x1080')), 1, 16) as still, sha1(concat_ws('|', 'v3', source, ns, coalesce(clip_pos::varchar, ''))) as feature, substr(sha1(concat_ws('|', coalesce(folder, ''), source, 'chill', '', '16:9', '0')), 1, 12) as plan from x""",
    "common_prefix": f"with {_C}, p as (select distinct folder, regexp_replace(source, '/[^/]*$', '') as root from c where source is not null) select folder, min(root) as root from p group by 1",
    "content_key": f"with {_C} select clip_id, sha1(concat_ws('|', 'v3', coalesce(source, ''), coalesce(clip_pos::varchar, ''), coalesce(width::varchar, ''))) as key from c",
    "folder_key": f"with {_C} select folder, substr(sha1(string_agg(line, chr(10) order by line)), 1, 12) as key from (select folder, concat_ws('|', split_part(source, '/', -1), clip_pos::varchar) as line from c where folder is not null) group by 1",
    "variant_pick": f"with {_C} select clip_id, (('0x' || substr(sha1(regexp_replace(split_part(source, '/', -1), '(.)\\.[^.]*$', '\\1')), 1, 8))::UBIGINT % 8)::bigint as variant from c",
    "filename_ts": "with n as (select distinct unnest(regexp_extract_all(text, '(VID_[0-9]{8}_[0-9]{6}|IMG-[0-9]{8}-WA[0-9]+|GX[0-9]{6})')) as name from documents where text is not null) select name, strftime(coalesce(try_strptime(case when starts_with(name, 'VID') then substr(name, 5, 15) end, '%Y%m%d_%H%M%S'), try_strptime(case when starts_with(name, 'IMG') then substr(name, 5, 8) end, '%Y%m%d') + to_seconds(try_cast(case when starts_with(name, 'IMG') then substr(name, 16) end as int))), '%Y-%m-%d %H:%M:%S') as moment from n",
    "cache_split": f"with {_K}, {_C}, n as (select file, count(*) as n from k group by 1) select clip_id, case when n.n is null then 'miss' else 'hit' end as state, coalesce(n.n, 0) as n from c left join n on n.file = c.file",
    "copy_classify": "with x as (select doc_id, coalesce(author, '') || '/' || (n_chars // 100)::varchar as name, n_chars as size, lang from documents where n_chars is not null), t as (select name, min(size) as there from x where lang = 'en' group by 1) select doc_id, case when there is null then 'copy' when there = size then 'skip' else 'conflict' end as action from x left join t using (name)",
    "lru_evict": "select doc_id, sum(n_chars) over (order by doc_id desc) <= 300000 as kept from documents where n_chars is not null",
    "cache_stats": "select source, count(*) filter (where lang = 'en') as hits, count(*) - count(*) filter (where lang = 'en') as misses, sum(n_chars)::bigint as bytes, min(doc_id) as oldest, max(doc_id) as newest, round(100.0 * count(*) filter (where lang = 'en') / greatest(1, count(*)), 4) as hit_percent from documents where n_chars is not null group by 1",
    "coverage_report": f"with {_K}, {_C}, t as (select file, least(3, count(*)) as n from k where score is not null and not isnan(score) group by 1) select folder, coalesce(sum(n), 0)::bigint as cuts, count(n) as sources_used, count(*) - count(n) as unused, coalesce(max(n), 0) as most, round(coalesce(avg(n), 0), 6) as average from c left join t on t.file = c.file group by 1",
    "plan_summary": "select o_custkey as plan, count(*) as n_cuts, count(distinct o_orderpriority) as sources_used, round(sum(o_totalprice), 2) as total from orders group by 1",
    "recents": "with l as (select user_id, json_extract_string(props, '$.k') as path, max(ts) as at_ from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by at_ desc, path) as place from l) select user_id, path, place from r where place <= 10",
    "layered_config": "select * from (values ('pace', 'slow'), ('source_cap', '1'), ('length_s', '60'), ('lut', 'chill')) t(name, value)",
}
