"""Queries of documents, sidecars, caches, listings, logs and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import settings
from lumenframe.functions.columns import base_name, extension, stem
from lumenframe.operators import extract
from lumenframe.plans.relations import _C, _K, _cands, _clips
from lumenframe.session import table
from lumenframe.sources import catalog, media, store
from lumenframe.streaming import progress


def _be(value, digits: int):
    """A number in big-endian hex."""
    return F.lpad(F.hex(value), digits, "0")


def telemetry_samples(spark: SparkSession, d: str) -> DataFrame:
    """Accelerations of the clips as telemetry blobs, in thousandths, parsed again."""
    a = F.transform("accl", lambda v: F.floor(v * 1000))
    whole = F.forall("accl", lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < 1e6))
    c = _clips(spark, d).where(whole & (F.size("accl") > 0)).select("clip_id", a.alias("a"))
    rows = F.array_join(F.transform("a", lambda v: F.concat(_be(v, 8), F.lit("0" * 16))), "")
    blob = F.unhex(F.concat(F.lit(b"SCAL".hex() + "73020001" + "03e80000" + b"ACCL".hex() + "6c0c"), _be(F.size("a"), 4), rows))
    return c.select("clip_id", blob.alias("blob")).lateralJoin(media.Telemetry(F.col("blob").outer())).select("clip_id", "stream", F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


def tag_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The clips' tags as boxes of a file, parsed again."""
    c = _clips(spark, d).where(F.forall("tags_ms", lambda t: t.isNotNull() & (t >= 0) & (t < 1 << 32)) & (F.size("tags_ms") > 0))
    box = F.unhex(F.concat(F.lit("0000"), _be(F.size("tags_ms") * 4 + 12, 8), F.lit(b"HMMT".hex()), _be(F.size("tags_ms"), 8), F.array_join(F.transform("tags_ms", lambda t: _be(t, 8)), "")))
    return c.select("clip_id", box.alias("box")).lateralJoin(media.HighlightTags(F.col("box").outer())).select("clip_id", "tag_ms")


def config_values(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lines of a settings file."""
    k = F.col("c_custkey").cast("string")
    line = F.element_at(F.array(F.lit("# note"), F.lit("  "), F.concat(F.lit("K"), k, F.lit("=v")), F.concat(F.lit(" K"), k, F.lit(" = 'x # y' ")), F.concat(F.lit("K"), k, F.lit("=a=b # note")), F.lit("no pair")), (F.col("c_custkey") % 6 + 1).cast("int"))
    return catalog.config_lines(table(spark, d, "customer").select(line.alias("value")))


def probed(spark: SparkSession, d: str) -> DataFrame:
    """What a container says of each clip: rates as fractions, some of them useless, and turned frames."""
    k = F.col("clip_id")
    rate = F.element_at(F.array(F.lit("30000/1001"), F.lit("60"), F.lit("0/0"), F.lit(None), F.lit("x/2")), (k % 5 + 1).cast("int"))
    turn = F.element_at(F.array(F.lit(0), F.lit(90), F.lit(-90), F.lit(180), F.lit(None)), (k % 5 + 1).cast("int"))
    p = store.probed(rate, F.col("width"), F.col("height"), turn, F.col("duration_s"))
    return _clips(spark, d).select("clip_id", p.alias("p")).select("clip_id", F.round("p.fps", 6).alias("fps"), "p.width", "p.height", "p.usable")


def json_entries(spark: SparkSession, d: str) -> DataFrame:
    """Order lines stored as JSON with fields left out by turns, one in eleven broken, read back with defaults."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    n = F.col("l_partkey")
    field = lambda name, value, k: F.when(n % k != 0, F.concat(F.lit(f', "{name}": '), value)).otherwise("")
    text = F.concat(F.lit('{"source": "s'), n.cast("string"), F.lit('", "start_s": 1.5, "other": {"a": 1}'), field("end_s", F.lit("9.5"), 7), field("out_duration_s", F.lit("2"), 2), field("speed", F.lit("0.5"), 3), field("score", F.lit("4.25"), 5), field("reasons", F.lit('["a", "b"]'), 4), F.when(n % 11 == 0, "").otherwise("}"))
    x = x.withColumn("e", store.plan_entry(text))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", *[F.col(f"e.{c}").alias(c) for c in ("source", "end_s", "out_duration_s", "speed", "score")], F.size("e.reasons").cast("bigint").alias("reasons"))


def sidecar_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sidecars of the customers: whole, malformed, no object, missing; read, merged and written again."""
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"banned": ["b'), (k % 3).cast("string"), F.lit('", 1, "a", "a", null, ["x"]], "favorited": {"no": "list"}}'))).when(k % 4 == 1, "{broken").when(k % 4 == 2, "[1, 2]")
    x = table(spark, d, "customer").select("c_custkey", text.alias("t"))
    x = x.withColumns({"banned": store.sidecar_list(F.col("t"), "banned"), "favorited": store.sidecar_list(F.col("t"), "favorited")})
    return x.select("c_custkey", F.array_join("banned", "|").alias("banned"), F.size("favorited").cast("bigint").alias("favorites"), store.sidecar_json(banned=F.concat("banned", F.array(F.lit("z"), F.lit(None), F.lit("a")))).alias("written"))


def latest_plan(spark: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer."""
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return store.latest(x, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def requested_names(spark: SparkSession, d: str) -> DataFrame:
    """The trusted cameras of each folder in the order in which its clips first name them."""
    asked = _clips(spark, d).where("camera is not null and clip_pos is not null").select("folder", "camera", F.col("clip_pos").cast("bigint").alias("place"))
    known = table(spark, d, "cameras").where("trust_rank <= 3").select("camera", "trust_rank")
    return store.in_request_order(asked, known, "camera", "place", "folder").select("folder", "camera", F.col("place").cast("bigint").alias("place"), "trust_rank")


def _music(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ext = F.element_at(F.array(*map(F.lit, (".mp3", ".WAV", ".txt", ".flac", ".Ogg"))), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("/music/"), F.when(k % 13 == 0, ".cache/").otherwise(""), F.when(k % 11 == 0, ".").otherwise(""), F.col("c_name"), ext)
    return table(spark, d, "customer").select("c_custkey", path.alias("path"))


def song_listing(spark: SparkSession, d: str) -> DataFrame:
    """Customers as audio files, listed with the durations known for a third of them."""
    x = _music(spark, d)
    known = x.where("c_custkey % 3 = 0").select("path", (F.col("c_custkey") / 7).alias("duration_s"))
    return store.songs(x.unionByName(x).select("path"), "path", known).select("path", "key", F.round("duration_s", 6).alias("duration_s"))


def capture_times(spark: SparkSession, d: str) -> DataFrame:
    """When each clip's file was taken: embedded moments for some, names, else the time of analysis."""
    c = _clips(spark, d).where("source is not null").withColumn("path", F.coalesce("origin", "source"))
    k = F.col("clip_id")
    path = F.when(k % 5 == 0, F.concat(F.col("path"), F.lit("-2026-04-08-08-43-11"), extension(F.col("path")))).otherwise(F.col("path"))
    exif = F.when(k % 3 == 0, F.format_string("2024:%02d:05 10:00:%02d", (k % 14).cast("int"), (k % 60).cast("int")))
    box = F.when(k % 4 == 0, F.format_string("2025-05-13T17:14:%02d.500000Z", (k % 60).cast("int")))
    return c.select("clip_id", store.captured_at(path, exif, box, F.unix_micros(F.col("analyzed_at").cast("timestamp")) / F.lit(1e6)).alias("taken_at"))


def clip_at(spark: SparkSession, d: str) -> DataFrame:
    """The clip at place 5 in the order of ids."""
    x = _clips(spark, d).select("clip_id", "source", "duration_s")
    few = x.orderBy("clip_id").limit(6).withColumn("pos", F.expr("row_number() over (order by clip_id) - 1"))
    return store.nth(few, "pos", 5).select("clip_id", "source", F.col("pos").cast("bigint").alias("pos"))


def stills_split(spark: SparkSession, d: str) -> DataFrame:
    """The stills behind clips by whether a moving part was extracted."""
    x = _clips(spark, d).where("origin is not null").select("clip_id", "origin", F.when(F.col("clip_id") % 3 == 0, F.col("source")).alias("motion"), (F.col("clip_id") % 2 == 0).alias("marker"))
    return store.split_stills(x, "origin", "motion", "marker").select("clip_id", "role", "orphan")


def import_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of days as users write them, whole or up to midnight."""
    k = F.col("c_custkey")
    since = F.when(k % 9 == 0, "tomorrow").otherwise(F.format_string("2024-%02d-10", (k % 14).cast("int")))
    until = F.when(k % 4 != 0, F.format_string("2024-%02d-%02d", (k % 13).cast("int"), (k % 31).cast("int")))
    x = table(spark, d, "customer").select("c_custkey", since.alias("s"), until.alias("u"))
    now = F.expr("timestamp_ntz'2024-07-01 12:00:00'")
    b = settings.day_bounds(F.col("s"), F.col("u"), now, True)
    m = settings.day_bounds(F.col("s"), F.col("u"), now, False)
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return x.select("c_custkey", show(b["low"]).alias("low"), show(b["high"]).alias("high"), b["folder"].alias("folder"), show(m["high"]).alias("midnight"))


def device_filter(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files of a device, with a declared type for some."""
    k = F.col("c_custkey")
    pick = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), (k % by + 1).cast("int"))
    name, kind = F.concat(F.lit("F"), k.cast("string"), pick(6, ".MP4", ".LRV", ".heic", ".url", ".png", ".txt")), pick(5, "", "public.movie", "public.heic", "public.text", None)
    return table(spark, d, "customer").select("c_custkey", store.device_takes(name, kind).alias("taken"))


def device_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Stills of the listing with the mov of their folder and stem."""
    c = _clips(spark, d)
    f = c.select(F.col("source").alias("path")).unionByName(c.where("origin is not null").select(F.regexp_replace("origin", "/stills/", "/").alias("path"))).where("path is not null").distinct()
    f = f.withColumns({"folder_path": F.regexp_replace("path", r"/[^/]*$", ""), "stem": stem(F.col("path"))})
    return store.live_pairs(f, "folder_path", "stem", "path").select("path", "live")


def best_detections(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each file and half minute as its detection, and the sum of all their scores."""
    x = _cands(spark, d).where("start_s is not null and score is not null and not isnan(score)").select("file", F.floor(F.col("start_s") / 30).alias("slot"), "cand_pos", "score")
    return store.top_detections(x, ["file", "slot"], "score", "cand_pos").select("file", "slot", "cand_pos", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def cache_after(spark: SparkSession, d: str) -> DataFrame:
    """A cache of document texts by author and month after the late ones were put into it."""
    x = table(spark, d, "documents").where("n_chars is not null and received_at is not null").select(F.concat_ws("/", F.coalesce("author", F.lit("-")), (F.col("doc_id") % 12).cast("string")).alias("key"), F.col("doc_id").cast("double").alias("at"), F.col("n_chars").alias("size"))
    return store.cache_put(x.where("at % 3 <> 0"), x.where("at % 3 = 0"), "key", "at", "size", 200_000)


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests of all candidates' files against a cache of the clips with an even id."""
    asked = _cands(spark, d).select("file", F.col("cand_pos").cast("double").alias("used_at"))
    cache = _clips(spark, d).where("clip_id % 2 = 0").select("file", F.lit(10.0).alias("used_at"), F.lit(0).cast("bigint").alias("hits"))
    return store.cache_get(cache, asked, "file", "used_at")[0]


def import_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty orders of each customer's priority, and how many more there are."""
    x = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    return store.dry_run(x, "o_orderpriority", ["o_orderkey"]).select("o_orderpriority", "o_orderkey", F.col("place").cast("bigint").alias("place"), F.col("more").cast("bigint").alias("more"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    line = F.when(q % 4 == 0, F.concat(F.lit("card: "), q.cast("string"), F.lit(" item(s) in range"))).when(q % 4 == 1, F.format_string("phone copied=%d skipped=%d failed=%d", q, F.col("l_partkey").cast("int") % 5, F.lit(1))).otherwise("working")
    return table(spark, d, "lineitem").select("l_orderkey", F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1").alias("seq"), line.alias("line"))


def import_counters(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as log lines of an import, with its running counters."""
    return store.log_counters(_log(spark, d), "l_orderkey", "seq", "line").select("l_orderkey", F.col("seq").cast("bigint").alias("seq"), "copied", "skipped", "failed", "total")


def import_tails(spark: SparkSession, d: str) -> DataFrame:
    """The last three log lines of each import."""
    return store.log_tails(_log(spark, d), "l_orderkey", "seq", "line", 3).select("l_orderkey", F.array_join("tail", "|").alias("tail"))


def progress_fields(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a progress stream, four to a block, with typed values."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.concat(F.lit("frame="), F.floor("value").cast("string"))).when(k % 4 == 1, F.when(k % 8 == 1, "speed=N/A").otherwise(F.concat(F.lit("speed="), F.round("value", 2).cast("string"), F.lit("x")))).when(k % 4 == 2, "no pair").otherwise(F.when(k % 8 == 3, "progress=continue").otherwise("progress=end"))
    b = progress.typed_fields(progress.progress_blocks(e.select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line"))
    return b.select("user_id", F.col("block").cast("bigint").alias("block"), F.col("integers")["frame"].alias("frame"), F.round(F.col("numbers")["speed"], 4).alias("speed"), F.col("texts")["progress"].alias("progress"))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """A feature per clip by a function that fails for clips without motion; their rows stay, with nulls."""
    def energy(row: dict) -> dict:
        values = [x for x in row["motion"] if x is not None]
        return {"total": float(sum(values)), "seconds": len(values)}

    x = extract.extract(_clips(spark, d).select("clip_id", "motion"), energy, "total double, seconds bigint", ["clip_id"])
    return x.select("clip_id", F.round("total", 6).alias("total"), "seconds", F.col("error").isNull().alias("ok"))


def still_variants(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).select("clip_id", settings.still_variant(stem(F.col("source")), F.col("width"), F.col("height"), 1920, 1080).alias("variant"))


def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    aspect = F.element_at(F.array(F.lit("16:9"), F.lit("9:16"), F.lit("1:1")), (F.col("clip_id") % 3 + 1).cast("int"))
    size = settings.frame_size(aspect, F.col("width"), F.col("height"))
    return _clips(spark, d).where("width > 0 and height > 0").select("clip_id", size["width"].alias("w"), size["height"].alias("h"))


def options_menu(spark: SparkSession, d: str) -> DataFrame:
    return settings.options_menu(spark)


def themed_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of every theme over defaults, where the pace was set by hand, and of its preview."""
    base = {"lut": None, "music_db": -8.0, "no_speed_ramp": False, "transitions": "soft", "audio_mix": "ducked", "pace": "medium", "aspect": "9:16", "preview": True, "res": "1920x1080", "fps": 30, "no_reframe": False}
    rows = []
    for t in [*settings.THEMES, "unknown"]:
        s = settings.with_theme(t, base | {"pace": "auto"}, base)
        p = settings.with_preview(s)
        rows.append((t, s["lut"], s["music_db"], s["pace"], p["res"], p["fps"], p["lut"]))
    return spark.createDataFrame(rows, "theme string, lut string, music_db double, pace string, preview_res string, preview_fps int, preview_lut string")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Safe names of the documents' sources and readable sizes."""
    x = table(spark, d, "documents").where("n_chars is not null")
    return x.select("doc_id", settings.slug(F.col("source")).alias("slug"), settings.byte_size(F.col("n_chars") * F.col("doc_id")).alias("size"))


def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of every file with the thumbnail key of its clip."""
    x = _cands(spark, d).select("cand_pos", "file").join(_clips(spark, d).select("file", catalog.content_key(F.col("source"), F.col("width"), length=16).alias("thumb")), "file", "left")
    return x.select("cand_pos", "thumb", base_name(F.col("file")).alias("name"))


QUERIES = {f.__name__: f for f in (telemetry_samples, tag_boxes, config_values, probed, json_entries, sidecar_lists, latest_plan, requested_names, song_listing, capture_times, clip_at, stills_split, import_ranges, device_filter, device_pairs, best_detections, cache_after, cache_hits, import_preview, import_counters, import_tails, progress_fields, extracted, still_variants, frame_sizes, options_menu, themed_settings, labels, thumbnails)}

_LOG = """y as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as seq, cast(trunc(l_quantity) as int) as q from lineitem)"""
_EXT = "lower(regexp_extract({p}, '[^/](\\.[^./]*)$', 1))"
_DAY = "try_strptime(case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then {c} end, '%Y-%m-%d')"

SQL = {
    "telemetry_samples": f"with {_C}, x as (select clip_id, accl from c where len(accl) > 0 and len(list_filter(accl, lambda v: v is not null and not isnan(v) and v >= 0 and v < 1e6)) = len(accl)), e as (select clip_id, unnest(accl) as v, unnest(range(0, len(accl))) as i from x) select clip_id, 'ACCL' as stream, i, round(floor(v * 1000) / 1000, 6) as value from e",
    "tag_boxes": f"with {_C} select clip_id, unnest(tags_ms) as tag_ms from c where len(tags_ms) > 0 and len(list_filter(tags_ms, lambda t: t is not null and t >= 0 and t < 4294967296)) = len(tags_ms)",
    "config_values": "select 'K' || c_custkey as key, case c_custkey % 6 when 2 then 'v' when 3 then 'x # y' else 'a=b' end as value from customer where c_custkey % 6 in (2, 3, 4)",
    "probed": f"with {_C} select clip_id, case clip_id % 5 when 0 then round(30000.0::double / 1001, 6) else 30.0 end as fps, case when clip_id % 5 in (1, 2) then coalesce(height, 1080) else coalesce(width, 1920) end as width, case when clip_id % 5 in (1, 2) then coalesce(width, 1920) else coalesce(height, 1080) end as height, coalesce(duration_s >= 0.3 and not isnan(duration_s), false) as usable from c",
    "json_entries": """with x as (select *, l_partkey as n, l_partkey % 11 <> 0 and l_partkey % 7 <> 0 as ok from lineitem)
      select l_orderkey, l_linenumber, l_partkey, l_quantity, case when ok then 's' || n end as source, case when ok then 9.5::double end as end_s, case when ok then case when n % 2 <> 0 then 2.0::double else 8.0 end end as out_duration_s,
        case when ok then case when n % 3 <> 0 then 0.5::double else 1.0 end end as speed, case when ok then case when n % 5 <> 0 then 4.25::double else 0.0 end end as score, case when ok then case when n % 4 <> 0 then 2 else 0 end end::bigint as reasons from x""",
    "sidecar_lists": """with x as (select c_custkey, case when c_custkey % 4 = 0 then ['b' || (c_custkey % 3), 'a'] else [] end as b from customer)
      select c_custkey, array_to_string(b, '|') as banned, 0::bigint as favorites, case when len(b) = 0 then '{"banned":["z","a"]}' else '{"banned":["' || b[1] || '","a","z"]}' end as written from x""",
    "latest_plan": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_custkey is not null) where r = 1",
    "requested_names": f"with {_C}, a as (select folder, camera, min(clip_pos) as at_ from c where camera is not null and clip_pos is not null group by 1, 2) select a.folder, a.camera, row_number() over (partition by a.folder order by at_, a.camera) - 1 as place, m.trust_rank from a join cameras m on m.camera = a.camera where m.trust_rank <= 3",
    "song_listing": """with x as (select c_custkey, '/music/' || case when c_custkey % 13 = 0 then '.cache/' else '' end || case when c_custkey % 11 = 0 then '.' else '' end || c_name || ['.mp3', '.WAV', '.txt', '.flac', '.Ogg'][c_custkey % 5 + 1] as path from customer)
      select path, lower(split_part(path, '/', -1)) as key, case when c_custkey % 3 = 0 then round(c_custkey / 7, 6) end as duration_s from x where c_custkey % 13 <> 0 and c_custkey % 11 <> 0 and c_custkey % 5 <> 2""",
    "capture_times": f"""with {_C}, x as (select *, coalesce(origin, source) as p0, clip_id as n from c where source is not null), y as (select *, {_EXT.format(p='p0')} as ext,
        epoch(try_strptime(case when n % 3 = 0 then printf('2024:%02d:05 10:00:%02d', n % 14, n % 60) end, '%Y:%m:%d %H:%M:%S')) as ex, case when n % 4 = 0 then epoch(timestamp '2025-05-13 17:14:00') + n % 60 + 0.5 end as bx, case when n % 5 = 0 then epoch(timestamp '2026-04-08 08:43:11') end as nm from x)
      select clip_id, coalesce(case when ext in ('.heic', '.heif', '.jpg', '.jpeg', '.png') then ex end, case when ext in ('.mp4', '.mov', '.m4v', '.insv', '.lrv') then bx end, ex, bx, nm, epoch(analyzed_at))::double as taken_at from y""",
    "clip_at": f"with {_C} select clip_id, source, 5::bigint as pos from c order by clip_id limit 1 offset 5",
    "stills_split": f"with {_C} select clip_id, case when clip_id % 3 = 0 and source is not null then 'motion' else 'still' end as role, not (clip_id % 3 = 0 and source is not null) and clip_id % 2 = 0 and {_EXT.format(p='origin')} in ('.heic', '.heif') as orphan from c where origin is not null",
    "import_ranges": f"""with x as (select c_custkey, case when c_custkey % 9 = 0 then 'tomorrow' else printf('2024-%02d-10', c_custkey % 14) end as s, case when c_custkey % 4 <> 0 then printf('2024-%02d-%02d', c_custkey % 13, c_custkey % 31) end as u from customer),
      y as (select *, {_DAY.format(c='s')} as lo, case when u is null then timestamp '2024-07-01 12:00:00' else {_DAY.format(c='u')} end as hi from x), z as (select *, case when u is null then hi else hi + interval '1 day' - interval '1 microsecond' end as top from y)
      select c_custkey, case when top >= lo then strftime(lo, '%Y-%m-%d %H:%M:%S.%f') end as low, case when top >= lo then strftime(top, '%Y-%m-%d %H:%M:%S.%f') end as high, case when top >= lo then strftime(lo, '%Y-%m-%d') || '_to_' || strftime(top, '%Y-%m-%d') end as folder, case when hi >= lo then strftime(hi, '%Y-%m-%d %H:%M:%S.%f') end as midnight from z""",
    "device_filter": "with x as (select c_custkey, ['.mp4', '.lrv', '.heic', '.url', '.png', '.txt'][c_custkey % 6 + 1] as e, ['', 'public.movie', 'public.heic', 'public.text', ''][c_custkey % 5 + 1] as k from customer) select c_custkey, e not in ('.lrv', '.url') and case when k = '' then e in ('.mp4', '.heic', '.png') else k in ('public.movie', 'public.heic') end as taken from x",
    "device_pairs": f"""with {_C}, f as (select distinct path from (select source as path from c union all select replace(origin, '/stills/', '/') from c where origin is not null) where path is not null),
      g as (select path, regexp_replace(path, '/[^/]*$', '') as fo, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') as st, {_EXT.format(p='path')} as e from f)
      select s.path, min(m.path) as live from g s left join g m on m.fo = s.fo and m.st = s.st and m.e = '.mov' where s.e in ('.heic', '.heif', '.jpg', '.jpeg', '.png') group by 1""",
    "best_detections": f"with {_K}, x as (select file, cast(floor(start_s / 30) as bigint) as slot, cand_pos, score from k where start_s is not null and score is not null and not isnan(score)) select file, slot, cand_pos, round(score, 6) as score, round(total, 6) as confidence from (select *, row_number() over (partition by file, slot order by score desc, cand_pos) as r, sum(score) over (partition by file, slot) as total from x) where r = 1",
    "cache_after": """with x as (select coalesce(author, '-') || '/' || (doc_id % 12) as key, doc_id::double as "at", n_chars as size from documents where n_chars is not null and received_at is not null),
      l as (select * from (select *, row_number() over (partition by key order by "at" desc) as r from x) where r = 1), s as (select *, sum(size) over (order by "at" desc, key desc) as upto, row_number() over (order by "at" desc, key desc) as k from l) select key, "at", size from s where upto <= 200000 or k = 1""",
    "cache_hits": f"with {_K}, {_C}, u as (select file, max(cand_pos) as m, count(*) as n from k group by 1) select c.file, greatest(10.0, coalesce(u.m, 10))::double as used_at, coalesce(u.n, 0)::bigint as hits from c left join u using (file) where clip_id % 2 = 0",
    "import_preview": "with x as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as place, count(*) over (partition by o_orderpriority) as n from orders) select o_orderpriority, o_orderkey, place, greatest(0, n - 20) as more from x where place < 20",
    "import_counters": f"""with {_LOG} select l_orderkey, seq, sum(case when q % 4 = 1 then q else 0 end) over w::bigint as copied, sum(case when q % 4 = 1 then l_partkey % 5 else 0 end) over w::bigint as skipped, sum(case when q % 4 = 1 then 1 else 0 end) over w::bigint as failed, sum(case when q % 4 = 0 then q else 0 end) over w::bigint as total
      from y window w as (partition by l_orderkey order by seq rows unbounded preceding)""",
    "import_tails": f"""with {_LOG}, z as (select l_orderkey, seq, row_number() over (partition by l_orderkey order by seq desc) as r, case when q % 4 = 0 then 'card: ' || q || ' item(s) in range' when q % 4 = 1 then 'phone copied=' || q || ' skipped=' || (l_partkey % 5) || ' failed=1' else 'working' end as line from y)
      select l_orderkey, string_agg(line, '|' order by seq) as tail from z where r <= 3 group by 1""",
    "progress_fields": """with x as (select *, event_id % 4 as m, coalesce(sum(case when event_id % 4 = 3 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as block from events where event_id % 4 <> 2)
      select user_id, block::bigint as block, arg_max(cast(floor(value) as bigint), event_id) filter (where m = 0) as frame, round(case when max(case when m = 1 then event_id end) % 8 = 1 then null else arg_max(round(value, 2), event_id) filter (where m = 1) end, 4) as speed, max(case when m = 3 then case when event_id % 8 = 3 then 'continue' else 'end' end end) as progress from x group by 1, 2""",
    "extracted": f"with {_C} select clip_id, case when motion is not null then round(coalesce(list_sum(list_filter(motion, lambda x: x is not null)), 0), 6) end as total, len(list_filter(motion, lambda x: x is not null)) as seconds, motion is not null as ok from c",
    "still_variants": f"with {_C} select clip_id, case when width > 0 and height > 0 and width / height < 1920 / 1080 * 0.85 then 'fit_pad' else ['live', 'live', 'push', 'pull', 'pan_h', 'fit_pad', 'blurred_bg', 'shake'][(('0x' || substr(sha1(regexp_replace(split_part(source, '/', -1), '(.)\\.[^.]*$', '\\1')), 1, 8))::UBIGINT % 8)::bigint + 1] end as variant from c",
    "frame_sizes": f"with {_C} select clip_id, case clip_id % 3 when 0 then width when 1 then case when width = height then 1080 else least(width, height) end else least(width, height) end as w, case clip_id % 3 when 0 then height when 1 then case when width = height then 1920 else greatest(width, height) end else least(width, height) end as h from c where width > 0 and height > 0",
    "options_menu": """select * from (values ('theme', 0, 'chill'), ('theme', 1, 'cinematic'), ('theme', 2, 'nostalgic'), ('theme', 3, 'punchy'), ('audio_mix', 0, 'ducked'), ('audio_mix', 1, 'music_only'), ('audio_mix', 2, 'clip_only'), ('pace', 0, 'auto'), ('pace', 1, 'slow'), ('pace', 2, 'medium'), ('pace', 3, 'fast'),
      ('transitions', 0, 'soft'), ('transitions', 1, 'auto'), ('transitions', 2, 'cut'), ('aspect', 0, '16:9'), ('aspect', 1, '9:16'), ('aspect', 2, '1:1'), ('resolution', 0, '1920x1080'), ('resolution', 1, '1080x1920'), ('resolution', 2, '1080x1080'), ('resolution', 3, '1280x720')) t(option, place, choice)""",
    "themed_settings": """select * from (values ('cinematic', 'cinematic', -9.0::double, 'auto', '480x854', 24, null::varchar), ('punchy', 'punchy', -6.0, 'auto', '480x854', 24, null), ('chill', 'chill', -10.0, 'auto', '480x854', 24, null), ('nostalgic', 'nostalgic', -10.0, 'auto', '480x854', 24, null), ('unknown', null, -8.0, 'auto', '480x854', 24, null)) t(theme, lut, music_db, pace, preview_res, preview_fps, preview_lut)""",
    "labels": """with x as (select doc_id, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s, n_chars * doc_id as n from documents where n_chars is not null)
      select doc_id, case when s = '' then 'camera' else s end as slug, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.2f KB', n / 1024) when n < 1073741824 then printf('%.2f MB', n / 1048576) else printf('%.2f GB', n / 1073741824) end as size from x""",
    "thumbnails": f"with {_K}, {_C}, t as (select file, substr(sha1(concat_ws('|', coalesce(source, ''), coalesce(width::varchar, ''))), 1, 16) as thumb from c) select cand_pos, thumb, split_part(k.file, '/', -1) as name from k left join t on t.file = k.file",
}
