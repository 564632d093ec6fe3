"""Documents, sidecars, caches, listings and logs as tables: lenient readers, upserts and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import base_name, extension, iso_time, name_time
from lumenframe.sources.catalog import AUDIO, LIVE_VIDEO, STILL, VIDEO, evict, visible

# What a device listing takes and leaves out.
TAKEN_TYPES = ["public.movie", "public.mpeg-4", "public.jpeg", "public.heic", "public.heif", "public.tiff", "public.image"]
TAKEN_EXTENSIONS = [".mp4", ".mov", ".m4v", ".jpg", ".jpeg", ".heic", ".heif", ".png", ".tif", ".tiff"]
LEFT_EXTENSIONS = [".lrv", ".thm", ".url", ".sav"]
#: Lines kept of a job's log, items shown of a dry run.
LOG_LINES, SHOWN = 200, 20

#: Type of a plan entry as it is stored in JSON; unknown fields are ignored, missing ones are null.
ENTRY = "source string, start_s double, end_s double, out_duration_s double, speed double, beat_time_s double, score double, reasons array<string>, components map<string,double>"


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The JSON documents of a folder by a fixed schema; unknown fields are ignored, missing ones and malformed documents are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)


def plan_entry(json: Column) -> Column:
    """A plan entry from JSON with defaults for what is missing; null without a source or a window, and for text that isn't an object."""
    e = F.from_json(json, ENTRY, {"mode": "PERMISSIVE"})
    number = lambda name, default: F.coalesce(e[name], default if isinstance(default, Column) else F.lit(default)).alias(name)
    whole = e["source"].isNotNull() & e["start_s"].isNotNull() & e["end_s"].isNotNull()
    return F.when(
        whole,
        F.struct(
            e["source"].alias("source"), e["start_s"].alias("start_s"), e["end_s"].alias("end_s"), number("out_duration_s", e["end_s"] - e["start_s"]), number("speed", 1.0), number("beat_time_s", 0.0), number("score", 0.0),
            F.coalesce(e["reasons"], F.array().cast("array<string>")).alias("reasons"), F.coalesce(e["components"], F.create_map().cast("map<string,double>")).alias("components"),
        ),
    )


def sidecar_list(json: Column, field: str) -> Column:
    """The strings of a list in a sidecar, each once in order of appearance; other items are left out, and a missing or malformed sidecar or field is an empty list."""
    items = F.try_variant_get(F.try_parse_json(json), f"$.{field}", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    return F.coalesce(F.array_distinct(texts), F.array().cast("array<string>"))


def sidecar_json(**lists: Column) -> Column:
    """A sidecar's text from lists of strings: nulls left out, each string once in order of appearance."""
    return F.to_json(F.struct(*[F.coalesce(F.array_distinct(F.array_compact(c)), F.array().cast("array<string>")).alias(k) for k, c in lists.items()]))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key by (``at``, ``tie``), found by a map-side maximum; rows without a time come last."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(at).isNotNull(), F.col(at), F.col(tie)))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*")


def in_request_order(requested: DataFrame, known: DataFrame, name: str, place: str, scope: str | None = None) -> DataFrame:
    """The known rows that were asked for, each once, with ``place`` from 0 in the order of the request; unknown names are dropped."""
    keys = [scope, name] if scope else [name]
    first = requested.groupBy(*keys).agg(F.min(place).alias("__at"))
    hit = first.join(known.dropDuplicates([name]), name)
    w = Window.partitionBy(scope).orderBy("__at", name) if scope else Window.orderBy("__at", name)
    return hit.withColumn(place, F.row_number().over(w) - 1).drop("__at")


def nth(df: DataFrame, pos: str, i: int) -> DataFrame:
    """The row at place ``i``; a place that isn't there is refused."""
    n = df.agg(F.max(pos)).first()[0]
    if n is None or not 0 <= i <= n:
        raise IndexError(f"{i} out of range (have {0 if n is None else n + 1})")
    return df.where(F.col(pos) == i)


def split_stills(stills: DataFrame, path: str, motion: str, marker: str) -> DataFrame:
    """``stills`` with ``role``: ``motion`` where a moving part was extracted, else ``still``; and ``orphan`` where a heic says it had one that isn't there.

    ``motion`` holds the extracted file or null, ``marker`` whether the file names one.
    """
    has = F.col(motion).isNotNull()
    orphan = ~has & F.coalesce(F.col(marker), F.lit(False)) & extension(F.col(path)).isin(".heic", ".heif")
    return stills.withColumns({"role": F.when(has, "motion").otherwise("still"), "orphan": orphan})


def songs(files: DataFrame, path: str, known: DataFrame, duration: str = "duration_s") -> DataFrame:
    """The visible audio files, each once, with their known duration and ``key``, the lower-case name they are listed by."""
    x = files.where(extension(F.col(path)).isin(AUDIO) & visible(F.col(path))).select(path).distinct()
    return x.join(known.select(path, duration).dropDuplicates([path]), path, "left").withColumns({"name": base_name(F.col(path)), "key": F.lower(base_name(F.col(path)))})


def captured_at(path: Column, exif: Column, container: Column, modified: Column) -> Column:
    """When a file was taken, in POSIX seconds: the embedded moment that its kind holds first, then the other, the one in its name, and its time of change.

    ``exif`` and ``container`` are the embedded texts, ``modified`` is in seconds. Moments without a zone are the session's.
    """
    still, moving = extension(path).isin(STILL), extension(path).isin(VIDEO)
    a, b = iso_time(exif), iso_time(container)
    named = F.unix_micros(name_time(base_name(path)).cast("timestamp")) / F.lit(1e6)
    return F.coalesce(F.when(still, a), F.when(moving, b), a, b, named, modified)


def probed(rate: Column, width: Column, height: Column, rotation: Column, duration: Column) -> Column:
    """``(fps, width, height, usable)`` of a container: the rate ``30000/1001`` (30 when it can't be read), sides (1920 x 1080 when unknown) swapped when turned by a quarter, and whether it lasts 0.3 s or more."""
    parts = F.split(rate, "/")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    fps = F.when(F.size(parts) == 2, F.try_divide(number(1), number(2)))
    width, height = F.coalesce(width, F.lit(1920)), F.coalesce(height, F.lit(1080))
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(180)) == 90
    usable = F.coalesce((duration >= 0.3) & ~F.isnan(duration), F.lit(False))
    return F.struct(F.coalesce(fps, F.lit(30.0)).alias("fps"), F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"), usable.alias("usable"))


def device_takes(name: Column, kind: Column) -> Column:
    """Whether a device's file is imported: never proxies and the like, by its declared type, and by its extension when it declares none."""
    e = extension(name)
    return ~e.isin(LEFT_EXTENSIONS) & F.when(F.coalesce(kind, F.lit("")) == "", e.isin(TAKEN_EXTENSIONS)).otherwise(kind.isin(TAKEN_TYPES))


def live_pairs(files: DataFrame, folder: str, stem: str, path: str) -> DataFrame:
    """Stills of a device with the ``live`` mov of the same folder and stem, null without one; movs of such a pair are not listed themselves."""
    e = extension(F.col(path))
    moving = files.where(e.isin(LIVE_VIDEO)).groupBy(folder, stem).agg(F.min(path).alias("live"))
    return files.where(e.isin(STILL)).join(moving, [folder, stem], "left")


def top_detections(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best detection of each key (highest score, then smaller ``tie``) and ``confidence``, the sum of all; rows without a score don't count."""
    usable = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(-F.col(score), F.col(tie)))
    return usable.groupBy(*keys).agg(best.alias("r"), F.sum(score).alias("confidence")).select(*keys, "r.*", "confidence")


def cache_put(cache: DataFrame, new: DataFrame, key: str, at: str, size: str, cap_bytes: int) -> DataFrame:
    """The cache after ``new`` entries: the last write of a key counts, then the oldest are evicted until the rest fits; the newest entry always stays."""
    both = latest(cache.select(*new.columns).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))), key, at, "__new").drop("__new")
    return evict(both, cap_bytes, size, at, key, protect_newest=True).where("kept").drop("kept")


def cache_get(cache: DataFrame, asked: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(the cache with the times of use of its hits renewed and counted in ``hits``, ``(hits, misses)`` of the requests ``(key, at)``)."""
    use = asked.groupBy(key).agg(F.max(at).alias("__at"), F.count(F.lit(1)).alias("__n"))
    hit = cache.join(use, key, "left")
    used = hit.withColumns({at: F.greatest(at, "__at"), "hits": F.coalesce("hits", F.lit(0)) + F.coalesce("__n", F.lit(0))}).drop("__at", "__n")
    found = F.col("__there").isNotNull()
    stats = asked.join(cache.select(key, F.lit(1).alias("__there")).dropDuplicates([key]), key, "left").agg(F.count_if(found).alias("hits"), F.count_if(~found).alias("misses"))
    return used, stats


def dry_run(items: DataFrame, key: str, order: list[str], shown: int = SHOWN) -> DataFrame:
    """The first items of each key with ``place`` from 0, and ``more``, the number of the others."""
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    x = items.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).where(F.col("place") < shown)
    return x.join(n, key).withColumn("more", F.greatest(F.lit(0), F.col("__n") - shown)).drop("__n")


def log_counters(lines: DataFrame, job: str, seq: str, line: str) -> DataFrame:
    """``lines`` with running totals ``copied, skipped, failed, total``: of ``copied=1 skipped=2 failed=3``, else of ``: 4 item(s) in range``."""
    done = [F.regexp_extract(line, r"copied=(\d+)\s+skipped=(\d+)\s+failed=(\d+)", g) for g in (1, 2, 3)]
    found = F.regexp_extract(line, r":\s+(\d+)\s+item\(s\)\s+in\s+range", 1)
    w = Window.partitionBy(job).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda c: F.coalesce(F.sum(F.when(c != "", c.cast("bigint"))).over(w), F.lit(0))
    return lines.withColumns({"copied": count(done[0]), "skipped": count(done[1]), "failed": count(done[2]), "total": count(F.when(done[0] == "", found))})


def log_tails(lines: DataFrame, job: str, seq: str, line: str, keep: int = LOG_LINES) -> DataFrame:
    """``(job, tail)``: the last lines of each job in order, of which no more than ``keep`` are ever collected."""
    r = F.row_number().over(Window.partitionBy(job).orderBy(F.col(seq).desc()))
    last = lines.withColumn("__r", r).where(F.col("__r") <= keep)
    return last.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(line).alias("l")))), lambda x: x["l"]).alias("tail"))
