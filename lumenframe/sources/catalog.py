"""File listings, content keys, caches, sinks and sidecars as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import base_name, extension, stem

# File kinds, folders a listing leaves out, and names of earlier results.
VIDEO = [".mp4", ".mov", ".m4v", ".insv", ".lrv"]
STILL = [".heic", ".heif", ".jpg", ".jpeg", ".png"]
AUDIO = [".mp3", ".wav", ".m4a", ".flac", ".aac", ".ogg"]
LIVE_VIDEO = [".mov"]
SKIPPED_DIRS = ["__pycache__", ".git", "node_modules", ".cache", "lumenframe_workdir"]
OUTPUT_HINTS = ["lumenframe", "highlight_reel", "recap"]
#: Ranges of ages that eviction totals at least.
RANGES = 64


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, modified, bytes)`` of every file below ``folder``; the contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def under_skipped(path: Column, skipped: list[str] = SKIPPED_DIRS) -> Column:
    """Whether a folder above the file (not the file itself) is one to skip, in this letter case."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), F.array(*map(F.lit, skipped)))


def kind_of(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(VIDEO), "video").when(e.isin(STILL), "still").when(e.isin(AUDIO), "audio").otherwise("other")


def prior_output(path: Column, hints: list[str] = OUTPUT_HINTS) -> Column:
    """Whether a file looks like an earlier result: an mp4 or mov whose name holds one of the hints, in any letter case."""
    name = F.lower(base_name(path))
    named = F.lit(False)
    for hint in hints:
        named = named | name.contains(hint.lower())
    return extension(path).isin(".mp4", ".mov") & named


def visible(path: Column) -> Column:
    """Neither hidden nor below a skipped folder."""
    return ~base_name(path).startswith(".") & ~under_skipped(path)


def discover(files: DataFrame, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """The usable videos of a listing with ``pos`` in path order per folder: no hidden files, skipped folders, earlier results or excluded paths."""
    x = files.where(kind_of(F.col(path)) == "video").where(visible(F.col(path))).where(~prior_output(F.col(path)))
    if excluded is not None:
        x = x.join(excluded.select(F.col(path)), path, "left_anti")
    folder = F.regexp_replace(F.col(path), r"/[^/]*$", "")
    return x.withColumn("folder_path", folder).withColumn("pos", F.row_number().over(Window.partitionBy("folder_path").orderBy(path)) - 1)


def stills_without_motion(files: DataFrame, path: str) -> DataFrame:
    """Visible stills without a visible mov of the same stem anywhere in the listing."""
    kinds = files.where(visible(F.col(path))).withColumns({"__kind": kind_of(F.col(path)), "__stem": stem(F.col(path))})
    moving = kinds.where(extension(F.col(path)).isin(LIVE_VIDEO)).select("__stem").distinct()
    return kinds.where("__kind = 'still'").join(moving, "__stem", "left_anti").drop("__kind", "__stem")


def listing(files: DataFrame, path: str, selected: DataFrame | None = None) -> DataFrame:
    """One row per (folder, stem) with its kind label: a still and a video of one stem are a live pair."""
    x = files.withColumns({"folder_path": F.regexp_replace(F.col(path), r"/[^/]*$", ""), "stem": F.lower(stem(F.col(path))), "kind": kind_of(F.col(path))}).where("kind in ('video', 'still')")
    g = x.groupBy("folder_path", "stem").agg(F.min(F.when(F.col("kind") == "video", F.col(path))).alias("video"), F.min(F.when(F.col("kind") == "still", F.col(path))).alias("still"), F.count(F.lit(1)).alias("files"))
    return g.select("folder_path", "stem", F.coalesce("video", "still").alias("path"), F.when(F.col("video").isNotNull() & F.col("still").isNotNull(), "live").when(F.col("video").isNotNull(), "video").otherwise("still").alias("label"), "files")


def sources(files: DataFrame, path: str, captured: str, excluded: DataFrame | None = None) -> DataFrame:
    """The sources that a picker shows, with ``kind``, ``selected`` and ``pos`` per folder by time of capture (unknown last), then name.

    Visible videos that are no earlier results, and visible stills; a still whose stem has a mov anywhere is hidden behind it, and the mov is a
    ``live_photo``. Paths in ``excluded`` are shown but not selected.
    """
    x = files.where(visible(F.col(path))).withColumns({"__stem": stem(F.col(path)), "kind": kind_of(F.col(path)), "__mov": extension(F.col(path)).isin(LIVE_VIDEO)})
    x = x.where((F.col("kind") == "still") | ((F.col("kind") == "video") & ~prior_output(F.col(path))) | F.col("__mov"))
    pairs = x.groupBy("__stem").agg((F.max("__mov") & F.max(F.col("kind") == "still")).alias("__pair"))
    x = x.join(pairs, "__stem").where(~(F.col("__pair") & (F.col("kind") == "still"))).where(~prior_output(F.col(path)))
    x = x.withColumn("kind", F.when(F.col("__pair") & F.col("__mov"), "live_photo").otherwise(F.col("kind")))
    if excluded is not None:
        x = x.join(excluded.select(F.col(path).alias("__out")).distinct(), F.col(path) == F.col("__out"), "left").withColumn("selected", F.col("__out").isNull()).drop("__out")
    else:
        x = x.withColumn("selected", F.lit(True))
    w = Window.partitionBy("folder_path").orderBy(F.col(captured).asc_nulls_last(), base_name(F.col(path)), path)
    return x.withColumn("folder_path", F.regexp_replace(F.col(path), r"/[^/]*$", "")).withColumn("pos", F.row_number().over(w) - 1).drop("__stem", "__mov", "__pair")


def ordered_union(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The rows of all ``parts``, repeated ones too, with ``part``; sorting by part and ``order`` gives the parts one after the other."""
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)))
    return out.select("part", *[c for c in parts[0].columns if c not in order], *order)


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Each key once, with the smallest place it has."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(pos).alias(pos))


def recombined(items: DataFrame, cached: DataFrame, computed: DataFrame, key: str, pos: str) -> DataFrame:
    """``items (key, pos)`` with their cached or newly computed columns, in the places they had; an item without either was lost and is left out."""
    return items.select(key, pos).join(cached.unionByName(computed).dropDuplicates([key]), key)


def content_key(*parts: Column, length: int = 40) -> Column:
    """sha1 of the parts joined by ``|`` (null as an empty string), cut to ``length`` hex digits."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length)


def group_key(df: DataFrame, group: str, line: Column, length: int = 12) -> DataFrame:
    """``(group, key)``: a content key over the sorted lines of each group, order-free. Lines are hashed first, and the 128-bit
    hashes are added up, so no group is ever collected."""
    h1, h2 = F.xxhash64(line).cast("decimal(38,0)"), F.xxhash64(F.lit(1), line).cast("decimal(38,0)")
    return df.groupBy(group).agg(F.substring(F.sha1(F.concat_ws("|", F.sum(h1).cast("string"), F.sum(h2).cast("string"), F.count(F.lit(1)).cast("string"))), 1, length).alias("key"))


def folder_key(df: DataFrame, group: str, line: Column, length: int = 12) -> DataFrame:
    """``(group, key)``: sha1 over the sorted, newline-joined lines of each group. For folders, whose listings are bounded by the file system."""
    return df.groupBy(group).agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")), 1, length).alias("key"))


def split_by_cache(items: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses)."""
    return items.join(cache, key), items.join(cache.select(key), key, "left_anti")


def evict(entries: DataFrame, cap_bytes: int, size: str, at: str, tie: str, protect_newest: bool = False) -> DataFrame:
    """``entries`` with ``kept``: the oldest go until the rest fits ``cap_bytes``; a cap of 0 or less keeps all.

    The running total from the newest is a sum per range of ages plus the totals of the newer ranges, so no task orders all entries. The ranges lie
    between quantiles of the ages and hold about a million entries each (1,000 ranges at most); an unknown age is the oldest.
    """
    if cap_bytes <= 0:
        return entries.withColumn("kept", F.lit(True))
    parts = min(1000, max(RANGES, entries.count() // 1_000_000))
    bounds = sorted(set(entries.agg(F.percentile_approx(F.col(at).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    ends = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    x = entries.withColumn("__p", F.when(F.col(at).isNull(), -1).otherwise(F.size(F.filter(ends, lambda b: b < F.col(at).cast("double")))))
    total = x.groupBy("__p").agg(F.sum(size).alias("__t")).withColumn("__newer", F.coalesce(F.sum("__t").over(Window.orderBy(F.col("__p").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("__p").orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    x = x.withColumns({"__run": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__r": F.row_number().over(w)}).join(F.broadcast(total.select("__p", "__newer")), "__p")
    keep = F.col("__run") + F.col("__newer") <= cap_bytes
    if protect_newest:
        keep = keep | ((F.col("__r") == 1) & (F.col("__newer") == 0))
    return x.withColumn("kept", keep).drop("__p", "__run", "__r", "__newer")


def copy_actions(items: DataFrame, present: DataFrame, name: str, size: str) -> DataFrame:
    """``items`` with ``action``: copy what isn't there, skip what is there with the same size, warn where the size differs."""
    there = present.select(F.col(name), F.col(size).alias("__size")).dropDuplicates([name])
    x = items.join(there, name, "left")
    return x.withColumn("action", F.when(F.col("__size").isNull(), "copy").when(F.col("__size") == F.col(size), "skip").otherwise("conflict")).drop("__size")


def recents(opened: DataFrame, user: str, path: str, at: str, keep: int = 10) -> DataFrame:
    """The ``keep`` last opened paths of each user, each once."""
    last = opened.groupBy(user, path).agg(F.max(at).alias(at))
    r = F.row_number().over(Window.partitionBy(user).orderBy(F.col(at).desc(), path))
    return last.withColumn("place", r).where(F.col("place") <= keep)


def config_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(key, value)`` of KEY=VALUE lines: blank lines, comments and lines without ``=`` are left out, one pair of quotes and inline comments stripped."""
    text = F.trim(F.col(line))
    x = lines.where((text != "") & ~text.startswith("#") & text.contains("=")).select(F.trim(F.substring_index(text, "=", 1)).alias("key"), F.trim(F.regexp_replace(text, r"^[^=]*=", "")).alias("v"))
    quoted = F.regexp_extract("v", "^([\"'])(.*)\\1", 2)
    return x.select("key", F.when(F.col("v").rlike("^([\"']).*\\1"), quoted).otherwise(F.trim(F.regexp_replace("v", r"\s+#.*$", ""))).alias("value"))


def layered(names: list[str], *layers: dict[str, object]) -> dict[str, object]:
    """Resolved settings: later layers win, nulls and unknown names fall through."""
    out: dict[str, object] = dict.fromkeys(names)
    for layer in layers:
        out |= {k: v for k, v in layer.items() if k in out and v is not None}
    return out


def write_snapshot(df: DataFrame, folder: str, id_column: str) -> None:
    """Write ``df`` partitioned by its snapshot id; only the partitions it holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(id_column).parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, id_column: str, value: str) -> DataFrame:
    """One snapshot, by partition pruning."""
    return spark.read.parquet(folder).where(F.col(id_column) == value)
