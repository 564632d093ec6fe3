"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.paths import normalized
from lumenframe.llm import caps, clusters, links, mixing, neighbours, oracle, packing, pii, survivors, tokens
from lumenframe.session import Written, table

DIM, MIN_COS, MAX_BITS = 96, 0.75, 8
K_NEAREST, NEAR_COS = 5, 0.85
CAP = 40
CONTAINER = 2048


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters_with_signatures(table(spark, d, "clips").select("clip_id", "folder", "signature", "embedding"), DIM, MIN_COS, MAX_BITS)


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    members, data = clusters.similar_clusters(table(spark, d, "clips"), "clip_id", "embedding", DIM, MIN_COS)
    return clusters.cluster_report(members, data)


def p1_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of bisecting k-means, before they are joined: sizes, compactness and the members nearest to the centre."""
    return clusters.cluster_report(*clusters.leaves(table(spark, d, "clips"), "clip_id", "embedding", DIM, MIN_COS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return links.hash_to_min(links.matching_pairs(table(spark, d, "clip_matches"))).select(F.col("id").alias("clip_id"), "group_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, d, "clips"), "clip_id", "embedding", DIM, K_NEAREST, NEAR_COS))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every clip whose id is divisible by 50, against all clips, however similar."""
    return neighbours.nearest(table(spark, d, "clips"), "clip_id", "embedding", DIM, K_NEAREST, visits=24.0, query_step=50, settle=True)


def _clip_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clips").select(normalized(F.col("source")).alias("file")).where("file is not null").distinct()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("cand_pos", "score", "scored_at", normalized(F.col("source")).alias("file"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    named = _candidates(spark, d).select("cand_pos", "score", "file").join(_clip_files(spark, d), "file", "left_semi")
    return caps.capped_out(named, "file", "score", "cand_pos", CAP)


def p5_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The same cap, split over the years of ``scored_at`` by largest remainder."""
    named = _candidates(spark, d).withColumn("year", F.year("scored_at")).join(_clip_files(spark, d), "file", "left_semi")
    return caps.cap_contributors(named, "file", "score", "cand_pos", CAP, "year").select("cand_pos", "file", "year", F.col("kept_rank").cast("bigint").alias("kept_rank"))


def _grouped_clips(spark: SparkSession, d: str) -> DataFrame:
    fields = ["clip_id", "folder", "source", "camera", "duration_s", "fps", "width", "height", "captured_at", "analyzed_at", "duplicate_group"]
    clips = table(spark, d, "clips").select(*fields).withColumn("number", survivors.stamp_number(F.col("duplicate_group"))).where("number is not null and folder is not null").drop("duplicate_group").dropDuplicates(["clip_id"])
    sizes = clips.groupBy("folder", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    clips = clips.join(sizes, ["folder", "number"]).withColumn("file", normalized(F.col("source")))
    best = _candidates(spark, d).where("score is not null and not isnan(score)").groupBy("file").agg(F.max("score").alias("score"))
    cameras = table(spark, d, "cameras").select("camera", "trust_rank", F.col("first_seen").alias("seen")).dropDuplicates(["camera"])
    return clips.join(best, "file", "left").join(cameras, "camera", "left").withColumn("duplicate_group", F.concat(F.lit("g"), "number"))


_SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {}) / 1000000.0D"


def _order() -> list:
    return [F.col("trust_rank").asc_nulls_last(), F.col("score").desc_nulls_last(), F.col("analyzed_at").desc_nulls_last(), F.col("clip_id").asc()]


def _usable() -> dict:
    ok = {f: F.col(f).isNotNull() & (F.col(f) > 0) & ~F.isnan(F.col(f).cast("double")) for f in ("duration_s", "fps", "width", "height", "captured_at")}
    after = F.col("seen").isNull() | (F.col("captured_at") >= F.expr(_SECONDS.format("seen")))
    before = F.col("analyzed_at").isNull() | (F.col("captured_at") <= F.expr(_SECONDS.format("analyzed_at")))
    return ok | {"captured_at": ok["captured_at"] & after & before}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_fields(_grouped_clips(spark, d), ["folder", "duplicate_group"], _usable(), _order(), "clip_id").select("folder", "duplicate_group", "field", "clip_id")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """The most complete clip of each group, ties by trust, score and recency."""
    full = sum((F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0) for ok in _usable().values()), F.lit(0))
    return survivors.best_records(_grouped_clips(spark, d), ["folder", "duplicate_group"], full, _order(), "clip_id").select("folder", "duplicate_group", "clip_id", F.col("completeness").cast("bigint").alias("completeness"))


def _sized(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return Written(tokens.with_token_counts(table(spark, d, "documents").select("doc_id", *columns, "text"), "text"), "tokens").df


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), "doc_id", "tokens", CONTAINER).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_sized(spark, d), "doc_id", "tokens", CONTAINER), CONTAINER)


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must not occur in the packing, counted."""
    sized = _sized(spark, d)
    return packing.violations(sized, packing.pack(sized, "doc_id", "tokens", CONTAINER), "doc_id", "tokens", CONTAINER)


def _mix(spark: SparkSession, d: str, budget: float | str = "exact") -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(_sized(spark, d, "source"), table(spark, d, "mix_targets"), "doc_id", "source", "tokens", budget)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix that meets every share within the most repeats."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_full_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix of the size of all listed sources, in which scarce sources end at their most repeats."""
    return _mix(spark, d, "all")[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must not occur in the mix, counted."""
    return mixing.violations(*_mix(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_spans(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clusters, p1_leaves, p2_found, p3_found, p3_nearest, p5_found, p5_by_year, p6_found, p6_records, p7_packed, p7_fill, p7_checks, p8_mix, p8_shares, p8_full_shares, p8_checks, p9_found, p9_redacted)}

SQL = oracle.SQL
