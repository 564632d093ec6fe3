"""Queries over the telemetry readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.anomalies import implausible_readings, scored_readings
from lumenframe.session import table


def p4_readings(spark: SparkSession, d: str) -> DataFrame:
    """The readings in long form with the camera of their clip."""
    cameras = table(spark, d, "clips").select(F.col("clip_id").alias("key"), F.col("camera").alias("source")).where("key is not null").dropDuplicates(["key"])
    return table(spark, d, "signals").select(F.col("clip_id").alias("key"), "name", "sec", "value").where("value is not null").join(cameras, "key", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(p4_readings(spark, d)).select(F.col("key").alias("clip_id"), "name", "sec").distinct()


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per signal and reason: readings, their mean, smallest and largest score; ``usual`` readings that the forest isolates (0.6 or more) are told apart."""
    x = scored_readings(p4_readings(spark, d)).where("score is not null")
    kind = F.coalesce("reason", F.when(F.col("score") >= 0.6, "isolated").otherwise("usual")).alias("kind")
    return x.groupBy("name", kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.min("score"), 4).alias("low"), F.round(F.max("score"), 4).alias("high"))


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores}

SQL = {
    "p4_found": """
with r as (select distinct s.clip_id, s.name, s.sec, s.value, c.camera
           from signals s left join (select distinct clip_id, camera from clips) c using (clip_id) where s.value is not null),
u as (select camera, name, quantile_cont(value, 0.5) as level, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 as spread
      from r where not isnan(value) and value >= 0 group by camera, name),
i as (select *, sec - row_number() over (partition by clip_id, name, value order by sec) as island from r where value > 0 and not isnan(value)),
k as (select clip_id, name, sec, count(*) over (partition by clip_id, name, value, island) as run from i)
select distinct r.clip_id, r.name, r.sec from r left join u on r.camera = u.camera and r.name = u.name left join k on r.clip_id = k.clip_id and r.name = k.name and r.sec = k.sec
where isnan(r.value) or r.value < 0 or abs(r.value - u.level) > 10 * u.spread or k.run >= 8
"""
}
