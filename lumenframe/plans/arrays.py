"""Queries of the functions over arrays, levels and pixels, and of faces in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import columns
from lumenframe.operators import scoring
from lumenframe.plans.relations import _C, _clips
from lumenframe.plans.scoring import _ARRAYS, _W, _sl
from lumenframe.session import table


def face_windows(spark: SparkSession, d: str) -> DataFrame:
    """What faces add to each window, when the well lit seconds of a clip are those with a face."""
    box = F.struct(F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"))
    c = _clips(spark, d).select("clip_id", "duration_s", "tags_ms", *_ARRAYS, F.transform("exposure", lambda e: F.when(e > 0.6, box)).alias("faces"))
    s = scoring.score_windows(scoring.clip_windows(c))
    return s.select("clip_id", "start_s", F.col("c_face").alias("face"), F.array_contains("reasons", "face_present").alias("tagged"))


def dot_products(spark: SparkSession, d: str) -> DataFrame:
    """Dot products of every vector and the one whose id follows."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return x.join(y, "vec_id").select("vec_id", F.round(columns.dot(F.col("embedding"), F.col("next")), 5).alias("dot"))


def unit_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels from log texts on a unit scale, and a saturating map."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("t RMS_level=-"), (k % 70).cast("string"), F.lit(".5 RMS_level=-inf x RMS_level=-3"))
    units = F.transform(columns.db_levels(text), lambda x: columns.db_to_unit(x))
    return table(spark, d, "customer").select("c_custkey", F.size(units).cast("bigint").alias("n"), F.round(columns.array_mean(units), 6).alias("level"), F.round(columns.saturate(k.cast("double")), 6).alias("sharpness"))


def pixel_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Difference hashes of made-up images of the customers."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: ((i * F.col("c_custkey")) % 97).cast("double"))
    return table(spark, d, "customer").select("c_custkey", columns.difference_hash(pixels).alias("hash"))


def padded_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Audio cut or filled to eight seconds, with zeros and with its last value."""
    c = _clips(spark, d).select("clip_id", columns.padded(F.col("audio"), 8, F.lit(0.0)).alias("a"), columns.extended(F.col("audio"), 8).alias("b"))
    return c.select("clip_id", F.posexplode(F.arrays_zip("a", "b")).alias("sec", "v")).select("clip_id", F.col("sec").cast("bigint").alias("sec"), F.col("v.a").alias("zeros"), F.col("v.b").alias("last"))


QUERIES = {f.__name__: f for f in (face_windows, dot_products, unit_levels, pixel_hashes, padded_arrays)}

SQL = {
    "face_windows": f"with {_W} select clip_id, start_s, case when len(list_filter({_sl('exposure')}, lambda x: x > 0.6)) > 0 then 0.5 else 0.0 end as face, coalesce(len(list_filter({_sl('exposure')}, lambda x: x > 0.6)) > 0, false) as tagged from w",
    "dot_products": "select x.vec_id, round(list_inner_product(list_transform(x.embedding, lambda v: v::double), list_transform(y.embedding, lambda v: v::double)), 5) as dot from embeddings x join embeddings y on y.vec_id = x.vec_id + 1",
    "unit_levels": "with x as (select c_custkey, greatest(0, least(1, (60 - (c_custkey % 70) - 0.5::double) / 54)) as a from customer) select c_custkey, 2::bigint as n, round((a + 1) / 2, 6) as level, round(c_custkey / (c_custkey + 500.0::double), 6) as sharpness from x",
    "pixel_hashes": """with b as (select c_custkey, unnest(range(0, 64)) as k from customer), p as (select c_custkey, k, 9 * (k // 8) + k % 8 as i from b),
      n as (select c_custkey, k // 4 as dg, sum(case when (i * c_custkey) % 97 > ((i + 1) * c_custkey) % 97 then 8 >> (k % 4)::int else 0 end)::int as v from p group by 1, 2)
      select c_custkey, string_agg(printf('%x', v), '' order by dg) as hash from n group by 1""",
    "padded_arrays": f"with {_C}, x as (select clip_id, coalesce(audio, []) as a from c), s as (select clip_id, a, unnest(range(0, 8)) as sec from x) select clip_id, sec, case when sec < len(a) then a[sec + 1] else 0.0 end as zeros, case when sec < len(a) then a[sec + 1] else coalesce(a[len(a)], 0.0) end as last from s",
}
