"""Problem 6: one surviving record per duplicate group, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A hot group is ranked in this many independent parts first.
SALTS = 64


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: Column) -> DataFrame:
    """First row per ``keys`` by ``order``: the best of each salted part, then the best of those."""
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    few = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))).withColumn("__r", F.row_number().over(part)).where("__r = 1").drop("__salt", "__r")
    return few.withColumn("__r", F.row_number().over(whole)).where("__r = 1").drop("__r")


def surviving_fields(records: DataFrame, group: Sequence[str], fields: Mapping[str, Column], order: Sequence[Column], record_id: str) -> DataFrame:
    """Which record supplies each field of each group: ``(*group, field, record_id, value)``.

    ``fields`` maps a field to the condition under which its value is usable; ``order`` ranks the records of a group
    (best first) and must end in a unique key. A group without a usable value of a field gives no row for it. Rows
    with a null group column belong to no group.
    """
    usable = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"))) for f, ok in fields.items()])
    long = records.where(" and ".join(f"`{g}` is not null" for g in group)).withColumn("__f", F.explode(F.array_compact(usable)))
    long = long.withColumns({"field": F.col("__f.field"), "value": F.col("__f.value")}).drop("__f")
    return _top(long, [*group, "field"], order, F.col(record_id)).select(*group, "field", record_id, "value")


def best_records(records: DataFrame, group: Sequence[str], completeness: Column, order: Sequence[Column], record_id: str) -> DataFrame:
    """The top record of each group by completeness (most first), then ``order``; all columns are kept."""
    x = records.where(" and ".join(f"`{g}` is not null" for g in group)).withColumn("completeness", completeness)
    return _top(x, group, [F.col("completeness").desc(), *order], F.col(record_id))


def stamp_number(stamp: Column) -> Column:
    """The number of a folder-wise stamp such as ``g7``, `` G007 `` or ``7`` without leading zeros; null if there is none."""
    digits = F.regexp_extract(F.trim(stamp), r"(?i)^\s*g?[\s_-]*0*(\d+)\s*$", 1)
    return F.when(digits != "", digits)
