"""Catalogs and plans as versioned tables in one folder, and the calls that read and change them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import settings
from lumenframe.operators import edits
from lumenframe.sources import catalog, store


class Engine:
    """Calls over a folder that holds ``catalogs``, ``plans`` and ``headers``, each partitioned by its id, so a call reads one partition."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, id_column: str, value: str) -> DataFrame:
        rows = catalog.read_snapshot(self.spark, f"{self.folder}/{table}", id_column, value)
        if not rows.limit(1).count():
            raise KeyError(f"{id_column} {value!r} is not known")
        return rows

    def themes(self) -> list[dict[str, Any]]:
        return [{"name": name, **values} for name, values in settings.THEMES.items()]

    def options(self) -> DataFrame:
        return settings.options_menu(self.spark)

    def colour_tables(self, folder: str) -> DataFrame:
        """``(name, path)`` of the ``.cube`` files of a folder."""
        f = catalog.list_files(self.spark, folder).where(F.lower("path").endswith(".cube"))
        return f.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "path")

    def analyze(self, clips: DataFrame, identity: Sequence[str]) -> str:
        """Store a catalog and give its id, a key over the ``identity`` columns of all rows; the same rows have the same id."""
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])
        row = catalog.group_key(clips.withColumn("__g", F.lit(1)), "__g", line).first()
        key = row["key"] if row else "empty"
        catalog.write_snapshot(clips.withColumn("catalog_id", F.lit(key)), f"{self.folder}/catalogs", "catalog_id")
        return key

    def catalog(self, catalog_id: str) -> DataFrame:
        return self._read("catalogs", "catalog_id", catalog_id)

    def inspect_clip(self, catalog_id: str, pos: str, i: int) -> DataFrame:
        """The clip at a place of a catalog; a place that isn't there is refused."""
        return store.nth(self.catalog(catalog_id), pos, i)

    def propose(self, catalog_id: str, entries: DataFrame, at: float = 0.0, **header: Any) -> str:
        """Store the entries of a plan (columns pos, source, out_duration_s, ...) made from a catalog, and give its id."""
        plan_id = edits.version_id(catalog_id, [("propose", {"at": at, **header})])
        self._store(plan_id, entries, [(plan_id, catalog_id, at, str(sorted(header.items())))])
        return plan_id

    def _store(self, plan_id: str, entries: DataFrame, header: list[tuple]) -> None:
        catalog.write_snapshot(entries.withColumn("plan_id", F.lit(plan_id)), f"{self.folder}/plans", "plan_id")
        catalog.write_snapshot(self.spark.createDataFrame(header, "plan_id string, catalog_id string, at double, settings string"), f"{self.folder}/headers", "plan_id")

    def plan(self, plan_id: str) -> DataFrame:
        return self._read("plans", "plan_id", plan_id)

    def header(self, plan_id: str) -> DataFrame:
        """A plan without its entries."""
        return self._read("headers", "plan_id", plan_id)

    def summary(self, plan_id: str) -> DataFrame:
        """``(plan_id, n_cuts, sources_used, total_s)``."""
        return self.plan(plan_id).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_cuts"), F.countDistinct("source").alias("sources_used"), F.sum("out_duration_s").alias("total_s"))

    def latest(self, catalog_id: str) -> DataFrame:
        """The header of the newest plan made from a catalog; no row without one."""
        return store.latest(self.spark.read.parquet(f"{self.folder}/headers").where(F.col("catalog_id") == catalog_id), "catalog_id", "at", "plan_id")

    def tweak(self, plan_id: str, ops: Sequence[tuple[str, dict]], at: float = 0.0) -> str:
        """Apply edits to a plan and store the result as a new one, whose id follows from the old one and the edits."""
        new = edits.version_id(plan_id, ops)
        old = self.header(plan_id).first()
        changed = edits.apply(self.plan(plan_id).withColumnRenamed("plan_id", "plan"), ops).drop("plan")
        self._store(new, changed, [(new, old["catalog_id"], at, old["settings"])])
        return new
