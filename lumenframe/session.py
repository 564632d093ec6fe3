"""Session helpers: the shared folder for written intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond them a shuffle join is used.
BROADCAST_ROWS = 200_000
#: Bytes that a scan puts into one task.
SPLIT_BYTES = 128 << 20

_own_dirs: dict[str, str] = {}
_written: list[Written] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder, else an own one (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lumenframe-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder belongs to the run and is removed with it
        pass


class Written:
    """A DataFrame written to the shared folder and read again; survives lost executors and cuts the lineage."""

    def __init__(self, df: DataFrame, name: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/lumenframe/{name}-{uuid.uuid4().hex}"
        _written.append(self)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


@atexit.register
def _drop_all() -> None:
    for t in _written:
        t.drop()


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table as read from there."""
    return Written(df, name).df


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it is counted to hold at most ``rows`` rows (narrow dimension rows); else leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """``df`` over enough tasks for heavy per-row work: unchanged when its size, as the optimizer estimates it, gives them already, else hashed by ``key``."""
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size >= wanted * SPLIT_BYTES else df.repartition(wanted, key)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for a shuffle of ``df`` in which each takes about ``rows`` rows: the number grows with the data, and is at least that of the session."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-df.count() // rows))


def grouped(df: DataFrame, *keys: str, per_core: int = 3):
    """``df`` grouped by ``keys`` for heavy work per group: over a fixed number of tasks, which AQE doesn't merge by their small size."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys).groupBy(*keys)
