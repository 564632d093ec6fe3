"""Binary parsers and a device listing as Spark sources: telemetry blocks, highlight tags, and a Python data source with time pushdown."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.functions import udtf

_NUMBER = {ord("b"): ("b", 1), ord("B"): ("B", 1), ord("s"): ("h", 2), ord("S"): ("H", 2), ord("l"): ("i", 4), ord("L"): ("I", 4), ord("f"): ("f", 4), ord("d"): ("d", 8)}


def blocks(blob: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(key, type, size, repeat, payload start, payload end) of a telemetry blob: four-character key, type, size, big-endian repeat, payload aligned to four bytes."""
    at, end = start, len(blob) if end is None else end
    while at + 8 <= end:
        key, kind, size, repeat = struct.unpack_from(">4sBBH", blob, at)
        stop = at + 8 + size * repeat
        if stop > end:
            return
        yield key.decode("latin-1"), kind, size, repeat, at + 8, stop
        at += 8 + (size * repeat + 3) // 4 * 4


def telemetry_rows(blob: bytes | None) -> Iterator[tuple[str, int, float]]:
    """(stream, i, value): magnitudes of ACCL and GYRO samples and the 2-D speed of GPS5 samples, scaled by the last SCAL before them."""
    if not blob:
        return
    counts: dict[str, int] = {}
    todo: list[tuple[int, int]] = [(0, len(blob))]
    scale: list[float] = [1.0]
    while todo:
        s, e = todo.pop()
        inner: list[tuple[int, int]] = []
        for key, kind, size, repeat, a, z in blocks(blob, s, e):
            if kind == 0:
                inner.append((a, z))
                continue
            code, width = _NUMBER.get(kind, ("", 0))
            if not width or size < width:
                continue
            per = size // width
            values = struct.unpack(f">{per * repeat}{code}", blob[a : a + per * repeat * width]) if size == per * width else ()
            if key == "SCAL":
                scale = [float(v) or 1.0 for v in values] or [1.0]
            elif key in ("ACCL", "GYRO", "GPS5"):
                for i in range(repeat):
                    row = [v / scale[k if len(scale) > k else -1] for k, v in enumerate(values[i * per : (i + 1) * per])]
                    if key == "GPS5" and len(row) > 3:
                        value = row[3]
                    else:
                        value = sum(x * x for x in row[:3]) ** 0.5
                    yield key, counts.get(key, 0), float(value)
                    counts[key] = counts.get(key, 0) + 1
        todo += reversed(inner)


@udtf(returnType="stream: string, i: int, value: double")
class Telemetry:
    """``SELECT * FROM telemetry(blob)``: the samples of one blob."""

    def eval(self, blob: bytes):
        yield from telemetry_rows(blob)


def highlight_tags(content: bytes | None) -> list[int]:
    """Tag times in milliseconds of the first ``HMMT`` box: its size stands before the name, after it come a big-endian count (at most 1000) and as many values, all within the box."""
    at = content.find(b"HMMT") if content else -1
    if at < 4:
        return []
    (size,) = struct.unpack_from(">I", content, at - 4)
    end = min(len(content), at - 4 + size)
    if end < at + 8:
        return []
    (n,) = struct.unpack_from(">I", content, at + 4)
    return list(struct.unpack_from(f">{n}I", content, at + 8)) if n <= 1000 and at + 8 + 4 * n <= end else []


@udtf(returnType="tag_ms: bigint")
class HighlightTags:
    """``SELECT * FROM highlight_tags(content)``."""

    def eval(self, content: bytes):
        for tag in highlight_tags(content):
            yield (tag,)


class FolderSource(DataSource):
    """``spark.read.format("folder").option("path", dir)``: files as ``(path, captured_at, bytes)``; ranges of captured_at are pushed to the listing.

    Needs ``spark.sql.python.filterPushdown.enabled``. One partition per folder.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, captured_at double, bytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"])


def device_listing(spark: SparkSession, folder: str, since: float, until: float) -> DataFrame:
    """``(path, captured_at, bytes)`` of a folder's files taken from ``since`` to ``until`` (both included), in order of time, then path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    x = spark.read.format("folder").option("path", folder).load()
    return x.where(F.col("captured_at").between(since, until)).orderBy("captured_at", "path")


class _FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path, float("-inf"), float("inf")

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("captured_at",):
                self.low = max(self.low, float(f.value))
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("captured_at",):
                self.high = min(self.high, float(f.value))
            else:
                yield f

    def partitions(self):
        folders = [root for root, _, files in os.walk(self.path) if files]
        return [InputPartition(f) for f in sorted(folders)] or [InputPartition(self.path)]

    def read(self, partition):
        for entry in sorted(os.scandir(partition.value), key=lambda e: e.name):
            info = entry.stat()
            if entry.is_file() and self.low <= info.st_mtime <= self.high:
                yield entry.path, float(info.st_mtime), info.st_size
