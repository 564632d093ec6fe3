"""Unit vectors as fixed-width binary rows, and the coarse bisecting tree that divides them into cells."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import BROADCAST_ROWS, Written, grouped

#: The upper level of the tree is fitted on about this many rows, the lower one, for each upper node, on about NODE_SAMPLE; every
#: row is then assigned with it. Both are hash samples, the same in every run.
TOP_SAMPLE, NODE_SAMPLE = 16_384, 65_536
#: At most this many cells; their centres are the only model that is broadcast (25 MB at 96 dimensions).
MAX_CELLS = 65_536
#: Up to FLAT_CELLS a row is compared with all centres, beyond them with those of its TOP_PROBES nearest upper nodes.
FLAT_CELLS, TOP_PROBES = 8_192, 16
#: Sampled rows per cell, rows aimed at per cell, and the cells that a small collection has at least.
SAMPLE_PER_CELL, CELL_ROWS, FEW_CELLS = 64, 800, 8
#: A cell of more than this many times the rows aimed at is divided into hash parts.
PART_CELLS = 4
#: Scale of the 16-bit numbers in which a visitor's columns travel (cosines within about 1e-5).
SHORT = 32767


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    """The rows of a binary column of equal-length values as a matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = []
    for part in parts:
        if len(part):
            wide = pa.types.is_large_binary(part.type)
            offsets = np.frombuffer(part.buffers()[1], np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1]
            rows.append(np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(part), -1).view(dtype))
    return np.concatenate(rows) if rows else np.zeros((0, 1), dtype)


def packed(rows: np.ndarray) -> pa.Array:
    """The inverse of ``matrix``."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unit_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit float64 rows of the usable vectors: ``dim`` finite numbers that aren't all zero, with an id."""
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    right = (length == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
    mask = pa.array(right)
    x = vectors.filter(mask).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    i = ids.filter(mask).to_numpy(zero_copy_only=False)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x, i = x[good], i[good]
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return i, x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int, rotate: bool = False) -> DataFrame:
    """``(id, vec)`` with unit float32 rows as binary; rows without an id or a usable vector are left out."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim) if rotate else None
        for b in batches:
            ids, x = unit_rows(b.column(0), b.column(1), dim)
            x = x @ turn if rotate else x
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), packed(x.astype(np.float32))], ["id", "vec"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(prepare, "id bigint, vec binary")


def copies(rows: DataFrame) -> DataFrame:
    """``(id, rep)`` of the ids whose vector is bytewise that of a smaller id, rep. Only 24 bytes a row are shuffled."""
    keyed = rows.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("top > rep").drop("top")
    return keyed.join(groups, ["h1", "h2"]).where("id > rep").select("id", "rep").distinct()


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """``rows`` but the ids in ``dropped``; broadcast only after a count."""
    few = dropped.select("id").limit(BROADCAST_ROWS + 1).count()
    if not few:
        return rows
    return rows.join(F.broadcast(dropped.select("id")) if few <= BROADCAST_ROWS else dropped.select("id"), "id", "left_anti")


def _two_means(x: np.ndarray, rounds: int = 6) -> np.ndarray | None:
    """Which rows go to the first of two centres; None when the rows can't be told apart."""
    mean = x.mean(0)
    far = x[np.argmin(x @ mean)]
    axis = far - x[np.argmin(x @ far)]
    proj = x @ axis
    side = proj > np.median(proj)
    for _ in range(rounds):
        if side.all() or not side.any():
            return None
        a, b = x[side].mean(0), x[~side].mean(0)
        new = x @ (a - b) > (a @ a - b @ b) / 2
        if (new == side).all():
            break
        side = new
    return side if side.any() and not side.all() else None


def bisecting_centres(x: np.ndarray, leaves: int) -> np.ndarray:
    """Centres of a bisecting k-means tree: the node of largest dispersion is split until there are ``leaves`` nodes."""

    def node(ix: np.ndarray) -> tuple[float, int, np.ndarray]:
        mean = x[ix].mean(0)
        return -len(ix) * max(0.0, 1 - float(mean @ mean)), int(ix[0]), ix

    heap, done = [node(np.arange(len(x)))], []
    while heap and len(heap) + len(done) < leaves:
        top = heapq.heappop(heap)
        side = _two_means(x[top[2]]) if len(top[2]) > 3 else None
        if side is None:
            done.append(top)
        else:
            heapq.heappush(heap, node(top[2][side]))
            heapq.heappush(heap, node(top[2][~side]))
    centres = np.stack([x[ix].mean(0) for _, _, ix in heap + done])
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Cells:
    """The cells of a collection: centres, the upper nodes and which of them owns each cell, the hash parts per cell, and a few rows to measure margins on."""

    centres: np.ndarray
    top: np.ndarray
    owner: np.ndarray
    parts: np.ndarray
    sample: np.ndarray

    def similarity(self, x: np.ndarray) -> np.ndarray:
        """Cosine of each row and centre; -2 where an upper node is too far to be looked into."""
        if len(self.centres) <= FLAT_CELLS:
            return x @ self.centres.T
        probes = min(TOP_PROBES, len(self.top))
        near = np.argpartition(-(x @ self.top.T), probes - 1, axis=1)[:, :probes]
        out = np.full((len(x), len(self.centres)), -2, np.float32)
        for node in np.unique(near):
            rows, cells = np.nonzero((near == node).any(1))[0], np.nonzero(self.owner == node)[0]
            out[np.ix_(rows, cells)] = x[rows] @ self.centres[cells].T
        return out

    def slices(self, n: int) -> Iterator[slice]:
        """Ranges of rows whose similarities fit in some tens of megabytes."""
        step = max(64, (16 << 20) // len(self.centres))
        return (slice(s, min(s + step, n)) for s in range(0, n, step))

    def part_of(self, ids: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Hash part of each row within its cell."""
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % self.parts[cell].astype(np.uint64)).astype(np.int32)


def fit_cells(rows: DataFrame, total: int, dim: int, cell_rows: int = CELL_ROWS) -> Cells:
    """The cells of ``rows (id, vec)``, about ``total / cell_rows`` of them, by a bisecting tree of two levels.

    The upper level is fitted on the driver on a hash sample of about ``TOP_SAMPLE`` rows; each of its nodes is then split
    further in a task of its own, on a hash sample of about ``NODE_SAMPLE`` of its rows. A cell that holds many more rows than
    aimed at, such as a crowd of near copies, has several hash parts, so no task holds it whole.
    """
    cells = int(max(1, min(MAX_CELLS, max(total // cell_rows, min(FEW_CELLS, total // SAMPLE_PER_CELL)))))
    drawn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    groups = max(1, round(cells**0.5))
    first = rows.where(drawn < min(1.0, TOP_SAMPLE / total)).select("vec").toArrow()
    x = np.unique(matrix(first.column(0)), axis=0) if first.num_rows else np.zeros((0, dim), np.float32)
    if not len(x):
        return Cells(np.zeros((1, dim), np.float32), np.zeros((1, dim), np.float32), np.zeros(1, np.int64), np.ones(1, np.int64), x)
    top = bisecting_centres(x, groups)
    share = np.bincount((x @ top.T).argmax(1), minlength=len(top)) / len(x)
    rate = np.minimum(min(1.0, SAMPLE_PER_CELL * cells / total), NODE_SAMPLE / np.maximum(1.0, share * total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node = (matrix(b.column(0)) @ top.T).argmax(1)
                keep = b.column(1).to_numpy() < rate[node]
                yield pa.RecordBatch.from_arrays([pa.array(node[keep].astype(np.int32)), b.column(0).filter(pa.array(keep))], ["node", "vec"])

    def split(t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        v = np.unique(matrix(t["vec"]), axis=0)
        here = len(v) / rate[node]
        centres = bisecting_centres(v, int(max(1, min(len(v) // 8, round(here * cells / total)))))
        count = np.bincount((v @ centres.T).argmax(1), minlength=len(centres))
        return pa.table({"node": np.full(len(centres), node, np.int32), "place": np.arange(len(centres), dtype=np.int32), "centre": packed(centres), "rows": count * (here / len(v))})

    sample = rows.select("vec", drawn.alias("u")).where(F.col("u") < float(rate.max())).mapInArrow(place, "node int, vec binary")
    found = grouped(sample, "node").applyInArrow(split, "node int, place int, centre binary, rows double").orderBy("node", "place").toArrow()
    if not found.num_rows:  # nothing drawn below the upper level
        found = pa.table({"node": np.arange(len(top), dtype=np.int32), "centre": packed(top), "rows": share * total})
    parts = np.ceil(found["rows"].to_numpy() / (PART_CELLS * cell_rows)).astype(np.int64)
    return Cells(matrix(found["centre"]), top, found["node"].to_numpy().astype(np.int64), np.maximum(parts, 1), x[:: max(1, len(x) // 2000)])


def margin_for(cells: Cells, visits: float) -> float:
    """The margin at which a sampled row visits ``visits`` cells besides its own on average, rows with more than four times as
    many counted as that, so that a crowd between many cells doesn't use up the visits of the others."""
    if len(cells.centres) <= visits + 1 or not len(cells.sample):
        return 2.0
    gaps = []
    for s in cells.slices(len(cells.sample)):
        sim = cells.similarity(cells.sample[s])
        gap = sim.max(1, keepdims=True) - sim
        most = min(int(4 * visits) + 1, gap.shape[1])
        gaps.append(np.sort(np.partition(gap, most - 1, axis=1)[:, :most], axis=1)[:, 1:].ravel())
    gap = np.concatenate(gaps)
    at = min(int(visits * len(cells.sample)), len(gap) - 1)
    return float(np.partition(gap, at)[at])


def cells_of(x: np.ndarray, cells: Cells, margin: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and the (row, cell) visits: other cells whose centre is at most ``margin`` less similar, none without a margin."""
    homes, rows, visited = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in cells.slices(len(x)):
        sim = cells.similarity(x[s])
        home = sim.argmax(1)
        homes.append(home)
        if margin is not None:
            here = np.arange(len(sim))
            near = (sim >= (sim[here, home] - margin)[:, None]) & (sim > -1.5)
            near[here, home] = False
            row, cell = np.nonzero(near)
            rows.append(row + s.start)
            visited.append(cell)
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(visited)


class VectorSet:
    """Usable vectors written once to the shared folder, their exact copies, and the fitted cells."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, dim: int, rotate: bool = False, cell_rows: int = CELL_ROWS):
        self.dim = dim
        self.rows = Written(usable(df, id_col, vector_col, dim, rotate), "vectors").df
        self.copies = Written(copies(self.rows), "copies").df
        self.distinct = without(self.rows, self.copies)
        self.total = self.distinct.select("id").distinct().count()
        self.cells = fit_cells(self.distinct, max(1, self.total), dim, cell_rows)
