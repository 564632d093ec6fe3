"""Problem 3: the most similar vectors of every vector, by an adaptive dimension scan within probed lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.vectors import SHORT, VectorSet, cells_of, margin_for, matrix, packed
from lumenframe.session import grouped

#: Columns per block, and how many standard errors a partial distance may exceed the limit before it is abandoned.
BLOCK, DOUBT = 24, 3.0
#: Share of pairs above which the next block is computed for all.
CROWDED = 0.05
#: Rows aimed at per list.
LIST_ROWS = 400
#: Visitors sent on in one batch.
VISITORS = 65_536
#: Rows of a list, and of queries, that are compared at once.
LIST_CHUNK, QUERY_CHUNK = 2048, 512
#: Rows, and queries, per block when the queries are settled against all rows.
BLOCK_ROWS = 50_000


def _least(part: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The k-th smallest value along an axis, infinite when there are fewer."""
    if part.shape[axis] <= k:
        return np.full([1 if d == axis else n for d, n in enumerate(part.shape)], np.inf, part.dtype)
    return np.take(np.partition(part, k - 1, axis=axis), [k - 1], axis=axis)


def adaptive_scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row, cosine) that an adaptive scan of rotated unit vectors doesn't abandon.

    ``limit`` is each query's largest squared distance of interest. The columns are read in blocks; after d of D columns a pair
    is abandoned when its partial squared distance is above ``limit * d/D * (1 + DOUBT/sqrt(d))^2``, that is when the
    hypothesis that its whole distance is within the limit is rejected. While many pairs are left the next block is a
    matrix product over all; when few are, it is computed for them alone. Among pairs that were never few (a crowd of
    near copies) only those that can be among the k nearest of their query, or with ``both`` of their row, are kept.
    """
    dim = q.shape[1]
    q2, x2 = np.square(q), np.square(x)
    part, left, d = np.zeros((len(q), len(x)), np.float32), np.ones((len(q), len(x)), bool), 0
    while d < dim and (d == 0 or left.mean() > CROWDED):
        e = min(d + BLOCK, dim)
        part += q2[:, d:e].sum(1)[:, None] + x2[:, d:e].sum(1)[None, :] - 2 * (q[:, d:e] @ x[:, d:e].T)
        d = e
        left &= part <= (limit * (d / dim) * (1 + (DOUBT / np.sqrt(d) if d < dim else 1e-5)) ** 2 + 2e-6)[:, None]
    if d == dim:
        part = np.where(left, part, np.inf)
        near = part <= _least(part, k + 1, 1) + 4e-6
        left &= near | (part <= _least(part, k + 1, 0) + 4e-6) if both else near
    i, j = np.nonzero(left)
    part = part[i, j]
    while d < dim and len(i):
        e = min(d + BLOCK, dim)
        part = part + np.square(q[i, d:e] - x[j, d:e]).sum(1)
        d = e
        keep = part <= limit[i] * (d / dim) * (1 + (DOUBT / np.sqrt(d) if d < dim else 1e-5)) ** 2 + 2e-6
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, np.einsum("ij,ij->i", q[i].astype(np.float64), x[j].astype(np.float64))


def _first_k(query: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: highest cosine, then smaller id."""
    order = np.lexsort((other, -cos, query))
    s = query[order]
    start = np.r_[True, s[1:] != s[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
    return order[np.arange(len(s)) - first < k]


def scan_list(ids: np.ndarray, x: np.ndarray, home: np.ndarray, asks: np.ndarray, k: int, min_cos: float, both: bool, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k candidates within one list: the home rows are searched for every asking row. A visitor's pairs also count for the home row (``both``).

    ``known`` is a cosine per row that its k-th nearest is known to reach.
    """
    own, guests = np.nonzero(home)[0], np.nonzero(~home)[0]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows in (own[asks[own]], guests[asks[guests]]):
        for s in range(0, len(rows), QUERY_CHUNK):
            r = rows[s : s + QUERY_CHUNK]
            limit = 2 - 2 * (np.full(len(r), min_cos) if known is None else np.maximum(known[r], min_cos))
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for t in range(0, len(own), LIST_CHUNK):
                h = own[t : t + LIST_CHUNK]
                i, j, cos = adaptive_scan(x[r], x[h], limit, k, both and not home[r[0]])
                keep = (ids[r[i]] != ids[h[j]]) & (cos >= min_cos)
                i, j, cos = i[keep], h[j[keep]], cos[keep]
                if both and not home[r[0]] and len(i):
                    back = asks[j]
                    out.append((j[back], r[i[back]], cos[back]))
                best = tuple(np.concatenate(z) for z in zip(best, (i, j, cos), strict=True))
                if len(best[0]):
                    top = _first_k(best[0], ids[best[1]], best[2], k)
                    best = tuple(z[top] for z in best)
                    full, n = np.unique(best[0], return_counts=True)
                    worst = np.full(len(r), np.inf)
                    np.minimum.at(worst, best[0], best[2])
                    full = full[n >= k]
                    limit[full] = np.minimum(limit[full], 2 - 2 * worst[full] + 1e-6)
            out.append((r[best[0]], best[1], best[2]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b, cos = (np.concatenate(z) for z in zip(*out, strict=True))
    top = _first_k(a, ids[b], cos, k)
    return ids[a[top]], ids[b[top]], cos[top]


def nearest(df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5, min_cos: float = -1.0, visits: float = 4.0, query_step: int = 1, settle: bool = False) -> DataFrame:
    """``(id, other, cosine, rank)``: the k most similar other vectors of every vector, those of cosine ``min_cos`` or more.

    The vectors are rotated and divided into lists (a bisecting tree of two levels fitted on bounded samples; every vector
    is indexed). Each list is scanned for its own vectors and for visitors: a vector visits the lists whose centre is nearly
    as similar as its own, by a margin at which a vector makes about ``visits`` visits. A list that holds a crowd is divided
    into hash parts that are all visited, so its work is spread, not dropped. Equal cosines prefer the smaller id. Bytewise equal
    vectors are searched once and expanded by their k + 1 smallest ids, which is exact for a top k. Rows without an id
    or a usable vector are neither queries nor results; repeated rows count once; an empty input gives no rows.
    ``query_step`` > 1 asks only for the ids divisible by it, against all rows. With ``settle`` the lists only give each
    query a first k-th cosine, and the query then scans all rows for what reaches it: nothing is lost to unvisited lists,
    at a cost of queries times rows.
    """
    data = VectorSet(df, id_col, vector_col, dim, rotate=True, cell_rows=LIST_ROWS)
    cells = data.cells
    margin = margin_for(cells, visits)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            if not len(ids):
                continue
            home, row, cell = cells_of(x, cells, margin)
            part = cells.part_of(ids, home)
            asks = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            # all parts of the visited lists, and the other parts of the own one; a pair that counts both ways is met in one of two parts
            crowded = np.nonzero(cells.parts[home] > 1)[0]
            row, cell = np.concatenate([row, crowded]), np.concatenate([cell, home[crowded]])
            row, cell = row[asks[row]], cell[asks[row]]
            each = cells.parts[cell]
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            row, cell = np.repeat(row, each), np.repeat(cell, each)
            own = cell == home[row]
            out = ~own | (at > part[row] if query_step == 1 else at != part[row])
            row, cell, at = row[out], cell[out], at[out].astype(np.int32)
            fields = ["cell", "part", "home", "ask", "id", "vec"]
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(part), pa.array(np.ones(len(ids), bool)), pa.array(asks), pa.array(ids), packed(x)], fields)
            for s in range(0, len(row), VISITORS):
                r = row[s : s + VISITORS]
                short = np.rint(x[r] * SHORT).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + VISITORS].astype(np.int32)), pa.array(at[s : s + VISITORS]), pa.array(np.zeros(len(r), bool)), pa.array(asks[r]), pa.array(ids[r]), packed(short)], fields)

    def scan(t: pa.Table) -> pa.Table:
        own, guests = t.filter(t["home"]), t.filter(pc.invert(t["home"]))
        t, x = pa.concat_tables([own, guests]), matrix(own["vec"])
        x = np.concatenate([x.reshape(-1, dim), matrix(guests["vec"], np.int16).reshape(-1, dim).astype(np.float32) / np.float32(SHORT)])
        ids, home = t["id"].to_numpy(), t["home"].to_numpy().astype(bool)
        _, once = np.unique(np.stack([ids, home.astype(np.int64)]), axis=1, return_index=True)
        ids, home, x, asks = ids[once], home[once], x[once], t["ask"].to_numpy()[once].astype(bool)
        a, b, c = scan_list(ids, x, home, asks, k, min_cos, both=query_step == 1)
        return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    ask = F.pmod("id", F.lit(query_step)) == 0
    rows = data.distinct.withColumn("ask", ask)
    if query_step > 1:  # a vector is asked for when any of its copies is
        also = data.copies.where(ask).select(F.col("rep").alias("id"), F.lit(True).alias("also")).distinct()
        rows = rows.join(also, "id", "left").select("id", "vec", (F.col("ask") | F.coalesce("also", F.lit(False))).alias("ask"))
    found = grouped(rows.select("id", "vec", "ask").mapInArrow(route, "cell int, part int, home boolean, ask boolean, id bigint, vec binary"), "cell", "part").applyInArrow(scan, "id bigint, other bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other"))
    if settle and len(cells.centres) > 1:
        found = _settled(rows, found, data.total, dim, k, min_cos)
    found = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    if not data.copies.limit(1).count():
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
    # each group of equal vectors, by the smallest id: the k + 1 smallest ids stand for it as results, all of them as queries
    copies = data.copies
    few = copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k).select("rep", "id")
    few = few.unionByName(few.select("rep", F.col("rep").alias("id")).distinct())
    every = copies.select("rep", "id").unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    results = found.select("id", F.col("other").alias("rep"), "cosine").join(few.withColumnRenamed("id", "other"), "rep", "left").select("id", F.coalesce("other", "rep").alias("other"), "cosine")
    asked = results.select(F.col("id").alias("rep"), "other", "cosine").join(every, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "other", "cosine")
    same = every.join(few.withColumnRenamed("id", "other"), "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
    if query_step > 1:
        asked, same = (x.where(F.pmod("id", F.lit(query_step)) == 0) for x in (asked, same))
    return asked.unionByName(same).where(F.col("cosine") >= min_cos).withColumn("rank", rank).where(F.col("rank") <= k)


def _settled(rows: DataFrame, found: DataFrame, total: int, dim: int, k: int, min_cos: float) -> DataFrame:
    """``(id, other, cosine)`` with the k nearest of every asking row among all ``rows (id, vec, ask)``, given candidates in ``found``.

    Blocks of queries meet blocks of rows; a pair is abandoned when it can't reach the k-th cosine found so far.
    """
    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    nq = rows.where("ask").count()
    across, down = max(tasks, -(-total // BLOCK_ROWS)), max(1, -(-nq // BLOCK_ROWS))
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    kth = found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
    kth = kth.select("id", (F.col("cosine") - 2 * np.sqrt(dim) / SHORT).alias("known"))  # less what 16-bit visitors may be off
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(17)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select("id", "vec", F.lit(None).cast("double").alias("known"), F.lit(True).alias("home"), block(across).alias("p"), every(down).alias("q"))
    asking = rows.where("ask").join(kth, "id", "left").select("id", "vec", F.coalesce("known", F.lit(-1.0)).alias("known"), F.lit(False).alias("home"), block(down).alias("q"), every(across).alias("p"))

    def scan(t: pa.Table) -> pa.Table:
        ids, home = t["id"].to_numpy(), t["home"].to_numpy().astype(bool)
        _, once = np.unique(np.stack([ids, home.astype(np.int64)]), axis=1, return_index=True)
        ids, home, x = ids[once], home[once], matrix(t["vec"])[once]
        known = pc.fill_null(t["known"], -1.0).to_numpy()[once]
        a, b, c = scan_list(ids, x, home, ~home, k, min_cos, False, known)
        return pa.table({"id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return grouped(own.unionByName(asking), "p", "q").applyInArrow(scan, "id bigint, other bigint, cosine double")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """The distinct undirected pairs of a ``nearest`` result."""
    return near.select(F.least("id", "other").alias("clip_a"), F.greatest("id", "other").alias("clip_b")).distinct()
