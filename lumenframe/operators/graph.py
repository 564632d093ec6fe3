"""Near-duplicate links and their connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import Written

#: First bit and width of the bands of a 64-bit signature: of two values within 8 bits one band differs in two bits at most, so
#: that a one-bit neighbour of the one's band is a one-bit neighbour of the other's.
BANDS = ((0, 22), (22, 21), (43, 21))
#: Up to this many distinct links (16 MB) are joined in one task; beyond them in rounds over the cluster.
ONE_TASK = 1_000_000


def _label_table(t: pa.Table) -> pa.Table:
    """``(id, root)`` of the links ``(v, u)`` of one table, by label propagation with pointer jumping."""
    ids, ends = np.unique(np.concatenate([t["v"].to_numpy(), t["u"].to_numpy()]), return_inverse=True)
    i, j = ends[: t.num_rows], ends[t.num_rows :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return pa.table({"id": ids, "root": ids[label]})
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``(id, root)``: the smallest id of each linked id's component. Self-links and nulls are ignored; an empty input gives no rows.

    Up to ``one_task`` distinct links are joined in one task. More are rewritten over the cluster, a large-star and a small-star step
    a round: each vertex points its larger neighbours, then its smaller ones and itself, to the smallest of them, until
    nothing changes. A round is written to the shared folder, the minimum of a hub is pre-aggregated, and no neighbourhood is collected.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = Written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct(), "edges")
    if now.df.limit(one_task + 1).count() <= one_task:
        return now.df.coalesce(1).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_label_table, "id bigint, root bigint")
    mark = None
    for _ in range(rounds):
        both = now.df.unionByName(now.df.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        first = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(first, "v").select("u", "m", "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(first.select("v", F.col("m").alias("u")))
        after = Written(small.distinct(), "edges")
        row = after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        now.drop()
        now, before, mark = after, mark, (row[0], row[1])
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.df.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def signature_links(rows: DataFrame, key: str, signature: str, max_bits: int = 8) -> DataFrame:
    """``(a, b, bits)``: pairs of distinct signatures' representatives within ``max_bits`` (8 or fewer), smallest frame distance.

    Rows of equal signatures are represented by their smallest key. Malformed and null signatures have no links. Both sides look
    up their bands of 21 or 22 bits and the one-bit neighbours of these, which finds every pair within 8 bits; each is verified.
    The optimizer takes a side for the size of its frames, of which it holds 67 times as many rows, so the join is never a broadcast.
    """
    if max_bits > 8:
        raise ValueError("the bands cover at most 8 bits")
    good = rows.where(F.col(signature).rlike(r"\A[0-9a-f]{16}(:[0-9a-f]{16})*\z")).groupBy(signature).agg(F.min(key).alias("k"))
    frames = good.select("k", F.explode(F.array_distinct(F.split(signature, ":"))).alias("f"))
    high, low = (F.conv(F.substring("f", s, 8), 16, 10).cast("bigint") for s in (1, 9))
    frames = frames.select("k", F.shiftleft(high, 32).bitwiseOR(low).alias("x"))
    keys = []
    for i, (first, width) in enumerate(BANDS):
        own = F.shiftrightunsigned("x", first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 22))
        keys += [own, *(own.bitwiseXOR(F.lit(1 << n)) for n in range(width))]
    probes = frames.select("k", "x", F.explode(F.array(*keys)).alias("key"))
    p, q = probes.select(F.col("k").alias("a"), F.col("x").alias("xa"), "key"), probes.select(F.col("k").alias("b"), F.col("x").alias("xb"), "key")
    bits = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb")))
    hit = p.join(q.hint("merge"), "key").where((F.col("a") < F.col("b")) & (bits <= max_bits)).select("a", "b", bits.alias("bits"))
    return hit.groupBy("a", "b").agg(F.min("bits").alias("bits"))


def equal_signatures(rows: DataFrame, key: str, signature: str) -> DataFrame:
    """``(a, b)``: every row of a well-formed signature linked to the smallest key that has it."""
    good = rows.where(F.col(signature).rlike(r"\A[0-9a-f]{16}(:[0-9a-f]{16})*\z")).select(F.col(key).alias("b"), signature)
    return good.join(good.groupBy(signature).agg(F.min("b").alias("a")).hint("merge"), signature).where("a <> b").select("a", "b").distinct()


def _unit(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    mask = pa.array((length == dim) & ids.is_valid().to_numpy(zero_copy_only=False))
    x = vectors.filter(mask).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return ids.filter(mask).to_numpy(zero_copy_only=False)[good], x[good] / norm[good, None]


def cosine_links(rows: DataFrame, key: str, vector: str, dim: int, min_cos: float, pivots: int | None = None) -> DataFrame:
    """``(a, b, cosine)``: all pairs a < b of cosine ``min_cos`` or more, found exactly.

    Vectors belong to the nearest of a few pivots and also visit every cell that the triangle inequality on angles does not
    rule out; only cells that can hold a partner are compared. Pivots are sampled by hash; the rows of a cell are
    compared in chunks. Without ``pivots`` there is one for about 500 rows, from 16 to 2,048.
    """
    data = Written(rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["id"]), "vectors").df
    pivots = pivots or min(2_048, max(16, data.count() // 500))
    sample = data.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
    _, centre = _unit(sample.column(0).combine_chunks(), sample.column(1).combine_chunks(), dim) if sample.num_rows else (None, np.zeros((1, dim)))
    reach = np.arccos(np.clip(min_cos, -1, 1)) + 1e-9

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _unit(b.column(0), b.column(1), dim)
            angle = np.arccos(np.clip(x @ centre.T, -1, 1)) if len(x) else np.zeros((0, len(centre)))
            home = angle.argmin(1) if len(x) else np.zeros(0, int)
            # y is at home in cell c with angle r; a partner x has angle(x, c) <= r + reach, and r <= angle(y, own pivot of x) for its own
            row, cell = np.nonzero(angle <= (angle.min(1, keepdims=True) + 2 * reach)) if len(x) else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), pa.array(ids[row], pa.int64()), pa.array(list(x[row]), pa.list_(pa.float64()))], ["cell", "home", "id", "v"])

    def meet(t: pa.Table) -> pa.Table:
        ids, home = t["id"].to_numpy(), t["home"].to_numpy().astype(bool)
        x = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        own, out = np.nonzero(home)[0], []
        for s in range(0, len(ids), 1024):
            cos = x[s : s + 1024] @ x[own].T
            i, j = np.nonzero(cos >= min_cos)
            keep = ids[i + s] < ids[own[j]]
            turned = (ids[i + s] > ids[own[j]]) & ~home[i + s]
            out += [(ids[i[keep] + s], ids[own[j[keep]]], cos[i[keep], j[keep]]), (ids[own[j[turned]]], ids[i[turned] + s], cos[i[turned], j[turned]])]
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "cosine": c})

    return data.mapInArrow(spread, "cell int, home boolean, id bigint, v array<double>").groupBy("cell").applyInArrow(meet, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def keep_best(rows: DataFrame, group: str, score: str, pos: str, owner: str) -> DataFrame:
    """Of each group the rows of the owner of its best row (highest score, then smaller ``pos``); rows without a group all stay.

    The rows are written, as they are read twice. Groups grow with the data, so the join is never a broadcast, and rows without one,
    which would all meet in one task, don't take part in it.
    """
    rows = Written(rows, "ranked").df
    some = rows.where(F.col(group).isNotNull())
    best = some.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(pos).alias("p"), F.col(owner).alias("o"))).alias("b")).select(F.col(group).alias("__g"), F.col("b.o").alias("__o"))
    kept = some.join(best.hint("merge"), F.col(group) == F.col("__g")).where(F.col(owner) == F.col("__o")).drop("__g", "__o")
    return kept.unionByName(rows.where(F.col(group).isNull()))


def numbered(roots: DataFrame, prefix: str) -> DataFrame:
    """``roots (id, root)`` with ``label`` prefix1, prefix2 ... by smallest id; the numbers come from the distinct roots only."""
    distinct = roots.select("root").distinct()
    n = distinct.withColumn("__p", F.floor(F.col("root") / 100_000))
    sizes = n.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = n.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("root"))).join(sizes, "__p").select("root", F.concat(F.lit(prefix), (F.col("__r") + F.col("__before")).cast("string")).alias("label"))
    return roots.join(place, "root")
