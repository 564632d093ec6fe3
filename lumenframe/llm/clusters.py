"""Problem 1: clusters of mutually similar records by bisecting k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.links import hash_to_min
from lumenframe.llm.vectors import SHORT, VectorSet, cells_of, matrix, packed
from lumenframe.session import Written, broadcast_if_small, grouped

#: A part of at least FOLD_ROWS rows within FOLD_SHARE of the limit's angle around its centre is one node where parts are linked.
FOLD_ROWS, FOLD_SHARE = 8, 0.25
#: Allowance for rounding in angles.
TINY = 1e-4
#: Rows of a linked group that one task compares; larger groups are compared in pairs of blocks.
GROUP_ROWS, BLOCK_ROWS = 20_000, 5_000
#: Rows per block when all parts are linked, and of them compared at once: few, so that the products stay in the cache.
GRID_ROWS, GRID_CHUNK = 50_000, 512
#: Rows compared at once, and rounds of two-means per split.
CHUNK, ROUNDS = 2_048, 4


def labels_of_edges(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's connected component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _by_label(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct labels, an order that sorts by label, and where each label starts in it."""
    order = np.argsort(label, kind="stable")
    distinct, starts = np.unique(label[order], return_index=True)
    return distinct, order, starts


def merge_hits(label: np.ndarray, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """``label`` after joining the rows ``a`` and ``b`` where ``hit`` is true.

    The partners of the best connected row are joined first; then rows and columns of one label are folded together, so a
    dense block never becomes a list of its pairs.
    """
    if not hit.any():
        return label
    top = int(hit.sum(1).argmax())
    star = label[b[hit[top]]]
    label = labels_of_edges(len(label), np.full(len(star), label[a[top]]), star)[label]
    la, oa, sa = _by_label(label[a])
    lb, ob, sb = _by_label(label[b])
    folded = np.logical_or.reduceat(np.logical_or.reduceat(hit[oa], sa, axis=0)[:, ob], sb, axis=1)
    i, j = np.nonzero(folded)
    return labels_of_edges(len(label), la[i], lb[j])[label]


def similar_groups(x: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Component of every row among the pairs of cosine ``min_cos`` or more, and the number of such partners."""
    n = len(x)
    label, degree = np.arange(n), np.zeros(n, np.int64)
    for s in range(0, n, CHUNK):
        a = np.arange(s, min(s + CHUNK, n))
        for t in range(s, n, CHUNK):
            b = np.arange(t, min(t + CHUNK, n))
            hit = x[a] @ x[b].T >= min_cos
            if s == t:
                np.fill_diagonal(hit, False)
            degree[a] += hit.sum(1)
            if s != t:
                degree[b] += hit.sum(0)
            label = merge_hits(label, a, b, hit)
    return label, degree


def _is_compact(x: np.ndarray, centre: np.ndarray, min_cos: float) -> bool:
    """Whether every two rows are similar: proven by the radius around the centre, else by comparing them in chunks."""
    near = float((x @ centre).min())
    if near >= np.cos(np.arccos(min_cos) / 2) + 1e-6:
        return True
    if near < min_cos - 1e-6:  # in a set of mutually similar unit rows each has at least that cosine with the centre
        return False
    return all((x[s : s + CHUNK] @ x[t : t + CHUNK].T).min() >= min_cos for s in range(0, len(x), CHUNK) for t in range(s, len(x), CHUNK))


def bisect(x: np.ndarray, min_cos: float) -> np.ndarray:
    """Leaf number of each row: nodes are split by two-means, most dispersed first, until every leaf is compact.

    A split depends on its own node only, so all nodes of a level that exceed the limit are split together, which
    gives the leaves of splitting them one at a time in order of dispersion.
    """
    n, leaf, next_leaf = len(x), np.full(len(x), -1), 0
    order, bounds = np.arange(n), np.array([0, n])
    while len(order):
        starts, sizes = bounds[:-1], np.diff(bounds)
        node = np.repeat(np.arange(len(sizes)), sizes)
        v = x[order]
        mean = np.add.reduceat(v, starts, axis=0) / sizes[:, None]
        norm = np.linalg.norm(mean, axis=1)
        centre = mean / np.maximum(norm, 1e-12)[:, None]
        to_centre = np.einsum("ij,ij->i", v, centre[node])
        # mean squared cosine spread: a compact node has mean norm^2 >= the mean pair similarity
        ready = np.array([s == 1 or (norm[k] ** 2 >= min_cos and _is_compact(v[b : b + s], centre[k], min_cos)) for k, (b, s) in enumerate(zip(starts, sizes, strict=True))])
        for k in np.nonzero(ready)[0]:
            leaf[order[starts[k] : starts[k] + sizes[k]]] = next_leaf
            next_leaf += 1
        stay = ~ready[node]
        if not stay.any():
            break
        order, v, node, to_centre = order[stay], v[stay], np.cumsum(~ready)[node[stay]] - 1, to_centre[stay]
        sizes = sizes[~ready]
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        # first centres: the row farthest from the centre, and the row farthest from that
        far = _arg_first(to_centre, starts, sizes, node)
        axis = v[far]
        other = v[_arg_first(np.einsum("ij,ij->i", v, axis[node]), starts, sizes, node)]
        axis = axis - other
        offset = np.zeros(len(sizes))
        side = np.zeros(len(v), bool)
        for _ in range(ROUNDS):
            side = np.einsum("ij,ij->i", v, axis[node]) > offset[node]
            count = np.add.reduceat(side, starts, dtype=np.int64)
            total = np.add.reduceat(v, starts, axis=0)
            one = np.add.reduceat(v * side[:, None], starts, axis=0)
            a, b = one / np.maximum(count, 1)[:, None], (total - one) / np.maximum(sizes - count, 1)[:, None]
            axis = a - b
            offset = (np.einsum("ij,ij->i", a, a) - np.einsum("ij,ij->i", b, b)) / 2
        side = np.einsum("ij,ij->i", v, axis[node]) > offset[node]
        count = np.add.reduceat(side, starts, dtype=np.int64)
        stuck = (count == 0) | (count == sizes)
        if stuck.any():  # rows that two-means can't tell apart are split in half
            place = np.arange(len(v)) - starts[node]
            side = np.where(stuck[node], place < sizes[node] // 2, side)
            count = np.add.reduceat(side, starts, dtype=np.int64)
        again = np.lexsort((~side, node))
        order = order[again]
        bounds = np.r_[0, np.cumsum(np.stack([count, sizes - count], 1).ravel())]
    return leaf


def _arg_first(value: np.ndarray, starts: np.ndarray, sizes: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Position of the smallest value of each segment."""
    least = np.minimum.reduceat(value, starts)
    hits = np.nonzero(value == least[node])[0]
    _, first = np.unique(node[hits], return_index=True)
    return hits[first]


def shapes(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, unit centre and angular radius of every label's rows."""
    count = np.bincount(label)
    total = np.zeros((len(count), x.shape[1]))
    np.add.at(total, label, x)
    centre = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    least = np.ones(len(count))
    np.minimum.at(least, label, np.einsum("ij,ij->i", x, centre[label]))
    return count, centre, np.where(count > 1, np.arccos(np.clip(least, -1, 1)), 0.0)


def leaf_pairs(x: np.ndarray, leaf: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, whole)``: the pairs of leaves with a pair of rows of cosine ``min_cos`` or more, and whether all their rows are so similar.

    The triangle inequality on angles, with the leaves' centres and radii, settles most pairs of leaves, one way or the
    other; only those that it leaves open are compared row by row.
    """
    count, centre, radius = shapes(x, leaf)
    rows = np.split(np.argsort(leaf, kind="stable"), np.cumsum(count)[:-1])
    first = np.array([r[0] for r in rows])
    reach, out = np.arccos(min_cos), []
    for s in range(0, len(centre), CHUNK):
        angle = np.arccos(np.clip(centre[s : s + CHUNK] @ centre.T, -1, 1))
        a, b = np.nonzero(angle <= reach + radius[s : s + CHUNK, None] + radius[None, :] + TINY)
        keep = a + s < b
        a, b, angle = a[keep] + s, b[keep], angle[a[keep], b[keep]]
        sure = angle <= reach - radius[a] - radius[b] - TINY
        some, whole = sure.copy(), sure.copy()
        single = np.nonzero(~sure & (count[a] == 1) & (count[b] == 1))[0]
        some[single] = whole[single] = np.einsum("ij,ij->i", x[first[a[single]]], x[first[b[single]]]) >= min_cos
        for k in np.nonzero(~sure & ((count[a] > 1) | (count[b] > 1)))[0]:
            some[k], whole[k] = _meeting(x, rows[a[k]], rows[b[k]], min_cos)
        out.append((a[some], b[some], whole[some]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _meeting(x: np.ndarray, a: np.ndarray, b: np.ndarray, min_cos: float) -> tuple[bool, bool]:
    """Whether any pair, and whether every pair, of two sets of rows is similar."""
    some, whole = False, True
    for s in range(0, len(a), CHUNK):
        for t in range(0, len(b), CHUNK):
            cos = x[a[s : s + CHUNK]] @ x[b[t : t + CHUNK]].T
            some, whole = some or bool(cos.max() >= min_cos), whole and bool(cos.min() >= min_cos)
            if some and not whole:
                return True, False
    return some, whole


def parts_of_cell(x: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf and part of each row of a cell, and whether the part is a set of mutually similar rows.

    The leaves come from ``bisect``; a part is a set of leaves linked directly or through others. It is mutually similar
    when every two of its leaves are.
    """
    leaf = bisect(x, min_cos)
    i, j, whole = leaf_pairs(x, leaf, min_cos)
    bundle = labels_of_edges(int(leaf.max()) + 1, i, j)
    size, similar = np.bincount(bundle), np.bincount(bundle[i[whole]], minlength=len(bundle))
    size = np.pad(size, (0, len(bundle) - len(size)))
    return leaf, bundle[leaf], (similar == size * (size - 1) // 2)[bundle[leaf]]


def _assign(data: VectorSet, min_cos: float) -> DataFrame:
    """``(id, leaf, part, rows, clean, radius, short)``: leaf and part of every row within its own cell or hash part of a cell, each by its smallest id.

    ``short`` is the row in 16 bits a column where it takes part in linking the parts. A tight part takes part with its
    centre only, at its smallest id, and the angle ``radius`` around it; for other rows the radius is 0.
    """
    cells = data.cells

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home, _, _ = cells_of(matrix(b.column(1)), cells, None)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(cells.part_of(b.column(0).to_numpy(), home)), b.column(0), b.column(1)], ["cell", "hash", "id", "vec"])

    def split(t: pa.Table) -> pa.Table:
        ids, once = np.unique(t["id"].to_numpy(), return_index=True)
        x = matrix(t["vec"])[once]
        leaf, part, clean = parts_of_cell(x, min_cos)
        _, leaf_first, leaf = np.unique(leaf, return_index=True, return_inverse=True)
        _, first, part, size = np.unique(part, return_index=True, return_inverse=True, return_counts=True)  # ids ascend, so the first is the smallest
        _, centre, radius = shapes(x, part)
        tight = clean[first] & (size >= FOLD_ROWS) & (radius <= FOLD_SHARE * np.arccos(min_cos))
        node = np.ones(len(x), bool)
        node[tight[part]] = False
        node[first] = True
        at, angle = x.copy(), np.zeros(len(x), np.float32)
        at[first[tight]], angle[first[tight]] = centre[tight], radius[tight] + TINY
        short = pa.array([v if n else None for v, n in zip(packed(np.rint(at * SHORT).astype(np.int16)), node, strict=True)], pa.binary())
        return pa.table([ids, ids[leaf_first][leaf], ids[first][part], size[part].astype(np.int64), clean, angle, short], names=["id", "leaf", "part", "rows", "clean", "radius", "short"])

    routed = data.distinct.mapInArrow(route, "cell int, hash int, id bigint, vec binary")
    return grouped(routed, "cell", "hash").applyInArrow(split, "id bigint, leaf bigint, part bigint, rows bigint, clean boolean, radius float, short binary")


def link_blocks(x: np.ndarray, radius: np.ndarray, label: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool, min_cos: float, doubt: float) -> np.ndarray:
    """``label`` after joining the labels of all rows of ``p`` and ``q`` (the same rows with ``same``) that may be linked."""
    reach = np.arccos(min_cos)
    some = x[:, : x.shape[1] // 2]
    less, one = -np.square(some).sum(1, keepdims=True) / 2, np.ones((len(x), 1), np.float32)
    left, right = np.hstack([some, less, one])[p], np.hstack([some, one, less])[q]
    for s in range(0, len(p), GRID_CHUNK):
        a = p[s : s + GRID_CHUNK]
        for o in range(s if same else 0, len(q), GRID_CHUNK):
            b = q[o : o + GRID_CHUNK]
            # half the squared distance in the first columns, turned round
            near = np.flatnonzero(left[s : s + GRID_CHUNK] @ right[o : o + GRID_CHUNK].T >= min_cos - 1 - 2 * doubt)
            if len(near) > len(a) * len(b) // 50:
                label = merge_hits(label, a, b, x[a] @ x[b].T >= min_cos - doubt)
                near = near[:0]
            i, j = np.divmod(near, len(b))
            i, j = a[i], b[j]
            close = (label[i] != label[j]) & (np.einsum("ij,ij->i", x[i], x[j]) >= min_cos - doubt)
            links = [(i[close], j[close])]
            for u, v in ((a[radius[a] > 0], b), (b[radius[b] > 0], a)):  # tight parts reach farther than their centre
                if len(u):
                    k, m = np.nonzero(x[u] @ x[v].T >= np.cos(reach + radius[u, None] + radius[None, v]) - doubt)
                    links.append((u[k], v[m]))
            i, j = (label[np.concatenate(z)] for z in zip(*links, strict=True))
            if (i != j).any():
                label = labels_of_edges(len(label), i[i != j], j[i != j])[label]
    return label


def _links(nodes: DataFrame, total: int, dim: int, min_cos: float) -> DataFrame:
    """``(a, b)``: links that join all parts with a pair of rows of cosine ``min_cos`` or more.

    Every two ``nodes (id, part, radius, short)`` are compared, in pairs of blocks, so that no link depends on which cells lie
    near each other. The vectors are rotated, so half of the columns already keep most pairs farther apart than the limit;
    only the others are compared in all. What the radii and the 16 bits leave open is allowed for: a link too many only has its parts compared exactly.
    """
    tasks = 3 * nodes.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // GRID_ROWS), int(np.ceil(np.sqrt(2 * tasks + 0.25) - 0.5)))
    doubt = np.sqrt(dim) / SHORT + 1e-6
    mine = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q")))
    spread = nodes.withColumn("block", mine).select("block", "part", "radius", "short", F.explode(pairs).alias("pq")).select("block", "part", "radius", "short", "pq.p", "pq.q")

    def compare(t: pa.Table) -> pa.Table:
        names, first, label = np.unique(t["part"].to_numpy(), return_index=True, return_inverse=True)
        x, block = matrix(t["short"], np.int16).astype(np.float32) / np.float32(SHORT), t["block"].to_numpy()
        radius = t["radius"].to_numpy().astype(np.float32)
        p, q = np.nonzero(block == t["p"][0].as_py())[0], np.nonzero(block == t["q"][0].as_py())[0]
        same = t["p"][0].as_py() == t["q"][0].as_py()
        label = link_blocks(x, radius, label, p, q, same, min_cos, doubt)
        root = names[label[first]]
        return pa.table({"a": names[names != root], "b": root[names != root]})

    return grouped(spread, "p", "q").applyInArrow(compare, "a bigint, b bigint")


def _verified(rows: DataFrame, dim: int, min_cos: float) -> DataFrame:
    """``(id, cluster)`` of the linked groups in ``rows (group, id, vec)``: components by exact comparison that are mutually similar.

    Groups of more than ``GROUP_ROWS`` are proven by their radius where it is small enough, and compared in pairs of blocks else.
    """

    def check(t: pa.Table) -> pa.Table:
        ids, once = np.unique(t["id"].to_numpy(), return_index=True)
        label, degree = similar_groups(matrix(t["vec"])[once], min_cos)
        _, first, label, size = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
        whole = np.ones(len(size), bool)
        np.logical_and.at(whole, label, degree == size[label] - 1)
        return pa.table({"id": ids[whole[label]], "cluster": ids[first][label][whole[label]]})

    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    small = rows.join(sizes.where(F.col("n") <= GROUP_ROWS).select("group"), "group").groupBy("group").applyInArrow(check, "id bigint, cluster bigint")
    large = sizes.where(F.col("n") > GROUP_ROWS)
    if not large.limit(1).count():
        return small
    many = rows.join(broadcast_if_small(large), "group")
    proven = Written(_proven(many, dim, min_cos), "proven").df
    open_ = many.join(broadcast_if_small(proven.select("group")), "group", "left_anti")
    done = rows.join(broadcast_if_small(proven), "group").select("id", "cluster")
    return small.unionByName(done).unionByName(_verified_in_blocks(open_, min_cos) if open_.limit(1).count() else done.where("false"))


def _proven(rows: DataFrame, dim: int, min_cos: float) -> DataFrame:
    """``(group, cluster)`` of the large groups whose rows all lie within half the limit's angle of their centre, and so are mutually similar."""
    centres = broadcast_if_small(_centres(rows.select(F.col("group").alias("cluster"), "vec"), dim))

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys, number = np.unique(b.column(0).to_numpy(), return_inverse=True)
                least = np.full(len(keys), 2.0)
                np.minimum.at(least, number, np.einsum("ij,ij->i", matrix(b.column(1)).astype(np.float64), matrix(b.column(2), np.float64)))
                first = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(first, number, b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(least), pa.array(first)], ["group", "least", "first"])

    near = rows.join(centres, F.col("group") == F.col("cluster")).select("group", "vec", "centre", "id").mapInArrow(farthest, "group bigint, least double, first bigint")
    least = near.groupBy("group").agg(F.min("least").alias("least"), F.min("first").alias("cluster"))
    return least.where(F.col("least") >= float(np.cos(np.arccos(min_cos) / 2)) + 1e-6).select("group", "cluster")


def _verified_in_blocks(rows: DataFrame, min_cos: float) -> DataFrame:
    """The same for groups too large for one task: each pair of blocks gives partner counts and a spanning forest of its links."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("p"), F.greatest(o, F.col("block")).alias("q")))
    spread = rows.withColumn("block", mine).select("group", "block", "id", "vec", F.explode(pairs).alias("pq")).select("group", "block", "id", "vec", "pq.p", "pq.q")

    def compare(t: pa.Table) -> pa.Table:
        ids, x, block = t["id"].to_numpy(), matrix(t["vec"]), t["block"].to_numpy()
        p, q = np.nonzero(block == t["p"][0].as_py())[0], np.nonzero(block == t["q"][0].as_py())[0]
        same, degree, label = t["p"][0].as_py() == t["q"][0].as_py(), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s in range(0, len(p), CHUNK):
            hit = x[p[s : s + CHUNK]] @ x[q].T >= min_cos
            if same:
                hit[np.arange(len(hit)), np.arange(s, s + len(hit))] = False
            degree[p[s : s + CHUNK]] += hit.sum(1)
            if not same:
                degree[q] += hit.sum(0)
            label = merge_hits(label, p[s : s + CHUNK], q, hit)
        return pa.table({"id": ids, "root": ids[label], "degree": degree})

    seen = Written(spread.groupBy("group", "p", "q").applyInArrow(compare, "id bigint, root bigint, degree bigint"), "blocks").df
    group = hash_to_min(seen.select(F.col("id").alias("a"), F.col("root").alias("b")))
    each = group.join(seen.groupBy("id").agg(F.sum("degree").alias("degree")), "id")
    bad = each.join(each.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")), "group_id").where("degree <> n - 1").select("group_id").distinct()
    return each.join(bad, "group_id", "left_anti").select("id", F.col("group_id").alias("cluster"))


def similar_clusters(df: DataFrame, id_col: str, vector_col: str, dim: int, min_cos: float = 0.75) -> tuple[DataFrame, VectorSet]:
    """``(id, cluster)``: sets of at least two records that are mutually similar and similar to no record outside.

    A bisecting tree divides all rows into cells, and a crowded cell into hash parts; in each, bisecting k-means goes on until every leaf is compact
    (every two rows have a cosine of ``min_cos`` or more). Leaves are linked by their centres and radii, and row by row where
    those leave it open; then the parts they form are linked between cells by comparing all nodes in pairs of blocks,
    where a tight part is one node. Parts so linked are compared exactly, which joins what one group was cut into and rejects
    what isn't mutually similar. No link is missed; its cost grows with the square of the nodes. Rows with bytewise equal vectors are represented by the smallest id. Records
    without an id or a usable vector, and records similar to none, are in no cluster; an empty input gives no rows.
    """
    data = VectorSet(df, id_col, vector_col, dim, True)
    table = Written(_assign(data, min_cos), "parts").df
    assigned, nodes = table.drop("short", "radius"), table.where("short is not null").select("id", "part", "radius", "short")
    links = _links(nodes if data.cells.parts.sum() > 1 else nodes.where("false"), nodes.count(), dim, min_cos)
    groups = Written(hash_to_min(links), "groups").df.select(F.col("id").alias("part"), F.col("group_id").alias("group"))
    linked = assigned.join(groups, "part").select("id", "group")
    alone = assigned.where("clean").join(groups, "part", "left_anti").select("id", F.col("part").alias("cluster"), "rows")
    checked = _verified(linked.join(data.distinct.dropDuplicates(["id"]), "id").select("group", "id", "vec"), dim, min_cos)
    copies = data.copies
    several = alone.where("rows > 1").select("id", "cluster").unionByName(checked)
    if copies.limit(1).count():
        twins = alone.where("rows = 1").select("id", "cluster").join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        several = several.unionByName(twins)
        several = several.unionByName(several.join(copies.withColumnRenamed("id", "copy").withColumnRenamed("rep", "id"), "id").select(F.col("copy").alias("id"), "cluster"))
    counts = several.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    return several.join(counts, "cluster", "left_semi").select("id", "cluster"), data


def leaves(df: DataFrame, id_col: str, vector_col: str, dim: int, min_cos: float = 0.75) -> tuple[DataFrame, VectorSet]:
    """``(id, cluster)``: the leaves of the bisecting tree alone, each named by its smallest id.

    Every two rows of a leaf are similar; leaves may be similar to each other. Bytewise equal vectors are in one leaf.
    Every record with an id and a usable vector is in one leaf.
    """
    data = VectorSet(df, id_col, vector_col, dim, True)
    own = Written(_assign(data, min_cos).select("id", F.col("leaf").alias("cluster")), "leaves").df
    return own.unionByName(own.join(data.copies.withColumnRenamed("id", "copy").withColumnRenamed("rep", "id"), "id").select(F.col("copy").alias("id"), "cluster")), data


def _centres(rows: DataFrame, dim: int) -> DataFrame:
    """``(cluster, size, compactness, centre)`` of ``rows (cluster, vec)``; summed per partition first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, number = np.unique(b.column(0).to_numpy(), return_inverse=True)
            total = np.zeros((len(keys), dim))
            if len(keys):
                np.add.at(total, number, matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(number)), packed(total)], ["cluster", "n", "total"])

    def centre(t: pa.Table) -> pa.Table:
        total = matrix(t["total"], np.float64).sum(0)
        n = int(np.sum(t["n"].to_numpy()))
        return pa.table({"cluster": t["cluster"][:1], "size": [n], "compactness": [float(np.linalg.norm(total) / n)], "centre": packed((total / max(np.linalg.norm(total), 1e-12))[None, :])})

    return rows.mapInArrow(sums, "cluster bigint, n bigint, total binary").groupBy("cluster").applyInArrow(centre, "cluster bigint, size bigint, compactness double, centre binary")


def cluster_report(members: DataFrame, data: VectorSet, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, compactness, typical_rank, clip_id, cosine)``: the members nearest to the centre of each cluster.

    The centre is summed per partition first; the ranking keeps at most ``typical`` rows per cluster and part.
    """
    ranked = members.join(data.rows.dropDuplicates(["id"]), "id").select("cluster", "id", "vec")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = np.einsum("ij,ij->i", matrix(b.column(1)).astype(np.float64), matrix(b.column(2), np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), b.column(5), pa.array(cos)], ["cluster_id", "clip_id", "size", "compactness", "cosine"])

    centres = _centres(ranked.select("cluster", "vec"), data.dim)
    near = ranked.join(centres, "cluster").select("cluster", "vec", "centre", "id", "size", "compactness").mapInArrow(cosines, "cluster_id bigint, clip_id bigint, size bigint, compactness double, cosine double")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("cosine").desc(), "clip_id"))
    return near.withColumn("typical_rank", rank).where(F.col("typical_rank") <= typical).select("cluster_id", "size", "compactness", "typical_rank", "clip_id", "cosine")


#: Five bands of a 64-bit signature: with at most 8 differing bits, one band differs in at most one bit.
_BANDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def signature_frames(signature: Column) -> Column:
    """The frames of a signature in lower case; null when it is malformed (not 16 hex digits, or several joined by colons)."""
    low = F.lower(signature)
    return F.when(low.rlike(r"\A[0-9a-f]{16}(:[0-9a-f]{16})*\z"), F.split(low, ":"))


def _frame_bits(frames: DataFrame) -> DataFrame:
    high, low = (F.conv(F.substring("frame", s, 8), 16, 10).cast("bigint") for s in (1, 9))
    return frames.withColumn("bits", F.shiftleft(high, 32).bitwiseOR(low)).drop("frame")


def near_signatures(asking: DataFrame, known: DataFrame, max_bits: int = 8) -> DataFrame:
    """Pairs ``(ask_id, id)`` of the same folder with two frames at most ``max_bits`` (8 or fewer) apart.

    ``asking`` and ``known`` hold ``(id, folder, signature)``. The bits are cut into five bands; the asking side
    looks up its bands and their one-bit neighbours, which finds every pair within 8 bits, then each pair is verified.
    """
    if max_bits > 8:
        raise ValueError("the bands cover at most 8 bits")
    frames = lambda d: _frame_bits(d.where("folder is not null").withColumn("frame", F.explode(F.array_distinct(signature_frames(F.col("signature"))))).drop("signature"))
    band = lambda k: F.shiftrightunsigned("bits", _BANDS[k][0]).bitwiseAND(F.lit((1 << _BANDS[k][1]) - 1))
    keys = F.array(*[F.struct(F.lit(k).alias("band"), band(k).alias("key")) for k in range(5)])
    flips = F.flatten(F.array(*[F.array(*[F.struct(F.lit(k).alias("band"), band(k).bitwiseXOR(F.lit(m)).alias("key")) for m in [0, *(1 << b for b in range(_BANDS[k][1]))]]) for k in range(5)]))
    a = frames(asking).select(F.col("id").alias("ask_id"), "folder", F.col("bits").alias("ask_bits"), F.explode(flips).alias("k")).select("ask_id", "folder", "ask_bits", "k.band", "k.key")
    b = frames(known).select("id", "folder", "bits", F.explode(keys).alias("k")).select("id", "folder", "bits", "k.band", "k.key")
    hit = a.join(b, ["folder", "band", "key"]).where(F.bit_count(F.col("bits").bitwiseXOR(F.col("ask_bits"))) <= max_bits)
    return hit.select("ask_id", "id").distinct()


def clusters_with_signatures(clips: DataFrame, dim: int = 96, min_cos: float = 0.75, max_bits: int = 8) -> DataFrame:
    """``(cluster_id, clip_id)``: the clusters by embedding, and the clips without a usable embedding whose signature is near a member's of their folder.

    ``clips`` holds clip_id, folder, signature and embedding, other columns are ignored. cluster_id is the smallest
    clip_id of the cluster.
    """
    members, data = similar_clusters(clips, "clip_id", "embedding", dim, min_cos)
    members = Written(members, "members").df
    light = clips.where("clip_id is not null and signature is not null and folder is not null").select(F.col("clip_id").cast("bigint").alias("id"), "folder", "signature").distinct()
    asking = light.join(data.rows.select("id"), "id", "left_anti")
    known = light.join(members, "id", "left_semi")
    attached = near_signatures(asking, known, max_bits).join(members, "id").select(F.col("ask_id").alias("id"), "cluster")
    everyone = members.unionByName(attached).distinct()
    least = everyone.groupBy("cluster").agg(F.min("id").alias("cluster_id"))
    return everyone.join(least, "cluster").select("cluster_id", F.col("id").alias("clip_id"))
