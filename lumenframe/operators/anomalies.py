"""Implausible readings per source: an isolation forest on level, difference, seasonal and run-length features, and explicit limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import Written, broadcast_if_small, grouped, tasks_for

#: Readings of a series handled together, and the overlap that lets a run be seen across the border.
CHUNK_S = 1024
#: The readings of a source are dealt to the trees of its forest: each to one, or to as many as give every tree about TREE_ROWS.
TREES, TREE_ROWS, DEPTH = 24, 256, 8
#: Phases of the seasonal profile.
PHASES = 6
#: Readings of a source that are scored together with its forest (about 60 KB), and rows scored at once.
SCORE_ROWS, BATCH = 200_000, 32_768
#: Readings per task of the features.
TASK_ROWS = 1_000_000
#: Where a reading that is no number stands among the compressed features: beyond every finite one.
BEYOND = 800.0

FEATURES = ("level", "difference", "seasonal", "run")


def series_features(readings: DataFrame, min_run: int = 8, period_s: int = 60) -> DataFrame:
    """``(key, name, sec, source, value, diff, run, phase)`` of the non-null readings ``(key, name, sec, source, value)``.

    diff is the change since the second before (null without one), run the length of the run of equal values in
    consecutive seconds. Series are cut into chunks of ``CHUNK_S`` seconds that overlap by ``min_run`` on either side, so
    no task has to hold a whole series; a run is at least ``min_run`` here exactly when it is in the whole series.
    Repeated rows count once. The number of tasks grows with the readings.
    """
    moved = F.col("sec") + CHUNK_S // 2  # most series start at 0, which is no border then
    chunk = F.floor(moved / CHUNK_S)
    place = F.pmod(moved, F.lit(CHUNK_S))
    chunks = F.when(place < min_run, F.array(chunk, chunk - 1)).when(place >= CHUNK_S - min_run, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    x = readings.where("value is not null and key is not null and name is not null and sec is not null").select("key", "name", "sec", "source", "value")
    x = x.withColumn("own", chunk).withColumn("chunk", F.explode(chunks))
    x = x.repartition(tasks_for(readings, TASK_ROWS), "key", "name", "chunk").distinct()
    series = Window.partitionBy("key", "name", "chunk").orderBy("sec", "value")
    follows = (F.col("sec") - F.lag("sec").over(series)) == 1
    before = F.lag("value").over(series)
    x = x.withColumns({"diff": F.when(follows, F.col("value") - before), "new": F.when(follows & (F.col("value") == before), 0).otherwise(1)})
    x = x.withColumn("run_no", F.sum("new").over(series.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("run", F.count(F.lit(1)).over(Window.partitionBy("key", "name", "chunk", "run_no")).cast("int")).where("own = chunk")
    phase = F.floor(F.pmod("sec", F.lit(period_s)) * PHASES / period_s).cast("int")
    return x.select("key", "name", F.col("sec").cast("int").alias("sec"), "source", "value", "diff", "run", phase.alias("phase"))


def plausible(value: str = "value") -> Column:
    """Neither NaN nor infinite nor below zero: the explicit physical limits of the readings here."""
    return ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < F.lit(float("inf")))


def usual_levels(features: DataFrame) -> DataFrame:
    """``(source, name, n, level, spread)``: median and interquartile range on the scale of a standard deviation, of the plausible readings.

    Both are quantiles of mergeable sketches (rank error 1e-4) and not moved by a small share of implausible readings.
    """
    q = F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000)
    x = features.where(plausible()).groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return x.select("source", "name", "n", F.col("q")[1].alias("level"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("spread"))


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_tree(x: np.ndarray, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, threshold (2^DEPTH - 1 inner nodes) and path length (2^DEPTH leaves) of an isolation tree over all rows, in whatever order.

    It is complete: a node that ends early keeps sending rows down, to leaves that all have its path length.
    """
    rng = np.random.default_rng(seed)
    inner, k = 2**DEPTH - 1, x.shape[1]
    feature, threshold = np.zeros(inner, np.int8), np.full(inner, np.inf, np.float32)
    node = np.zeros(len(x), np.uint8)
    ended = np.full(1, np.nan)
    for depth in range(DEPTH + 1):
        width = 2**depth
        order = np.argsort(node, kind="stable")
        x, node = x[order], node[order]
        n = np.bincount(node, minlength=width)
        low, high = np.full((width, k), np.inf, np.float32), np.full((width, k), -np.inf, np.float32)
        held = np.nonzero(n)[0]
        if len(held):
            at = (np.cumsum(n) - n)[held]
            low[held], high[held] = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
        wide = high > low
        stop = (n <= 1) | ~wide.any(1) | (depth == DEPTH)
        ended = np.where(np.isnan(ended), np.where(stop, depth + _path(n), np.nan), ended)
        if depth == DEPTH:
            break
        chosen = np.where(wide, rng.random(wide.shape), -1).argmax(1)
        pick = np.arange(width), chosen
        with np.errstate(invalid="ignore"):
            cut = (low[pick] + rng.random(width) * (high[pick] - low[pick])).astype(np.float32)
        cut = np.where(np.isnan(ended), cut, np.inf).astype(np.float32)
        feature[width - 1 : 2 * width - 1], threshold[width - 1 : 2 * width - 1] = chosen, cut
        node = (2 * node + (x[np.arange(len(x)), chosen[node]] >= cut[node])).astype(np.uint8)
        ended = np.repeat(ended, 2)
    return feature, threshold, ended.astype(np.float32)


def fit_forest(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of ``fit_tree`` over rows in one place, each row dealt to one tree or, of few rows, to more."""
    copies = min(TREES, -(-TREES * TREE_ROWS // max(len(x), 1)))
    first = np.random.default_rng(seed).permutation(len(x))
    trees = [fit_tree(x[(t - first) % TREES < copies], (seed, t)) for t in range(TREES)]
    return tuple(np.stack(part) for part in zip(*trees, strict=True))


def forest_scores(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, length: np.ndarray, fitted: float) -> np.ndarray:
    """Score in (0, 1) of each row by one forest, whose trees have ``fitted`` rows each. Around 0.5 is usual, near 1 isolated at once."""
    inner = 2**DEPTH - 1
    out = np.empty(len(x))
    for s in range(0, len(x), BATCH):
        rows = x[s : s + BATCH]
        flat, at = rows.ravel(), np.arange(len(rows)) * x.shape[1]
        total = np.zeros(len(rows))
        for t in range(len(feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (flat[at + feature[t, node]] >= threshold[t, node])
            total += length[t, node - inner]
        out[s : s + BATCH] = 2.0 ** (-total / len(feature) / max(float(_path(fitted)), 1e-9))
    return out


def _feature_matrix(value: np.ndarray, diff: np.ndarray, run: np.ndarray, level: np.ndarray, spread: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
    """The four features, in spreads (compressed by arcsinh, so that a huge reading doesn't hide a large one) and log2 of the run.

    A change that isn't known is none; a level that is no finite number lies beyond all others.
    """
    scale = np.maximum(spread, 1e-9)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.stack([np.arcsinh((value - level) / scale), np.arcsinh(np.nan_to_num(diff) / scale), np.arcsinh((value - seasonal) / scale), np.log2(np.maximum(run, 1))], axis=1)
    return np.nan_to_num(x, nan=BEYOND, posinf=BEYOND, neginf=-BEYOND).astype(np.float32)


def seasonal_profiles(features: DataFrame, levels: DataFrame) -> DataFrame:
    """The levels with ``profile``: the median of each phase over all readings within ten spreads; the level for a phase without any."""
    near = F.abs(F.col("value") - F.col("level")) <= 10 * F.greatest("spread", F.lit(1e-9))
    x = features.where(plausible()).join(broadcast_if_small(levels.select("source", "name", "level", "spread")), ["source", "name"]).where(near)
    x = x.groupBy("source", "name", "phase").agg(F.percentile_approx("value", 0.5, 10_000).alias("usual"))
    x = x.groupBy("source", "name").agg(F.map_from_entries(F.collect_list(F.struct("phase", "usual"))).alias("__usual"))
    of = F.transform(F.sequence(F.lit(0), F.lit(PHASES - 1)), lambda p: F.coalesce(F.try_element_at("__usual", p), F.col("level")))
    return levels.join(x, ["source", "name"], "left").withColumn("profile", of).drop("__usual")


def fit_sources(features: DataFrame, levels: DataFrame) -> DataFrame:
    """One model row per source and name, fitted on all plausible readings of it.

    Each reading is part of one tree, drawn by hash; of a source with few readings, of as many trees as give each about ``TREE_ROWS``.
    A task fits a tree of a source at a time, and ``fitted`` is the mean number of readings of its trees.
    """
    levels = Written(levels.where("source is not null and name is not null"), "levels").df
    levels = Written(seasonal_profiles(features, levels), "levels").df
    copies = F.least(F.lit(TREES), F.ceil(F.lit(TREES * TREE_ROWS) / F.col("n"))).cast("int")
    first = F.pmod(F.xxhash64("key", "name", "sec", F.lit(17)), F.lit(TREES)).cast("int")
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: (first + i) % TREES))
    dealt = features.where(plausible()).join(broadcast_if_small(levels.select("source", "name", copies.alias("copies"))), ["source", "name"])
    dealt = dealt.select("source", "name", tree.alias("tree"), "value", "diff", "run", "phase")
    out = "source string, name string, n bigint, level double, spread double, fitted double, profile binary, feature binary, threshold binary, length binary"
    bits = pa.binary()
    none = pa.schema([("source", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("level", pa.float64()), ("spread", pa.float64()), ("fitted", pa.float64()), ("profile", bits), ("feature", bits), ("threshold", bits), ("length", bits), ("tree", pa.int32())])

    def fit(t: pa.Table, level: pa.Table) -> pa.Table:
        if not t.num_rows:
            return none.empty_table()
        num = lambda c, kind=float: t[c].to_numpy().astype(kind)
        usual, spread = level["level"][0].as_py(), level["spread"][0].as_py()
        profile, no = np.array(level["profile"][0].as_py(), float), level["tree"][0].as_py()
        x = _feature_matrix(num("value"), num("diff"), num("run"), usual, spread, profile[num("phase", np.int64)])
        f, h, length = fit_tree(x, (len(x), no))
        parts = {"fitted": [float(len(x))], "profile": [profile.tobytes()], "feature": [f.tobytes()], "threshold": [h.tobytes()], "length": [length.tobytes()]}
        return pa.table({c: level[c] if c in level.column_names and c not in parts else parts[c] for c in none.names}, schema=none)

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("tree")
        whole = {c: [b"".join(t[c].to_pylist())] for c in ("feature", "threshold", "length")}
        return pa.table({c: t[c][:1] for c in ("source", "name", "n", "level", "spread")} | {"fitted": [float(np.mean(t["fitted"].to_numpy()))], "profile": t["profile"][:1]} | whole)

    keys = ["source", "name", "tree"]
    tasks = tasks_for(features, TASK_ROWS)
    each = levels.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).repartition(tasks, *keys)
    trees = dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(fit, f"{out}, tree int")
    return grouped(trees, "source", "name").applyInArrow(grow, out)


def score_readings(features: DataFrame, models: DataFrame) -> DataFrame:
    """The features with ``level``, ``spread`` and the forest's ``score``; nulls for readings without a source or of a source without a model.

    The readings of a source meet its forest in parts of about ``SCORE_ROWS``, so that neither all forests nor all readings
    of a source are ever in one place.
    """
    inner = 2**DEPTH - 1
    parts = F.ceil(F.col("n") / SCORE_ROWS).cast("int")
    sized = broadcast_if_small(models.select(F.col("source").alias("__s"), F.col("name").alias("__n"), parts.alias("__parts")))
    names = features.columns
    x = features.join(sized, (F.col("source") == F.col("__s")) & (F.col("name") == F.col("__n")), "left")
    x = x.withColumn("part", F.pmod(F.xxhash64("key", "sec"), F.coalesce("__parts", F.lit(1))).cast("int")).select(*names, "part")
    shaped = features.select("*", F.lit(0.0).alias("level"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("score")).schema

    def score(rows: pa.Table, model: pa.Table) -> pa.Table:
        none = pa.nulls(rows.num_rows, pa.float64())
        rows = rows.select(names)
        if not rows.num_rows or not model.num_rows:
            return pa.table([*rows.columns, none, none, none], names=[*names, "level", "spread", "score"])
        num = lambda c, kind=float: rows[c].to_numpy().astype(kind)
        read = lambda c, kind, *shape: np.frombuffer(model[c][0].as_py(), kind).reshape(shape)
        level, spread, fitted = (model[c][0].as_py() for c in ("level", "spread", "fitted"))
        profile = read("profile", np.float64, PHASES)
        m = _feature_matrix(num("value"), num("diff"), num("run"), level, spread, profile[num("phase", np.int64)])
        result = forest_scores(m, read("feature", np.int8, -1, inner), read("threshold", np.float32, -1, inner), read("length", np.float32, -1, inner + 1), fitted)
        return pa.table([*rows.columns, np.full(len(m), level), np.full(len(m), spread), result], names=[*names, "level", "spread", "score"])

    keys = ["source", "name", "part"]
    tasks = tasks_for(features, TASK_ROWS)
    forests = models.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).repartition(tasks, *keys)
    scored = x.where("source is not null").repartition(tasks, *keys).groupBy(*keys).cogroup(forests.groupBy(*keys)).applyInArrow(score, shaped)
    unknown = F.lit(None).cast("double")
    return scored.unionByName(features.where("source is null").withColumns({"level": unknown, "spread": unknown, "score": unknown}))


def scored_readings(readings: DataFrame, min_score: float = 0.5, spreads: float = 10.0, min_run: int = 8) -> DataFrame:
    """Every non-null reading of ``(key, name, sec, source, value)`` once, with ``diff, run, phase, level, spread, score, reason``.

    score is that of the isolation forest of the reading's source and name. reason is ``limit`` for NaN, infinite or
    negative readings (explicit physical limits), ``stuck`` for a positive reading in a run of ``min_run`` or more equal ones in
    consecutive seconds, ``spike`` for a reading that the forest isolates (score ``min_score`` or more) and that
    lies more than ``spreads`` usual spreads from its source's level, else null.
    """
    features = Written(series_features(readings, min_run), "features").df
    models = Written(fit_sources(features, usual_levels(features)), "forests").df
    isolated = (F.col("score") >= min_score) & (F.abs(F.col("value") - F.col("level")) > spreads * F.col("spread"))
    reason = F.when(~plausible(), "limit").when((F.col("run") >= min_run) & (F.col("value") > 0), "stuck").when(isolated, "spike")
    return score_readings(features, models).withColumn("reason", reason)


def implausible_readings(readings: DataFrame, min_score: float = 0.5, spreads: float = 10.0, min_run: int = 8) -> DataFrame:
    """``(key, name, sec, value, score, reason)`` of the implausible readings of ``(key, name, sec, source, value)``.

    They are the ``scored_readings`` with a reason. Null readings aren't measured and never flagged; zero is rest, never
    stuck. Readings without a source have no score and can only break the limits or be stuck. An empty input gives no rows.
    """
    return scored_readings(readings, min_score, spreads, min_run).where("reason is not null").select("key", "name", "sec", "value", "score", "reason")
