"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source_key(source: Column) -> Column:
    """One spelling per source: trimmed, lower case, with ``_`` for spaces and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def repetition_rates(sizes: dict[str, int], targets: dict[str, tuple[float, float]], budget: float | None = None) -> dict[str, float]:
    """How often a document of each source is used, so that the mix has ``budget`` tokens in the target shares.

    ``targets`` maps a source to (share, most repeats). A source that can't reach its part even at the most repeats gives all
    it may, and what is missing is taken from the others in proportion to their shares, until nothing is missing or all
    are at their limit. Sources that are empty or not listed have rate 0. Without a budget the mix gets the size of all listed sources.
    """
    live = {s: (max(0.0, w), max(0.0, r)) for s, (w, r) in targets.items() if sizes.get(s, 0) > 0}
    goal = float(sum(sizes[s] for s in live)) if budget is None else float(budget)
    full: dict[str, float] = {}
    while True:
        rest = goal - sum(full.values())
        weight = sum(w for s, (w, _) in live.items() if s not in full)
        if weight <= 0:
            break
        over = {s: sizes[s] * r for s, (w, r) in live.items() if s not in full and rest * w / weight > sizes[s] * r}
        if not over:
            full |= {s: rest * w / weight for s, (w, _) in live.items() if s not in full}
            break
        full |= over
    return {s: full.get(s, 0.0) / sizes[s] for s in live}


def exact_budget(sizes: dict[str, int], targets: dict[str, tuple[float, float]]) -> float:
    """The largest mix in which every source that has documents reaches its share without more than its most repeats."""
    live = {s: (w, r) for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w > 0}
    weight = sum(w for w, _ in live.values())
    return min((sizes[s] * r * weight / w for s, (w, r) in live.items()), default=0.0)


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, budget: float | str = "exact", seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """The mix ``(id, source, copy, size)`` and its report, one row per target source, with the standard ``deviation`` of its tokens.

    The budget is a number of tokens; "exact" takes the largest at which no limit binds, so that every source with documents
    reaches its share; "all" takes the size of all listed sources, at which scarce ones end below their share.
    A document of a source with rate r is given floor(r) times and once more with probability r - floor(r), decided by
    a hash of its id and the seed, so every run gives the same mix and no copy exceeds the most repeats. Repeated
    ids count once; documents without an id, a listed source or a positive size aren't used. Target rows of one source
    are added up (shares) with the smallest limit; only the targets and their totals, one row per source, are collected.
    """
    spark = docs.sparkSession
    clean = docs.where(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).dropDuplicates([id_col]).select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(size_col).cast("bigint").alias("size"))
    wanted = targets.where("source is not null and target_share > 0").groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    goal = {r["source"]: (float(r["share"]), float(r["most"])) for r in wanted.collect()}
    named = clean.where(F.col("source").isin(list(goal))) if goal else clean.where("false")
    found = named.groupBy("source").agg(F.sum("size"), F.sum(F.col("size").cast("double") * F.col("size"))).collect()
    sizes, squares = {r[0]: int(r[1]) for r in found}, {r[0]: float(r[2]) for r in found}
    rates = repetition_rates(sizes, goal, exact_budget(sizes, goal) if budget == "exact" else None if budget == "all" else budget)
    chances = {s: rate % 1 for s, rate in rates.items()}
    rows = [(s, w, int(r), sizes.get(s, 0), rates.get(s, 0.0), (squares.get(s, 0.0) * chances.get(s, 0.0) * (1 - chances.get(s, 0.0))) ** 0.5) for s, (w, r) in sorted(goal.items())]
    plan = spark.createDataFrame(rows, T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.LongType()), T.StructField("source_tokens", T.LongType()), T.StructField("rate", T.DoubleType()), T.StructField("deviation", T.DoubleType())]))
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    times = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    mixed = named.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("times", times.cast("int")).where("times > 0")
    mixed = mixed.select("id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "size")
    reached = mixed.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most_copies"))
    report = plan.join(reached, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # one row per target
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    actual = F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share")
    return mixed, report.select("source", "target_share", actual, "max_repeats", "rate", "source_tokens", "deviation", zero("tokens"), zero("copies"), zero("most_copies"))


def violations(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """``(what, n)``: what must not occur in a mix of the largest exact budget, counted.

    too_many_copies: documents used more often than their source allows; misnumbered: documents whose copies aren't
    1, 2, ...; unlisted: documents of no target source; off_target: sources whose planned part is not their share among
    the sources that have documents; off_plan: sources whose tokens are more than four standard deviations of the
    Bernoulli copies beside the plan.
    """
    each = mixed.groupBy("id", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("top"))
    x = each.join(F.broadcast(report.select("source", "max_repeats")), "source", "left").groupBy("source")
    seen = x.agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("many"), F.count_if((F.col("n") != F.col("top")) | (F.col("n") != F.col("d"))).alias("odd"), F.count_if(F.col("max_repeats").isNull()).alias("unlisted"))
    y = report.join(seen, "source", "full")
    every = Window.partitionBy()  # one row per source
    live = F.when(F.col("source_tokens") > 0, F.col("target_share"))
    planned = F.col("rate") * F.col("source_tokens")
    y = y.withColumns({"goal": live / F.sum(live).over(every), "part": F.try_divide(planned, F.sum(planned).over(every))})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    one = y.agg(total("many").alias("too_many_copies"), total("odd").alias("misnumbered"), total("unlisted").alias("unlisted"), F.count_if(F.abs(F.col("part") - F.col("goal")) > 1e-6).alias("off_target"), F.count_if(F.abs(F.col("tokens") - planned) > 4 * F.col("deviation") + 1).alias("off_plan"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in one.columns])).alias("r")).select("r.what", "r.n")
