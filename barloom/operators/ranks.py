"""Average ranks without a task that holds a group.

Equal values are one row with their count. A group's distinct values are cut into parts at quantiles
of a sketch; a part is a function of the value, so ties never lie in two. Ranks within a part are
offset by the rows of the parts before it, and go back to the rows by their value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.store import settled

from .chunks import null_safe, strips

#: Parts of a group.
PARTS = 64
#: Distinct values of features and keys, at most, whose ranks go to all tasks.
FEW = 1 << 16
#: Distinct values of a strip.
STRIP = 1 << 18


def rank_table(counts: DataFrame, col: str, keys: list[str], name: str) -> DataFrame:
    """keys, col, name: the average rank from 1 of each distinct value of a group; nulls are the smallest value.
    counts: keys, col and _n, the rows that have a value; read three times, so it should be cheap to make again."""
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(col, [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"))
    counts = null_safe(counts, cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))  # one row
    part = F.when(F.col(col).isNull() | F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(col))))
    counts = counts.withColumn("_part", part).drop("_cuts")
    by = [*keys, "_part"]
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(*by, (F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")).alias("_before"))  # PARTS rows a group
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(col))
    ranked = null_safe(counts.withColumn("_upto", upto), sizes, by)
    return ranked.select(*keys, col, (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def average_rank(df: DataFrame, col: str, keys: list[str], name: str) -> DataFrame:
    """df and name: the average rank of a row's value in its group."""
    return null_safe(df, rank_table(settled(df.groupBy(*keys, col).agg(F.count("*").alias("_n"))), col, keys, name), [*keys, col])


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, n, rho: Pearson of average ranks over rows where both are there; rho is null if one is constant. Pairs of
    equal values are one row with their count."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count("*").alias("_w"))
    pairs = settled(pairs)
    # Both columns in one table of values, where they have one type.
    kind = "double" if pairs.schema[a].dataType != pairs.schema[b].dataType else pairs.schema[a].dataType
    both = F.array(*(F.struct(F.lit(k).alias("_of"), F.col(c).cast(kind).alias("_value")) for k, c in enumerate((a, b))))
    long = pairs.select(*keys, "_w", F.explode(both).alias("_x")).select(*keys, "_w", "_x.*")
    ranks = rank_table(long.groupBy(*keys, "_of", "_value").agg(F.sum("_w").alias("_n")), "_value", [*keys, "_of"], "_rank")
    ranked = pairs
    for k, (c, name) in enumerate(((a, "_ra"), (b, "_rb"))):
        own = ranks.where(F.col("_of") == k).select(*keys, F.col("_value").alias("_v"), F.col("_rank").alias(name))
        ranked = null_safe(ranked.withColumn("_v", F.col(c).cast(kind)), own, [*keys, "_v"]).drop("_v")
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    mid = ranked.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("_mx"), (F.sum(w * y) / F.sum(w)).alias("_my"))
    ranked = null_safe(ranked, mid, keys) if keys else ranked.crossJoin(F.broadcast(mid))  # one row
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    out = ranked.groupBy(*keys, "n").agg(F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy"))
    return out.select(*keys, "n", F.try_divide("_xy", F.nullif(F.sqrt("_xx") * F.sqrt("_yy"), F.lit(0.0))).alias("rho"))


def spearman_wide(df: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """feature, keys, n, rho: spearman() of each feature, a number, with one target, without a row for each feature and row.
    Features with few values have their ranks looked up, so a distinct value of the target takes one row: for each feature
    its rows and the sum of their ranks. The target's ranks are running sums of these rows. Other features go the
    general way. Runs jobs."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    df = df.select(*keys, F.col(target), *cols).where(F.col(target).isNotNull())
    counts = df.unpivot([*keys, target], features, "feature", "_x").where("_x IS NOT NULL").groupBy("feature", *keys, "_x").agg(F.count("*").alias("_n"))
    sizes = {r["feature"]: r["d"] for r in df.agg(*(F.approx_count_distinct(F.struct(*keys, c)).alias(c) for c in features)).unpivot([], features, "feature", "d").collect()}
    few = [c for c in features if sizes[c] <= FEW]
    many = [c for c in features if c not in few]
    parts = [spearman(df.select(*keys, target, F.lit(c).alias("feature"), F.col(c).alias("_x")), "_x", target, ["feature", *keys]).select("feature", *keys, "n", "rho") for c in many]
    if few:
        parts.append(_with_few(df, counts.where(F.col("feature").isin(few)), few, target, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_few(df: DataFrame, counts: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    by = ["feature", *keys]
    counts = settled(counts)
    ranks = settled(null_safe(counts, rank_table(counts, "_x", by, "_rank"), [*by, "_x"]))
    total = ranks.groupBy(*by).agg(F.sum("_n").alias("n"))
    spread = null_safe(ranks, total, by).groupBy(*by, "n").agg(F.sum(F.col("_n") * F.pow(F.col("_rank") - (F.col("n") + 1) / 2, F.lit(2.0))).alias("_xx"))
    for k, c in enumerate(features):
        own = ranks.where(F.col("feature") == c).select(*keys, F.col("_x").alias(c), F.col("_rank").alias(f"_r{k}"))
        df = null_safe(df, F.broadcast(own), [*keys, c], "left")
    sums = [x for k in range(len(features)) for x in (F.count(f"_r{k}").alias(f"_n{k}"), F.sum(f"_r{k}").alias(f"_s{k}"))]
    values = strips(df.groupBy(*keys, target).agg(*sums), [*keys, target], "_strip", STRIP)
    strip = [*keys, "_strip"]
    before = Window.partitionBy(*keys).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)  # a row a strip
    ends = values.groupBy(*strip).agg(*(F.sum(f"_n{k}").alias(f"_e{k}") for k in range(len(features))))
    ends = ends.select(*strip, *(F.coalesce(F.sum(f"_e{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(features))))
    here = Window.partitionBy(*strip).orderBy(target).rowsBetween(Window.unboundedPreceding, 0)
    values = null_safe(values.withColumns({f"_u{k}": F.sum(f"_n{k}").over(here) for k in range(len(features))}), ends, strip)
    # The rank of a value of the target among the rows that have the feature.
    named = [F.struct(F.lit(c).alias("feature"), F.col(f"_n{k}").alias("w"), F.col(f"_s{k}").alias("s"), (F.col(f"_b{k}") + F.col(f"_u{k}") - (F.col(f"_n{k}") - 1) / 2).alias("y")) for k, c in enumerate(features)]
    long = values.select(*keys, F.explode(F.array(*named)).alias("_p")).select(*keys, "_p.*").where("w > 0")
    mid = (F.col("n") + 1) / 2
    both = null_safe(long, F.broadcast(spread), by)
    out = both.groupBy(*by, "n", "_xx").agg(F.sum((F.col("y") - mid) * (F.col("s") - F.col("w") * mid)).alias("_xy"), F.sum(F.col("w") * F.pow(F.col("y") - mid, F.lit(2.0))).alias("_yy"))
    return out.select(*by, "n", F.try_divide("_xy", F.nullif(F.sqrt("_xx") * F.sqrt("_yy"), F.lit(0.0))).alias("rho"))
