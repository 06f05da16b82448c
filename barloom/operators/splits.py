"""Splits, folds, row ids, windows of time and safe regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunks


def outside(bar: str, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a & b, (~F.col(bar).between(s, e) for s, e in ranges), F.lit(True))


def row_ids(tape: DataFrame) -> DataFrame:
    """row_id: place in the order (datetime, symbol). Ranks are per day, days are offset by the
    rows before them, so no task holds the whole tape."""
    df = tape.withColumn("_day", F.to_date("datetime"))
    days = df.groupBy("_day").agg(F.count("*").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(Window.orderBy("_day")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_day").orderBy("datetime", "symbol")) - 1
    return df.withColumn("_place", place).join(days, "_day").withColumn("row_id", F.col("_place") + F.col("_before")).drop("_day", "_place", "_before")


def numbered(df: DataFrame, keys: list[str] | None = None, order: list | None = None) -> DataFrame:
    """rn from 1 and n, by symbol; other keys and orders are those of small tables."""
    if keys is None and len(order or ["datetime"]) == 1:
        return chunks.numbered(df, "rn", total="n", time=(order or ["datetime"])[0]).withColumn("rn", F.col("rn") + 1)
    part = Window.partitionBy(*(keys or ["symbol"]))
    return df.withColumn("rn", F.row_number().over(part.orderBy(*(order or ["datetime"])))).withColumn("n", F.count(F.lit(1)).over(part))


def holdout(df: DataFrame, fraction: float = 0.65, embargo: int = 96) -> DataFrame:
    """split: train, then `embargo` rows dropped, then val."""
    cut = F.floor(F.col("n") * fraction)
    df = numbered(df).withColumn("split", F.when(F.col("rn") <= cut, "train").when(F.col("rn") > cut + embargo, "val"))
    return df.where("split IS NOT NULL").drop("rn", "n")


def purged_halves(df: DataFrame, purge: int) -> DataFrame:
    """half: fitness or selection, `purge` rows dropped on either side of the middle."""
    mid = F.floor(F.col("n") / 2)
    df = numbered(df).withColumn("half", F.when(F.col("n") <= 1, "fitness").when(F.col("rn") <= mid - purge, "fitness").when(F.col("rn") > mid + purge, "selection"))
    return df.where("half IS NOT NULL").drop("rn", "n")


def fold_bounds(df: DataFrame, splits: int, holdout_fraction: float, min_train: float, embargo: int, min_valid: int = 0) -> DataFrame:
    """symbol, fold, v_start, v_end, train_end: expanding folds over bars, the last one the
    final holdout. Train ends `embargo` bars before the validation starts."""
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    usable = F.floor(F.col("n") * (1 - holdout_fraction))
    first = F.floor(usable * min_train)
    size = F.floor((usable - first) / splits)
    cv = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits)))).withColumns({
        "v_start": F.when(F.col("fold") == splits, usable).otherwise(first + F.col("fold") * size),
        "v_end": F.when(F.col("fold") == splits, F.col("n")).otherwise(first + (F.col("fold") + 1) * size)})
    cv = cv.withColumn("train_end", F.greatest(F.col("v_start") - embargo, F.lit(0))).where(F.col("v_end") - F.col("v_start") >= min_valid)
    return cv.select("symbol", "fold", F.col("v_start").cast("long"), F.col("v_end").cast("long"), F.col("train_end").cast("long"))


def fold_rows(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of each fold with role train or valid. Bounds have one row a symbol and fold."""
    j = df.join(bounds, "symbol")
    role = F.when(F.col("bar") < F.col("train_end"), "train").when((F.col("bar") >= F.col("v_start")) & (F.col("bar") < F.col("v_end")), "valid")
    return j.withColumn("role", role).where("role IS NOT NULL").drop("v_start", "v_end", "train_end")


def linspace_folds(df: DataFrame, k: int) -> DataFrame:
    """fold by truncated equal bounds on the row number (sizes as of linspace, not ntile)."""
    fold = F.lit(0)
    for i in range(1, k):
        fold = F.when(F.col("rn") - 1 >= F.floor(F.col("n") * i / k), i).otherwise(fold)
    return numbered(df).withColumn("fold", fold).drop("rn", "n")


def time_windows(df: DataFrame, days: int, min_rows: int, most: int) -> DataFrame:
    first = df.agg(F.min(F.unix_timestamp("datetime")).alias("t0"))
    wid = F.floor((F.unix_timestamp("datetime") - F.col("t0")) / (days * 86400))
    k = df.crossJoin(F.broadcast(first)).groupBy(wid.alias("window_id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return k.withColumn("rk", F.row_number().over(Window.orderBy("window_id"))).where(F.col("rk") <= most).drop("rk")


#: Rows of a strip.
STRIP = 1 << 18


def largest_gap(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """symbol, start, size of the largest run of [low, high) outside the (s, e) ranges, inclusive. Ranges
    are cut into strips of their order; a strip knows how far those before it reach."""
    edges = ranges.select("symbol", "s", "e").union(ranges.select("symbol").distinct().select("symbol", F.lit(high).alias("s"), F.lit(high).alias("e")))
    edges = chunks.strips(edges, ["symbol", "s", "e"], "_strip", STRIP)
    by = ["symbol", "_strip"]
    earlier = Window.partitionBy("symbol").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)  # a row a strip
    ends = edges.groupBy(*by).agg(F.max("e").alias("_top")).select(*by, F.max("_top").over(earlier).alias("_before"))
    here = F.max("e").over(Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    df = chunks.null_safe(edges.withColumn("_here", here), ends, by)
    start = F.coalesce(F.greatest("_here", "_before") + 1, F.lit(low)).cast("long")
    best = F.max(F.struct(F.greatest(F.col("s") - start, F.lit(0)).cast("long").alias("size"), (-start).alias("first")))
    return df.groupBy("symbol").agg(best.alias("_best")).select("symbol", (-F.col("_best.first")).alias("start"), "_best.size")


def aligned_sample(df: DataFrame, size: int, seed: int) -> DataFrame:
    """One run of bars, shared by all symbols; a seed gives its start."""
    top = df.groupBy("symbol").agg(F.max("bar").alias("m")).agg(F.min("m")).first()[0] or 0
    start = seed % (max(0, top + 1 - size) + 1)
    return df.where(F.col("bar").between(start, start + size - 1))


def drop_last(df: DataFrame, n: int) -> DataFrame:
    return chunks.numbered(df, "_r", total="_n").where(F.col("_r") < F.col("_n") - n).drop("_r", "_n")


def release_rows(tape: DataFrame, offset: Column, name: str = "release_row") -> DataFrame:
    """tape (symbol, bar, row_id, ...) with the row_id of the symbol's first row whose bar is at
    least bar + offset; null if there is none, or the offset is missing or negative. Bars may have
    gaps. One sort by symbol and bar over both sides, no join."""
    at = F.when(offset >= 0, F.col("bar") + offset)
    asks = tape.withColumns({"_t": at, "_kind": F.lit(1), "_row": F.lit(None).cast("long")})
    rows = tape.withColumns({"_t": F.col("bar"), "_kind": F.lit(0), "_row": F.col("row_id").cast("long")})
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asks).withColumn(name, F.last("_row", ignorenulls=True).over(w)).where("_kind = 1")
    return both.withColumn(name, F.when(F.col("_t").isNotNull(), F.col(name))).drop("_t", "_kind", "_row")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """name: place from 1 in the order. Rows are cut into strips of the whole order
    and ranked within them; strips are offset by the rows before, so no task holds all rows."""
    df = chunks.strips(df, order, "_strip", STRIP)
    sizes = df.groupBy("_strip").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_strip", (F.sum("_n").over(Window.orderBy("_strip")) - F.col("_n")).alias("_before"))  # a row a strip
    place = F.row_number().over(Window.partitionBy("_strip").orderBy(*order))
    return df.withColumn("_place", place).join(F.broadcast(sizes), "_strip").withColumn(name, F.col("_place") + F.col("_before")).drop("_strip", "_place", "_before")


def nested_bounds(df: DataFrame, outer: int, min_train: float, purge: int) -> DataFrame:
    """symbol, fold, v_start, v_end, train_end: contiguous outer folds after the first part of the
    rows; the first folds take the remainder. Inner rows end `purge` bars before."""
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    first = F.greatest(F.floor(F.col("n") * min_train), F.lit(1))
    usable = F.greatest(F.col("n") - first, F.lit(0))
    base, rest = F.floor(usable / outer), usable % outer
    b = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).withColumns({
        "v_start": first + F.col("fold") * base + F.least("fold", rest), "v_end": first + (F.col("fold") + 1) * base + F.least(F.col("fold") + 1, rest)})
    b = b.where("v_end > v_start").withColumn("train_end", F.greatest(F.col("v_start") - purge, F.lit(0)))
    return b.select("symbol", "fold", *(F.col(c).cast("long") for c in ("v_start", "v_end", "train_end")))


def select_folds(bounds: DataFrame, what: str) -> DataFrame:
    """'holdout': the last fold of each symbol; 'cv': the others."""
    last = F.max("fold").over(Window.partitionBy("symbol"))
    return bounds.withColumn("_last", last).where((F.col("fold") == F.col("_last")) if what == "holdout" else (F.col("fold") < F.col("_last"))).drop("_last")


def nested_select(scores: DataFrame, score: str = "score") -> DataFrame:
    """fold, candidate and outer score of the candidate with the best inner score of each fold; of
    equal ones the first. scores: fold, candidate, role (inner or outer), score."""
    both = scores.groupBy("fold", "candidate").agg(F.max(F.when(F.col("role") == "inner", F.col(score))).alias("_inner"), F.max(F.when(F.col("role") == "outer", F.col(score))).alias("outer_score"))
    w = Window.partitionBy("fold").orderBy(F.desc_nulls_last("_inner"), "candidate")
    return both.where("_inner IS NOT NULL").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("fold", "candidate", "outer_score")


def tail_folds(df: DataFrame, splits: int, tail: float) -> DataFrame:
    """fold: equal chunks of each symbol's head, the last takes the rest; `splits` is the tail. A
    symbol with too few rows is repeated splits + 1 times first, in order."""
    df = numbered(df)
    few = F.col("n") < splits + 1
    df = df.withColumn("_copy", F.explode(F.when(few, F.sequence(F.lit(0), F.lit(splits))).otherwise(F.array(F.lit(0)))))
    df = df.withColumn("_at", F.col("rn") - 1 + F.col("_copy") * F.col("n")).withColumn("_size", F.when(few, F.col("n") * (splits + 1)).otherwise(F.col("n")))
    kept = F.col("_size") - (F.greatest(F.rint(F.col("_size") * tail), F.lit(1.0)).cast("long") if tail > 0 else F.lit(0))
    chunk = F.greatest(F.floor(kept / splits), F.lit(1))
    fold = F.when(F.col("_at") >= kept, splits).otherwise(F.least(F.floor(F.col("_at") / chunk), F.lit(splits - 1)))
    return df.withColumn("fold", fold.cast("long")).drop("rn", "n", "_copy", "_at", "_size")


def training_rows(df: DataFrame, bounds: DataFrame, embargo: int) -> DataFrame:
    """Rows outside every validation and holdout range of their symbol and the embargo before it."""
    ranges = bounds.groupBy("symbol").agg(F.collect_list(F.struct(F.greatest(F.col("v_start") - embargo, F.lit(0)).alias("a"), F.col("v_end").alias("b"))).alias("_r"))
    return df.join(ranges, "symbol", "left").where(~F.coalesce(F.exists("_r", lambda r: (F.col("bar") >= r.a) & (F.col("bar") < r.b)), F.lit(False))).drop("_r")


def epoch_seed(seed: int, epoch: int, island: str = "") -> int:
    """The seed of an epoch's sample: windows rotate, and a rerun gives the same ones."""
    import hashlib

    return int(hashlib.sha256(f"{seed}|{epoch}|{island}".encode()).hexdigest()[:12], 16)
