"""Running figures over an order, folded by block and carried from block to block.

A figure is an element of a monoid: what a block does to whatever comes before it. Blocks are folded
side by side, a scan over one element a block gives what comes before each, and a second look at the
block's own rows gives its results. So no window and no list has the rows of a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks
from .chunks import null_safe, numbered, slot_of


def running_sum(df: DataFrame, col: str, keys: list[str], order: str, name: str) -> DataFrame:
    """name: the sum of col up to a row; rows of one slot of the order are one block."""
    df = df.withColumn("_slot", slot_of(df, order))
    by = [*keys, "_slot"]
    ends = df.groupBy(*by).agg(F.sum(col).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    ends = ends.select(*by, F.sum("_sum").over(earlier).alias("_before"))
    here = F.sum(col).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    both = F.when(F.col(name).isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return null_safe(df.withColumn(name, here), ends, by).withColumn(name, both).drop("_slot", "_before")


def deepest_fall(df: DataFrame, col: str, keys: list[str], order: str, start: float) -> DataFrame:
    """By key, max_drawdown_pct: the largest fall from the running peak of start plus the running sum, in percent of
    the peak. A block's element: its sum and its highest partial sum."""
    df = df.withColumn("_slot", slot_of(df, order))
    by = [*keys, "_slot"]
    here = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_run", F.sum(col).over(here)).withColumn("_high", F.max("_run").over(here))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    ends = df.groupBy(*by).agg(F.sum(col).alias("_sum"), F.max("_run").alias("_top")).withColumn("_before", F.sum("_sum").over(earlier))
    ends = ends.select(*by, "_before", F.max(F.coalesce("_before", F.lit(0.0)) + F.col("_top")).over(earlier).alias("_peak"))
    j = null_safe(df, ends, by)
    run = F.when(F.col("_run").isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce("_run", F.lit(0.0)) + F.coalesce("_before", F.lit(0.0)))
    peak = start + F.greatest(F.lit(0.0), F.col("_peak"), F.coalesce("_before", F.lit(0.0)) + F.col("_high"))
    dip = F.when(peak > 0, (peak - (start + run)) / peak * 100).otherwise(100.0)
    return j.groupBy(*keys).agg(F.max(dip).alias("max_drawdown_pct"))


def compound(df: DataFrame, col: str, keys: list[str], order: str, rows: int | None = None) -> DataFrame:
    """By key: equity, the product of 1 + col / 100 in the order (rows of one place by their value), and dip_pct, its
    deepest fall below its peak in percent of the peak. A block's element: its product, and its highest and
    lowest partial products, as a product below zero turns them round."""
    df = numbered(df, "_pos", keys=tuple(keys), time=order, then=(col,)).withColumn("_block", F.floor(F.col("_pos") / (rows or chunks.ROWS)))
    lists = df.groupBy(*keys, "_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.col(col).cast("double").alias("r")))), lambda x: 1 + x["r"] / 100).alias("_f"))
    none = F.lit(None).cast("double")

    def fold(a, f):
        p = a["p"] * f
        return F.struct(p.alias("p"), F.greatest(a["high"], p).alias("high"), F.least(a["low"], p).alias("low"))

    one = F.aggregate("_f", F.struct(F.lit(1.0).alias("p"), none.alias("high"), none.alias("low")), fold)
    ends = lists.select(*keys, F.struct(F.col("_block"), one.alias("e")).alias("_e")).groupBy(*keys).agg(F.sort_array(F.collect_list("_e")).alias("_ends"))  # an element a block

    def step(a, x):
        own = F.struct(x["_block"].alias("block"), a["eq"].alias("eq"), a["top"].alias("top"))
        high = F.when(a["eq"] >= 0, a["eq"] * x["e"]["high"]).otherwise(a["eq"] * x["e"]["low"])
        return F.struct(F.concat(a["out"], F.array(own)).alias("out"), (a["eq"] * x["e"]["p"]).alias("eq"), F.greatest(a["top"], high).alias("top"))

    empty = F.array().cast("array<struct<block:bigint,eq:double,top:double>>")
    scan = ends.select(*keys, F.aggregate("_ends", F.struct(empty.alias("out"), F.lit(1.0).alias("eq"), none.alias("top")), step).alias("_s"))
    carry = scan.select(*keys, F.col("_s.eq").alias("_equity"), F.explode("_s.out").alias("_c")).select(*keys, "_equity", F.col("_c.block").alias("_block"), F.col("_c.eq").alias("_eq"), F.col("_c.top").alias("_top"))

    def again(a, f):
        eq = a["eq"] * f
        top = F.greatest(a["top"], eq)
        return F.struct(eq.alias("eq"), top.alias("top"), F.greatest(a["dip"], (top - eq) / F.greatest(top, F.lit(1e-12)) * 100).alias("dip"))

    dip = F.aggregate("_f", F.struct(F.col("_eq").alias("eq"), F.col("_top").alias("top"), F.lit(0.0).alias("dip")), again)["dip"]
    out = null_safe(lists, carry, [*keys, "_block"]).select(*keys, "_equity", dip.alias("_dip"))
    return out.groupBy(*keys).agg(F.first("_equity").alias("equity"), F.max("_dip").alias("dip_pct"))
