"""Order within a symbol without a task that holds a symbol.

numbered() gives each row its place: rows are counted by slots of time, the counts are summed over
the slots, and a row's place within its slot is added. framed() cuts a symbol into chunks of equally
many rows and gives each chunk copies of the rows before and after it that its frames reach (its
halo); what is computed for copies is dropped. carried() hands the last value on from slot to slot.
Windows by symbol alone run over one row a slot only, never over one row a bar.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

#: Rows of a chunk without its halo.
ROWS = 4096
#: Seconds of a slot of time.
SPAN = 30 * 86400


def slot_of(df: DataFrame, time: str, span: int | None = None) -> Column:
    """The slot of a time, of a struct's first field, or of a number (ROWS of it); rows without one come first."""
    kind, col = df.schema[time].dataType, F.col(time)
    if isinstance(kind, StructType):
        kind, col = kind.fields[0].dataType, col[kind.fields[0].name]
    slot = F.floor(col / (span or ROWS)) if isinstance(kind, NumericType) else F.floor(F.unix_timestamp(col) / (span or SPAN))
    return F.coalesce(slot, F.lit(-(1 << 62)))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the keys of the left side stay."""
    right = right.withColumnsRenamed({k: f"_right{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"_right{k}"]) for k in keys))
    return left.join(right, on, how).drop(*(f"_right{k}" for k in keys))


def numbered(df: DataFrame, name: str, total: str | None = None, keys: tuple[str, ...] = ("symbol",), time: str = "datetime", span: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """name: the place of a row from 0 in order of time (then of other columns) by key; total: the rows of the key."""
    df = df.withColumn("_slot", slot_of(df, time, span))
    by = [*keys, "_slot"]
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot")) - F.col("_n")  # a row a slot
    own = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    counts = counts.select(*by, before.alias("_before"), *own)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(time, *then)) - 1
    return null_safe(df.withColumn(name, place), counts, by).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_slot", "_before")


def strips(df: DataFrame, order: list[str], name: str, rows: int = 1 << 16) -> DataFrame:
    """df, stored, with the number of its strip: strips hold about `rows` rows each and follow one another in the order, in
    which rows that are equal are in one strip. The cuts are those of Spark's range partitioning. df is read once."""
    from barloom.sources.store import settled

    df = settled(df)
    pieces = -(-df.count() // rows) or 1
    return settled(df.repartitionByRange(pieces, *order).withColumn(name, F.spark_partition_id()))


def chunked(df: DataFrame, before: int, after: int, rows: int | None = None, place: str | None = None) -> DataFrame:
    """df with _pos, _chunk and _core: a row once for each chunk whose frames reach it, that is its
    own (_core) and those that begin within `before` rows after it or end within `after` before it."""
    rows = rows or ROWS
    df = df.withColumn("_pos", F.col(place)) if place else numbered(df, "_pos")
    at = lambda shift: F.floor((F.col("_pos") + shift) / rows)
    reached = F.sequence(F.greatest(F.lit(0), at(-after)), at(before))
    return df.withColumn("_chunk", F.explode(reached)).withColumn("_core", F.col("_chunk") == at(0))


def framed(df: DataFrame, before: int, after: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], rows: int | None = None, place: str | None = None) -> DataFrame:
    """compute(df, window), where the window has a chunk of a symbol in order of time: right for
    frames of at most `before` rows before and `after` rows after a row. place: a column with
    numbered()'s places, if df has it."""
    out = compute(chunked(df, before, after, rows, place), Window.partitionBy("symbol", "_chunk").orderBy("_pos"))
    return out.where("_core").drop("_pos", "_chunk", "_core")


def carried(df: DataFrame, name: str, order: list[str], time: str, key: str = "symbol", span: int | None = None) -> DataFrame:
    """name filled with the last value before or at a row in the order, whose first column is the time."""
    df = df.withColumn("_slot", slot_of(df, time, span))
    by = [key, "_slot"]
    rank = F.struct(*order)
    ends = df.groupBy(*by).agg(F.max_by(name, F.when(F.col(name).isNotNull(), rank)).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    ends = ends.select(*by, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    here = F.last(name, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return null_safe(df.withColumn(name, here), ends, by).withColumn(name, F.coalesce(name, "_carry")).drop("_slot", "_carry")


def shifted(df: DataFrame, name: str, col: str, by: int, place: str | None = None) -> DataFrame:
    """name: col of the row `by` rows after (or before, if negative) in its symbol."""
    return framed(df, max(0, -by), max(0, by), lambda d, w: d.withColumn(name, F.lead(col, by).over(w) if by > 0 else F.lag(col, -by).over(w)), place=place)


def time_codes(df: DataFrame, time: str, name: str, row: str) -> DataFrame:
    """df and name: dense codes of the times from 0 in their order, equal for equal times; a row without a time has a code
    of its own after all others, in order of `row`, a column that tells rows apart."""
    times = numbered(df.where(F.col(time).isNotNull()).select(time).distinct(), name, total="_times", keys=(), time=time)
    count = df.agg(F.countDistinct(time).alias("_times"))  # one row
    lost = numbered(df.where(F.col(time).isNull()).select(row), "_lost", keys=(), time=row)
    out = null_safe(df.join(times.drop("_times"), time, "left"), lost, [row], "left").crossJoin(F.broadcast(count))
    return out.withColumn(name, F.coalesce(F.col(name), F.col("_times") + F.col("_lost"))).select(*df.columns, name)
