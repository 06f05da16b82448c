"""Prepared tapes: the whole way from a file or raw table to rows for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import indicators as I  # noqa: E741, N812
from barloom.operators import labels as L  # noqa: N812
from barloom.operators.chunks import shifted

from .tape import csv_columns, same_place, with_bar_index, write_csv

PRICES = ("open", "high", "low", "close", "volume")
LABELS = ("label_open_next", "label_close_h", "label_min_h", "label_max_h", "label_max_first")
META = ("datetime", "symbol")
CONTEXT = (*I.STATES, *I.FLAGS)
#: Columns of the package's own: a bar's place, and outcomes (these start with _).
INTERNAL = ("bar", "row_id")


def feature_columns(df: DataFrame, raw_prices: bool = False) -> list[str]:
    """Columns that may be features: no labels, keys, context, internal ones or raw prices."""
    out = {*LABELS, *META, *CONTEXT, *INTERNAL, *(() if raw_prices else PRICES)}
    return [c for c in df.columns if c not in out and not c.startswith("_")]


def slim(df: DataFrame, features: list[str]) -> DataFrame:
    """Keys, labels, internal and context columns that are there, and the named features."""
    keep = [*META, *LABELS, *INTERNAL, *(c for c in df.columns if c.startswith("_")), *CONTEXT, *features]
    return df.select(*[c for c in dict.fromkeys(keep) if c in df.columns])


def downcast(df: DataFrame) -> DataFrame:
    """Smaller types for storage: floats for doubles other than prices, labels and outcomes, shorts
    for the flags and states. What is computed with stays as it is."""
    kinds = {}
    for c, t in df.dtypes:
        if c in CONTEXT:
            kinds[c] = "byte"
        elif t == "double" and c not in (*PRICES, *LABELS) and not c.startswith("_"):
            kinds[c] = "float"
    return df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}) if kinds else df


def ensure_labels(df: DataFrame, horizon: int) -> DataFrame:
    """The supplied labels if all are there, derived ones if none is. Raises if some are, or if
    they can't be derived, or a key has two rows."""
    there = [c for c in LABELS if c in df.columns]
    if len(there) == len(LABELS):
        return df
    if there:
        raise ValueError(f"only some labels are there: {there}")
    missing = [c for c in PRICES if c not in df.columns]
    if missing:
        raise ValueError(f"labels can't be derived without {missing}")
    if not df.groupBy(*META).count().where("count > 1").isEmpty():
        raise ValueError("a key has two rows")
    own = "bar" in df.columns
    out = L.add_labels(df if own else with_bar_index(df), horizon)
    return out if own else out.drop("bar")


def prepare(df: DataFrame, horizon: int, *, features: list[str] | None = None, tail: bool = True, barriers: tuple[list[float], list[float]] | None = None, context: bool | None = None, lookback: int = 24) -> DataFrame:
    """Rows for scoring: labels kept or derived, the context checked if it is there (or required),
    outcomes of barriers attached on request before the tail is cut, the last `horizon` rows of
    each symbol dropped, rows without labels dropped, missing features 0, and the bar index."""
    df = ensure_labels(df.drop("bar"), horizon)
    has_context = any(c in df.columns for c in CONTEXT)
    if context or (context is None and has_context):
        I.check_context(df, lookback)
    if barriers is not None and set(PRICES) <= set(df.columns):
        df = L.attach_barriers(with_bar_index(df), horizon, *barriers).drop("bar")
    if tail:
        df = L.drop_tail(df, horizon)
    df = df.na.drop(subset=list(LABELS))
    names = [c for c in (feature_columns(df) if features is None else features) if c in df.columns]
    numeric = [c for c, t in df.dtypes if c in names and t not in ("string", "boolean", "timestamp", "date")]
    return with_bar_index(df.na.fill(0, numeric) if numeric else df)


def tape_schema(names: list[str]) -> T.StructType:
    """The types of a tape's columns by their names, whatever the data are like."""
    known = {"datetime": T.TimestampType(), "symbol": T.StringType(), "bar": T.LongType(), "row_id": T.LongType(), "label_max_first": T.IntegerType(), **dict.fromkeys(CONTEXT, T.IntegerType())}
    return T.StructType([T.StructField(n, known.get(n, T.IntegerType() if n.startswith("_off_") else T.DoubleType())) for n in names])


def load(spark: SparkSession, path: str, horizon: int, schema=None, **how) -> DataFrame:
    """prepare() of a CSV or Parquet tape. A CSV file is read once: without a schema its header gives the columns,
    which are numbers but for those that tape_schema() knows otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).schema(schema or tape_schema(csv_columns(spark, path))).csv(path)
    return prepare(raw.withColumn("datetime", F.col("datetime").cast("timestamp")).withColumn("symbol", F.col("symbol").cast("string")), horizon, **how)


def grid_faults(df: DataFrame, step_minutes: int = 15) -> DataFrame:
    """By symbol: rows, missing times, repeated keys, gaps other than the step, and rows off the
    grid of the step, to the microsecond."""
    step = step_minutes * 60 * 1_000_000
    df = shifted(df, "_gap", "datetime", -1).withColumn("_gap", F.unix_micros("datetime") - F.unix_micros("_gap"))
    return df.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("datetime").isNull()).alias("n_null_ts"), (F.count("datetime") - F.countDistinct("datetime")).alias("n_duplicates"),
        F.count_if((F.col("_gap") != step) & (F.col("_gap") != 0)).alias("n_gaps"), F.count_if(F.unix_micros("datetime") % step != 0).alias("n_off_grid"))


def for_evaluation(reference: DataFrame, tape: DataFrame, modes: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """The tape in the reference's columns, prepared, and the modes of the features, which come
    from the training side alone."""
    missing = [c for c in reference.columns if c not in tape.columns and c not in LABELS]
    if missing:
        raise ValueError(f"the tape lacks {missing}")
    rows = prepare(tape.select(*[c for c in reference.columns if c in tape.columns]), horizon)
    return rows, modes.where(F.col("feature").isin(feature_columns(rows)))


def forward_symbols(test: DataFrame, forward: DataFrame) -> DataFrame:
    """One row: whether both tapes have the same symbols, and whether the forward one begins
    after the other ends."""
    a, b = test.select("symbol").distinct(), forward.select("symbol").distinct()
    one = lambda df, name: df.agg((F.count("*") == 0).alias(name))
    end, begin = test.agg(F.max("datetime").alias("end")), forward.agg(F.min("datetime").alias("begin"))
    return one(a.subtract(b).union(b.subtract(a)), "same_symbols").crossJoin(end.crossJoin(begin).select((F.col("begin") > F.col("end")).alias("later")))  # one row each


def write_enriched(spark: SparkSession, source: str, out: str, *, lookback: int, mid: tuple[str, int], high: tuple[str, int], base_step: str, thresholds: dict[str, DataFrame], history: DataFrame | None = None) -> DataFrame:
    """Enrich the CSV tape at source with thresholds that are given (never fitted here), warmed up by history, and write
    it to another place; what was written, read back."""
    if same_place(spark, source, out):
        raise ValueError("an enriched tape never overwrites its source")
    names = csv_columns(spark, source)
    raw = spark.read.option("header", True).schema(tape_schema(names)).csv(source)
    done = I.enrich_target(raw, history, lookback, mid, high, base_step, thresholds).select(*names, *CONTEXT)
    write_csv(done, out, source)
    return spark.read.option("header", True).schema(tape_schema([*names, *CONTEXT])).csv(out)
