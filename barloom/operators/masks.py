"""Rule masks from a bitmap index of conditions.

A condition is evaluated once, whatever number of rules has it. Its rows are bitmaps, one for each
bucket of 32,768 rows. A rule's mask is the AND of its conditions' bitmaps; what a bucket holds no
bitmap of has no row. The rows that two rules share are counted from their bitmaps, bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as R  # noqa: N812

#: Rows of a bucket (fixed by the bitmap functions).
BUCKET = 32_768
#: The condition that every row meets: that of a rule without conditions.
EVERY = ""


def conditions_of(rules: dict[int, list[str]]) -> list[tuple[int, str]]:
    """(rule, condition) of texts: a rule's symbols are one condition; a rule without any has EVERY."""
    out = []
    for rule, texts in rules.items():
        features, symbols = R.split_conditions(texts)
        own = [*dict.fromkeys(features), *(["symbol IS " + ", ".join(sorted(symbols))] if symbols else [])]
        out += [(rule, c) for c in own or [EVERY]]
    return out


def rule_conditions(spark: SparkSession, rules: dict[int, list[str]]) -> DataFrame:
    """rule, condition as a table."""
    return spark.createDataFrame(conditions_of(rules), "rule long, condition string")


def index(df: DataFrame, row: str, conditions: dict[str, Column] | list[str]) -> DataFrame:
    """condition, bucket, bitmap. row: a number of the row, 0 or more. Conditions are columns by name, or texts."""
    if not isinstance(conditions, dict):
        conditions = {c: R.rule_mask([c] if c else [], df.columns) for c in dict.fromkeys(conditions)}
    met = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in conditions.items())))
    at = F.col("_row") + 1  # bitmaps begin at 1
    rows = df.select(F.col(row).cast("long").alias("_row"), F.explode(met).alias("condition"))
    return rows.groupBy("condition", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def masks(index_: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, bucket, bitmap of the rules (rule, condition). A condition that isn't in the index holds for no row."""
    rules = rules.select("rule", "condition").distinct()
    wanted = rules.groupBy("rule").agg(F.count("*").alias("_all"))
    met = rules.join(index_, "condition").groupBy("rule", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("_met"))
    return met.join(wanted, "rule").where("_met = _all AND bitmap_count(bitmap) > 0").select("rule", "bucket", "bitmap")


def sizes(masks_: DataFrame) -> DataFrame:
    """rule, n: how many rows a rule matches."""
    return masks_.groupBy("rule").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def _rows(batches: Iterable) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for rule, bucket, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rule, np.int64)), pa.array(at + (bucket - 1) * BUCKET)], ["rule", "row"])


def matched(masks_: DataFrame) -> DataFrame:
    """rule, row of the masks."""
    return masks_.select(F.col("rule").cast("long"), "bucket", "bitmap").mapInArrow(_rows, "rule long, row long")


class _Shared:
    """Rows that rules share, added up over buckets: one matrix of counts, whose side grows with the rules."""

    def __init__(self):
        import numpy as np

        self.place: dict[int, int] = {}
        self.counts = np.zeros((0, 0), np.int64)

    def add(self, rules: list[int], bits: list[bytes], step: int = 512) -> None:
        """One bucket: products of its bits, `step` bytes of every bitmap at a time."""
        import numpy as np

        at = np.array([self.place.setdefault(r, len(self.place)) for r in rules])
        if len(self.place) > len(self.counts):
            grown = np.zeros((2 * len(self.place), 2 * len(self.place)), np.int64)
            grown[: len(self.counts), : len(self.counts)] = self.counts
            self.counts = grown
        packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
        both = np.zeros((len(bits), len(bits)), np.float32)  # whole numbers up to 32,768
        for s in range(0, packed.shape[1], step):
            part = packed[:, s : s + step]
            if part.any():
                x = np.unpackbits(part, axis=1).astype(np.float32)
                both += x @ x.T
        self.counts[np.ix_(at, at)] += both.astype(np.int64)

    def batch(self):
        import numpy as np
        import pyarrow as pa

        names = np.array(list(self.place), np.int64)
        i, j = np.nonzero(self.counts[: len(names), : len(names)])
        low = names[i] <= names[j]
        i, j = i[low], j[low]
        return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), pa.array(self.counts[i, j])], ["a", "b", "n"])


def _shared(batches: Iterable) -> Iterator:
    """Rows come in order of the bucket."""
    shared, rules, bits, now = _Shared(), [], [], None
    for batch in batches:
        for bucket, rule, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and rules:
                shared.add(rules, bits)
                rules, bits = [], []
            now = bucket
            rules.append(rule)
            bits.append(bitmap)
    if rules:
        shared.add(rules, bits)
    yield shared.batch()


def overlap(masks_: DataFrame) -> DataFrame:
    """a, b, both, coefficient for rules a < b that share rows: those rows over the smaller rule's rows. A task holds one
    bucket's bitmaps and one matrix of pairs, which is what the result has."""
    dealt = masks_.select("bucket", F.col("rule").cast("long").alias("rule"), "bitmap").repartition("bucket").sortWithinPartitions("bucket")
    pairs = dealt.mapInArrow(_shared, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("both"))
    own = sizes(masks_)
    left, right = own.select(F.col("rule").alias("a"), F.col("n").alias("na")), own.select(F.col("rule").alias("b"), F.col("n").alias("nb"))
    return pairs.where("a < b").join(left, "a").join(right, "b").select("a", "b", "both", (F.col("both") / F.least("na", "nb")).alias("coefficient"))
