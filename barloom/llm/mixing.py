"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source's repetition rate is its target share of the output over its share of the input. Each
document's count of copies inverts the Poisson distribution of that mean at a point hashed
from seed and document, so a rerun gives the same counts. A mean above PART is a sum of equal
parts, each inverted at a point of its own. Copies get a hashed key, are dealt by it and sorted
by it: a global shuffle.

Defined results: a null text has size 0 and is mixed like any other; null sources form one
source; null ids are hashed by their text; equal ids get equal counts; a source whose sizes
are all 0, or without a target, has rate 0; other columns pass through; where one is called
`mix` the result is `_mix` (free_name); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, fresh, materialise, table, text_of

#: Largest mean of one inverted part; exp(-PART) is far from underflow.
PART = 32.0


def unit(*parts: Column) -> Column:
    """A point in (0, 1) hashed from the parts."""
    hexed = F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, source_col: str, size: Column, *, targets: dict[str | None, float] | None, alpha: float, epochs: float) -> DataFrame:
    """source, rate, parts, cdf: one row for each source. targets: weight of each source; by
    default its size to the power alpha."""
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if targets is None:
        weight = F.when(F.col("size") > 0, F.pow("size", F.lit(float(alpha)))).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for k, v in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
        weight = F.when(F.col("size") > 0, weight).otherwise(0.0)
    sums = sums.withColumn("weight", weight)
    totals = sums.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    df = sums.join(F.broadcast(totals))  # one row: an ungrouped aggregate
    df = df.withColumn("rate", F.coalesce(F.try_divide(F.col("weight") * epochs * F.col("all_size"), F.col("all_weight") * F.col("size")), F.lit(0.0)))
    df = df.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    last = (F.ceil(mean + 12 * F.sqrt(mean)) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("f"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda a, k: F.struct((a.p * mean / k).alias("p"), (a.f + a.p * mean / k).alias("f"), F.concat(a.cdf, F.array(a.f + a.p * mean / k)).alias("cdf"))
    return df.select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a.cdf).alias("cdf"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    targets: dict[str | None, float] | None = None,
    alpha: float = 0.7,
    epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """The columns of docs and a struct column `mix`: copy (from 0), n_copies, key. Sizes are
    characters. The rates are a written table, so the planner broadcasts them only if they are
    small; a larger table is joined by a shuffle whose frequent keys adaptive execution splits."""
    size, name = F.length(text_of(text_col)), free_name(docs, "mix")
    table_ = materialise(rates(docs, source_col, size, targets=targets, alpha=alpha, epochs=epochs), "mix-rates")
    who, src, cdf, parts, rate, n, copy = fresh(docs, "who", "source", "cdf", "parts", "rate", "n", "copy")
    df = docs.join(table_.select(F.col("source").alias(src), F.col("cdf").alias(cdf), F.col("parts").alias(parts)), F.col(source_col).eqNullSafe(F.col(src)), "left")
    df = df.withColumn(who, F.coalesce(F.col(id_col).cast("string"), F.md5(text_of(text_col))))
    points = F.transform(F.sequence(F.lit(1), F.coalesce(F.col(parts), F.lit(1))), lambda j: unit(F.lit(seed), F.col(who), j))
    count = F.aggregate(points, F.lit(0), lambda a, u: a + F.size(F.filter(F.col(cdf), lambda c: c < u)))
    df = df.withColumn(n, F.greatest(count, F.lit(0)))
    df = df.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.col(who), F.col(copy).cast("string"))), 1, 15), 16, 10).cast("long")
    out = df.select(*docs.columns, F.struct(F.col(copy).cast("long").alias("copy"), F.col(n).cast("long").alias("n_copies"), key.alias("key")).alias(name))
    return out.repartition(F.col(f"{name}.key")).sortWithinPartitions(f"{name}.key")


def op2_query(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return m.select("doc_id", "source", "text", "mix.copy", "mix.n_copies", F.col("mix.key").alias("mix_key"))


ORACLE = """
WITH d AS (SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS who FROM documents),
s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM d GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0 END AS weight FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN weight * (SELECT sum(size) FROM w) / ((SELECT sum(weight) FROM w) * size) ELSE 0 END AS rate FROM w),
p AS (SELECT source, rate, greatest(CAST(ceil(rate / 32.0) AS INTEGER), 1) AS parts FROM r),
k AS (SELECT source, rate / parts AS mean, parts, unnest(range(0, CAST(ceil(rate / parts + 12 * sqrt(rate / parts)) AS INTEGER) + 25)) AS k FROM p),
c AS (SELECT source, parts, list(f ORDER BY k) AS cdf FROM (
  SELECT source, parts, k, sum(CASE WHEN mean > 0 THEN exp(-mean + k * ln(mean) - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS f FROM k) GROUP BY source, parts),
n AS (SELECT d.doc_id, d.source, d.text, d.who, list_sum(list_transform(range(1, c.parts + 1), lambda j:
    len(list_filter(c.cdf, lambda x: x < (CAST(('0x' || substr(md5('17|' || d.who || '|' || j), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)))) AS n
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
x AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM n WHERE n > 0)
SELECT doc_id, source, text, copy, CAST(n AS BIGINT) AS n_copies,
       CAST(('0x' || substr(md5('17-order|' || who || '|' || copy), 1, 15)) AS BIGINT) AS mix_key
FROM x
"""


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents repeated and shuffled; columns unchanged."""
    return mix(docs).drop(free_name(docs, "mix"))
