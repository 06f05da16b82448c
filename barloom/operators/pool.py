"""Pools and archives of candidate rules as tables: merging, caching, niches, diversity, seeds, scope.

A candidate has a genotype (an array of genes), figures, and whatever else its table carries.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.store import settled

from .quantiles import quantiles
from .search import hamming

#: Version of stored archives.
VERSION = 1


def best_of(df: DataFrame, by: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first `most` rows of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def merge_archive(parts: list[DataFrame], key: list[str], order: list[Column], most: int) -> DataFrame:
    """Entries of several pools: of those with one key the first in the order, and of all the first `most`."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return best_of(both, key, order).orderBy(*order).limit(most)


def load_archive(spark: SparkSession, folder: str, direction: str, features: list[tuple[str, str]]) -> DataFrame | None:
    """The entries of a stored archive; None where there is none, or one of another version, direction or signature
    (name and mode of the features, in order)."""
    from barloom.sources.runs import get_json

    about = get_json(spark, f"{folder}/archive_{direction}.json")
    wanted = {"version": VERSION, "direction": direction, "signature": [list(f) for f in features]}
    if not isinstance(about, dict) or {k: about.get(k) for k in wanted} != wanted or not about.get("entries"):
        return None
    return spark.read.parquet(f"{folder}/{about['entries']}")


def save_archive(spark: SparkSession, folder: str, direction: str, features: list[tuple[str, str]], entries: DataFrame, key: list[str], order: list[Column], most: int, **more) -> DataFrame:
    """Merge entries into the stored archive and read it back. The table is written beside the old one, and the small
    file that names it last, so a reader finds the old archive or the new one. An incompatible one is replaced;
    without any entry nothing is written."""
    from barloom.sources.runs import put_json

    if direction not in ("long", "short"):
        raise ValueError(f"direction must be long or short, not {direction!r}")
    old = load_archive(spark, folder, direction, features)
    merged = merge_archive([entries] if old is None else [old, entries], key, order, most)
    name = f"archive_{direction}_{uuid.uuid4().hex}"
    merged.write.parquet(f"{folder}/{name}")
    done = spark.read.schema(merged.schema).parquet(f"{folder}/{name}")
    if not done.isEmpty():
        put_json(spark, f"{folder}/archive_{direction}.json", {"version": VERSION, "direction": direction, "signature": [list(f) for f in features], "entries": name, **more})
    return done


def misses(candidates: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """One candidate of each key that has no figures yet: what a generation must evaluate."""
    return candidates.dropDuplicates(key).join(cache.select(*key), key, "left_anti")


def looked_up(candidates: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """All candidates with the figures that are known, and whether they are: column known."""
    return candidates.join(cache.withColumn("_known", F.lit(True)), key, "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def remember(cache: DataFrame, figures: DataFrame, key: list[str], age: str, most: int) -> DataFrame:
    """The cache with new figures (they win), bounded: of the keys the `most` of the greatest age column."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(figures.withColumn("_new", F.lit(1)))
    return best_of(both, key, [F.desc("_new"), F.desc(age)]).drop("_new").orderBy(F.desc(age), *key).limit(most)


def niches(df: DataFrame, by: dict[str, Column], order: list[Column], most: int) -> DataFrame:
    """The best candidates of each niche; a niche is a value of each of the columns in `by`, which are kept."""
    return best_of(df.withColumns(by), list(by), order, most)


def migrants(df: DataFrame, island: str, order: list[Column], most: int, islands: int) -> DataFrame:
    """The best of each island, with the island they go to: the next one of a ring of `islands`."""
    return best_of(df, [island], order, most).withColumn("target", F.pmod(F.col(island) + 1, F.lit(islands)))


def buckets(steps: dict[str, float]) -> list[Column]:
    """The phenotype of a candidate: its figures in steps, towards zero."""
    return [(F.col(c) / max(step, 1e-9)).cast("int") for c, step in steps.items()]


def crowded(df: DataFrame, steps: dict[str, float], weight: float) -> DataFrame:
    """bucket, n, penalty: the phenotypes and what each of its candidates but one pays."""
    return df.groupBy(F.array(*buckets(steps)).alias("bucket")).agg(F.count("*").alias("n")).withColumn("penalty", weight * (F.col("n") - 1))


def _segments(genes: Column, n: int, cuts: int) -> Column:
    """The genes in `cuts` pieces, each with its number."""
    edges = [k * n // cuts for k in range(cuts + 1)]
    return F.array(*(F.struct(F.lit(k).alias("k"), F.slice(genes, a + 1, b - a).alias("part")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def within(asked: DataFrame, known: DataFrame, n: int, d: int, same: bool = True) -> DataFrame:
    """g, nearest: the genotypes of asked (g) that differ from one of known (g) in at most d of n genes (and, unless `same`,
    in one at least), with the least difference. Of d + 1 pieces two such genotypes share one, so
    they meet by an equal piece and are compared in full."""
    cuts = min(d + 1, n)
    own = asked.select("g", F.explode(_segments(F.col("g"), n, cuts)).alias("s"))
    other = known.select(F.col("g").alias("h"), F.explode(_segments(F.col("g"), n, cuts)).alias("s"))
    far = hamming(F.col("g"), F.col("h"))
    met = own.join(other, "s").withColumn("far", far).where((F.col("far") <= d) & (F.lit(same) | (F.col("far") > 0)))
    return met.groupBy("g").agg(F.min("far").alias("nearest"))


def nearest_distance(df: DataFrame, genes: str, archive: DataFrame, n: int) -> DataFrame:
    """df and nearest: in how many of its n genes a genotype differs from the closest one of the archive (a table with a
    column g); null if the archive is empty. The allowed difference grows; what is found leaves. Distinct
    genotypes are compared, and those that differ in all genes need no partner."""
    known = settled(archive.select("g").distinct())
    left, found = settled(df.select(F.col(genes).alias("g")).distinct()), []
    some = not known.isEmpty()
    for d in range(n if some else 0):
        hits = settled(within(left, known, n, d))
        found.append(hits)
        left = settled(left.join(hits, "g", "left_anti"))
        if left.isEmpty():
            break
    found.append(left.select("g", F.lit(n if some else None).cast("int").alias("nearest")))
    return df.join(reduce(lambda a, b: a.union(b), found).withColumnRenamed("g", genes), genes)


def diversity_penalty(df: DataFrame, refs: DataFrame, n: int, d: int, steps: dict[str, float], weight: float) -> DataFrame:
    """df and penalty: weight for a candidate whose genotype (g) is within d genes of another reference, or
    whose phenotype is that of a reference with another genotype. Both have g and the columns of steps."""
    near = within(df.select("g").distinct(), refs.select("g").distinct(), n, d, same=False).select("g", F.lit(True).alias("_near"))
    place = F.array(*buckets(steps))
    least = refs.groupBy(place.alias("_bucket")).agg(F.min("g").alias("_least"), F.max("g").alias("_most"))
    both = df.withColumn("_bucket", place).join(near, "g", "left").join(least, "_bucket", "left")
    hit = F.coalesce("_near", F.lit(False)) | F.coalesce((F.col("_least") != F.col("g")) | (F.col("_most") != F.col("g")), F.lit(False))
    return both.withColumn("penalty", F.when(hit, float(weight)).otherwise(0.0)).drop("_bucket", "_near", "_least", "_most")


def sampling_weights(df: DataFrame, score: str, temperature: float = 1.0, uniform: float = 0.1, least: float | None = None) -> DataFrame:
    """df and weight: the softmax of the score at a temperature, mixed with equal shares. least: smallest score."""
    x = (F.col(score) if least is None else F.greatest(F.col(score), F.lit(float(least)))).cast("double") / temperature
    df = df.withColumn("_x", F.coalesce(x, F.lit(float(least or 0.0)) / temperature))
    top = df.agg(F.max("_x").alias("_top"), F.count("*").alias("_n"))  # one row each
    total = df.crossJoin(F.broadcast(top)).agg(F.sum(F.exp(F.col("_x") - F.col("_top"))).alias("_sum"), F.first("_top").alias("_top"), F.first("_n").alias("_n"))
    share = (1 - uniform) * F.exp(F.col("_x") - F.col("_top")) / F.col("_sum") + uniform / F.col("_n")
    return df.crossJoin(F.broadcast(total)).withColumn("weight", share).drop("_x", "_sum", "_top", "_n")


def compatible(pool: DataFrame, used: str, selected: DataFrame, feature: str = "feature") -> DataFrame:
    """The candidates all of whose used features (an array) are in the table of selected ones; one without any is."""
    own = pool.withColumn("_id", F.monotonically_increasing_id())
    own = settled(own)
    missing = own.select("_id", F.explode(used).alias(feature)).join(selected.select(feature).distinct(), feature, "left_anti").select("_id").distinct()
    return own.join(missing, "_id", "left_anti").drop("_id")


def seeds(pool: DataFrame, used: str, selected: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` compatible candidates."""
    return compatible(pool, used, selected).orderBy(*order).limit(most)


def symbol_scope(trades: DataFrame, rule: str, symbol: str, traded: Column) -> DataFrame:
    """rule, symbols (in order), traded: the symbols that a rule comes from and how many of its rows traded."""
    return trades.groupBy(rule).agg(F.array_sort(F.collect_set(F.col(symbol).cast("string"))).alias("symbols"), F.count_if(traded).alias("traded"))


def scoped(rules: DataFrame, scope: DataFrame, rule: str, conditions: str = "conditions", most: int = 10) -> DataFrame:
    """The rules with their scope as a condition, 'symbol is A, B'; beyond `most` symbols a rule stays as it is."""
    names = F.when((F.size("symbols") > 0) & (F.size("symbols") <= most), F.concat(F.lit("symbol is "), F.array_join("symbols", ", ")))
    return rules.join(scope.select(rule, "symbols"), rule, "left").withColumn(conditions, F.array_compact(F.concat(F.col(conditions), F.array(names)))).drop("symbols")


def diagnostics(df: DataFrame, score: str, front: str = "front", sample: int = 40) -> dict:
    """Figures of a population (genotypes g, a front from 1, a score): n, unique_ratio, rank0_fraction, rank1_fraction,
    max_rank, median_score (exact), and the median difference of pairs among `sample` distinct genotypes of
    the first front, those of the smallest hashes."""
    one = df.agg(
        F.count("*").alias("n"), F.countDistinct("g").alias("unique"), F.avg((F.col(front) == 1).cast("double")).alias("rank0_fraction"),
        F.avg((F.col(front) == 2).cast("double")).alias("rank1_fraction"), F.max(F.col(front) - 1).alias("max_rank")).first()
    some = [r["g"] for r in df.where(F.col(front) == 1).select("g").distinct().orderBy(F.xxhash64("g"), "g").limit(sample).collect()]
    apart = sorted(sum(x != y for x, y in zip(a, b, strict=True)) for a, b in combinations(some, 2))
    middle = (apart[(len(apart) - 1) // 2] + apart[len(apart) // 2]) / 2 if apart else 0.0
    return {
        "n": one["n"], "unique_ratio": one["unique"] / one["n"] if one["n"] else 0.0, "rank0_fraction": one["rank0_fraction"] or 0.0, "rank1_fraction": one["rank1_fraction"] or 0.0,
        "max_rank": one["max_rank"] or 0, "median_score": quantiles(df, {"x": (F.col(score), 0.5)})["x"], "median_pairwise_hamming": float(middle),
    }
