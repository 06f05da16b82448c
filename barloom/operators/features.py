"""Feature tables: modes, scaling, dispersion, relevance, stability, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import null_safe
from .rules import labels_of


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in features]
    return df.select(*keep, *cols).unpivot(keep, features, "feature", "x")


def modes(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mode: by values, sign and the share of zeros (nulls are zeros)."""
    x = F.coalesce(F.col("x"), F.lit(0.0))
    a = long_form(df, features, []).groupBy("feature").agg(
        F.bool_and(x.isin(0.0, 1.0)).alias("two"), F.bool_and(x.isin(-1.0, 0.0, 1.0)).alias("three"), F.min("x").alias("low"), F.avg((x == 0).cast("double")).alias("zeros"))
    mode = F.when(F.col("two"), "binary").when(F.col("three"), "ternary").when((F.col("low") < 0) & (F.col("zeros") > 0.3), "sparse_signed").when(F.col("low") < 0, "signed").when(F.col("zeros") > 0.3, "sparse_positive").otherwise("positive")
    return a.select("feature", mode.alias("mode"), F.col("zeros").alias("zero_ratio"))


def ordinal_scales(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, scale: whole numbers in 0..4, -2..2 or -5..5 are ordinal codes; else null."""
    a = long_form(df, features, []).groupBy("feature").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.bool_and(F.col("x") == F.rint("x")).alias("whole"))
    wide = F.col("whole") & ((F.col("b") > 1) | (F.col("a") < -1))
    scale = F.when(wide & (F.col("a") >= 0) & (F.col("b") <= 4), 4.0).when(wide & (F.col("a") >= -2) & (F.col("b") <= 2), 2.0).when(wide & (F.col("a") >= -5) & (F.col("b") <= 5), 5.0)
    return a.select("feature", scale.alias("scale"))


def scaled(col, scale: float):
    return F.greatest(F.least(col / scale, F.lit(1.0)), F.lit(-1.0))


def dispersion(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, modal_share: the share of the most frequent value."""
    counts = long_form(df, features, []).groupBy("feature", "x").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("modal_share"))


def mutual_information(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Plug-in estimate in nats over joint counts of two discrete columns."""
    joint = df.groupBy(*keys, a, b).agg(F.count("*").cast("double").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    j = joint.withColumns({"na": by(a), "nb": by(b), "nn": by()})
    return j.groupBy(*keys).agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("na") * F.col("nb")))).alias("mi"))


def stability(scores: DataFrame) -> DataFrame:
    """feature, score: mean relevance over symbols, less for spread. scores: feature, symbol, mi."""
    a = scores.groupBy("feature").agg(F.avg("mi").alias("m"), F.stddev_pop("mi").alias("s"))
    return a.select("feature", (F.greatest(F.least(1 - F.try_divide("s", F.nullif("m", F.lit(0.0))), F.lit(1.0)), F.lit(0.0)) * F.col("m")).alias("score"))


def stationary(scores: DataFrame, cv_max: float, drift_max: int) -> DataFrame:
    """Features whose fold scores vary and change rank little. scores: feature, fold, mi."""
    r = scores.withColumn("rk", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("mi"), "feature")))
    a = r.groupBy("feature").agg(F.try_divide(F.stddev_pop("mi"), F.avg("mi")).alias("cv"), (F.max("rk") - F.min("rk")).alias("drift"))
    return a.where((F.col("cv") <= cv_max) & (F.col("drift") <= drift_max))


def sign_consistent(rhos: DataFrame, least: float = 0.03, min_folds: int = 1, valid: DataFrame | None = None) -> DataFrame:
    """Features without significant fold correlations of both signs, up and down being their
    numbers. rhos: feature, fold, rho. valid (feature, rho): a significant validation correlation
    against the sign of the folds drops the feature, too."""
    a = rhos.groupBy("feature").agg(F.count("rho").alias("n"), F.count_if(F.col("rho") >= least).alias("up"), F.count_if(F.col("rho") <= -least).alias("down"))
    a = a.where((F.col("n") >= min_folds) & ((F.col("up") == 0) | (F.col("down") == 0))).drop("n")
    if valid is None:
        return a
    v = valid.select("feature", F.col("rho").alias("_v"))
    flips = ((F.col("up") > 0) & (F.col("_v") < -least)) | ((F.col("down") > 0) & (F.col("_v") > least))
    return a.join(v, "feature", "left").where(~F.coalesce(flips, F.lit(False))).drop("_v")


def discrete_features(modes_: dict[str, str]) -> dict[str, bool]:
    """Whether relevance takes a feature's values as classes: two and three values only."""
    return {f: m in ("binary", "ternary") for f, m in modes_.items()}


def neighbour_information(df: DataFrame, x: str, y: str, keys: list[str], k: int = 3) -> DataFrame:
    """Mutual information in nats of a continuous x and classes y, by the k nearest neighbours
    within a class (Ross 2014). Distances along one axis come from the sorted neighbours, and the
    points within a distance from a running count, so each is a window over sorted rows. Classes
    of one point are left out; no noise is added, so points of equal x are at distance 0."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"))
    n_y = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_y"))
    df = df.withColumn("_ny", n_y).where("_ny > 1").withColumn("_id", F.monotonically_increasing_id())
    own = Window.partitionBy(*keys, "_y").orderBy("_x", "_id")
    kk = F.least(F.lit(k), F.col("_ny") - 1)
    gaps = []
    for j in range(k + 1):  # j neighbours below, kk - j above
        for m in range(1, k + 1):
            if j <= m:
                below = F.col("_x") - F.lag("_x", j).over(own) if j else F.lit(0.0)
                above = F.lead("_x", m - j).over(own) - F.col("_x") if m > j else F.lit(0.0)
                gaps.append(F.when((kk == m) & below.isNotNull() & above.isNotNull(), F.greatest(below, above)))
    df = df.withColumns({"_r": F.least(*gaps), "_k": kk})
    points = df.select(*keys, F.col("_x").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_id"), F.lit(1).alias("_one"))
    # Strictly nearer than r, or at the point itself: from x - r (exclusive) to x + r (exclusive).
    low = df.select(*keys, (F.col("_x") - F.col("_r")).alias("_t"), F.when(F.col("_r") > 0, 2).otherwise(0).alias("_kind"), "_id", F.lit(0).alias("_one"))
    high = df.select(*keys, (F.col("_x") + F.col("_r")).alias("_t"), F.when(F.col("_r") > 0, 0).otherwise(2).alias("_kind"), "_id", F.lit(0).alias("_one"))
    run = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda side: points.unionByName(side).withColumn("_c", F.sum("_one").over(run)).where("_id IS NOT NULL").select(*keys, "_id", "_c")
    m = count(high).withColumnRenamed("_c", "_hi").join(count(low).withColumnRenamed("_c", "_lo"), [*keys, "_id"]).select(*keys, "_id", F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)).alias("_m"))
    psi = lambda c: digamma(F.col(c).cast("double"))
    rows = df.join(m, [*keys, "_id"]).withColumn("_psi", psi("_k") - psi("_ny") - psi("_m"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_psi").alias("_mean"))
    return out.select(*keys, F.greatest(psi("_n") + F.col("_mean"), F.lit(0.0)).alias("mi"))


def digamma(x):
    """The digamma function of a positive number, by recurrence to 6 and the asymptotic series."""
    steps = F.greatest(F.lit(0), F.ceil(6 - x)).cast("int")
    low = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0.0), lambda a, i: a + F.when(i < steps, 1 / (x + i)).otherwise(0.0))
    z = x + steps
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, F.lit(4))) - 1 / (252 * F.pow(z, F.lit(6))) + 1 / (240 * F.pow(z, F.lit(8))) - low


def shuffled(df: DataFrame, col: str, keys: list[str], order: list[str], seed: int) -> DataFrame:
    """df with the values of col dealt anew among the rows of each group, by a hash of seed and
    row: the null model of a feature."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*keys, *order]))
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_from": F.row_number().over(w.orderBy(F.md5(text))), "_to": F.row_number().over(w.orderBy(*order))})
    moved = rows.select(*keys, F.col("_from").alias("_to"), F.col(col).alias("_moved"))
    return rows.drop("_from", col).join(moved, [*keys, "_to"]).drop("_to").withColumnRenamed("_moved", col)


def greedy_uncorrelated(names: list[str], corr: dict[tuple[str, str], float], most: float = 0.95) -> list[str]:
    """Keep a name if no kept one correlates above `most`. Names are in order of score."""
    kept: list[str] = []
    for a in names:
        if all(abs(corr.get((a, b), corr.get((b, a), 0.0)) or 0.0) <= most for b in kept):
            kept.append(a)
    return kept


def capped_overlap(long: dict[str, float], short: dict[str, float], k: int, share: float = 0.8) -> tuple[list[str], list[str]]:
    """Top k of both directions; shared names beyond the share leave the side where they score
    less, the smallest gap first, and the next names fill in."""
    rank = lambda d: sorted(d, key=lambda n: (-d[n], n))
    a, b = rank(long)[:k], rank(short)[:k]
    both = sorted(set(a) & set(b), key=lambda n: (abs(long[n] - short[n]), n))
    for n in both[: max(0, len(both) - int(share * k))]:
        side, scores, other = (a, long, b) if long[n] < short[n] else (b, short, a)
        side.remove(n)
        spare = [x for x in rank(scores) if x not in side and x not in other and x != n]
        side += spare[:1]
    return a, b


def balanced_clusters(profile: DataFrame, features: list[str], k: int, seed: int = 7) -> dict[str, int]:
    """Symbols to k clusters of near equal size: k-means centres, then nearest free place. One
    row a symbol."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    stats = profile.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    z = profile.select("symbol", *((F.col(f) - stats[f"m_{f}"]).alias(f) if not stats[f"s_{f}"] else ((F.col(f) - stats[f"m_{f}"]) / stats[f"s_{f}"]).alias(f) for f in features))
    v = VectorAssembler(inputCols=features, outputCol="v").transform(z)
    centres = KMeans(k=k, seed=seed, featuresCol="v").fit(v).clusterCenters()
    rows = [(r["symbol"], [r[f] for f in features]) for r in z.orderBy("symbol").collect()]
    room = -(-len(rows) // len(centres))
    near = sorted((sum((x - c) ** 2 for x, c in zip(p, centre, strict=True)), s, i) for s, p in rows for i, centre in enumerate(centres))
    out: dict[str, int] = {}
    used = [0] * len(centres)
    for _, s, i in near:
        if s not in out and used[i] < room:
            out[s], used[i] = i, used[i] + 1
    return out


def univariate_pool(df: DataFrame, modes_: dict[str, str], target: str, keys: list[str], min_rows: int) -> DataFrame:
    """keys, feature, label, condition, n, mean, lift: every rule of one condition with at least min_rows rows, the mean of
    the target on them, and by how much it is above that of all rows of its keys. One pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), labels_of(F.col(f), m).alias("label")) for f, m in modes_.items()))
    every = df.groupBy(*keys).agg(F.avg(target).alias("_all"))
    own = df.select(*keys, target, F.explode(pairs).alias("p")).where("p.label IS NOT NULL").groupBy(*keys, F.col("p.feature").alias("feature"), F.col("p.label").alias("label")).agg(F.count(target).alias("n"), F.avg(target).alias("mean"))
    own = own.where(F.col("n") >= min_rows)
    both = null_safe(own, every, keys) if keys else own.crossJoin(F.broadcast(every))  # one row
    condition = F.concat(F.lit("["), "feature", F.lit("] IS "), "label")
    return both.select(*keys, "feature", "label", condition.alias("condition"), "n", "mean", (F.col("mean") - F.col("_all")).alias("lift"))


def feature_masks(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, present: whether a feature has any value that varies for a key (a symbol); scores of others are zero there."""
    long = long_form(df, features, keys)
    return long.groupBy(*keys, "feature").agg((F.min("x") < F.max("x")).alias("present")).withColumn("present", F.coalesce("present", F.lit(False)))


def align(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The kept columns and the features in order; one that isn't there is missing in every row."""
    return df.select(*keep, *((F.col(f) if f in df.columns else F.lit(None)).cast("double").alias(f) for f in features))
