"""Clustering of vectors by centroids in whole numbers, with block-norm screening.

A vector's components become integers floor(scale * x), once. It is cut into segments, and of each
segment two integers are kept: the sum s, and the root r (rounded down) of what the sum doesn't
explain, m * sum(v^2) - s^2 for m components. These are the compressed vector. By Cauchy and Schwarz

    m * |v - c|^2  >=  sum over segments of (s_v - s_c)^2 + max(0, |r_v - r_c| - 1)^2

where the 1 is for the rounding. In a round each vector first gets its exact distance to the centroid
of the least bound; only centroids whose bound isn't beyond the best distance so far get an exact one.
So the bound decides speed, not results: ties and values are those of all exact distances.

The compressed vectors are written once. A round is one scan with partial sums by task, of which
k rows are gathered; k and the number of components are parameters, so this is bounded. Distances
and bounds fit 64 bits because components beyond largest() in size (65,536 at scale 1024 and 64
components) raise an error.

Defined results: a vector that is null, has another number of components, or one that is null or not
finite, is left out and gets no row; equal vectors and repeated ids are separate rows; fewer
vectors than k start as many centroids; null ids are hashed as empty texts; equal hashes are in order of
their components; an empty centroid stays; an empty table gives an empty result. Columns to carry
keep their names, results whose names they have get underscores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, free_name, materialise, ship, table

SEGMENT = 8


def largest(dims: int) -> int:
    """Sizes of components below this give squared distances of which SEGMENT are below 2^63."""
    return isqrt((1 << 63) // (SEGMENT * dims)) // 2


def whole(col: str | Column, dims: int, scale: int) -> Column:
    """The integers of a vector; null where it is left out."""
    v = F.col(col) if isinstance(col, str) else col
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: F.when(F.abs(x) < float(largest(dims)), F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large for whole distances")).cast("long"))
    return F.when(good, F.transform(v, lambda x: fits(x.cast("double") * scale)))


def compressed(v):
    """Sums and roots of the segments: (rows, segments) each. v: (rows, components) integers."""
    import numpy as np

    parts = v.reshape(len(v), -1, min(SEGMENT, v.shape[1]))
    s = parts.sum(axis=2)
    rest = parts.shape[2] * np.square(parts).sum(axis=2) - s * s
    root = np.sqrt(rest.astype(np.float64)).astype(np.int64)
    root -= root * root > rest  # a float root may be off by one
    root += (root + 1) * (root + 1) <= rest
    return s, root


def bounds(v, c):
    """Lower bounds of m * squared distance, (rows, centroids), from the compressed forms."""
    import numpy as np

    out = np.zeros((len(v[0]), len(c[0])), np.int64)
    for b in range(v[0].shape[1]):
        out += np.square(v[0][:, b, None] - c[0][None, :, b])
        out += np.square(np.maximum(np.abs(v[1][:, b, None] - c[1][None, :, b]) - 1, 0))
    return out


def nearest(v, packed, centroids):
    """(cluster, squared distance, exact distances that were needed) of each row. Ties: the smaller number."""
    import numpy as np

    c = np.array(centroids, np.int64)
    low = bounds(packed, compressed(c))
    m = min(SEGMENT, v.shape[1])
    cluster = low.argmin(axis=1)
    distance = np.square(v - c[cluster]).sum(axis=1)
    needed, first = len(v), cluster.copy()
    for k in range(len(c)):
        rows = np.flatnonzero((low[:, k] <= m * distance) & (first != k))
        needed += len(rows)
        d = np.square(v[rows] - c[k]).sum(axis=1)
        better = (d < distance[rows]) | ((d == distance[rows]) & (k < cluster[rows]))
        distance[rows[better]], cluster[rows[better]] = d[better], k
    return cluster, distance, needed


def _matrix(column):
    """A list column as a matrix of long."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _packed(batches: Iterable, width: int) -> Iterator:
    """The columns of a batch, the last of which are the integers, and the compressed vectors."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        s, r = compressed(_matrix(batch.column(batch.num_columns - 1)))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.int64())) for x in (s, r)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "sums", "roots"])


def _sums(batches: Iterable, centroids: list[list[int]]) -> Iterator:
    """cluster, n, sums of the components over a task's vectors."""
    import numpy as np
    import pyarrow as pa

    dims = len(centroids[0])
    total, count = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
    out = pa.list_(pa.int64())

    def rows():
        own = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(total[own].tolist(), out)], ["cluster", "n", "sums"])

    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column(0))
        cluster, _, _ = nearest(v, (_matrix(batch.column(1)), _matrix(batch.column(2))), centroids)
        for k in np.unique(cluster).tolist():
            total[k] += v[cluster == k].sum(axis=0)
        count += np.bincount(cluster, minlength=len(centroids))
        seen += len(v)
        if seen >= 1 << 32:  # sums stay below 2^60
            yield rows()
            total[:], count[:], seen = 0, 0, 0
    yield rows()


def _assigned(batches: Iterable, centroids: list[list[int]]) -> Iterator:
    """The carried columns with cluster and distance in place of the vectors."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_columns - 3
        cluster, distance, _ = nearest(_matrix(batch.column(n)), (_matrix(batch.column(n + 1)), _matrix(batch.column(n + 2))), centroids)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(cluster, pa.int32()), pa.array(distance)], [*batch.schema.names[:n], "cluster", "distance"])


def start(vectors: DataFrame, id_col: str, v: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors of the smallest hashes of `seed:id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("key"), F.col(v).alias("v")).orderBy("key", "v").limit(k).collect()]


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    dims: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: int = 3,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The carried columns (by default the id) and cluster, distance, cluster_inertia, inertia,
    centroid_sha256, centroid (its integers)."""
    if dims > SEGMENT and dims % SEGMENT:
        raise ValueError("the components must fill whole segments")
    spark = df.sparkSession
    ship(spark)
    carry = carry or (id_col,)
    names = [free_name(df, n, carry) for n in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")]
    (own_id, v) = fresh(df, "id", "v")
    own = [f"{own_id}_{i}" for i in range(len(carry))]
    rows = df.select(F.col(id_col).alias(own_id), *(F.col(c).alias(n) for c, n in zip(carry, own, strict=True)), whole(vector_col, dims, scale).alias(v)).where(F.col(v).isNotNull())
    held = T.StructType([*rows.schema.fields, *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("sums", "roots"))])
    width = max(1, dims // SEGMENT)
    packed = materialise(rows.mapInArrow(lambda it: _packed(it, width), held), "centroid-vectors")
    at = start(packed, own_id, v, k, seed)
    for _ in range(rounds if at else 0):
        now = at
        local = packed.select(v, "sums", "roots").mapInArrow(lambda it, now=now: _sums(it, now), "cluster int, n long, sums array<long>")
        exact = F.sum(F.col("x").cast("decimal(38,0)"))
        summed = local.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(exact.alias("x"), F.sum("n").alias("n"))
        at = [list(c) for c in now]
        for r in summed.collect():  # k rows a component
            at[r["cluster"]][r["i"]] = int(r["x"]) // r["n"]
    plain = [F.col(n) for n in own]
    schema = T.StructType([*packed.select(*plain).schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    out = materialise(packed.select(*plain, v, "sums", "roots").mapInArrow(lambda it: _assigned(it, at), schema), "centroid-assigned")
    by = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    facts = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for j, c in enumerate(at)]
    facts = spark.createDataFrame(facts, "cluster int, centroid_sha256 string, centroid array<long>")
    of_cluster = by.crossJoin(F.broadcast(out.agg(F.sum("distance").alias("inertia")))).join(facts, "cluster")  # one row; k rows
    done = out.join(F.broadcast(of_cluster), "cluster")
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    return done.select(*(F.col(n).alias(c) for c, n in zip(carry, own, strict=True)), *(F.col(r).alias(n) for r, n in zip(results, names, strict=True)))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def oracle(dims: int = 64, k: int = 8, rounds: int = 10) -> str:
    """DuckDB SQL: the rounds written out."""
    near = lambda c: f"SELECT rid, vec_id, v, first(cluster ORDER BY d, cluster) AS cluster, min(d) AS d FROM (SELECT kept.rid, vec_id, kept.v, cluster, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i]))) AS BIGINT) AS d FROM kept, {c} AS c) GROUP BY 1, 2, 3"
    parts = [
        f"""raw AS (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings),
kept AS MATERIALIZED (SELECT rid, vec_id, list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM raw WHERE len(e) = {dims} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED ({near(f"c{r}")}),
m{r} AS (SELECT cluster, i, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS x FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY 1, 2)),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(l.v, c.v) AS v FROM c{r} AS c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM m{r} GROUP BY 1) AS l ON l.cluster = c.cluster)""")
    parts.append(f"done AS MATERIALIZED ({near(f'c{rounds}')})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, d.cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY d.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM done AS d JOIN c{rounds} AS c ON c.cluster = d.cluster"""


ORACLE = oracle()
