"""Nearest vectors by inner product: a forest of random-projection trees, one priority queue, exact reranking.

Index. Vectors are lengthened by sqrt(M^2 - |x|^2), M the largest norm, and a query by 0, so that the largest
inner product is the nearest direction. Trees are fitted on a bounded sample (`sample` vectors of the
smallest hashes): a node's plane stands between two of its sample vectors, at the median of the sample.
Then every distinct vector goes down every tree to a leaf. Equal vectors are one entry that holds
the ids of its first k + 1 rows by id, as no query can want more of them; so copies make no hot leaf.

Search. A query's one queue holds nodes of all trees by the sum of squared margins on the wrong side;
the least is taken next, and leaves are gathered until they hold `share` times the number of entries
(at least `least`; an entry counts once a tree). Trees have as many levels for any input, so leaves
grow with it: they are packed into cells of about `cell` entries, or split into cells where they are
larger, and each cell compares its entries with the queries that want its leaves. A query's
k-th product with the sample is a floor: what is below can't be in the result and isn't sent. Products are
summed from left to right in double precision.

Recall depends on the data. Uniformly random directions are the worst case: neighbours are hardly nearer
than others, so `share` is large by default. recall() measures it.

Defined results: vectors that are null, zero, of another length than `dims` (by default the commonest
length, the smaller of equally common ones), or with components that are null or not finite take no
part; nor do rows without an id. Every row is a candidate for every other row, so rows that repeat an id
may give it more than once, and repeated query rows give repeated results. Fewer than k candidates:
all of them. An empty table gives an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, ship, table

#: Rows of a block of products.
BLOCK = 512


class Forest:
    """Planes of `trees` complete binary trees: node n of a level has the children 2n and 2n + 1 of the next."""

    def __init__(self, sample, trees: int, leaf: int, seed: int):
        """sample: (n, dims) of lengthened vectors."""
        import numpy as np

        self.levels = max(0, (len(sample) // leaf).bit_length() - 1) if len(sample) else 0
        self.trees = [self._fit(sample, np.random.default_rng([seed, t])) for t in range(trees)]
        self.leaves = 1 << self.levels

    def _fit(self, sample, rng) -> list[tuple]:
        import numpy as np

        members, planes = [np.arange(len(sample))], []
        for _ in range(self.levels):
            w, b = np.zeros((len(members), sample.shape[1])), np.zeros(len(members))
            below = []
            for k, own in enumerate(members):
                i, j = rng.choice(own, 2, replace=False) if len(own) > 1 else (0, 0)
                d = sample[i] - sample[j]
                size = np.linalg.norm(d)
                w[k] = d / size if size > 0 else 0.0
                p = sample[own] @ w[k]
                b[k] = np.median(p) if len(own) else 0.0
                below += [own[p <= b[k]], own[p > b[k]]]
            planes.append((w, b))
            members = below
        return planes

    def leaf_of(self, x, tree: int):
        """The leaf of each row."""
        import numpy as np

        node = np.zeros(len(x), np.int64)
        for w, b in self.trees[tree]:
            node = 2 * node + (np.einsum("ij,ij->i", x, w[node]) > b[node])
        return node

    def margins(self, q) -> list[list]:
        """Signed margins of each row at every node, by tree and level."""
        return [[q @ w.T - b for w, b in levels] for levels in self.trees]

    def visit(self, margins: list[list], row: int, sizes: list[list[int]], wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) of one query in order of the shared queue, until they hold `wanted` entries."""
        queue = [(0.0, t, 0, 0) for t in range(len(self.trees))]
        out, held = [], 0
        while queue and held < wanted:
            cost, t, level, node = heapq.heappop(queue)
            while level < self.levels:  # on the near side the cost stays the same
                m = margins[t][level][row, node]
                near = int(m > 0)
                heapq.heappush(queue, (cost + float(m) * float(m), t, level + 1, 2 * node + 1 - near))
                level, node = level + 1, 2 * node + near
            if sizes[t][node]:
                out.append((t, node))
                held += sizes[t][node]
        return out


def lengthened(x, most: float):
    import numpy as np

    norm = np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.sqrt(np.maximum(most * most - norm, 0.0))])


def _vectors(column):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def products(q, x):
    """Inner products of rows, each summed from left to right."""
    import numpy as np

    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


class _Index:
    """What a task needs to route: the forest, its leaf sizes and cells (all bounded by the parameters)."""

    def __init__(self, forest: Forest, most: float):
        self.forest, self.most = forest, most
        self.sizes: list[list[int]] = []
        #: (first cell, number of cells) of each leaf, by tree.
        self.cells: list[list[tuple[int, int]]] = []
        self.floor_sample = None

    def pack(self, sizes: list[list[int]], cell: int) -> None:
        """Consecutive leaves share a cell of up to `cell` entries; a larger leaf has several."""
        self.sizes, number = sizes, 0
        for tree in sizes:
            held, own = 0, []
            for n in tree:
                if n > cell:
                    parts = -(-n // cell)
                    number += 1 if held else 0
                    own.append((number, parts))
                    number, held = number + parts, 0
                else:
                    if held + n > cell:
                        number, held = number + 1, 0
                    own.append((number, 1))
                    held += n
            number += 1 if held else 0
            self.cells.append(own)


def _counted(batches: Iterable, index: _Index) -> Iterator:
    """tree, leaf, n of a task's entries."""
    import numpy as np
    import pyarrow as pa

    counts = [np.zeros(index.forest.leaves, np.int64) for _ in index.forest.trees]
    for batch in batches:
        if batch.num_rows:
            x = lengthened(_vectors(batch.column(0)), index.most)
            for t, own in enumerate(counts):
                own += np.bincount(index.forest.leaf_of(x, t), minlength=index.forest.leaves)
    for t, own in enumerate(counts):
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), pa.array(own[at])], ["tree", "leaf", "n"])


def _placed(batches: Iterable, index: _Index) -> Iterator:
    """cell, leaf, entry, ids, vector: an entry once a tree."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        x = lengthened(_vectors(batch.column(2)), index.most)
        spread = batch.column(3).to_numpy()
        for t, cells in enumerate(index.cells):
            leaf = index.forest.leaf_of(x, t)
            first, parts = np.array(cells, np.int64)[leaf].T
            yield pa.RecordBatch.from_arrays([pa.array(first + spread % parts), pa.array(leaf), batch.column(0), batch.column(1), batch.column(2)], ["cell", "leaf", "entry", "ids", "v"])


def _routed(batches: Iterable, index: _Index, wanted: float, k: int) -> Iterator:
    """cell, leaves, key, floor, vector: a query once for each cell that holds leaves it wants."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            q = _vectors(part.column(1))
            margins = index.forest.margins(np.column_stack([q, np.zeros(len(q))]))
            held = q @ index.floor_sample.T
            slack = 1e-9 * index.most * np.sqrt(np.einsum("ij,ij->i", q, q))
            floors = -np.partition(-held, k, axis=1)[:, k] - slack if held.shape[1] > k else np.full(len(q), -np.inf)
            rows, cell, leaves = [], [], []
            for r in range(len(q)):
                by: dict[int, list[int]] = {}
                for t, leaf in index.forest.visit(margins, r, index.sizes, wanted):
                    first, parts = index.cells[t][leaf]
                    for c in range(first, first + parts):
                        by.setdefault(c, []).append(leaf)
                rows += [r] * len(by)
                cell += by
                leaves += by.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), part.column(0).take(take), pa.array(floors[rows]), part.column(1).take(take)], ["cell", "leaves", "key", "floor", "v"])


def _compared(entries, queries, k: int):
    """key, entry, nth, vec_id, score: the best k + 1 entries of a cell for each of its queries, with all ties and ids."""
    import numpy as np
    import pyarrow as pa

    entries, queries = entries.combine_chunks(), queries.combine_chunks()
    one = lambda t, c: t.column(c).combine_chunks() if t.num_rows else t.column(c)
    parts: dict[str, list] = {c: [] for c in ("key", "entry", "nth", "vec_id", "score")}
    if entries.num_rows and queries.num_rows:
        x, leaf, names = _vectors(one(entries, "v")), one(entries, "leaf").to_numpy(), one(entries, "ids")
        offsets, flat, entry = names.offsets.to_numpy(), names.values.to_numpy(), one(entries, "entry").to_numpy()
        q, floors, key = _vectors(one(queries, "v")), one(queries, "floor").to_numpy(), one(queries, "key").to_numpy()
        wanted = one(queries, "leaves")
        number = {n: j for j, n in enumerate(np.unique(leaf).tolist())}
        at = np.array([number[n] for n in leaf.tolist()])
        for s in range(0, len(q), BLOCK):
            block = q[s : s + BLOCK]
            want = np.zeros((len(block), len(number)), bool)
            for r, own in enumerate(wanted.slice(s, BLOCK).to_pylist()):
                want[r, [number[n] for n in own if n in number]] = True
            near = block @ x.T
            slack = 1e-9 * np.sqrt(np.einsum("ij,ij->i", block, block)) * np.sqrt(np.einsum("ij,ij->i", x, x).max())
            near[~want[:, at]] = -np.inf
            floor = floors[s : s + BLOCK]
            if near.shape[1] > k + 1:
                floor = np.maximum(floor, -np.partition(-near, k, axis=1)[:, k] - slack)
            r, e = np.nonzero((near >= floor[:, None]) & np.isfinite(near))
            exact = products(block[r], x[e])
            n = offsets[e + 1] - offsets[e]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for c, values in (("key", np.repeat(key[s + r], n)), ("entry", np.repeat(entry[e], n)), ("nth", nth), ("vec_id", flat[np.repeat(offsets[e], n) + nth]), ("score", np.repeat(exact, n))):
                parts[c].append(values)
    return pa.table({c: np.concatenate(x) if x else np.zeros(0, np.float64 if c == "score" else np.int64) for c, x in parts.items()})


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries: Column | None = None,
    *,
    k: int = 20,
    dims: int | None = None,
    trees: int = 4,
    leaf: int = 64,
    sample: int = 1 << 15,
    share: float = 1.2,
    least: int = 4096,
    cell: int = 4096,
    floor_sample: int = 1 << 13,
    seed: int = 13,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row where `queries` (a condition on df's columns;
    by default all rows) holds."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries if queries is not None else F.lit(True), F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    if dims is None:
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dims = common["n"] if common else 1
    rows = rows.where(F.size("v") == dims)
    # -0.0 and 0.0 are one value to Spark's grouping, and give equal products.
    rows = rows.withColumn("hash", F.xxhash64("v"))
    place = F.row_number().over(Window.partitionBy("hash", "v").orderBy("id"))
    held = rows.select("hash", "v", "id").withColumn("place", place).where(F.col("place") <= k + 1)
    entries = held.groupBy("hash", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialise(entries.withColumn("entry", F.monotonically_increasing_id()), "forest-entries")
    asked = materialise(rows.where("asked").select("hash", "v", "id").join(entries.select("hash", "v", "entry"), ["hash", "v"]).select("id", "entry"), "forest-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = entries.agg(F.count("*").alias("n"), F.max(norm).alias("most")).first()
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not facts["n"]:
        return spark.createDataFrame([], out)

    index = _fitted(entries, facts["most"], trees, leaf, sample, floor_sample, seed)
    sizes = [[0] * index.forest.leaves for _ in range(trees)]
    counts = entries.select("v").mapInArrow(lambda it: _counted(it, index), "tree int, leaf long, n long")
    for r in counts.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():  # the leaves of the forest
        sizes[r["tree"]][r["leaf"]] = r["n"]
    index.pack(sizes, cell)
    wanted = max(share * facts["n"], least)
    kind = rows.schema["v"].dataType.simpleString()

    spread = F.pmod(F.xxhash64("entry"), F.lit(1 << 30))
    placed = entries.select("entry", "ids", "v", spread.alias("spread")).mapInArrow(lambda it: _placed(it, index), f"cell long, leaf long, entry long, ids array<long>, v {kind}")
    # Equal queries are searched once, under the name of their entry.
    questions = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "v")
    routed = questions.mapInArrow(lambda it: _routed(it, index, wanted, k), f"cell long, leaves array<long>, key long, floor double, v {kind}")
    found = placed.groupBy("cell").cogroup(routed.groupBy("cell")).applyInArrow(lambda a, b: _compared(a, b, k), "key long, entry long, nth long, vec_id long, score double")
    found = found.dropDuplicates(["key", "entry", "nth"])  # what several trees found
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "entry", "nth"))
    best = found.withColumn("place", order).where(F.col("place") <= k + 1)
    lists = best.groupBy(F.col("key").alias("entry")).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", F.col("entry").alias("of")))).alias("found"))
    lists = materialise(lists, "forest-found")
    own = F.array_position(F.transform("found", lambda x: (x["vec_id"] == F.col("id")) & (x["of"] == F.col("entry"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != F.col("own")), 1, k)
    result = asked.join(lists, "entry").withColumn("own", own).select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return result.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _fitted(entries: DataFrame, most: float, trees: int, leaf: int, sample: int, floor_sample: int, seed: int) -> _Index:
    """The forest of a sample of the entries of at most `sample` rows, which the driver holds."""
    import numpy as np

    drawn = entries.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).toArrow()
    x = _vectors(drawn.column("v").combine_chunks())
    index = _Index(Forest(lengthened(x, most), trees, leaf, seed), most)
    index.floor_sample = np.ascontiguousarray(x[:floor_sample])
    return index


def recall(df: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> float:
    """The share of the true k nearest of the queries in `found` that it holds: products of all rows with
    these queries, which must be few, a block of rows at a time."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = rows.join(found.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").toArrow()
    names, q = asked.column("id").to_numpy(), _vectors(asked.column("v").combine_chunks())

    def best(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ids, near = batch.column(0).to_numpy(), q @ _vectors(batch.column(1)).T
                near[names[:, None] == ids[None, :]] = -np.inf  # ids are taken to be unique here
                n = min(k, len(ids))
                top = np.argpartition(-near, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(near, top, axis=1).ravel())], ["query_id", "vec_id", "score"])

    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = rows.mapInArrow(best, "query_id long, vec_id long, score double").withColumn("place", order).where((F.col("place") <= k) & (F.col("score") > float("-inf")))
    hits = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("hit") / F.count("*")).first()[0]


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)
