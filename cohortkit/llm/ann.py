"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted in numpy on a bounded sample (``SAMPLE`` rows): every node
splits its points into ``BRANCH`` clusters until a leaf holds ``LEAF_POINTS`` of
them or the tree has ``MAX_LEAVES`` leaves.  Every row of the table is then
assigned to a leaf.

A query descends best-bin-first: a priority queue holds nodes by the inner
product with their centre, the best is opened first, and leaves are visited until
the calibrated number is reached (and, whatever it is, until they hold as many
rows of other ids as are asked for).  Calibration widens the visits: for ``CALIBRATION``
queries the exact neighbours are found among all rows, and the number of visits is
the smallest whose mean recall is at least ``RECALL``.

Leaf and visiting queries meet in blocks of bounded size: a crowded leaf is dealt
out over row blocks, and the queries of a popular one over query blocks.  Inside a
block a matrix product finds the candidates; the score reported is the plain
double-precision sum over the components in order, so equal vectors tie exactly.

Defined cases: vectors that are NULL, zero, hold a NULL or a non-finite component
or differ from the usual length take no part, nor do rows with a NULL id; rows
with the same id are candidates one by one but never of their own id's query, and
a repeated query id is searched once, with its smallest vector; with fewer than
``k`` candidates all are returned; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read_table, written

K = 20
SAMPLE = 20_000          # rows that the tree is fitted on
BRANCH = 8
LEAF_POINTS = 100
MAX_LEAVES = 4096
CALIBRATION = 200        # queries whose exact neighbours set the number of visits
RECALL = 0.93
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
SEED = 13


@dataclass
class Tree:
    centers: np.ndarray          # (nodes, dimensions); node 0 is the root
    children: list               # per node a range of nodes, empty for a leaf
    leaf: np.ndarray             # per node its leaf number or -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster number per point (Lloyd's rounds from distinct random points)."""
    distinct = np.unique(points, axis=0)
    centers = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centers))
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return nearest(points, centers)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1)[None, :] - 2 * points @ centers.T).argmin(axis=1)


def fit(points: np.ndarray, branch: int = BRANCH, leaf_points: int = LEAF_POINTS, max_leaves: int = MAX_LEAVES,
        seed: int = SEED) -> Tree:
    """Split the fullest leaf first until all are small or there are enough."""
    rng = np.random.default_rng(seed)
    centers, children, members = [points.mean(axis=0)], [range(0)], {0: np.arange(len(points))}
    queue = [(-len(points), 0)]
    leaves = 1
    while queue and leaves + branch - 1 <= max_leaves:
        size, node = heapq.heappop(queue)
        if -size <= leaf_points:
            break
        own = members.pop(node)
        part = k_means(points[own], branch, rng)
        found = np.unique(part)
        if len(found) < 2:                          # equal points: stays a leaf
            members[node] = own
            continue
        children[node] = range(len(centers), len(centers) + len(found))
        for c in found:
            members[len(centers)] = own[part == c]
            heapq.heappush(queue, (-int((part == c).sum()), len(centers)))
            centers.append(points[own[part == c]].mean(axis=0))
            children.append(range(0))
        leaves += len(found) - 1
    leaf = np.full(len(centers), -1)
    for number, node in enumerate(i for i, c in enumerate(children) if not c):
        leaf[node] = number
    return Tree(np.array(centers), children, leaf)


def assign(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of every point: from the root to the nearest child, again and again."""
    at = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if not tree.children[node]:
            at[own] = tree.leaf[node]
        elif len(own):
            kids = tree.children[node]
            part = nearest(points[own], tree.centers[kids.start:kids.stop])
            todo += [(kids.start + i, own[part == i]) for i in range(len(kids))]
    return at


def best_bins(tree: Tree, scores: np.ndarray):
    """Leaf numbers in best-bin-first order; ``scores`` are the query's products with all centres."""
    queue = [(-scores[0], 0)]
    while queue:
        _, node = heapq.heappop(queue)
        kids = tree.children[node]
        if not kids:
            yield int(tree.leaf[node])
        for kid in kids:
            heapq.heappush(queue, (-scores[kid], kid))


def visits(tree: Tree, scores: np.ndarray, counts: np.ndarray, least: int, k: int, own: int = 1) -> list[int]:
    """Leaves to visit: ``least`` of them, and on until they hold ``k`` rows besides the ``own`` of the query's id."""
    out, rows = [], 0
    for leaf in best_bins(tree, scores):
        if len(out) >= least and rows >= k + own:
            break
        out.append(leaf)
        rows += counts[leaf]
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired vectors, summed component by component in double precision."""
    total = np.zeros(np.broadcast_shapes(queries.shape, rows.shape)[0])
    for i in range(rows.shape[1]):
        total += queries[..., i] * rows[:, i]
    return total


def top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, at_once: int = 64):
    """(query number, row number, score) of each query's k best rows; ties to the smaller id.

    A matrix product finds the rows that may be among the best (all that come within
    rounding of the k-th); the plain sums decide."""
    size = np.sqrt((rows * rows).sum(axis=1).max()) if len(rows) else 0.0
    found = []
    for part in range(0, len(queries), at_once):
        q, qid = queries[part:part + at_once], query_ids[part:part + at_once]
        approx = q @ rows.T
        approx[qid[:, None] == ids[None, :]] = -np.inf
        floor = np.full(len(q), -np.inf)
        if len(ids) > k:
            floor = np.partition(approx, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9 * size * np.sqrt((q * q).sum(axis=1))
        at, row = np.nonzero((approx >= floor[:, None]) & (approx > -np.inf))
        score = products(q[at], rows[row])
        order = np.lexsort((ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        keep = nth < k
        found.append((at[keep] + part, row[keep], score[keep]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def vectors(column, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dimensions)


def usable(table: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows that take part, their number, their dimensions)."""
    kind = table.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"       # single precision stays as compact as it came
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")
                        ).filter(F.col("vec_id").isNotNull() & ok & F.exists("embedding", lambda x: x != 0))
    usual = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "d").limit(1).collect()
    d, n = (usual[0]["d"], usual[0]["n"]) if usual else (0, 0)
    return rows.filter(F.size("embedding") == d), n, d


def in_leaves(rows: DataFrame, tree: Tree, d: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(assign(tree, vectors(b.column(1), d)))],
                                                 names=["vec_id", "embedding", "leaf"])
    return rows.mapInArrow(run, f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, leaf long")


def exact_leaves(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, d: int) -> DataFrame:
    """(query_id, leaf, score, vec_id) of the exact neighbours of a few queries, one scan of all rows.

    A task keeps k rows a query, whatever it reads.
    """
    def run(batches):
        import pyarrow as pa
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            part = [vectors(b.column(1), d), b.column(0).to_numpy(), b.column(2).to_numpy()]
            q, r, s = top(queries, query_ids, part[0], part[1], k)
            new = [query_ids[q], part[2][r], s, part[1][r]]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            order = np.lexsort((held[3], -held[2], held[0]))
            held = [x[order] for x in held]
            first = np.r_[0, np.flatnonzero(np.diff(held[0])) + 1]
            nth = np.arange(len(held[0])) - np.repeat(first, np.diff(np.r_[first, len(held[0])]))
            held = [x[nth < k] for x in held]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query_id", "leaf", "score", "vec_id"])
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.mapInArrow(run, "query_id long, leaf long, score double, vec_id long")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))


def calibrate(tree: Tree, rows: DataFrame, queries: DataFrame, n_queries: int, k: int, d: int, target: float,
              calibration: int) -> int:
    """The smallest number of leaf visits with mean recall of ``target`` on the calibration queries."""
    draw = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000))
    some = queries.filter(draw * n_queries <= 1_000_000 * calibration).orderBy("vec_id").collect()
    if not some:
        return 1
    ids, q = np.array([r["vec_id"] for r in some]), np.array([r["embedding"] for r in some], np.float64)
    found = exact_leaves(rows, q, ids, k, d).collect()
    ranks = []
    scores = q @ tree.centers.T
    order = {int(i): {leaf: n for n, leaf in enumerate(best_bins(tree, s), 1)} for i, s in zip(ids, scores)}
    for r in found:
        ranks.append(order[r["query_id"]][r["leaf"]])
    if not ranks:
        return 1
    return int(np.sort(ranks)[int(np.ceil(target * len(ranks))) - 1])


def search(table: DataFrame, every: int = 20, k: int = K, target: float = RECALL, sample: int = SAMPLE,
           calibration: int = CALIBRATION, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of the rows whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows, n, d = usable(table)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a draw for every row, equal rows by their place in the input; about twice the bound, then cut to it
    draw = F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id())
    drawn = rows.select("embedding", draw.alias("draw")).filter(
        (F.col("draw").cast("double") / 2.0 ** 64 + 0.5) * n <= F.lit(2.0 * sample + 1000))
    points = [r["embedding"] for r in drawn.orderBy("draw").limit(sample).collect()] or [rows.first()["embedding"]]
    tree = fit(np.array(points, np.float64))
    rows = written(in_leaves(rows, tree, d), "ann-rows")
    per_leaf = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()      # at most MAX_LEAVES rows
    counts = np.zeros(tree.leaves, np.int64)
    for r in per_leaf:
        counts[r["leaf"]] = r["n"]
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("own"))
    n_queries = queries.count()
    least = calibrate(tree, rows, queries, max(1, n_queries), k, d, target, calibration)

    def send(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            scores = vectors(b.column(1), d) @ tree.centers.T
            where = [visits(tree, s, counts, least, k, own) for s, own in zip(scores, b.column(2).to_pylist())]
            at = np.repeat(np.arange(b.num_rows), [len(w) for w in where])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)),
                                              pa.array(np.concatenate(where).astype(np.int64))],
                                             names=["query_id", "query", "leaf"])
    kind = rows.schema["embedding"].dataType.simpleString()
    sent = written(queries.mapInArrow(send, f"query_id long, query {kind}, leaf long"), "ann-visits")
    q_counts = {r["leaf"]: r["n"] for r in sent.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(leaf, -(-int(counts[leaf]) // row_block), -(-n // query_block)) for leaf, n in q_counts.items()],
        "leaf long, rbs int, qbs int") if q_counts else spark.createDataFrame([], "leaf long, rbs int, qbs int")
    blocks = F.broadcast(blocks)                                                     # at most MAX_LEAVES rows

    def own(col, n):
        return F.pmod(F.xxhash64(col, F.lit(SEED)), F.col(n)).cast("int")

    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(SEED)), F.col("rbs")).cast("int")    # rows of one id apart
    left = rows.join(blocks, "leaf").select("leaf", place.alias("rb"), F.explode(
        F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), "vec_id", "embedding")
    right = sent.join(blocks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)).alias("rb"),
                                             own("query_id", "qbs").alias("qb"), "query_id", "query")

    def compare(a, b):
        import pyarrow as pa
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, qids = a.column("vec_id").to_numpy(), b.column("query_id").to_numpy()
        q, r, s = top(vectors(b.column("query").combine_chunks(), d), qids,
                      vectors(a.column("embedding").combine_chunks(), d), ids, k)
        return pa.table([pa.array(qids[q]), pa.array(ids[r]), pa.array(s)], names=names)

    found = left.groupBy("leaf", "rb", "qb").cogroup(right.groupBy("leaf", "rb", "qb")).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))
