"""Operator 5: exact top-k by inner product, with a ball tree and branch and bound in each shard.

Vectors become integers, floor(scale * x). Candidates are hashed by id into shards of bounded size, and each shard's ball tree is built
once: nodes hold a centre and a radius, so that the score of a query q with any vector of a node is at most q . centre + |q| radius.
Queries come in blocks. A block first searches a few shards one after the other, the k-th score reached in one being the bound in the next; then
it goes to every shard with that score as a bound. Queries move, trees do not: a shard's tree goes to a few lanes, and blocks pass through them. Within
a task nodes are taken by their bound, largest first, by all queries that still need them. Only scores that can be among the k best leave a task.

Scores are sums of products of integers; tables whose scores may reach 2^53 in size are refused (OverflowError), so that they are exact. Nodes are left out only
if their bound is less than the k-th score, so that ties are found and go to the smaller id. Vectors that are null or hold null or non-finite components
or nothing take no part, nor do vectors without an id. Vectors are compared with those of their own length. Every row is a candidate, and a query, by itself: rows that repeat
an id find each other, and a repeated query id has an answer for each row. Fewer than k candidates give fewer rows. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch_of, lean, settled, stored, table

#: Vectors of a shard, about; of a leaf at most; queries of a block, about.
SHARD, LEAF, BLOCK = 16_384, 128, 2_048
#: Shards that a block searches for its first bounds.
FIRST = 3


class BallTree:
    """Vectors in leaf order with ids and row numbers, and nodes as arrays: first and last vector, children (0: none), centre, radius."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((rows, ids))
        ids, numbers, vectors = ids[order], rows[order], vectors[order].astype(np.float64)
        place = np.arange(len(ids))
        first, last, child, centre, radius = [0], [len(ids)], [0], [], []
        at = 0
        while at < len(first):
            a, b = first[at], last[at]
            rows = vectors[place[a:b]]
            c = rows.mean(0)
            away = np.sqrt(((rows - c) ** 2).sum(1))
            centre.append(c)
            radius.append(float(away.max()) * (1 + 1e-9) + 1e-6)
            if b - a > leaf and away.max() > 0:
                # Split by the line from the farthest vector to the one farthest from it, at the median.
                one = rows[away.argmax()]
                two = rows[((rows - one) ** 2).sum(1).argmax()]
                cut = np.argsort(rows @ (two - one), kind="stable")
                place[a:b] = place[a:b][cut]
                child[at] = len(first)
                first += [a, (a + b) // 2]
                last += [(a + b) // 2, b]
                child += [0, 0]
            at += 1
        self.ids, self.rows, self.vectors = ids[place], numbers[place], vectors[place]
        self.first, self.last, self.child = np.array(first), np.array(last), np.array(child)
        self.centre, self.radius = np.array(centre), np.array(radius)


class Best:
    """The k best (score, id) of each query so far, smaller ids first among equal scores."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.inf) if floor is None else floor

    def bound(self, q: np.ndarray) -> np.ndarray:
        """A score that one of the k best has at least, for each query."""
        return np.maximum(self.floor[q], self.score[q, -1])

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # of many, those that reach the k-th score
            least = np.partition(score, -k, 1)[:, -k]
            least = np.maximum(least, self.bound(q))
            keep = score >= least[:, None]
            wide = int(keep.sum(1).max())
            if not wide:
                return
            pick = np.argsort(~keep, axis=1, kind="stable")[:, :wide]
            score = np.where(np.take_along_axis(keep, pick, 1), np.take_along_axis(score, pick, 1), -np.inf)
            ids = ids[pick]
        else:
            ids = np.broadcast_to(ids, score.shape)
        s = np.concatenate([self.score[q], score], 1)
        i = np.concatenate([self.id[q], np.where(score > -np.inf, ids, np.iinfo(np.int64).max)], 1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(tree: BallTree, rows: np.ndarray, queries: np.ndarray, best: Best) -> int:
    """Branch and bound of all queries at once, none of which finds its own row; returns how many scores were computed."""
    size = np.sqrt((queries**2).sum(1))
    upper = lambda node, q: queries[q] @ tree.centre[node] + size[q] * tree.radius[node]
    every = np.arange(len(rows))
    ub = upper(0, every)
    heap = [(-ub.max(), 0, every, ub)]
    done = 0
    while heap:
        _, node, q, ub = heapq.heappop(heap)
        need = ub >= best.bound(q)
        q, ub = q[need], ub[need]
        if not len(q):
            continue
        if c := int(tree.child[node]):
            for x in (c, c + 1):
                u = np.minimum(ub, upper(x, q) + 1e-6 * (1 + size[q]))
                keep = u >= best.bound(q)
                if keep.any():
                    heapq.heappush(heap, (-u[keep].max(), x, q[keep], u[keep]))
        else:
            a, b = tree.first[node], tree.last[node]
            score = queries[q] @ tree.vectors[a:b].T
            score[rows[q][:, None] == tree.rows[None, a:b]] = -np.inf
            done += score.size
            best.add(q, score, tree.ids[a:b])
    return done


def quantised(vectors: DataFrame, scale: float = 256) -> DataFrame:
    """vec_id, vector (array of floor(scale * x)), n (its length); rows that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(fine & (F.size("embedding") > 0)).select("vec_id", F.transform("embedding", lambda v: F.floor(v * scale)).alias("vector"), F.size("embedding").alias("n"))
    return rows.select("vec_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"), "n")


def _matrix(col: pa.ListArray, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, for the rows of `vectors` that `is_query` says are queries."""
    rows = stored(quantised(vectors, scale).withColumns({"row": F.monotonically_increasing_id(), "asked": F.coalesce(is_query, F.lit(False))}), "vectors")
    sizes = rows.groupBy("n").agg(F.count("*").alias("all"), F.count_if("asked").alias("asked"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).orderBy("n").collect()
    for s in sizes:
        if s["n"] * s["most"] ** 2 >= 2**53:
            raise OverflowError(f"scores of vectors of length {s['n']} may reach 2^53; use a smaller scale than {scale}")
    found = [_of_length(rows.where(F.col("n") == s["n"]), s["all"], s["asked"], k, shard, block) for s in sizes if s["asked"]]
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint") if not found else found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _of_length(rows: DataFrame, n: int, n_asked: int, k: int, shard: int, block: int) -> DataFrame:
    """The same for vectors of one length."""
    shards, blocks = -(-n // shard), -(-n_asked // block)
    hashed = lambda of, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(of)).cast("int")
    tree_schema = pa.schema([("shard", pa.int32()), ("tree", pa.binary())])

    def build(key: tuple, t: pa.Table) -> pa.Table:
        import pickle

        t = t.combine_chunks()
        tree = BallTree(t["vec_id"].to_numpy(), t["row"].to_numpy(), _matrix(t["vector"].combine_chunks(), t.num_rows))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps(tree.__dict__, 5)], pa.binary())], schema=tree_schema)

    # Shards are of bounded size, since their number follows the rows; hashing row numbers deals them evenly, whatever the ids are.
    trees = stored(rows.select("vec_id", "row", "vector", hashed(shards, 1).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, tree binary"), "trees")
    asked = rows.where("asked").select("vec_id", "row", "vector", hashed(blocks, 2).alias("block"))
    asked = stored(asked.groupBy("block").agg(F.collect_list(F.struct("vec_id", "row", "vector")).alias("queries")), "queries")  # about `block` rows each
    found_schema = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found_ddl = "block int, place int, query_id bigint, vec_id bigint, score bigint"

    def tree_of(data: bytes) -> BallTree:
        import pickle

        tree = BallTree.__new__(BallTree)
        tree.__dict__.update(pickle.loads(data))
        return tree

    class Block:
        def __init__(self, number: int, given: pa.Scalar, floors: list | None):
            self.number, given = number, given.values
            self.ids, self.rows = (given.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
            self.queries = _matrix(given.field("vector"), len(self.ids))
            floor = np.full(len(self.ids), -np.inf)
            for x in floors or []:
                floor[x["place"]] = x["floor"]
            self.best = Best(len(self.ids), k, floor)

        def found(self) -> pa.RecordBatch:
            q, j = np.nonzero((self.best.score > -np.inf) & (self.best.score >= self.best.floor[:, None]))
            return batch_of(found_schema, np.full(len(q), self.number, np.int32), q.astype(np.int32), self.ids[q], self.best.id[q, j], self.best.score[q, j].astype(np.int64))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, queries, tree), a block's rows one after the other; its k-th scores go from shard to shard."""
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                if now is None or now.number != batch.column(0)[i].as_py():
                    if now:
                        yield now.found()
                    now = Block(batch.column(0)[i].as_py(), batch.column(1)[i], None)
                search(tree_of(batch.column(2)[i].as_py()), now.rows, now.queries, now.best)
        if now:
            yield now.found()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, queries, floor, tree): a shard's tree, then all blocks that pass through it."""
        tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(3)[i].is_valid:
                    tree = tree_of(batch.column(3)[i].as_py())
                    continue
                now = Block(batch.column(0)[i].as_py(), batch.column(1)[i], batch.column(2)[i].as_py())
                search(tree, now.rows, now.queries, now.best)
                yield now.found()

    # A few shards of the block's own give the first bounds: the k-th best there is reached by the whole's k-th best.
    firsts = min(shards, FIRST)
    homed = asked.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.lit(firsts - 1)), lambda i: F.pmod(F.col("block") + i, F.lit(shards)).cast("int"))))
    homed = homed.join(trees, "shard").repartition("block").sortWithinPartitions("block", "shard")
    bounds = stored(homed.select("block", "queries", "tree").mapInArrow(lean(first), found_ddl), "bounds")
    kth = bounds.groupBy("block", "place").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
    kth = kth.groupBy("block").agg(F.collect_list(F.struct("place", "floor")).alias("floor"))
    # Every block goes to every shard: to one of the shard's lanes, which are as many as keep the cores busy.
    lanes = min(blocks, max(1, -(-4 * rows.sparkSession.sparkContext.defaultParallelism // shards)))
    none = F.lit(None)
    moved = asked.join(kth, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    moved = moved.select("shard", F.pmod("block", F.lit(lanes)).cast("int").alias("lane"), "block", "queries", "floor", none.cast("binary").alias("tree"))
    still = trees.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    still = still.select("shard", "lane", F.lit(-1).alias("block"), none.cast(moved.schema["queries"].dataType).alias("queries"), none.cast(moved.schema["floor"].dataType).alias("floor"), "tree")
    met = moved.unionByName(still).repartition("shard", "lane").sortWithinPartitions("shard", "lane", "block").select("block", "queries", "floor", "tree").mapInArrow(lean(meet), found_ddl)
    place = Window.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0), "top-k")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
