"""Operator 6: n-gram Jaccard join by MinHash banding.

Words are runs without white space; a document is the set of its 5-word n-grams (one n-gram of all words where there are fewer).
Documents with equal sets are one node with a multiplicity. Band and row counts are chosen for a target recall at the threshold
(`bands_for`). Nodes are shuffled on band hashes; those that share one with another node are candidates, and only their sets are
cut again, once, and move on. Candidates are verified on the full sets, every pair of nodes that shares a band hash, in blocks of bounded size.

No pair becomes a row. Nodes that share band hashes are brought together by a label (the least node met in their buckets), each
label's nodes are dealt by hash to blocks of bounded bytes, and each two blocks that share a bucket meet in one task, which counts
each node's links and gives a spanning forest of them. So the rows between stages follow the nodes, and a large group of copies is
spread over many tasks, while no link is lost. Links of a forest are joined into classes by minimum labels with pointer jumping.

Very long texts are read whole. Null texts and texts without words have no n-grams and no links; each row of this kind is a class of its own. Rows with the same id
and text are copies of each other. Empty tables give an empty result. `one_of_each` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import HashOf, batch_of, forget, lean, make_filter, mix64, settled, spread, stored, table, text_blocks

N, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Hashes of a signature at most; nodes and n-grams of a block, about.
MOST_HASHES, BLOCK_NODES, BLOCK_GRAMS = 128, 400, 400_000


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) with which `most` hashes reach the recall at the threshold."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def text_hash() -> Column:
    """Tells rows with the same id (null: 0 and marked) but other texts apart."""
    return F.xxhash64("text", F.col("doc_id").isNull())


def grams(text: str, hashes: HashOf, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words."""
    words = hashes.array(text.split())
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix64(out + words[i : len(words) - k + 1 + i])
    return np.unique(out)


class Signer:
    """Band hashes of n-gram sets, from fixed permutations."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.a = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.b = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(1 << 32))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(grams), 2048):
            low = np.minimum(low, (self.a[:, None] * grams[None, i : i + 2048] + self.b[:, None]).min(1))
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            out = mix64(out + low[j :: self.rows])
        return out.view(np.int64)


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, node (the n-gram set's hash; null without n-grams), n_grams, bands; a row for each row of `docs`."""
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("n_grams", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = HashOf(), Signer(bands, rows)
        for part, texts in text_blocks(batches):
            sets = [grams(t, hashes, n) for t in texts]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield batch_of(schema, part.column(0), part.column(1), nodes, [len(s) for s in sets], [sign(s) if len(s) else None for s in sets])

    given = docs.select(F.col("doc_id").cast("bigint"), text_hash().alias("text_hash"), F.col("text").cast("string"))
    return spread(given).mapInArrow(lean(run), "doc_id bigint, text_hash bigint, node binary, n_grams bigint, bands array<bigint>")


def nodes_of(marked: DataFrame) -> DataFrame:
    """One row for each n-gram set: node, rep (least id and text hash), n_docs, n_grams, bands."""
    return marked.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n_docs"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))


def block_pairs(nodes: DataFrame, small: DataFrame | None = None) -> DataFrame:
    """node, block, low, high: the pairs of blocks that share a bucket, for each candidate node of either block."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").select("bucket", "head")
    member = stored(rows.join(shared, "bucket"), "members")
    first = stored(member.groupBy("node").agg(F.min("head").alias("label")), "first-labels")  # a plain table on both sides of the look-up
    step = first.select(F.col("node").alias("label"), F.col("label").alias("next"))
    label = first.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    sized = stored(label.join(nodes.select("node", "n_grams"), "node"), "labels")
    chunks = sized.groupBy("label").agg(F.greatest(F.ceil(F.sum("n_grams") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_NODES)).alias("chunks"))
    # Only labels of more than one block are joined, as a table of its own, so that a label with many nodes can be split.
    many = sized.join(stored(chunks.where("chunks > 1"), "chunks"), "label", "left")
    dealt = stored(many.select("node", F.xxhash64("label", F.expr("pmod(xxhash64(node), coalesce(chunks, 1))")).alias("block")), "blocks")
    seen = member.join(dealt, "node").select("bucket", "block").distinct()
    pairs = seen.withColumnRenamed("block", "low").join(seen.withColumnRenamed("block", "high"), "bucket").where("low <= high").select("low", "high").distinct()
    ends = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return dealt.join(ends, "block")


def count_links(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Whether sets reach the threshold: the first `left` against the rest, or all against all where left is 0."""
    sizes = np.array([len(s) for s in sets], np.float64)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    column = np.cumsum(times > 1) - 1
    keep = times[place] > 1  # others meet nothing
    owner, col = owner[keep], column[place[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    rows, cols = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    both = np.zeros((len(sizes[rows]), len(sizes[cols])), np.float32)
    wide = max(256, 4_000_000 // len(sets))
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        a, b = np.searchsorted(col, [start, start + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[a:b], col[a:b] - start] = 1
        both += m[rows] @ m[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - both
    linked = both >= threshold * union - 1e-6
    if not left:
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray, left: int) -> np.ndarray:
    """A root for each set: the least index that links lead to."""
    n = linked.shape[0] + (linked.shape[1] if left else 0)
    root = np.arange(n)
    a, b = np.nonzero(linked)
    b = b + left if left else b
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def n_gram_sets(docs: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """node, n_docs, grams: each candidate's set, read once from its representative's text. Rows that a Bloom filter of the candidates' keys does
    not know leave no text behind the scan; the join decides."""
    key = F.xxhash64("near_id", "near_hash")
    passes = make_filter(candidates.select(key.alias("h")))
    sent = docs.sparkSession.sparkContext.broadcast(passes)
    schema = pa.schema([("near_id", pa.int64()), ("near_hash", pa.int64()), ("grams", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = HashOf()
        for batch in batches:
            known = sent.value.where(batch.column(2).to_numpy().view(np.uint64))
            for part, texts in text_blocks([batch.take(pa.array(known))]):
                yield batch_of(schema, part.column(0), part.column(1), [grams(t, hashes, n).tobytes() for t in texts])

    given = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("near_id"), text_hash().alias("near_hash"), F.col("text").cast("string").alias("text"))
    read = spread(given.select("near_id", "near_hash", key.alias("key"), "text")).mapInArrow(lean(cut), "near_id bigint, near_hash bigint, grams binary")
    # Rows equal in id and text are one.
    return stored(candidates.join(read, ["near_id", "near_hash"]).select("node", "n_docs", "grams").dropDuplicates(["node"]), "sets")


def links(docs: DataFrame, nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, root, n_links (documents in linked nodes), n_sets (linked nodes): a row for each node and task that found it links."""
    met = stored(block_pairs(nodes), "met")
    candidates = stored(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "n_docs", F.coalesce("rep.doc_id", F.lit(0)).alias("near_id"), F.col("rep.text_hash").alias("near_hash")), "candidates")
    sets = n_gram_sets(docs, candidates, n)
    sets = met.join(sets, "node").select("low", "high", "block", "node", "n_docs", "grams")
    out = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("n_links", pa.int64()), ("n_sets", pa.int64())])

    def verify(low: int, high: int, rows: dict[bytes, tuple]) -> pa.RecordBatch | None:
        order = sorted(rows, key=lambda k: (rows[k][0] != low, k))
        left = sum(rows[k][0] == low for k in order) if low != high else 0
        if len(order) < 2 or left == len(order):
            return None
        many = np.array([rows[k][1] for k in order])
        linked = count_links([np.frombuffer(rows[k][2], np.uint64) for k in order], left, threshold)
        root = forest(linked, left)
        if left:
            weight = np.concatenate([linked @ many[left:], many[:left] @ linked])
            count = np.concatenate([linked.sum(1), linked.sum(0)])
        else:
            weight, count = linked @ many, linked.sum(1)
        some = np.flatnonzero(count)
        return batch_of(out, [order[i] for i in some], [order[root[i]] for i in some], weight[some], count[some]) if len(some) else None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}
        for batch in batches:
            for low, high, block, node, n_docs, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (low, high) != at:
                    if at and (found := verify(*at, rows)):
                        yield found
                    at, rows = (low, high), {}
                rows[node] = (block, n_docs, g)
        if at and (found := verify(*at, rows)):
            yield found

    return sets.repartition("low", "high").sortWithinPartitions("low", "high").mapInArrow(lean(meet), "node binary, root binary, n_links bigint, n_sets bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that edges lead to), for every node of the edges (node, root)."""
    both = stored(edges.where("node != root").select("node", "root").union(edges.where("node != root").select("root", "node")).distinct(), "edges")
    label = stored(both.groupBy("node").agg(F.min("root").alias("r")).select("node", F.least("node", "r").alias("label")), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "root"), "root").groupBy("node").agg(F.min("label").alias("near"))
        step = label.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        ahead = label.select(F.col("node").alias("new"), F.col("label").alias("next"))
        new = stored(step.join(ahead, "new", "left").select("node", F.least("new", F.coalesce("next", "new")).alias("label"), F.col("label").alias("old")), "labels")
        moved = new.where("label != old").limit(1).count()
        forget(label)
        label = new.select("node", "label")
        label._stored_at = new._stored_at
        if not moved:
            return label


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of `docs`: doc_id, text_hash, class_id (least id of its class of links), n_links (other documents at the
    threshold or more, copies included), n_copies (other documents with the same n-grams), n_texts (linked n-gram sets), rep (the class's
    representative: least id, then text hash)."""
    bands, rows = bands_for(threshold, recall)
    marked = stored(signed(docs, n, bands, rows), "signed")
    nodes = stored(nodes_of(marked), "nodes")
    found = stored(links(docs, nodes, n, threshold), "links")
    label = components(found)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_sets").alias("n_texts"))
    joined = nodes.select("node", "rep", "n_docs").join(counts, "node", "left").join(label, "node", "left")
    every = stored(joined.withColumn("label", F.coalesce("label", "node")), "classes")
    # Both sides are tables of their own, so that a class with many nodes can be split; nodes that are alone need no join.
    tops = stored(every.groupBy("label").agg(F.min("rep").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "tops")
    known = every.join(tops, "label", "left").select("node", F.coalesce("top", "rep").alias("top"), "n_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    own = F.struct("doc_id", "text_hash")
    out = marked.select("doc_id", "text_hash", "node").join(known, "node", "left").withColumn("rep", F.coalesce("top", own))
    copies = F.coalesce(F.col("n_docs") - 1, F.lit(0))
    return out.select("doc_id", "text_hash", F.col("rep.doc_id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + copies).cast("long").alias("n_links"), copies.cast("long").alias("n_copies"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"), "rep", F.col("node").isNull().alias("alone"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one of each class kept (its least id, then text hash); documents without n-grams all stay."""
    kept = join(docs, **settings).where(F.col("alone") | F.col("rep").eqNullSafe(F.struct("doc_id", "text_hash")))
    kept = kept.groupBy(F.coalesce("doc_id", F.lit(0)).alias("near_id"), F.col("text_hash").alias("near_hash")).agg(F.max("alone").alias("near_alone"))
    whole = docs.select(F.struct("*").alias("near_row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("near_id"), text_hash().alias("near_hash"))
    place = Window.partitionBy("near_id", "near_hash").orderBy("near_alone")
    chosen = whole.join(kept, ["near_id", "near_hash"]).withColumn("near_place", F.row_number().over(place))
    return chosen.where(F.col("near_alone") | (F.col("near_place") == 1)).select("near_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: join(table(spark, sf_dir, "documents")).drop("text_hash", "rep", "alone"), "near-join")


#: The same by comparing all documents that share an n-gram; classes by closure over the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w
), k AS MATERIALIZED (
  SELECT doc_id, len(g) AS n, sha256(array_to_string(list_sort(g), chr(10))) AS h FROM g
), u AS MATERIALIZED (
  SELECT doc_id, unnest(g) AS s FROM g
), p AS MATERIALIZED (
  SELECT c.x, c.y, a.h = b.h AS same, b.h AS h FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
  ) c JOIN k a ON a.doc_id = c.x JOIN k b ON b.doc_id = c.y WHERE 5 * c.c >= 4 * (a.n + b.n - c.c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM k UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y
), top AS (
  SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1
), n AS (
  SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS n_copies, count(DISTINCT h) FILTER (NOT same) AS n_texts FROM p GROUP BY 1
)
SELECT k.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies, coalesce(n_texts, 0) AS n_texts
FROM k JOIN top USING (doc_id) LEFT JOIN n USING (doc_id)
"""
