"""Operator 4: benchmark decontamination by spaced-seed hashing.

Fixed masks of kept and ignored token positions slide over the tokens (lower-cased runs of word characters) of test items and
of documents; the kept tokens of each place give a hash, so that a place survives substitutions at the ignored ones. Test and
training hashes are joined; each hit names a document, an item and the offset between them, and is verified on the tokens
themselves: along that offset the best run (a match counts 1, a substitution -2) must have enough matches and identity.

Document hashes first pass a Bloom filter of the test hashes. Its size is bounded (`_common.MOST_BITS`) whatever the benchmark is, so that
it can be sent to all tasks; a fuller filter only lets more hashes through to the join, which decides.

Items shorter than the shortest mask are found where a whole line of a document (or its whole text) has their tokens and no others: such
short runs of words occur by chance inside sentences. Their lines are looked for in a pass of their own, if there are such items.

Null and empty texts hold no tokens and take no part. Repeated rows and ids
are matched each by itself (rows are told apart by id and text hash). Very long texts are read whole; of a document only the stretches around
hits go on. Of equally good runs the earlier counts. Empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Filter, HashOf, batch_of, lean, make_filter, mix64, settled, spread, stored, table, text_blocks

#: Kept (1) and ignored (0) positions.
MASKS = ("11101011", "111001011", "1101100101", "1011010011")
#: An overlap counts from so many matching tokens on, or from this share of an item that is shorter, at this identity.
MIN_MATCHES, MIN_SHARE, MIN_IDENTITY = 13, 0.7, 0.7

TOKEN = re.compile(r"\w+")
_STEPS = mix64(np.arange(1, 65, dtype=np.uint64))


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the kept tokens at each place where the mask fits."""
    form = MASKS[mask]
    n = len(words) - len(form) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _STEPS[-1 - mask])
    for i, kept in enumerate(form):
        if kept == "1":
            out += words[i : i + n] * (_STEPS[i] | np.uint64(1))
    return mix64(out)


def item_seeds(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of test items: (h, item_id, at) for each mask and place, and (item_id, words) with the tokens' hashes."""
    words_schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = HashOf()
        for part, texts in text_blocks(batches):
            yield batch_of(words_schema, part.column(0), [hashes.array(tokens(t)).view(np.int64) for t in texts])

    seed_schema = pa.schema([("h", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in zip(batch.column(0), batch.column(1), strict=True):
                words = np.array(w.as_py(), np.int64).view(np.uint64)
                for m in range(len(MASKS)):
                    h = seeds(words, m).view(np.int64)
                    yield batch_of(seed_schema, pa.array(h), pa.array([i.as_py()] * len(h), pa.int64()), pa.array(np.arange(len(h), dtype=np.int32)))

    # An item is its text: rows with the same id and text are one.
    read_items = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).dropDuplicates()
    words = stored(spread(read_items).mapInArrow(lean(read), "item_id bigint, words array<bigint>"), "items")
    return words.mapInArrow(lean(hash_), "h bigint, item_id bigint, at int"), words


def regions(docs: DataFrame, keep: Filter, reach: int) -> DataFrame:
    """The stretches of documents around hashes that pass the filter: doc_id, text_hash, start, words (hashes), hits (h, at)."""
    hit = pa.struct([("h", pa.int64()), ("at", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())), ("hits", pa.list_(hit))])
    sent = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, passes = HashOf(), sent.value
        for part, texts in text_blocks(batches):
            each = [hashes.array(tokens(t)) for t in texts]
            ends = np.cumsum([len(w) for w in each])
            words = np.concatenate(each)
            found, at = [], []
            for m, form in enumerate(MASKS):
                h = seeds(words, m)
                i = passes.where(h)
                doc = np.searchsorted(ends, i, "right")
                inside = i + len(form) <= ends[np.minimum(doc, len(ends) - 1)]  # not across two documents
                found.append(h[i[inside]])
                at.append(i[inside])
            h, at = np.concatenate(found), np.concatenate(at)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            doc = np.searchsorted(ends, at, "right")
            new = np.flatnonzero(np.diff(doc, prepend=-1).astype(bool) | (np.diff(at, prepend=-1) > 2 * reach))
            rows = []
            for a, b in zip(new, [*new[1:], len(at)], strict=True):
                d = int(doc[a])
                first = int(ends[d]) - len(each[d])
                lo, hi = max(first, int(at[a]) - reach), min(int(ends[d]), int(at[b - 1]) + reach)
                rows.append((d, lo - first, words[lo:hi].view(np.int64), [{"h": int(x), "at": int(y)} for x, y in zip(h[a:b].view(np.int64), at[a:b] - first, strict=True)]))
            pick = pa.array([r[0] for r in rows], pa.int64())
            yield batch_of(schema, part.column(0).take(pick), part.column(1).take(pick), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])

    given = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return spread(given).mapInArrow(lean(run), "doc_id bigint, text_hash bigint, start int, words array<bigint>, hits array<struct<h:bigint,at:int>>")


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the highest score (1 for a match, -2 for a substitution)."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[: end + 1] == low[end]))
    return start, end, int(same[start:end].sum())


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified overlaps: doc_id, text_hash, item_id, doc_start and item_start (in tokens), n_words, n_matches, share (of the item)."""
    found, item_words = item_seeds(items)
    reach = item_words.agg(F.max(F.size("words"))).first()[0] or 0
    near = stored(regions(docs, make_filter(found), max(reach, max(map(len, MASKS)))).withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = near.select("region", F.explode("hits").alias("hit")).select("region", F.col("hit.h").alias("h"), F.col("hit.at").alias("doc_at"))
    pairs = hits.join(found, "h").select("region", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    pairs = pairs.join(item_words.withColumnRenamed("words", "item_words"), "item_id")
    pairs = pairs.join(near.select("region", "doc_id", "text_hash", "start", "words"), "region")
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32()), ("n_matches", pa.int32()), ("share", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                item, doc = np.array(r["item_words"]), np.array(r["words"])
                shift = r["shift"] - r["start"]  # of the item against the region
                lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
                if hi <= lo:
                    continue
                a, b, n = best_run(item[lo:hi] == doc[lo + shift : hi + shift])
                if n >= min(MIN_MATCHES, int(np.ceil(MIN_SHARE * len(item)))) and n >= MIN_IDENTITY * (b - a):
                    rows.append((r["doc_id"], r["text_hash"], r["item_id"], lo + a + r["shift"], lo + a, b - a, n, n / len(item)))
            if rows:
                yield batch_of(schema, *map(list, zip(*rows, strict=True)))

    slim = pairs.select("doc_id", "text_hash", "item_id", "shift", "start", "words", "item_words")
    out = slim.mapInArrow(lean(verify), "doc_id bigint, text_hash bigint, item_id bigint, doc_start int, item_start int, n_words int, n_matches int, share double")
    short = item_words.where(F.size("words").between(1, min(map(len, MASKS)) - 1)).select("item_id", F.col("words").alias("item_words"), F.xxhash64("words").alias("h"))
    return out if short.isEmpty() else out.unionByName(whole_lines(docs, short))


def whole_lines(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Overlaps, as above, of lines that have a short item's tokens and no others. `short` has item_id, item_words and their hash h."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("doc_start", pa.int32()), ("words", pa.list_(pa.int64()))])
    most = min(map(len, MASKS)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = HashOf()
        for part, texts in text_blocks(batches):
            pick, starts, words = [], [], []
            for i, t in enumerate(texts):
                at = 0
                for line in t.splitlines():
                    w = tokens(line)
                    if 0 < len(w) <= most:
                        pick.append(i)
                        starts.append(at)
                        words.append(hashes.array(w).view(np.int64))
                    at += len(w)
            chosen = pa.array(pick, pa.int64())
            yield batch_of(schema, part.column(0).take(chosen), part.column(1).take(chosen), starts, words)

    given = spread(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")))
    lines = given.mapInArrow(lean(run), "doc_id bigint, text_hash bigint, doc_start int, words array<bigint>").withColumn("h", F.xxhash64("words"))
    met = lines.join(short, "h").where(F.col("words") == F.col("item_words"))
    size = F.size("item_words")
    return met.select("doc_id", "text_hash", "item_id", "doc_start", F.lit(0).alias("item_start"), size.alias("n_words"), size.alias("n_matches"), F.lit(1.0).alias("share"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best overlap of each document and item that have one (ties: the earlier in the document)."""
    rank = F.struct("n_matches", F.negative("n_words").alias("less"), F.negative("doc_start").alias("earlier"), "item_start", "share")
    best = overlaps(docs, items).groupBy("doc_id", "text_hash", "item_id").agg(F.max(rank).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", F.negative("b.earlier").alias("doc_start"), "b.item_start", F.negative("b.less").alias("n_words"), "b.n_matches", "b.share")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, all columns kept."""
    found = overlaps(docs, items).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    return docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["leak_id"]) & (F.xxhash64(docs["text"]) == found["leak_hash"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash"), "leaks")


def _sql() -> str:
    """The same over all places of all texts: seeds as joined tokens, and the best run by running sums."""
    masks = ", ".join(f"({n}, {len(m)}, {[i for i, c in enumerate(m) if c == '1']})" for n, m in enumerate(MASKS))
    return rf"""
WITH m AS (
  SELECT * FROM (VALUES {masks}) t(mask, span, kept)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents
), i AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), ds AS (
  SELECT r, mask, p, array_to_string(list_transform(kept, lambda k: w[p + k + 1]), ' ') AS s
  FROM (SELECT r, w, mask, kept, unnest(range(0, len(w) - span + 1)) AS p FROM d, m WHERE len(w) >= span)
), si AS (
  SELECT q, mask, p, array_to_string(list_transform(kept, lambda k: w[p + k + 1]), ' ') AS s
  FROM (SELECT q, w, mask, kept, unnest(range(0, len(w) - span + 1)) AS p FROM i, m WHERE len(w) >= span)
), h AS (
  SELECT DISTINCT r, q, ds.p - si.p AS shift FROM ds JOIN si USING (mask, s)
), o AS (
  SELECT r, q, shift, doc_id, item_id, d.w AS dw, i.w AS iw, greatest(0, -shift) AS lo, least(len(i.w), len(d.w) - shift) AS hi
  FROM h JOIN d USING (r) JOIN i USING (q)
), c AS (
  SELECT r, q, shift, doc_id, item_id, lo, len(iw) AS n, j - lo + 1 AS k, iw[j + 1] = dw[j + shift + 1] AS same
  FROM (SELECT *, unnest(range(lo, hi)) AS j FROM o)
), t AS (
  SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY r, q, shift ORDER BY k) AS total FROM c
), l AS (
  SELECT *, least(0, min(total) OVER (PARTITION BY r, q, shift ORDER BY k)) AS low FROM t
), e AS (
  SELECT r, q, shift, arg_max(k, (total - low) * 1000000 - k) AS stop, arg_max(low, (total - low) * 1000000 - k) AS low FROM l GROUP BY ALL
), b AS (
  SELECT r, q, shift, stop, CASE WHEN e.low = 0 THEN 0 ELSE min(k) FILTER (total = e.low) END AS start FROM l JOIN e USING (r, q, shift) GROUP BY r, q, shift, stop, e.low
), f AS (
  SELECT doc_id, r, item_id, CAST(lo + start + shift AS INTEGER) AS doc_start, CAST(lo + start AS INTEGER) AS item_start, CAST(stop - start AS INTEGER) AS n_words,
    CAST(count(*) FILTER (same AND k > start AND k <= stop) AS INTEGER) AS n_matches, n
  FROM c JOIN b USING (r, q, shift) GROUP BY doc_id, r, item_id, lo, start, shift, stop, n
), g AS (
  SELECT *, n_matches / CAST(n AS DOUBLE) AS share FROM f
  WHERE n_matches >= least({MIN_MATCHES}, ceil({MIN_SHARE}::DOUBLE * n)) AND n_matches >= {MIN_IDENTITY}::DOUBLE * n_words
), y AS (
  SELECT r, doc_id, j, regexp_extract_all(lower(lines[j]), '[\p{{L}}\p{{N}}_]+') AS w
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS j FROM (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM documents))
), x AS (
  SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y
), z AS (
  SELECT doc_id, r, item_id, doc_start, item_start, n_words, n_matches, share FROM g
  UNION ALL
  SELECT x.doc_id, x.r, i.item_id, CAST(before AS INTEGER), 0, CAST(len(i.w) AS INTEGER), CAST(len(i.w) AS INTEGER), 1.0 FROM x JOIN i ON x.w = i.w WHERE len(i.w) BETWEEN 1 AND {min(map(len, MASKS)) - 1}
)
SELECT doc_id, item_id, doc_start, item_start, n_words, n_matches, share FROM z
QUALIFY row_number() OVER (PARTITION BY doc_id, r, item_id ORDER BY n_matches DESC, n_words, doc_start, item_start DESC, share DESC) = 1
"""


SQL = _sql()
