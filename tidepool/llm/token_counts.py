"""Operator 2: token counts.

Texts are cut into pre-tokens. A grouped aggregation gives the distinct pre-tokens of the corpus with their frequencies; the pieces of each are
counted once. That table is joined to the documents' pre-token frequencies, and the products are summed by document; no ids are made. The join
has two ways, both exact: the most frequent pre-tokens, FREQUENT at most whatever the corpus is, are sent to the tasks; all rarer ones are joined by a
128-bit hash, one row for each document and distinct rare pre-token, spread evenly since none of them is frequent.

Counts are those of the `tokenizers` library for a byte-level BPE file with default handling of added tokens: their
strings in a text count as one token each. Null texts count as empty ones (0 bytes, 0 tokens); repeated rows each give a
row; an empty table gives an empty one; columns other than `doc_id` and `text` are ignored, whatever their names. Texts are read whole, however
long. Which of equally frequent pre-tokens are sent has no effect on the counts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_of, lean, least_frequent, settled, spread, stored, table, text_blocks
from .bpe import BLOCK, byte_characters

#: Pre-tokens sent to the tasks at most; distinct pre-tokens, and characters of them, that a task counts before it hands them on.
FREQUENT, HELD, HELD_CHARS = 200_000, 400_000, 30_000_000
#: Characters of a pre-token that is sent, at most.
LONGEST = 200


class Cutting:
    """Pre-tokens of texts by a byte-level BPE tokenizer file, given as its text."""

    def __init__(self, file: str, pattern: str):
        import regex

        given = json.loads(file)
        pre = given["pre_tokenizer"]
        if given["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or given.get("normalizer") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normaliser is needed")
        added = given.get("added_tokens") or []
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added):
            raise ValueError("added tokens that take up their surroundings are not supported")
        self.prefix = bool(pre.get("add_prefix_space"))
        self.pattern = regex.compile(pattern)
        strings = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, strings))) if strings else None

    def sections(self, text: str) -> tuple[list[str], int]:
        """The stretches between added tokens' strings, and how many of these there are."""
        if self.added is None or not self.added.search(text):
            return [text], 0
        return (found := self.added.split(text)), len(found) - 1

    def into(self, out: Counter, text: str) -> int:
        """Adds a text's pre-tokens to a count; the number of added tokens."""
        parts, n = self.sections(text)
        for part in parts:
            if self.prefix and part and not part.startswith(" "):
                part = " " + part
            if len(part) < 4 * BLOCK:
                out.update(self.pattern.findall(part))
            else:
                found = self.pattern.finditer(part)
                while block := [m[0] for m in islice(found, BLOCK)]:
                    out.update(block)
        return n


class Pieces:
    """How many pieces a pre-token has, by a tokenizer file given as its text."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(file).model
        self.shown = {b: c for b, c in enumerate(byte_characters())}

    def __call__(self, word: str) -> int:
        return len(self.model.tokenize(word.encode().decode("latin-1").translate(self.shown)))


def distinct(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """w and c: each pre-token of the corpus and how often it occurs."""
    schema = pa.schema([("w", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutting, seen = Cutting(file, pattern), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for i in range(0, len(words), 100_000):
                part = words[i : i + 100_000]
                yield batch_of(schema, part, [seen[w] for w in part])
            seen.clear()

        for _, texts in text_blocks(batches):
            for t in texts:
                cutting.into(seen, t)
            if len(seen) > HELD or sum(map(len, seen)) > HELD_CHARS:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(lean(run), "w string, n bigint").groupBy("w").agg(F.sum("n").alias("c"))


def with_pieces(words: DataFrame, file: str) -> DataFrame:
    """Adds pieces, counted once for each pre-token, and the two halves of its hash (g, h)."""
    from xxhash import xxh3_128_digest

    schema = pa.schema([("w", pa.string()), ("c", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("pieces", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(file)
        for batch in batches:
            words = batch.column(0).to_pylist()
            halves = np.frombuffer(b"".join(xxh3_128_digest(w) for w in words), np.int64).reshape(-1, 2)
            yield batch_of(schema, batch.column(0), batch.column(1), np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), [pieces(w) for w in words])

    return words.select("w", "c").mapInArrow(lean(run), "w string, c bigint, g bigint, h bigint, pieces bigint")


def met(docs: DataFrame, file: str, pattern: str, frequent: dict[str, int]) -> DataFrame:
    """Rows of two kinds: for each row of `docs` a number of its own, doc_id, n_bytes and the tokens counted here (known); for each document and
    distinct pre-token that is not among the frequent ones the row's number, the hash (g, h) and how often it occurs (n)."""
    from xxhash import xxh3_128_digest

    schema = pa.schema([("row", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutting, pieces, row = Cutting(file, pattern), sent.value, TaskContext.get().partitionId() << 36
        for part, texts in text_blocks(batches):
            rows, words, times, known = [], [], [], []
            for i, t in enumerate(texts):
                freq: Counter = Counter()
                total = cutting.into(freq, t)
                for w, k in freq.items():
                    if (p := pieces.get(w)) is None:
                        rows.append(row + i)
                        words.append(w)
                        times.append(k)
                    else:
                        total += p * k
                known.append(total)
            own = row + np.arange(len(texts), dtype=np.int64)
            row += len(texts)
            none = pa.nulls(len(texts), pa.int64())
            yield batch_of(schema, own, none, none, none, part.column(0), [len(t.encode()) for t in texts], known)
            if rows:
                halves = np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.int64).reshape(-1, 2)
                none = pa.nulls(len(rows), pa.int64())
                yield batch_of(schema, rows, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), times, none, none, none)

    return docs.mapInArrow(lean(run), "row bigint, g bigint, h bigint, n bigint, doc_id bigint, n_bytes bigint, known bigint")


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens, a row for each row of `docs`. `path` is read here; its content goes to the tasks."""
    with open(path, encoding="utf-8") as f:
        file = f.read()
    given = spread(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    words = stored(with_pieces(distinct(given, file, pattern), file), "pre-tokens")
    # Long pre-tokens are joined, however frequent, so that what is sent is bounded in bytes too.
    chosen = words.where((F.col("c") >= least_frequent(words, FREQUENT)) & (F.char_length("w") <= LONGEST)).select("w", "pieces").toArrow()
    parts = stored(met(given, file, pattern, dict(zip(chosen["w"].to_pylist(), chosen["pieces"].to_pylist(), strict=True))), "pre-token-counts")
    rare = parts.where("n is not null").select("row", "g", "h", "n").join(words.select("g", "h", "pieces"), ["g", "h"]).groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    heads = parts.where("n is null").select("row", "doc_id", "n_bytes", "known")
    return heads.join(rare, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rare", F.lit(0))).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    counted = settled(lambda: count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "token-counts")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
