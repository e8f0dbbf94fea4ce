"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storing import forget, settled, shared_dir, stored

__all__ = ["BLOCK_CHARS", "Filter", "HashOf", "Places", "batch_of", "forget", "lean", "least_frequent", "make_filter", "mix64", "settled", "shared_dir", "spread", "stored", "table", "text_blocks", "utf8_bytes"]

#: Characters of text that one Arrow batch of results covers at most (one whole text at least).
BLOCK_CHARS = 4_000_000
#: Bits of a Bloom filter for each hash, and at least and at most.
BITS_A_HASH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 26
#: The setting that bounds Arrow batches in bytes, Spark's default and ours.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Deals rows anew only if the input has far fewer partitions than the cluster has cores; otherwise it is left as it is.

    Rows go to Python from here, so that the session's Arrow batches are bounded too, unless it has a bound of its own: long texts would
    else make batches that JVM and worker hold several times over."""
    if df.sparkSession.conf.get(BATCH[0], None) == BATCH[1]:
        df.sparkSession.conf.set(BATCH[0], BATCH[2])
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)


def text_blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts batches into slices of about BLOCK_CHARS bytes of text; null texts are read as empty ones."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.diff(_offsets(col))
        start, n = 0, len(col)
        ends = np.cumsum(sizes, dtype=np.int64)
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BLOCK_CHARS, "right")))
            part = batch.slice(start, stop - start)
            yield part, [x or "" for x in col.slice(start, stop - start).to_pylist()]
            start = stop


def _offsets(col: pa.Array) -> np.ndarray:
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.dtype(np.int64 if large else np.int32)
    raw = np.frombuffer(col.buffers()[1], dtype=kind) if len(col) else np.zeros(1, kind)
    return raw[col.offset : col.offset + len(col) + 1]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, after which the worker gives its memory back: workers live on, and what one task has needed would else add up
    with what the JVM and other workers need later."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def utf8_bytes(text: F.Column = None) -> F.Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col("text") if text is None else text), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of uint64 that spreads bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashOf(dict):
    """Word to 64-bit hash, remembered for the words met lately; at most `most` entries are held."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self._hash, self._most = xxh3_64_intdigest, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self._most:
            self.clear()
        v = self[word] = self._hash(word)
        return v

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Places:
    """Where each of many distinct 64-bit keys stands, looked up array by array: a table with open addressing, a third full at most."""

    def __init__(self, keys: np.ndarray):
        keys = self._no_zero(keys)
        bits = max(4, int(3 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._key, self._at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self._at[slot] < 0
            self._at[slot[free]] = left[free]
            placed = self._at[slot] == left
            self._key[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self._mask

    @staticmethod
    def _no_zero(keys: np.ndarray) -> np.ndarray:
        return np.where(keys == 0, np.uint64(1), keys)  # 0 marks free slots

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the array that the table was made of, -1 for others."""
        keys = self._no_zero(keys)
        slot = self._home(keys)
        got = self._key[slot]
        out = np.where(got == keys, self._at[slot], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self._mask
            got = self._key[slot]
            hit = got == keys[open_]
            out[open_[hit]] = self._at[slot[hit]]
            on = ~hit & (got != 0)
            open_, slot = open_[on], slot[on]
        return out


class Filter:
    """A Bloom filter of 64-bit hashes with three bits each."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.bytes = np.uint64(bits), words.view(np.uint8)

    def _has(self, at: np.ndarray) -> np.ndarray:
        at = at & (self.bits - np.uint64(1))
        return (self.bytes[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def where(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the set."""
        found = np.flatnonzero(self._has(hashes))
        for shift in (20, 40):
            found = found[self._has(hashes[found] >> np.uint64(shift))]
        return found


def make_filter(hashed: DataFrame) -> Filter:
    """From a column `h`. At most MOST_BITS / 64 rows reach the driver."""
    n = hashed.count()
    bits = LEAST_BITS
    while bits < min(n * BITS_A_HASH, MOST_BITS):
        bits *= 2
    places = hashed.select(F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(bits - 1) for s in (0, 20, 40)])).alias("at"))
    rows = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).collect()
    words = np.zeros(bits // 64, np.uint64)
    for r in rows:
        words[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return Filter(bits, words)


def least_frequent(counts: DataFrame, most: int) -> int:
    """A count that at most `most` rows of a column `c` reach, the least one as far as bins of a sixteenth of an octave tell."""
    bins = counts.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("top")).orderBy(F.desc("bin")).collect()
    found, seen = (bins[0]["top"] + 1 if bins else 1), 0
    for b in bins:
        seen += b["n"]
        if seen > most:
            break
        found = b["least"]
    return found
