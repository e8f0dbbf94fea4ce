"""Operator 1: byte-level BPE encoding and decoding.

The rank file becomes a sentencepiece BPE model without any training: each token's bytes are written with one printable
character a byte, its score is its negative rank, and normalisation is the identity. A text is split by the pre-token
pattern; each pre-token is encoded by itself, and ids are decoded by the inverse mapping, byte string after byte string.

The merge order of sentencepiece (highest score first, then leftmost) is that of the ranks. One rule comes from the rank
files' own library: a pre-token that is a token as a whole is that token, even where no merges lead to it.

Rows: null texts count as empty ones (no ids, empty bytes); repeated rows and repeated ids each give a row of their own;
an empty table gives an empty one; columns other than `doc_id` and `text` are ignored. Texts are encoded whole; memory is
bounded by one text and a block of pre-tokens.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_of, lean, spread, table, text_blocks

#: Pre-tokens that a worker remembers, and pre-tokens of a text that are held at once.
CACHE, BLOCK = 250_000, 300_000
#: The unknown piece's name; it holds a character that no mapped byte has.
UNKNOWN = "⁇unknown"
SCHEMA = "doc_id bigint, ids array<int>, decoded binary"


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable in Latin-1, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    if not all(out):
        raise ValueError("ranks must run from 0 without gaps")
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i has the mapped bytes of token i and the score -i; the unknown piece comes last."""
    to = byte_characters()
    out = []
    for rank, token in enumerate(tokens):
        out.append(_field(1, _field(1, "".join(to[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -float(rank))))
    out.append(_field(1, _field(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", -float(len(tokens))) + _flag(3, 2)))
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1)  # BPE, size
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)  # no prefix, no white space removed or escaped
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to int32 ids and decodes ids to bytes; made once in a worker."""

    def __init__(self, tokens: list[bytes], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or serialise(tokens))
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _learn(self, pieces: Iterable[str]) -> None:
        ask, texts = [], []
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (i := self.whole.get(raw)) is not None:
                self.known[p] = struct.pack("<i", i)
            else:
                ask.append(p)
                texts.append(raw.decode("latin-1").translate(self.shown))
        if texts:
            for p, ids in zip(ask, self.processor.encode(texts, out_type=int, num_threads=1), strict=True):
                self.known[p] = struct.pack(f"<{len(ids)}i", *ids)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens, a bounded number at a time."""
        if len(text) < 4 * BLOCK:
            yield self.pattern.findall(text)
        else:
            found = self.pattern.finditer(text)
            while block := [m[0] for m in islice(found, BLOCK)]:
                yield block

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. New pre-tokens of short texts are learnt together, since each call of the library has a cost of its own."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for block in self.blocks(text):
                held.append((i, block))
                size += len(block)
                if size > BLOCK:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return [np.frombuffer(b"".join(x), "<i4") for x in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        self._learn({p for _, block in held for p in block if p not in known})
        for i, block in held:
            out[i].append(b"".join([known[p] for p in block]))

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


_CODECS: dict[tuple[int, str], Codec] = {}


def codec_of(tokens: list[bytes], model: bytes, pattern: str) -> Codec:
    """The worker's codec, which later tasks in the same worker use again; what it has learnt is not kept from task to task."""
    key = hash(model), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern, model)
    _CODECS[key].known.clear()
    return _CODECS[key]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (the text's tokens) and decoded (the bytes that the ids stand for), a row for each row of `docs`."""
    tokens = read_ranks(ranks_path)
    # The vocabulary's size is fixed by the file (about 1 MB), whatever the documents are.
    given = docs.sparkSession.sparkContext.broadcast((tokens, serialise(tokens)))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*given.value, pattern)
        for part, texts in text_blocks(batches):
            ids = codec.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield batch_of(schema, part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), [codec.decode(x) for x in ids])
        codec.known.clear()

    return spread(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(lean(run), SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
