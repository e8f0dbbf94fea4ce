"""Operator 10: language-model scores by a gated recurrent network.

Tokens are the words of a text (runs without ASCII white space, A-Z in lower case) and one end. Documents whose crc32(doc_id) mod 7
is not 2 are the training side; over all of it a grouped aggregation counts every token (c), their sum N and the distinct ones V.

Texts are read once: their tokens' hashes are stored, and counting, training and scoring read those.

The network (`recurrent`) predicts each token from the state that it carries through the whole document: a class, then a token of the
class. Its vocabulary is the VOCABULARY most frequent tokens (ties: by hash), among them the end, and a token for all other words. It is trained by truncated
backpropagation: first on the driver on a sample of about START_TOKENS tokens, from which weights all start, then by tasks on every document of the
training side once, in ROUNDS. A round's documents are dealt by hash into shards of about SHARD_TOKENS; each shard is trained from the
round's first weights, and the shards' weights are averaged, by tokens. Shards, and so updates, grow with the corpus. A word
outside the vocabulary has the probability of "other" times its share (c + 1) of what the vocabulary leaves of N + V + 1, so
that a text's probability is a proper one over all texts.

Counts reach documents in two ways, both exact. The most frequent tokens, FREQUENT at most whatever the corpus is,
are sent to the tasks; all rarer ones are joined by hash, one row for each document and distinct rare word, spread evenly since
none of them is frequent. Words are known by a 64-bit hash.

Very long texts are scored whole, their state carried on. Null texts count as empty ones (one token, the end). A null id counts as the empty string in the crc (training side). Repeated rows each
give a row and count each time. An empty table gives an empty one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common
from ._common import HashOf, Places, batch_of, forget, lean, least_frequent, settled, stored, table, text_blocks
from .recurrent import Recurrent

CLASSES, WIDTH, HIDDEN = 32, 32, 24
VOCABULARY = CLASSES * WIDTH - 1
#: Tokens of the sample that the first weights are trained on, about, and how many are met in that; tokens sent to the tasks at most.
START_TOKENS, START_MET, FREQUENT = 300_000, 600_000, 200_000
START_RATES = (0.01, 0.0005)
#: Rounds over parts of the training side, after each of which weights are averaged; tokens of a shard, about; a round's rates, from first to last.
ROUNDS, SHARD_TOKENS = 2, 500_000
RATES = ((0.004, 0.002), (0.002, 0.0002))
#: Documents that a shard trains side by side; weights that are averaged together; tokens that are counted at a time.
LANES, BLOCK, COUNTED = 128, 4096, 2_000_000
#: Tokens from which on a document is a long one; tokens of long documents that are scored together, about.
LONG, HELD_TOKENS = 2_000, 500_000
#: What `score` marks a document's own sums by; rows of the counts that a partition of the join holds in memory at most.
OWN, HELD_ROWS = (-1, -2, -3, -4), 200_000
#: The end's hash is that of the empty word, which no text holds.
END = b""
FOLDS, HELD = 7, 2


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def hashed(text: str, hashes: HashOf) -> np.ndarray:
    """Hashes of the text's tokens, the end included."""
    return hashes.array([*words(text), END]).view(np.int64)


def hashed_docs(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, held (whether it is held out), mix (a hash of id and text), n_tokens and tokens (64-bit hashes) of each row."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("mix", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, row = HashOf(), TaskContext.get().partitionId() << 36
        for part, texts in text_blocks(batches):
            rows = row + np.arange(len(texts), dtype=np.int64)
            row += len(texts)
            each = [hashed(t, hashes) for t in texts]
            yield batch_of(schema, rows, part.column(0), [is_held_out(i) for i in part.column(0).to_pylist()], part.column(1), [len(x) for x in each], [x.tobytes() for x in each])

    # By id and text, so that neither null ids nor copies are dealt alike.
    given = docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(11)).alias("mix"), "text")
    return stored(given.mapInArrow(lean(run), "row bigint, doc_id bigint, held boolean, mix bigint, n_tokens bigint, tokens binary"), "lm-words")


def _arrays(column: pa.Array, kind: type = np.int64) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def token_counts(train: DataFrame) -> DataFrame:
    """h (the token's hash) and c, over all of `train` (rows of `hashed_docs`)."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            made = batch_of(schema, *np.unique(np.concatenate(held), return_counts=True))
            held.clear()
            return made

        for batch in batches:
            held += _arrays(batch.column(0))
            size += sum(len(x) for x in held[-batch.num_rows :]) if batch.num_rows else 0
            if size > COUNTED:
                yield out()
                size = 0
        if held:
            yield out()

    return train.select("tokens").mapInArrow(lean(run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))


class Model:
    """What the tasks need: the frequent tokens' counts, the vocabulary and the network. Of bounded size."""

    def __init__(self, n: int, v: int, h: np.ndarray, c: np.ndarray, end: int):
        by = np.argsort(h)  # rows come in any order
        h, c = h[by], c[by]
        order = np.lexsort((h, -c))
        pick = order[:VOCABULARY]
        if end not in h[pick]:  # the end is always a token of its own
            pick = pick[: VOCABULARY - 1]
        ends = h[pick] == end
        vocabulary = np.concatenate([h[pick[~ends]], [end]])
        kept = np.concatenate([c[pick[~ends]], [c[pick[ends]].sum()]])
        rank = np.argsort(-kept, kind="stable")
        vocabulary, kept = vocabulary[rank], kept[rank]
        self.other = len(vocabulary)  # the id of all other words
        counts = np.zeros(CLASSES * WIDTH)
        counts[: len(kept)] = kept
        counts[self.other] = max(0, n - kept.sum())
        self.left = float(n + v + 1 - (kept + 1).sum() + (0 if ends.any() else 1))  # what the vocabulary leaves of N + V + 1
        self.left = max(self.left, 1.0)
        # The vocabulary's tokens are among those that are sent; the end is added where it is not.
        self.h, self.c = (h, c) if end in h else (np.append(h, end), np.append(c, 0))
        self.known = len(h)
        self.n, self.v = n, v
        self.network = Recurrent(CLASSES, WIDTH, HIDDEN, counts)
        ids = dict(zip(vocabulary.tolist(), range(len(vocabulary)), strict=True))
        self.ids = np.array([ids.get(x, self.other) for x in self.h.tolist()] + [self.other], np.int64)

    @cached_property
    def places(self) -> Places:
        return Places(self.h.view(np.uint64))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "places"}

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the tokens, and whether the counts are known here (else the token is none of the frequent ones)."""
        at = self.places.find(h.view(np.uint64))
        found = (at >= 0) & (at < self.known)
        return self.ids[at], np.where(found, np.append(self.c, 0)[at], 0), found


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """`docs` is the training side (rows of `hashed_docs`), `counts` its tokens' counts."""
    end = int(HashOf().array([END]).view(np.int64)[0])
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # FREQUENT rows at most, and the vocabulary's, where equal counts leave them out of these.
    rows = counts.where(F.col("c") >= least_frequent(counts, FREQUENT)).unionByName(counts.orderBy(F.desc("c"), "h").limit(VOCABULARY)).distinct().toArrow()
    model = Model(size["n"], size["v"], rows["h"].to_numpy(), rows["c"].to_numpy(), end)
    # A text longer than the whole sample is left to the rounds, which meet every document; so the sample is bounded whatever the texts are.
    share = min(1.0, START_TOKENS / max(1, size["n"]))
    chosen = docs.where((F.pmod(F.xxhash64("mix", F.lit(10)), F.lit(1 << 30)) < int((1 << 30) * share)) & (F.col("n_tokens") <= START_TOKENS))
    sample = [model.look_up(np.frombuffer(r["tokens"], np.int64))[0].astype(np.uint16) for r in chosen.select("tokens").toLocalIterator()]
    # In an order that does not depend on how the rows came.
    model.network.fit(sorted(sample, key=lambda d: (zlib.crc32(d.tobytes()), d.tobytes())), START_MET, START_RATES)
    model.trained = train_all(docs, model)
    return model


def train_all(docs: DataFrame, model: Model) -> int:
    """Trains the model's network on every document of `docs`; the number of tokens that it was trained on."""
    shards = max(1, -(-model.n // (ROUNDS * SHARD_TOKENS)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = _arrays(batch.column(1))
            flat = sent.value.look_up(np.concatenate(each))[0].astype(np.uint16) if each else np.zeros(0, np.uint16)
            cuts = np.cumsum([0, *map(len, each)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in pairwise(cuts)], pa.binary())], names=["key", "tokens"])

    key = F.pmod("mix", F.lit(ROUNDS * shards)).cast("int").alias("key")
    dealt = stored(docs.select(key, "tokens").mapInArrow(lean(tokens), "key int, tokens binary"), "lm-tokens")
    total = 0
    for i in range(ROUNDS):
        total += _round(dealt.where(F.col("key") % ROUNDS == i).select((F.col("key") / ROUNDS).cast("int").alias("shard"), "tokens"), shards, model.network, RATES[i])
    forget(dealt)
    return total


def _round(dealt: DataFrame, shards: int, network: Recurrent, rates: tuple[float, float]) -> int:
    """Puts the shards' mean weights into the network; the number of tokens."""
    network.restart()
    sent = dealt.sparkSession.sparkContext.broadcast(network)
    schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        nets: dict[int, Recurrent] = {}
        size, seen = Counter(), Counter()

        def follow(shard: int) -> None:
            # In an order that does not depend on how the rows came.
            part = [np.frombuffer(x, np.uint16) for x in sorted(held.pop(shard), key=lambda x: (zlib.crc32(x), x))]
            if shard not in nets:
                nets[shard] = copy.deepcopy(sent.value)
            nets[shard].follow(part, rates, LANES)
            seen[shard] += size.pop(shard)

        for batch in batches:
            for shard, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(shard, []).append(x)
                size[shard] += len(x) // 2
                if size[shard] > 4 * SHARD_TOKENS:  # many rows with the same id and text, or very long texts: as they come
                    follow(shard)
        for shard in sorted(held):
            follow(shard)
        for shard, net in nets.items():
            flat = net.flat
            cut = [flat[j : j + BLOCK].tobytes() for j in range(0, len(flat), BLOCK)]
            yield batch_of(schema, list(range(len(cut))), [shard] * len(cut), [seen[shard]] * len(cut), cut)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: Counter = Counter()
        for batch in batches:
            for block, _, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[block] = sums.get(block, 0.0) + k * np.frombuffer(x, np.float32).astype(np.float64)
                n[block] += k
        yield batch_of(schema, list(sums), [0] * len(sums), [n[b] for b in sums], [(v / max(1, n[b])).tobytes() for b, v in sums.items()])

    ddl = "block int, shard int, n bigint, weights binary"
    learnt = dealt.repartitionById(shards, F.col("shard")).mapInArrow(lean(learn), ddl)
    # Summed in the order of shards, so that the mean is the same in every run; one network's weights reach the driver.
    rows = learnt.repartition(16, "block").sortWithinPartitions("block", "shard").mapInArrow(lean(mean), ddl).collect()
    if not rows:
        return 0
    network.put(np.concatenate([np.frombuffer(r["weights"], np.float64) for r in sorted(rows, key=lambda r: r["block"])]))
    return rows[0]["n"]


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """A row for each row of `docs` (rows of `hashed_docs`): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    schema = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("value", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            # Long documents wait for each other: side by side they take as many steps as the longest of them alone.
            now = []
            for item in zip(batch.column(0).to_pylist(), _arrays(batch.column(1)), strict=True):
                (held if len(item[1]) > LONG else now).append(item)
            yield from made(now)
            if sum(len(x) for _, x in held) > HELD_TOKENS:
                yield from made(held)
                held = []
        yield from made(held)

    def made(items: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not items:
            return
        m, rows, each = sent.value, np.array([r for r, _ in items], np.int64), [x for _, x in items]
        flat, sizes = np.concatenate(each), np.array([len(x) for x in each])
        doc = np.repeat(np.arange(len(each)), sizes)
        token, c, found = m.look_up(flat)
        logs = np.where(found, np.log10(c + 1.0), 0.0)
        other = token == m.other
        lm = np.array([x.sum() for x in m.network.score(np.split(token, np.cumsum(sizes)[:-1]))]) / np.log(10)
        total = lambda x: np.bincount(doc, x, len(each))
        # What is known here of a document goes to the join in rows of its own, with keys that are spread as those of words are.
        spread_ = _common.mix64(rows.astype(np.uint64)).view(np.int64)
        for code, value in zip(OWN, (total(logs), lm + total(np.where(other, logs, 0.0)), total(found), total(other)), strict=True):
            yield batch_of(schema, spread_, rows, np.full(len(each), code, np.int32), value)
        rare = np.flatnonzero(~found)
        if len(rare):
            rare = rare[np.argsort(flat[rare], kind="stable")]  # equal words of a document come together
            new = np.flatnonzero(np.concatenate([[True], (np.diff(doc[rare]) != 0) | (np.diff(flat[rare]) != 0)]))
            times = np.diff(np.append(new, len(rare))).astype(np.int32)
            word = rare[new]
            by = np.argsort(doc[word].astype(np.uint16 if len(each) < 65_536 else np.int64), kind="stable")
            yield batch_of(schema, flat[word[by]], rows[doc[word[by]]], times[by], pa.nulls(len(word), pa.float64()))

    parts = docs.select("row", "tokens").mapInArrow(lean(run), "h bigint, row bigint, n int, value double")
    # Where a partition's share of the counts is small, they are held in memory, so that words need no sort.
    if model.v <= HELD_ROWS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        counts = counts.hint("shuffle_hash")
    word = F.when(F.col("value").isNull(), F.col("n"))
    own = [F.sum(F.when(F.col("n") == code, F.col("value"))).alias(name) for code, name in zip(OWN, ("base", "lm", "known", "other"), strict=True)]
    rare = [F.sum(word * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), word)).alias("rare_known")]
    summed = parts.join(counts, "h", "left").groupBy("row").agg(*own, *rare)
    rare = F.coalesce("rare", F.lit(0.0))
    whole, left = float(np.log10(model.n + model.v + 1)), float(np.log10(model.left))
    return docs.select("row", "doc_id", "held", "n_tokens").join(summed, "row").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known").cast("long") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * whole).alias("base_score"), (F.col("lm") + rare - F.col("other") * left).alias("score"),
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    given = hashed_docs(_common.spread(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))))
    side = given.where("not held")
    counts = stored(token_counts(side), "token-counts")
    return score(given, train(side, counts), counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: lm_scores(table(spark, sf_dir, "documents")), "lm-scores")
