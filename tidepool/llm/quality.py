"""Operator 8: a quality classifier by an interpolated modified Kneser-Ney n-gram model.

Trusted text (labels with quality 1) is dealt by hash of the id into two folds, and a model is trained on each; every document is scored by the
model of the other fold, so that no document meets a model that has seen it, and the thresholds are those of unseen text. The n-grams are
characters, up to ORDER, and run across words (white space between words counts as one blank), so that the order of words matters.
All counts are grouped aggregations sharded by n-gram: raw counts at the highest order, the numbers of left neighbours at the lower
ones, each context's total and its numbers of followers seen once, twice and more; these tables are joined by context to the discounted
probabilities and back-off weights, and level by level to the interpolated ones. Documents are scored with them, and a document's perplexity (a character) is
compared with quantiles of its own language and band of length (short texts vary more): those of all trusted documents of that language and
band, of the band in all languages where these are fewer than LEAST, or of all trusted documents. Text is rejected above the upper or below the lower threshold.

The models are trained on the whole text of all trusted documents, and the quantiles are those of all of them. Tables of up to SENT rows are sent to
the tasks as hashes; larger ones stay where they are, and the n-grams of the documents are joined to them, with the same probabilities.

Null texts and texts without words hold no evidence (perplexity null) and are kept; documents with a null language are judged by
the thresholds of all languages. Ids with conflicting labels are not trusted; null ids never are. Repeated rows each give a row. A perplexity
equal to a threshold is kept. Very long texts are scored whole, in stretches that overlap. A fold without trusted text borrows the other's model; without any, all
is kept. An empty table gives an empty one. `accepted` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Places, batch_of, forget, lean, settled, spread, stored, table, text_blocks

ORDER, FOLDS = 5, 2
#: Rows of the models, and trusted ids, that are sent to the tasks; more of them are joined.
SENT, SENT_IDS = 4_000_000, 1_000_000
#: Distinct n-grams that a task counts before it hands them on.
HELD = 300_000
#: Quantiles of trusted perplexities, widened on both sides by the factor; trusted documents that thresholds need for their own.
LOW, HIGH, MARGIN, LEAST = 0.001, 0.996, 1.02, 50
#: Scored characters from which the second and the third band of length begin.
BANDS = (200, 1000)
#: Stands before a text's first character, as often as n-grams reach back.
START = "\n"
#: Characters that are looked up at a time.
STRETCH = 1 << 18


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int")


def running(text: str, order: int = ORDER) -> str:
    """The text with single blanks between words and one at its end, after the start symbols; without words the start symbols alone."""
    words = text.split()
    return START * (order - 1) + (" ".join(words) + " " if words else "")


def stretches(s: str, order: int) -> Iterator[list[str]]:
    """All n-grams of a running text, some at a time."""
    n = len(s) - order + 1
    for a in range(0, n, STRETCH):
        yield [s[i : i + order] for i in range(a, min(a + STRETCH, n))]


def grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """fold, gram, n: how often each n-gram of the highest order occurs. `docs` has fold and text."""
    schema = pa.schema([("fold", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(FOLDS)]

        def handed_on() -> pa.RecordBatch:
            out = batch_of(schema, [f for f, c in enumerate(seen) for _ in c], [g for c in seen for g in c], [n for c in seen for n in c.values()])
            for c in seen:
                c.clear()
            return out

        for part, texts in text_blocks(batches):
            for f, t in zip(part.column(0).to_pylist(), texts, strict=True):
                for some in stretches(running(t, order), order):
                    seen[f].update(some)
                    if sum(map(len, seen)) > HELD:
                        yield handed_on()
        yield handed_on()

    return docs.select("fold", "text").mapInArrow(lean(run), "fold int, gram string, n bigint").groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def counts(raw: DataFrame, order: int = ORDER) -> DataFrame:
    """fold, gram, k (its length), n: raw counts at the highest order and for n-grams with a start symbol, else the number of left neighbours."""
    every, above = [], raw.withColumn("raw", F.col("n"))
    for k in range(order, 0, -1):
        if k < order:
            above = above.groupBy("fold", F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("left"))
            above = above.select("fold", "gram", "raw", F.when(F.col("gram").startswith(START), F.col("raw")).otherwise(F.col("left")).alias("n"))
        every.append(above.select("fold", "gram", F.lit(k).alias("k"), "n"))
    out = every[0]
    for e in every[1:]:
        out = out.union(e)
    return out


def discounts(seen: dict[int, int]) -> tuple[float, float, float]:
    """From the numbers of n-grams counted once to four times; plain values where these are too few."""
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i + 1 - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


def model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """fold, seen, k (its length), gram, value: log10 of each seen n-gram's interpolated probability (`seen`; that of an unseen character for
    the empty one) and log10 of each context's back-off weight (not `seen`), of a training table with fold and text. An n-gram's ending is
    seen where the n-gram is, so that a character needs as many look-ups as its longest seen n-gram is short of the order."""
    raw = stored(grams(docs, order), "grams")
    n = stored(counts(raw, order), "counts")
    few: dict[tuple[int, int], dict[int, int]] = {}
    for r in n.where("n <= 4").groupBy("fold", "k", "n").agg(F.count("*").alias("m")).collect():
        few.setdefault((r["fold"], r["k"]), {})[r["n"]] = r["m"]
    cut = F.lit(0.0)
    for f, k in sorted({(r["fold"], r["k"]) for r in n.select("fold", "k").distinct().collect()}):
        d = discounts(few.get((f, k), {}))
        cut = F.when((F.col("fold") == f) & (F.col("k") == k), F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(cut)
    cuts = n.withColumn("cut", cut).withColumn("ctx", F.expr("substring(gram, 1, k - 1)"))
    ctx = cuts.groupBy("fold", "ctx", "k").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
    own = cuts.join(ctx, ["fold", "ctx", "k"]).select("fold", "k", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("high"), (F.col("freed") / F.col("total")).alias("free"))
    own = stored(own, "discounted")
    every = [stored(ctx.select("fold", F.lit(False).alias("seen"), F.col("k") - 1, F.col("ctx"), F.log10(F.col("freed") / F.col("total"))).toDF("fold", "seen", "k", "gram", "value"), "weights")]
    p = own.where("k = 1").groupBy("fold").agg((1 / (1 + F.count("*"))).alias("p")).select("fold", F.lit("").alias("gram"), "p")
    for k in range(order + 1):
        if k:
            lower = p.select("fold", F.col("gram").alias("rest"), F.col("p").alias("lower"))
            longer = own.where(F.col("k") == k).withColumn("rest", F.expr("substring(gram, 2)"))
            p = stored(longer.join(lower, ["fold", "rest"]).select("fold", "gram", (F.col("high") + F.col("free") * F.col("lower")).alias("p")), "interpolated")
        every.append(p.select("fold", F.lit(True).alias("seen"), F.lit(k).alias("k"), "gram", F.log10("p").alias("value")))
    out = every[0]
    for e in every[1:]:
        out = out.union(e)
    forget(raw)
    forget(n)
    return out


Tables = tuple[dict[str, float], dict[str, float]]


def tables(docs: DataFrame, order: int = ORDER) -> list[Tables]:
    """For each fold the rows of a small `model`, as dictionaries: log10 probabilities by n-gram and back-off weights by context."""
    made: list[Tables] = [({}, {}) for _ in range(FOLDS)]
    for r in model(docs, order).collect():
        made[r["fold"]][0 if r["seen"] else 1][r["gram"]] = r["value"]
    return made


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Base of the n-grams' hashes.
BASE = np.uint64(0x9E6C63D0876A9A99)


def rolling(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length the hash of the n-gram that ends at each place (at the first places, of what there is)."""
    one = codes.astype(np.uint64) + np.uint64(1)
    out, power = [one], np.uint64(1)
    for j in range(1, most):
        with np.errstate(over="ignore"):
            power = power * BASE
        h = out[-1].copy()
        h[j:] += one[:-j] * power
        out.append(h)
    return out


def hashed(some: list[str], k: int) -> np.ndarray:
    """Hashes of n-grams of k characters."""
    return rolling(_codes("".join(some)), k)[-1][k - 1 :: k] if some and k else np.zeros(len(some), np.uint64)


def hashes(made: DataFrame) -> DataFrame:
    """The rows of a model with hashes for n-grams: seen, k, hash, value."""
    schema = pa.schema([("seen", pa.bool_()), ("k", pa.int32()), ("hash", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.array(batch.column(1).to_pylist(), np.int32)
            out = np.zeros(len(k), np.uint64)
            for one in set(k.tolist()):
                at = np.flatnonzero(k == one)
                out[at] = hashed(batch.column(2).take(pa.array(at)).to_pylist(), one)
            yield batch_of(schema, batch.column(0), k, out.view(np.int64), batch.column(3))

    return made.select("seen", F.col("k").cast("int"), "gram", "value").mapInArrow(lean(run), "seen boolean, k int, hash bigint, value double")


class Scorer:
    """log10 probabilities of texts. N-grams are known by 64-bit hashes, one table for each length."""

    def __init__(self, seen: dict[str, float], back: dict[str, float], order: int = ORDER):
        def some(values: dict[str, float], k: int) -> tuple[np.ndarray, np.ndarray]:
            of = [g for g in values if len(g) == k]
            return hashed(of, k), np.array([values[g] for g in of])

        self._fill(lambda is_seen, k: some(seen if is_seen else back, k), order)

    @classmethod
    def of(cls, made: DataFrame, order: int = ORDER) -> Scorer | None:
        """Of one fold's rows of a model, None if there are none."""
        rows = hashes(made).toArrow()
        if not len(rows):
            return None
        is_seen, k, key, value = (c.to_numpy() for c in rows.columns)
        out = cls.__new__(cls)
        out._fill(lambda s, n: (key[at := (is_seen == s) & (k == n)].view(np.uint64), value[at]), order)
        return out

    def _fill(self, rows: Callable[[bool, int], tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.order, self.floor, self.base = order, *(float(rows(s, 0)[1].sum()) for s in (True, False))
        self.seen, self.back = ([(Places(h), v) for h, v in (rows(s, k) for k in range(1, order + s))] for s in (True, False))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each character after the first order - 1."""
        h = rolling(codes, self.order)
        left = np.arange(self.order - 1, len(codes))
        out = np.zeros(len(codes))
        for k in range(self.order, 0, -1):
            found, p = self.seen[k - 1]
            at = found.find(h[k - 1][left])
            hit = at >= 0
            out[left[hit]] += p[at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if k > 1:
                found, g = self.back[k - 2]
                at = found.find(h[k - 2][left - 1])
                hit = at >= 0
                out[left[hit]] += g[at[hit]]
        out[left] += self.base + self.floor
        return out[self.order - 1 :]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of characters scored and their log10 probability."""
        reach = self.order - 1
        running_ = [running(t, self.order) for t in texts]
        sizes = np.array([len(r) for r in running_], np.int64)
        codes = _codes("".join(running_))
        each = np.zeros(len(codes))
        for a in range(reach, len(codes), STRETCH):
            each[a : a + STRETCH] = self.places(codes[a - reach : a + STRETCH])
        each[codes == ord(START)] = 0.0  # start symbols are given, not predicted; no running text holds another one
        ends = np.cumsum(sizes)
        return sizes - reach, np.add.reduceat(each, ends - sizes) if len(texts) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model of the whole text of all trusted documents."""
    ids, given = trusted_ids(labels), docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # Ids that can be sent leave texts where they are; more of them are met by shuffled texts, which need no sorting.
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("shuffle_hash")
    return model(given.join(ids, "doc_id", "left_semi").select(fold().alias("fold"), "text"))


def score(docs: DataFrame, made: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, n_scored (characters and bounds), log10_p, perplexity; a row for each row of `docs`."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_hash"), F.col("lang").cast("string"), F.col("text").cast("string"))
    given = given.select("doc_id", "text_hash", "lang", fold().alias("fold"), "text")
    out = by_sent_tables(spread(given), made) if made.count() <= SENT else by_join(spread(given), made)
    return out.withColumn("perplexity", F.when(F.col("n_scored") > 0, F.pow(F.lit(10.0), -F.col("log10_p") / F.col("n_scored"))))


def by_sent_tables(given: DataFrame, made: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), ("n_scored", pa.int64()), ("log10_p", pa.float64())])
    sent = given.sparkSession.sparkContext.broadcast([Scorer.of(made.where(F.col("fold") == f)) for f in range(FOLDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = sent.value
        unseen = [scorers[1 - f] or scorers[f] for f in range(FOLDS)]
        for part, texts in text_blocks(batches):
            folds = np.array(part.column(3).to_pylist())
            n, p = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for f, scorer in enumerate(unseen):
                at = np.flatnonzero(folds == f)
                if scorer and len(at):
                    n[at], p[at] = scorer.texts([texts[i] for i in at])
            yield batch_of(schema, *part.columns[:3], n, p)

    return given.mapInArrow(lean(run), "doc_id bigint, text_hash bigint, lang string, n_scored bigint, log10_p double")


def by_join(given: DataFrame, made: DataFrame, order: int = ORDER) -> DataFrame:
    """The same by joins alone, for models of any size. Rows of equal id and text add up and are divided by their number."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fold", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])
    folds = [r["fold"] for r in made.select("fold").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            for i, h, f, t in zip(*(part.column(c).to_pylist() for c in (0, 1, 3)), texts, strict=True):
                for some in stretches(running(t, order), order):
                    c = Counter(some)
                    yield batch_of(schema, [i] * len(c), [h] * len(c), [1 - f if 1 - f in folds else f] * len(c), list(c), list(c.values()))

    each = given.mapInArrow(lean(run), "doc_id bigint, text_hash bigint, fold int, gram string, n bigint")
    wanted = stored(each.select("fold", "gram").distinct(), "wanted")
    known = [made.where((F.col("seen") == s) & (F.col("k") == k)).select("fold", "gram", "value") for k in range(order + 1) for s in (True, False)]
    p = known[0]
    for k in range(1, order + 1):
        ends = wanted.select("fold", F.expr(f"substring(gram, {order - k + 1})").alias("gram")).distinct()
        ends = ends.withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("rest", F.expr("substring(gram, 2)"))
        ends = ends.join(known[2 * k].withColumnRenamed("value", "own"), ["fold", "gram"], "left").join(known[2 * k - 1].toDF("fold", "ctx", "weight"), ["fold", "ctx"], "left")
        longer = F.coalesce("own", F.coalesce("weight", F.lit(0.0)) + F.col("lower"))
        p = stored(ends.join(p.toDF("fold", "rest", "lower"), ["fold", "rest"]).select("fold", "gram", longer.alias("value")), "looked-up")
    # Sums of decimals are the same in whatever order.
    summed = each.join(p, ["fold", "gram"]).groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(16,13)") * F.col("n").cast("decimal(18,0)")).alias("p"))
    rows = given.select("doc_id", "text_hash", "lang").withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "text_hash")))
    summed = summed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n", F.col("p").cast("double").alias("p"))
    out = rows.join(summed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    n, p = (F.coalesce(F.col(c) / F.col("same"), F.lit(0.0)) for c in ("n", "p"))
    return out.select("doc_id", "text_hash", "lang", n.cast("bigint").alias("n_scored"), p.alias("log10_p"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, perplexity, low, high (the thresholds) and keep, a row for each row of `docs`."""
    scored = stored(score(docs, train(docs, labels)), "scored")
    scored = scored.withColumn("band", sum((F.col("n_scored") >= n).cast("int") for n in BANDS))
    good = scored.join(trusted_ids(labels), "doc_id", "left_semi").where("perplexity is not null")
    # Quantiles of perplexities in bins of a thousandth of a decade: a sum for each bin, the same in every run whatever the partitions are.
    bins = good.groupBy("lang", "band", F.rint(F.log10("perplexity") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    bins = stored(bins, "bins")

    def limits(name: str, *by: str) -> DataFrame:
        counted = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*by, F.lit(0)).orderBy("bin")
        summed = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*by, F.lit(0))))
        at = lambda q: F.pow(F.lit(10.0), F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) / 1000)
        out = summed.groupBy(*by).agg((at(LOW) / MARGIN).alias("low"), (at(HIGH) * MARGIN).alias("high"), F.max("total").alias("n"))
        enough = out.where(F.col("n") >= LEAST) if by else out
        return enough.select(*by, F.struct("low", "high").alias(name))

    # One row for all, one for each band; languages with LEAST trusted documents in a band are joined, whatever their number.
    own = stored(limits("own", "lang", "band").where("lang is not null"), "thresholds")
    out = scored.join(own, ["lang", "band"], "left").join(F.broadcast(limits("banded", "band")), "band", "left").join(F.broadcast(limits("every")))
    limit = F.coalesce("own", "banded", "every")
    keep = F.coalesce((F.col("perplexity") >= limit["low"]) & (F.col("perplexity") <= limit["high"]), F.lit(True))
    return out.select("doc_id", "text_hash", "lang", "n_scored", "perplexity", limit["low"].alias("low"), limit["high"].alias("high"), keep.alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    out = judged(docs, labels).where("not keep").select(F.coalesce("doc_id", F.lit(0)).alias("quality_id"), F.col("text_hash").alias("quality_hash")).distinct()
    mine = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0)) == out["quality_id"]
    return docs.join(out, mine & (F.xxhash64(docs["text"], docs["doc_id"].isNull()) == out["quality_hash"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash"), "quality")
