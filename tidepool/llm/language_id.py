"""Operator 7: language identification by Bayesian evidence fusion.

For a page or document the posterior of language l is proportional to

    P(l | host) * P(declared | l) * P(suffix | l) * P(text | l) ^ temper

The text likelihood is that of character trigrams within words and their bounds, trained on documents of known language. A first
decision from text alone gives, by grouped aggregation over all rows, how often each declared markup language and each address suffix
goes with each language (smoothed), and the host priors, which are smoothed along a hierarchy: all rows, the address suffix, the
host's domain, the host; each level's counts are shrunk to its parent's distribution with the weight STRENGTH. A row's own first
decision is taken out of its host's and domain's counts, so that it does not vouch for itself.

The training sample is that many documents of each language (TRAIN_DOCS), so that no language goes without; every language that labels
name is known. The tables sent to the tasks are bounded by the languages and the sample; n-grams that a language has not are not held for it. Counts of hosts,
domains, suffixes and declared languages are joined as tables and never gathered. Of declared languages the primary subtag counts, whole.

Rows without text, address or markup go by the prior alone. Null texts and addresses count as empty. Repeated rows each give a row. Very long texts
are read whole. Equal posteriors go to the language with more training text, then to the first by name. Without training text the language is null.
An empty table gives an empty one. Columns that are not named are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_of, forget, lean, settled, spread, stored, table, text_blocks

#: Documents of each language that the text likelihood is trained on, about.
TRAIN_DOCS = 1_000
#: Weight of a parent's distribution, in rows; pseudo-count of declared languages and suffixes; exponent of the text likelihood.
STRENGTH, SMOOTH, TEMPER = 20.0, 1.0, 0.3
#: Characters of an n-gram; numbers (words times languages) that are remembered, and that are made at a time.
GRAMS, CACHE, MADE = 3, 1_600_000, 1_000_000

ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)</\1>", re.S | re.I)
HIDDEN = re.compile(r"<(script|style|nav|head|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def visible(page: str) -> str:
    """The text of a page: of its article where it marks one, else of the body without navigation, scripts and the like."""
    found = ARTICLE.findall(page)
    return markup.unescape(HIDDEN.sub(" ", " ".join(x[1] for x in found) if found else page))


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + GRAMS] for i in range(len(w) - GRAMS + 1)]


class Grams:
    """log P(n-gram | language) by n-gram and language, held where a language has the n-gram; elsewhere `none`, by language."""

    def __init__(self, langs: list[str], counts: list[tuple[str, str, int]]):
        self.langs, at = langs, {x: i for i, x in enumerate(langs)}
        self.gram: dict[str, int] = {}
        for _, g, _ in counts:
            self.gram.setdefault(g, len(self.gram))
        row = np.array([self.gram[g] for _, g, _ in counts], np.int64)
        lang, n = np.array([at[x] for x, _, _ in counts], np.int64), np.array([k for _, _, k in counts], float)
        total = np.bincount(lang, n, len(langs)) + 0.5 * (len(self.gram) + 1)
        self.none = np.log(0.5 / total)
        order = np.argsort(row, kind="stable")
        self.lang, self.value = lang[order], (np.log((n + 0.5) / total[lang]) - self.none[lang])[order]
        self.starts = np.searchsorted(row[order], np.arange(len(self.gram) + 2))  # one more row, of an n-gram that nobody has

    def of(self, words: list[str]) -> np.ndarray:
        """Words by languages: the sum over a word's n-grams."""
        each = [grams(w) for w in words]
        get, n = self.gram.get, len(self.gram)
        found = np.fromiter((get(g, n) for e in each for g in e), np.int64)
        sizes = np.array([len(e) for e in each])
        word, held = np.repeat(np.arange(len(words)), sizes), self.starts[found + 1] - self.starts[found]
        at = np.repeat(self.starts[found] - np.cumsum(held) + held, held) + np.arange(held.sum())
        cell = np.repeat(word, held) * len(self.langs) + self.lang[at]
        return np.bincount(cell, self.value[at], len(words) * len(self.langs)).reshape(len(words), -1) + sizes[:, None] * self.none


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], Grams | None]:
    """Languages, those with more training text first, and their n-grams."""
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string"))
    # A row for each language, of which the model holds more than a row each.
    shares = docs.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg((F.lit(float(most)) / F.count("*")).alias("share"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.col("share")
    known = known.join(F.broadcast(shares), "lang").where(part).select("doc_id", "lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_blocks(batches):
            words: Counter = Counter()
            for lang, t in zip(part.column(1).to_pylist(), texts, strict=True):
                words.update((lang, w) for w in t.lower().split())
            seen: Counter = Counter()
            for (lang, w), k in words.items():
                for g in grams(w):
                    seen[lang, g] += k
            yield batch_of(schema, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))

    counted = known.mapInArrow(lean(run), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-grams")
    langs = [r["lang"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    rows = [tuple(r) for r in counted.toLocalIterator()]
    forget(counted)
    return (langs, Grams(langs, rows)) if langs else ([], None)


class Likelihood:
    """Log-likelihoods of texts by language, by words that are remembered for a while; new words of a block are scored together."""

    def __init__(self, model: Grams):
        self.model, self.at = model, {}
        self.table = np.zeros((0, len(model.langs)))

    def texts(self, texts: list[str]) -> np.ndarray:
        n = len(self.model.langs)
        split = [t.lower().split() for t in texts]
        new = list({w for s in split for w in s if w not in self.at})
        if (len(self.at) + len(new)) * n > CACHE:
            self.at, self.table = {}, self.table[:0]
            new = list({w for s in split for w in s})
        step, made = max(1, MADE // n), [self.table]
        for i in range(0, len(new), step):
            made.append(self.model.of(new[i : i + step]))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.table = np.concatenate(made)
        out = np.zeros((len(texts), n))
        for i, s in enumerate(split):
            if s:
                out[i] = self.table[np.fromiter(map(self.at.__getitem__, s), np.int64, len(s))].sum(0)
        return out


def text_evidence(rows: DataFrame, model: Grams, n: int, html: bool) -> DataFrame:
    """Adds `evidence` (log-likelihood of the text by language) in place of `text`."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = Likelihood(sent.value)
        for part, texts in text_blocks(batches):
            found = likely.texts([visible(t) for t in texts] if html else texts)
            columns = [part.column(part.schema.get_field_index(c)) for c in names]
            evidence = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, evidence], names=[*names, "evidence"])

    kinds = dict(rows.dtypes)
    return spread(rows).mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in names) + ", evidence array<double>")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def fused(rows: DataFrame, langs: list[str], model: Grams | None, html: bool) -> DataFrame:
    """`rows` has text, declared and host besides any keys; adds lang, confidence, text_lang (by text alone) and keeps the rest but the text."""
    n = len(langs)
    if not n:
        return rows.drop("text").withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")})
    name = lambda i: F.when(i.isNotNull(), F.element_at(F.array(*map(F.lit, langs)), i))
    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.col("host"))
    read = text_evidence(rows, model, n, html).withColumns({"declared": F.regexp_extract(F.lower(F.coalesce("declared", F.lit(""))), "^[a-z]+", 0), "suffix": F.element_at(parts, -1), "domain": domain})
    top = F.array_position("evidence", F.array_max("evidence")).cast("int")
    read = stored(read.withColumn("first", F.when(F.exists("evidence", lambda v: v != 0), top)), "evidence")
    counted = F.array(*[F.count_if(F.col("first") == i + 1) for i in range(n)]).cast("array<double>")
    none = F.array_repeat(F.lit(0.0), n)
    # Grouped counts at each level; a text without words counts nowhere.
    every = read.agg(counted.alias("n_all"))
    # Stored, so that the join's sides are plain tables and a host with many rows can be split.
    level = lambda key: stored(read.groupBy(key).agg(counted.alias(f"n_{key}")), "counts")
    out = read.join(F.broadcast(every))  # one row
    for key in ("suffix", "domain", "host", "declared"):
        out = out.join(level(key), key, "left").withColumn(f"n_{key}", F.coalesce(f"n_{key}", none))
    own = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce((i == F.col("first")).cast("double"), F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    less = lambda a: F.zip_with(a, "own", lambda x, y: x - y)
    shrunk = lambda a, parent: F.zip_with(a, parent, lambda x, p: (x + STRENGTH * p) / (total(a) + STRENGTH))
    rate = lambda a: F.zip_with(a, "n_all", lambda x, m: F.log((x + SMOOTH * (m + 1) / (total(F.col("n_all")) + n)) / (m + SMOOTH)))
    out = out.withColumn("own", own).withColumn("p_all", F.transform("n_all", lambda x: (x + 1) / (total(F.col("n_all")) + n)))
    out = out.withColumn("p_suffix", shrunk(less("n_suffix"), "p_all")).withColumn("p_domain", shrunk(less("n_domain"), "p_suffix"))
    out = out.withColumn("prior", F.when(F.col("host") == "", F.col("p_all")).otherwise(shrunk(less("n_host"), "p_domain")))
    evidence = F.zip_with(F.transform("evidence", lambda v: v * TEMPER), F.transform("prior", lambda v: F.log(v)), lambda a, b: a + b)
    evidence = F.when(F.col("declared") == "", evidence).otherwise(F.zip_with(evidence, rate(less("n_declared")), lambda a, b: a + b))
    evidence = F.when(F.col("host") == "", evidence).otherwise(F.zip_with(evidence, rate(less("n_suffix")), lambda a, b: a + b))
    out = out.withColumn("post", evidence).withColumn("best", F.array_max("post"))
    out = out.withColumns({"lang": name(F.array_position("post", F.col("best")).cast("int")), "confidence": 1 / total(F.transform("post", lambda v: F.exp(v - F.col("best")))), "text_lang": name(F.col("first"))})
    return out.select(*[c for c in rows.columns if c != "text"], "lang", "confidence", "text_lang")


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each document (its source is its host) and each page: doc_id, page_id, host, declared, lang, confidence, text_lang."""
    langs, model = train(docs)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.lit(None).cast("bigint").alias("page_id"), F.lower(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("host"), F.lit(None).cast("string").alias("declared"), F.col("text").cast("string"))
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    webs = pages.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint"), host_of(F.col("url")).alias("host"), F.nullif(declared, F.lit("")).alias("declared"), F.col("html").cast("string").alias("text"))
    return fused(texts, langs, model, False).unionByName(fused(webs, langs, model, True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")), "languages")
