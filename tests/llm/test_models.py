import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import language_id, lm_scores, quality
from tidepool.llm.recurrent import Recurrent

from .helpers import ODD_TEXTS, by_id, docs

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Quality.


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over characters of running text, written plainly: log10 probability of a text."""
    raw = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = "\n" * (order - 1) + " ".join(t.split()) + " "
        for i in range(order - 1, len(s)):
            for k in range(1, order + 1):
                raw[k][s[i - k + 1 : i + 1]] += 1
    use = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in raw[k].items():
            use[k][g] = n if k == order or g[0] == "\n" else sum(1 for h in raw[k + 1] if h[1:] == g)
    cut = [None] + [quality.discounts(Counter(v for v in use[k].values() if v <= 4)) for k in range(1, order + 1)]

    def p(context, char):
        k = len(context) + 1
        low = p(context[1:], char) if context else 1 / (1 + len(raw[1]))
        follow = {g: n for g, n in use[k].items() if g[:-1] == context}
        if not follow:
            return low
        d = lambda n: cut[k][min(n, 3) - 1]
        total, n = sum(follow.values()), follow.get(context + char, 0)
        return ((n - d(n)) if n else 0) / total + sum(map(d, follow.values())) / total * low

    def log10_p(text):
        s = "\n" * (order - 1) + " ".join(text.split()) + " "
        return sum(math.log10(p(s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s)))

    return log10_p


TRAINING = ["the cat that sat on the mat", "then the thin cat  hid", "a cat\na hat a rat", "catch that bat"]


def test_probabilities_are_those_of_the_definition(spark):
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(TRAINING)], "fold int, text string")
    for order in (3, 5):
        for f, model in enumerate(quality.tables(df, order=order)):
            own, plain = quality.Scorer(*model, order), kneser_ney(TRAINING[f::2], order)
            tried = ["the cat sat on a mat", "a", "zebra a z", "cat cat cat cat", "hid\n thin", "thatthat"]
            n, p = own.texts(["", *tried, " \n"])
            assert n.tolist() == [0, *(len(" ".join(t.split())) + 1 for t in tried), 0] and p[0] == p[-1] == 0
            assert p[1:-1] == pytest.approx([plain(t) for t in tried], abs=1e-9)
            words, shuffled = own.texts(["cat the that sat", "sat cat that the"])[1]
            assert words != pytest.approx(shuffled, abs=1e-3)
            seen, back = model
            chars = [g for g in seen if len(g) == 1]
            for context in ("", "t", "th", " c"):
                def p_of(ch, c=context):
                    v, ctx = 0.0, c
                    while ctx + ch not in seen and ctx:
                        v += back.get(ctx, 0.0)
                        ctx = ctx[1:]
                    return 10 ** (v + (seen[ctx + ch] if ctx + ch in seen else back[""] + seen[""]))

                assert sum(map(p_of, chars)) + p_of("\0") == pytest.approx(1, abs=1e-9)


def test_texts_longer_than_a_stretch_are_scored_alike(spark, monkeypatch):
    df = spark.createDataFrame([(0, t) for t in TRAINING], "fold int, text string")
    own, text = quality.Scorer(*quality.tables(df)[0]), "the cat hat then that zebra " * 50
    whole = own.texts([text, "a rat", text])
    monkeypatch.setattr(quality, "STRETCH", 37)
    cut = own.texts([text, "a rat", text])
    assert cut[0].tolist() == whole[0].tolist() and cut[1] == pytest.approx(whole[1], abs=1e-9)


def test_perplexities_thresholds_and_decisions_are_those_of_a_plain_version(spark, monkeypatch):
    """With few labels: each fold's model, the other fold's scores, quantiles by language and band, decisions, all written plainly."""
    monkeypatch.setattr(quality, "LEAST", 12)
    monkeypatch.setattr(quality, "BANDS", (40, 80))
    rng = np.random.default_rng(3)
    say = lambda words, n: " ".join(rng.choice(words, n))
    en, de = ["the", "cat", "sat", "on", "that", "mat"], ["der", "hund", "lag", "auf", "dem", "bett"]
    rows = [(i, say(en if i % 3 else de, int(rng.integers(1, 30))), "en" if i % 3 else "de") for i in range(90)]
    rows += [(100 + i, "zq xj " * (i + 1), "en") for i in range(10)] + [(200, None, "en"), (201, "cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    folds = {r["doc_id"]: r["f"] for r in df.select("doc_id", quality.fold().alias("f")).collect()}
    models = [kneser_ney([t for i, t, _ in rows if i < 60 and folds[i] == f], quality.ORDER) for f in (0, 1)]
    known = {(f, t): models[f](t) for f, t in {(1 - folds[i], t) for i, t, _ in rows if t}}
    size = lambda t: len(" ".join(t.split())) + 1
    band = lambda t: sum(size(t) >= n for n in (40, 80))
    value = {i: 10 ** (-known[1 - folds[i], t] / size(t)) for i, t, _ in rows if t}
    good = [(i, t, lang, round(math.log10(value[i]) * 1000)) for i, t, lang in rows if i < 60]

    def limits(bins):
        at = lambda q: min(b for b in bins if sum(x <= b for x in bins) >= q * len(bins))
        return 10 ** (at(quality.LOW) / 1000) / quality.MARGIN, 10 ** (at(quality.HIGH) / 1000) * quality.MARGIN

    got = by_id(quality.judged(df, labels))
    assert len(got) == len(rows) and got[200]["perplexity"] is None and got[200]["keep"]
    used = Counter()
    for i, t, lang in rows:
        if not t:
            continue
        choices = [[x[3] for x in good if x[2] == lang and band(x[1]) == band(t)], [x[3] for x in good if band(x[1]) == band(t)], [x[3] for x in good]]
        n = next(n for n, c in enumerate(choices) if len(c) >= 12 and (n or lang))
        used[n] += 1
        low, high = limits(choices[n])
        assert (got[i]["perplexity"], got[i]["low"], got[i]["high"]) == pytest.approx((value[i], low, high), rel=1e-9)
        assert got[i]["keep"] == (low <= value[i] <= high)
    assert used[0] and used[1] and sum(not r["keep"] for r in got.values()) >= 8


def test_repeated_words_and_junk_are_rejected_more_often(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.judged(table(spark, "documents", sf), table(spark, "labels", sf)).join(table(spark, "labels", sf), "doc_id").toPandas()
    assert got[got.quality == 0].keep.mean() <= 0.08 and got[got.quality == 1].keep.mean() >= 0.995


def many_trusted(spark):
    """6,000 trusted documents, more than once were trained on; each has a character of its own."""
    texts = [f"{'the cat sat on the mat ' * (i % 4)}x{chr(0x4E00 + i)}y" for i in range(6000)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return df, spark.range(6000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")


def test_models_learn_from_every_trusted_document(spark):
    df, labels = many_trusted(spark)
    models = quality.tables(df.select(quality.fold().alias("fold"), "text"))
    rows = df.select("doc_id", quality.fold().alias("f"), "text").collect()
    assert sum(len(g) == 1 and g > "\u4dff" for m in models for g in m[0]) == 6000
    own = [quality.Scorer(*m) for m in models]
    want = {}
    for f in (0, 1):
        of = [r for r in rows if r["f"] == f]
        n, p = own[1 - f].texts([r["text"] for r in of])
        want |= {r["doc_id"]: 10 ** (-x / m) for r, m, x in zip(of, n, p, strict=True)}
    got = {r["doc_id"]: r["perplexity"] for r in quality.judged(df, labels).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_models_too_large_to_be_sent_are_joined(spark, monkeypatch):
    df = docs(spark).union(docs(spark, ["the cat sat on the mat " * i for i in range(40)], repeat=False).withColumn("doc_id", F.expr("doc_id + 100")))
    for trusted in (range(100, 130), [101], []):
        labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
        found = []
        for sent, ids, held, stretch in ((4_000_000, 1_000_000, 300_000, 1 << 18), (0, 0, 20, 50)):
            for name, v in zip(("SENT", "SENT_IDS", "HELD", "STRETCH"), (sent, ids, held, stretch), strict=True):
                monkeypatch.setattr(quality, name, v)
            rows = quality.judged(df, labels).collect()
            key = lambda r: (str(r["doc_id"]), r["text_hash"])
            found.append(sorted(rows, key=key))
        assert len(found[0]) == len(found[1]) == df.count()
        for a, b in zip(*found, strict=True):
            assert a[:4] == b[:4] and a["keep"] == b["keep"] and (a["perplexity"] is None) == (b["perplexity"] is None)
            assert a["perplexity"] is None or a["perplexity"] == pytest.approx(b["perplexity"], rel=1e-9)


def test_junk_is_rejected_and_trusted_text_kept(spark):
    got = quality.judged(table(spark, "documents"), table(spark, "labels")).join(table(spark, "labels"), "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.995
    assert got[got.quality == 0].keep.mean() <= 0.4


def test_quality_of_odd_rows(spark):
    labels = table(spark, "labels").union(spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    df = docs(spark)
    out = quality.judged(df, labels)
    assert out.count() == df.count() and by_id(out)[0]["keep"] and by_id(out)[1]["perplexity"] is None
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {0, 1, 2, 3} <= {r["doc_id"] for r in kept.collect()}
    none = labels.limit(0)
    assert quality.accepted(df, none).count() == df.count() and quality.judged(df.limit(0), labels).count() == 0


# Language.


def test_languages_of_held_out_rows(spark):
    d = table(spark, "documents")
    pages = table(spark, "pages")
    got = language_id.identify(d, pages)
    out = got.where("doc_id is not null").join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (out.lang == out.truth).mean() >= 0.98
    web = got.where("page_id is not null").toPandas()
    assert len(web) == pages.count() and (web.lang == web.declared).mean() >= 0.95
    # Trained without the second half, tried on it.
    langs, model = language_id.train(d.where("doc_id % 2 = 0"))
    rest = d.where("doc_id % 2 = 1").select("doc_id", F.lit("").alias("host"), F.lit(None).cast("string").alias("declared"), "text")
    held = language_id.fused(rest, langs, model, False).join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (held.lang == held.truth).mean() >= 0.97


def test_evidence_beyond_the_text(spark):
    words = {"en": "the of and to in is that it for was", "fr": "le la les des et un une est que pour"}
    d = spark.createDataFrame([(i, words[x], x, "s") for i, x in enumerate(["en", "fr"] * 20)], "doc_id long, text string, lang string, source string")
    langs, model = language_id.train(d)
    rows = [(i, "fr.example.net" if i < 30 else "en.example.net", None, words["fr" if i < 30 else "en"]) for i in range(60)]
    rows += [(100, "fr.example.net", None, ""), (101, "en.example.net", None, None), (102, "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, host string, declared string, text string")
    got = {r["page_id"]: r for r in language_id.fused(df, langs, model, False).collect()}
    assert got[100]["lang"] == "fr" and got[101]["lang"] == "en" and got[100]["text_lang"] is None
    assert got[102]["confidence"] < 0.7


def test_visible_text():
    page = "<html><head><title>x</title></head><body><nav>menu</nav><!-- c --><article class=a>one &amp; <b>two</b><script>no()</script></article></body>"
    assert language_id.visible(page).split() == ["one", "&", "two"]
    assert language_id.visible("<p>plain</p><style>p{}</style>").split() == ["plain"]


def test_language_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language_id.identify(docs(spark).limit(0), pages).count() == 0
    none = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(none, pages).where("lang is null").count() == docs(spark).count()
    odd = language_id.identify(docs(spark), spark.createDataFrame([(1, None, None), (2, "x", ""), (None, "http://a.b/c", "<html lang=de>")], "page_id long, url string, html string"))
    assert odd.count() == docs(spark).count() + 3


# Language-model scores.


def brute(texts, ids):
    toks = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for t, h in zip(toks, held, strict=True)]


@pytest.mark.parametrize("frequent", [200_000, 20])
def test_base_scores_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scores, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scores, "START_MET", 5_000)
    texts = ODD_TEXTS + ["A b\x0bC d", "ÀB àb", "the same words the same words"] * 4
    df = docs(spark, texts)
    rows = df.select("doc_id", "text").collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm_scores.lm_scores(df).collect())
    expect = brute([r["text"] for r in rows], [r["doc_id"] for r in rows])
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0, *e[:4], round(e[4], 6)) for r, e in zip(rows, expect, strict=True))


def test_the_network_beats_the_base_on_held_out_text(spark):
    out = lm_scores.query(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1] + 0.02 * abs(out[1])


def test_scores_of_an_empty_table(spark):
    assert lm_scores.lm_scores(docs(spark).limit(0)).count() == 0


def plain_states(net, inputs):
    """The network's states one by one, written plainly."""
    p, k, h, out = {n: v.astype(float) for n, v in net.p.items()}, net.hidden, np.zeros(net.hidden), []
    for i in inputs:
        a, u = p["x"][i] + p["b"], h @ p["u"]
        r, z = (1 / (1 + np.exp(-(a[j : j + k] + u[j + k : j + 2 * k]))) for j in (0, k))
        new = np.tanh(a[2 * k :] + r * u[:k])
        h = (1 - z) * new + z * h
        out.append(h)
    return out


def plain_log_p(net, h, token):
    p = {n: v.astype(float) for n, v in net.p.items()}
    c, i = divmod(int(token), net.width)
    share = lambda x, j: x[j] - math.log(sum(math.exp(v) for v in x))
    return share(h @ p["wc"] + p["bc"], c) + share(h @ p["wt"][c] + p["bt"][c], i)


def test_scores_are_those_of_a_plain_network(spark, monkeypatch):
    """The sum over a document's tokens of the plain network's probabilities; other words times their share of what the vocabulary leaves."""
    for name, value in (("CLASSES", 4), ("WIDTH", 4), ("VOCABULARY", 15), ("START_MET", 4_000)):
        monkeypatch.setattr(lm_scores, name, value)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], int(rng.integers(0, 60)), p=np.arange(40, 0, -1) / 820)) for _ in range(60)] + [None, "new words only", "w1 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = []
    train = lm_scores.train
    monkeypatch.setattr(lm_scores, "train", lambda *a: models.append(train(*a)) or models[0])
    got = by_id(lm_scores.lm_scores(df))
    net = models[0].network
    toks = [[*(t or "").encode().lower().split(), b""] for t in texts]
    c = Counter(w for i, t in enumerate(toks) if not lm_scores.is_held_out(i) for w in t)
    n, v = sum(c.values()), len(c)
    hashes = lm_scores.HashOf()
    key = lambda w: int(hashes.array([w]).view(np.int64)[0])
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], key(w)))
    top = sorted([b"", *ranked[: 14]], key=lambda w: -c[w])
    left = n + v + 1 - sum(c[w] + 1 for w in top)
    assert len(top) == 15 and models[0].trained == n
    for i, t in enumerate(toks):
        ids = [top.index(w) if w in top else 15 for w in t]
        expect = sum(plain_log_p(net, h, x) for h, x in zip(plain_states(net, [net.start, *ids[:-1]]), ids, strict=True)) / math.log(10)
        expect += sum(math.log10((c[w] + 1) / left) for w in t if w not in top)
        assert got[i]["score"] == pytest.approx(expect, rel=1e-4), i


def test_gradients_are_those_of_differences():
    net = Recurrent(3, 4, 5, np.ones(12))
    rng = np.random.default_rng(0)
    net.put(net.flat + 0.3 * rng.standard_normal(net.flat.shape), np.float64)
    tokens = rng.integers(0, 12, (6, 4))
    before = np.vstack([np.full((1, 4), net.start), tokens[:-1]])
    before[3, 1] = net.start  # a document begins inside the window
    h, start = rng.standard_normal((5, 4)), net.flat.copy()
    g, _ = net.gradients(tokens, before, h)
    numeric = np.empty_like(g)

    def loss():
        """The loss a token, by the plain network; where the input is the start, a state is dropped."""
        out = 0.0
        for j in range(4):
            state, p, k = h[:, j], net.p, net.hidden
            for y, i in zip(tokens[:, j], before[:, j], strict=True):
                state = state * (i != net.start)
                a, u = p["x"][i] + p["b"], state @ p["u"]
                r, z = (1 / (1 + np.exp(-(a[m : m + k] + u[m + k : m + 2 * k]))) for m in (0, k))
                new = np.tanh(a[2 * k :] + r * u[:k])
                state = (1 - z) * new + z * state
                out -= plain_log_p(net, state, y)
        return out / 24

    for i in range(len(g)):
        ends = []
        for way in (1e-5, -1e-5):
            moved = start.copy()
            moved[i] += way
            net.put(moved, np.float64)
            ends.append(loss())
        numeric[i] = (ends[0] - ends[1]) / 2e-5
    assert np.abs(g).max() > 0.05 and np.allclose(g, numeric, atol=1e-8)


def test_probabilities_sum_to_one_and_windows_do_not_matter():
    net = Recurrent(3, 4, 6, np.arange(12.0))
    h = np.random.default_rng(1).standard_normal((1, 6)).astype(np.float32)
    assert np.exp(net.log_p(np.repeat(h, 12, 0), np.arange(12))).sum() == pytest.approx(1, abs=1e-6)
    texts = [np.random.default_rng(i).integers(0, 12, n) for i, n in enumerate((50, 3, 120, 1))]
    one, two = net.score(texts), net.score(texts, cells=8)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one, two, strict=True))
    assert np.allclose(net.score(texts[2:3])[0], one[2], atol=1e-5)


def test_the_network_is_trained_on_every_token_of_the_training_side(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "START_TOKENS", 100)
    monkeypatch.setattr(lm_scores, "START_MET", 100)
    monkeypatch.setattr(lm_scores, "SHARD_TOKENS", 2_000)
    df = docs(spark, ["one two three four five six"] * 2_000, repeat=False).select("doc_id", "text")
    side = lm_scores.hashed_docs(df).where("not held")
    counts = lm_scores.token_counts(side)
    one, two = (lm_scores.train(d, counts) for d in (side.coalesce(1), side.repartition(7)))
    assert one.trained == two.trained == one.n == side.count() * 7
    # The weights are the same whatever the partitions are.
    assert all(np.array_equal(v, two.network.p[k]) for k, v in one.network.p.items())


def test_lanes_go_once_over_all_documents(monkeypatch):
    net = Recurrent(3, 4, 5, np.ones(12))
    seen, started = [], []
    monkeypatch.setattr(net, "window", lambda tokens, before, h, rate: (seen.extend(tokens.ravel()), started.extend((before == net.start).ravel()), h)[2])
    net.follow([np.full(n, i) for i, n in enumerate((50, 3, 0, 120, 7))], (0.01, 0.01), lanes=4, length=8)
    assert len(seen) == 180 and sum(started) == 4
    assert Counter(seen) == {0: 50, 1: 3, 3: 120, 4: 7}
