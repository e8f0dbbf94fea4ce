import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tidepool.llm import near_join

from .helpers import docs


def gram_set(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)) if w else None


def brute(texts):
    """Links and class of each row, over all pairs."""
    sets = [gram_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [(links[i], top(i)) for i in range(len(texts))]


def family(rng, n, words=60, edits=3):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9000)}"
        out.append(" ".join(w))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    texts = [None, "", "one", "one", "two words", "two  words", "a b c d e", "a b c d e", "a b c d f"]
    for n in (2, 3, 5, 40):
        texts += family(rng, n)
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(40)]
    texts += [texts[20]] * 7
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 60, 3)]
    return texts


def check(spark, texts):
    df = docs(spark, texts, repeat=False)
    found = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in near_join.join(df).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_links_and_classes_against_brute_force(spark):
    check(spark, corpus())


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_NODES", 4)
    check(spark, corpus(3))


def test_count_links_in_parts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(25)]
    j = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5
    expect = np.array([[j(a, b) for b in sets] for a in sets])
    np.fill_diagonal(expect, False)
    assert (near_join.count_links(sets, 0, 0.5) == expect).all()
    assert (near_join.count_links(sets, 10, 0.5) == expect[:10, 10:]).all()


def test_bands_reach_the_recall():
    for t, r in ((0.8, 0.99999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = near_join.bands_for(t, r)
        assert 1 - (1 - t**rows) ** bands >= r and bands * rows <= near_join.MOST_HASHES


def test_one_of_each_keeps_all_columns(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None, None, "", "other words that stand alone here"])
    out = near_join.one_of_each(df)
    assert out.columns == df.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids == {0: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 1}


def test_empty_table(spark):
    df = docs(spark).limit(0)
    assert near_join.join(df).count() == 0 and near_join.one_of_each(df).count() == 0


def test_stage(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f"], repeat=False)
    assert dict(corpus_pipeline.STAGES)["near_copies"](spark, df, "").count() == 1
