import random

import numpy as np
import pytest

from tidepool.operators import duplicates, grouping, leaders
from tidepool.operators.checks import CHECKS, evaluate


def sequential(items, value, holds, better):
    """The plain loop: each item in order joins the best keeper so far, else is a keeper."""
    keepers, out = [], {}
    for i, x in enumerate(items):
        if x is None:
            continue
        best = None
        for k in keepers:
            v = value(x, items[k])
            if holds(v) and (best is None or better(v, best[1])):
                best = (k, v)
        if best:
            out[i] = best
        else:
            keepers.append(i)
            out[i] = (i, None)
    return out


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("distance", [0, 3, 7, 10, 16])
def test_hamming_groups_are_those_of_the_loop(spark, distance, small, monkeypatch):
    monkeypatch.setattr(leaders, "SMALL", small)
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [None, "", "zz"] + [f"{b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1):016x}" for b in base for _ in range(8)]
    rng.shuffle(hashes)
    valid = [int(h, 16) if h and len(h) == 16 else None for h in hashes]
    df = spark.createDataFrame([(str(i), i, h) for i, h in enumerate(hashes)], "image_id string, _pos long, phash string")
    expect = sequential(valid, lambda a, b: (a ^ b).bit_count(), lambda v: v <= distance, lambda v, w: v < w)
    sizes = {}
    for k, _ in expect.values():
        sizes[k] = sizes.get(k, 0) + 1
    for r in duplicates.perceptual_groups(df, distance).collect():
        i = r["_pos"]
        if i not in expect or sizes[expect[i][0]] == 1:
            assert (r["perceptual_duplicate_group_id"], r["perceptual_duplicate_count"], r["perceptual_duplicate_distance"]) == ("", 1, None)
        else:
            k, v = expect[i]
            assert r["perceptual_duplicate_group_id"] == f"perceptual-{hashes[k]}"
            assert (r["perceptual_duplicate_count"], r["perceptual_duplicate_distance"]) == (sizes[k], v or 0)


@pytest.mark.parametrize("threshold, small", [(0.92, 0), (0.3, 0), (0.3, 10**6)])
def test_similarity_groups_are_those_of_the_loop(spark, threshold, small, monkeypatch):
    monkeypatch.setattr(leaders, "SMALL", small)
    monkeypatch.setattr(leaders.similarity_edges, "__defaults__", (16,))
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 6))
    v = centres[rng.integers(0, 8, 90)] + 0.2 * rng.standard_normal((90, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[60:80], v[82:88] = v[:20], 0.4 * v[3]  # equal ones, some of them too short to be near themselves
    rows = [(str(i), i, x.tolist()) for i, x in enumerate(v)] + [("n", 90, None)]
    df = spark.createDataFrame(rows, "image_id string, _pos long, embedding array<double>")
    expect = sequential(list(v), lambda a, b: float(a @ b), lambda s: s >= threshold, lambda s, t: s > t)
    got = {r["_pos"]: r for r in duplicates.semantic_groups(df, threshold).collect()}
    assert got[90]["semantic_duplicate_count"] == 1
    for i, (k, s) in expect.items():
        n = sum(x[0] == k for x in expect.values())
        assert got[i]["semantic_duplicate_group_id"] == (f"semantic-{k}" if n > 1 else "")
        if n > 1:
            assert got[i]["semantic_duplicate_score"] == pytest.approx(1.0 if s is None else s)


def test_similarity_edges_follow_the_rows(spark):
    """Rows that are all near each other: pairs of them are not listed."""
    rng = np.random.default_rng(5)
    v = np.array([1.0, 0, 0, 0]) + 0.05 * rng.standard_normal((300, 4))
    df = spark.createDataFrame([(i, str(i), x.tolist()) for i, x in enumerate(v)], "pos long, image_id string, vector array<double>")
    edges = leaders.similarity_edges(df, 0.5).collect()
    assert len(edges) == 299 and {e["early"] for e in edges} == {0}


@pytest.mark.parametrize("threshold", [-0.5, 0.0, 2.0])
def test_ties_of_whole_numbers_go_to_the_earliest_keeper(spark, threshold):
    """Many equal scores, scores at the threshold itself, and rows that are not near themselves; several blocks of keepers."""
    rng = np.random.default_rng(11)
    v = rng.integers(-1, 2, (150, 4)).astype(float)
    order = rng.permutation(150)
    df = spark.createDataFrame([(int(i), str(i), v[i].tolist()) for i in order], "pos long, image_id string, vector array<double>")
    expect = sequential(list(v), lambda a, b: float(a @ b), lambda s: s >= threshold, lambda s, t: s > t)
    led = leaders.lead(df.select("pos", "image_id"), leaders.similarity_edges(df, threshold, 8), best_is_least=False, own=9.0).collect()
    assert {r["pos"]: (r["keeper_pos"], r["value"]) for r in led} == {i: (k, 9.0 if s is None else s) for i, (k, s) in expect.items()}


def test_far_hamming_edges_follow_the_rows(spark):
    """Beyond the bands' distance: one edge for each member, not for each pair."""
    rng = random.Random(7)
    hashes = ["0" * 16] + [f"{sum(1 << b for b in rng.sample(range(64), 6)):016x}" for _ in range(299)]
    df = spark.createDataFrame([(i, str(i), h) for i, h in enumerate(hashes)], "pos long, image_id string, hash string")
    edges = leaders.hamming_edges(df, 18).collect()
    assert len(edges) == 299 and {(e["early"], e["value"]) for e in edges} == {(0, 6.0)}


def test_no_vectors(spark):
    df = spark.createDataFrame([("a", 0, None)], "image_id string, _pos long, embedding array<double>")
    assert duplicates.semantic_groups(df, 0.3).first()["semantic_duplicate_count"] == 1


def test_pairs_and_relation(spark):
    df = spark.createDataFrame([("first", 0, "h1"), ("unique", 1, "h2"), ("second", 2, "h1"), ("none", 3, "")], "image_id string, _pos long, content_hash string")
    grouped = duplicates.exact_groups(df)
    assert {r["image_id"]: (r["exact_duplicate_group_id"], r["exact_duplicate_count"]) for r in grouped.collect()} == {"first": ("exact-h1", 2), "second": ("exact-h1", 2), "unique": ("", 1), "none": ("", 1)}
    rel = duplicates.relation(duplicates.exact_pairs(grouped), "exact_duplicate", "exact_duplicate_group_id", "duplicate_group_computer")
    assert rel.columns == list(duplicates.RELATION) and [(r["source_image_id"], r["target_image_id"]) for r in rel.collect()] == [("first", "second")]


def test_large_groups_are_joined_apart(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(str(i), i, rng.choice(["a", "a", "a", "b", f"u{i}", ""])) for i in range(200)], "image_id string, _pos long, content_hash string")
    key = lambda d: sorted(map(tuple, d.collect()))
    one = key(duplicates.exact_groups(df))
    checked = key(evaluate(duplicates.exact_groups(df), [CHECKS["exact_duplicate"].configured()]))
    monkeypatch.setattr(grouping, "LARGE", 50)
    assert key(duplicates.exact_groups(df)) == one
    assert key(evaluate(duplicates.exact_groups(df), [CHECKS["exact_duplicate"].configured()])) == checked
