import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, shard int"


def brute(rows, step=50, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok, out = [(i, v) for i, v in ok if len(v)], []
    for n_q, (q, v) in enumerate(ok):
        if q % step == 0:
            best = sorted(((-int(v @ w), i) for n, (i, w) in enumerate(ok) if n != n_q and len(w) == len(v)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, **settings):
    return sorted(map(tuple, top_k.top_k(df, F.col("vec_id") % 50 == 0, **settings).collect()))


def test_against_brute_force_with_many_small_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.standard_normal(8)).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # ties
    rows += [(5000, None), (5050, [None] * 8), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)
    expect = brute(rows)
    assert found(df) == expect
    assert found(df, shard=60, block=4) == expect


def test_repeated_ids_and_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 120, rng.standard_normal(3 if i % 4 else 5).round(2).tolist()) for i in range(300)] + [(50, [1.0, 2.0, 3.0])] * 3 + [(100, []), (150, [1.0] * 9)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)
    assert found(df) == found(df, shard=40, block=3) == brute(rows)


def test_scores_that_would_not_be_exact_are_refused(spark):
    df = spark.createDataFrame([(0, [1e17, 2.0], 0, 0), (7, [1e17, 0.5], 0, 0)], SCHEMA)
    with pytest.raises(OverflowError):
        top_k.top_k(df, F.col("vec_id") % 50 == 0)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, 0), (7, [0.5, 0.5], 0, 0)], SCHEMA)
    assert found(df) == [(0, 1, 7, 128 * 256 + 128 * 512)]
    assert found(df.limit(0)) == []


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, top_k.query(spark, "/root/testdata/sf0.01").collect())) == sorted(con.sql(top_k.SQL).fetchall())


def test_branch_and_bound_leaves_out_vectors():
    rng = np.random.default_rng(1)
    v = np.concatenate([np.floor(256 * (c + 0.02 * rng.standard_normal((500, 16)))) for c in rng.standard_normal((16, 16))])
    best = top_k.Best(1, 5)
    assert top_k.search(top_k.BallTree(np.arange(len(v)), np.arange(len(v)), v), np.array([-1]), v[:1], best) < len(v) / 2
