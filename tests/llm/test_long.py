"""One very long text among short ones, and rows of every odd kind, through operators and stages."""

import random

import public_tokenizers as P
import pytest

import corpus_pipeline
from tidepool.llm import bpe, decontaminate, language_id, lm_scores, near_join, pii, quality, sharding, token_counts

from .helpers import docs

RNG = random.Random(8)
LONG = " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 7))) for _ in range(60_000))
TEXTS = ["short text", LONG, LONG + " end", "a" * 1_000_000, None]


@pytest.fixture(scope="module")
def rows(spark):
    return docs(spark, TEXTS, repeat=False).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(
    "run",
    [
        lambda d: bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json"), P.PATTERN),
        lambda d: sharding.shard(d)[0],
        lambda d: near_join.join(d),
        lambda d: pii.find(d),
        lambda d: lm_scores.lm_scores(d),
        lambda d: language_id.identify(d, d.sparkSession.createDataFrame([], "page_id long, url string, html string")),
    ],
)
def test_each_row_has_a_result(rows, run):
    assert run(rows).count() == len(TEXTS)


def test_near_copies_and_leaks_of_long_texts(spark, rows, labels):
    classes = {r["doc_id"]: r["class_id"] for r in near_join.join(rows).collect()}
    assert classes == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
    item = spark.createDataFrame([(7, " ".join(LONG.split()[40_000:40_030]))], "item_id long, text string")
    assert {(r["doc_id"], r["doc_start"]) for r in decontaminate.leaks(rows, item).collect()} == {(1, 40_000), (2, 40_000)}
    assert quality.judged(rows, labels).count() == len(TEXTS)


def test_stages_on_odd_rows(spark, tmp_path):
    df = docs(spark)
    df.sparkSession.createDataFrame([(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (None, ""), (1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        n = out.count()
        if name in ("personal_data", "decontamination", "byte_bpe"):
            assert n == df.count(), name
        if name != "byte_bpe":
            assert out.columns == df.columns, name
            assert {0, 1, 2, 3} <= {r["doc_id"] for r in out.collect()} or name == "quality"
