import base64

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidepool.llm import decontaminate, pii, quality
from tidepool.llm._common import table

from .test_near_join import brute

SF = "/root/testdata/sf0.001"


def test_the_rows_are_those_of_plain_stages(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    bad = {r["doc_id"] for r in quality.judged(table(spark, SF, "documents"), table(spark, SF, "labels")).where("not keep").collect()}
    left = sorted(docs.keys() - bad)
    found = brute([docs[i]["text"] for i in left])
    left = [i for n, (i, (_, top)) in enumerate(zip(left, found, strict=True)) if top == n]
    tests = [decontaminate.tokens(r["text"]) for r in table(spark, SF, "benchmark").collect()]

    def leaks(text):
        words = decontaminate.tokens(text)
        at = {w: [i for i, x in enumerate(words) if x == w] for w in {t[0] for t in tests}}
        return any(words[i : i + len(t)] == t for t in tests for i in at[t[0]])

    left = [i for i in left if not leaks(docs[i]["text"])]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expect = {}
    for i in left:
        text = docs[i]["text"]
        expect[i] = len(lib.encode_ordinary(pii.masked(text, pii.selector().select(text, pii.base_spans(text)))))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expect and 0 < len(got) < len(docs)


def test_nothing_but_the_result_is_left_in_the_shared_folder(spark):
    import pathlib

    from tidepool.storing import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    corpus_pipeline.run(spark, SF).count()
    quality.query(spark, SF).count()
    assert sorted(p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before) == ["pipeline-byte_bpe", "quality"]


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_quality_stage_learns_from_every_trusted_document(spark, tmp_path):
    """A form of text that 20 of 8,000 trusted documents have, all of them beyond the sample of 4,000 that was once trained on, is kept."""
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    beyond = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) >= 1 << 29).select("doc_id", quality.fold().alias("f")).orderBy("doc_id").collect()
    rare = {r["doc_id"] for f in (0, 1) for r in [r for r in beyond if r["f"] == f][:10]}
    words = "the cat sat on that mat and then hid under a red hat near my old bed".split()
    say = lambda i: " ".join(words[(i * 7 + j * j * (1 + i % 5)) % len(words)] for j in range(20))
    docs = spark.createDataFrame([(i, "zq xj wv " * 12 if i in rare else say(i) + chr(0x4E00 + i) * (i % 80 == 0), "en") for i in range(8000)], "doc_id long, text string, lang string")
    ids.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert rare <= {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()}
