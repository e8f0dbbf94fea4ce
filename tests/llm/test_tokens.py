import base64
import hashlib

import public_tokenizers as P
import pytest

from tidepool.llm import bpe, token_counts

from .helpers import ODD_TEXTS, by_id, docs

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sample(sf="sf0.001"):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '/root/testdata/{sf}/documents.parquet' order by doc_id").fetchall()]


def test_ids_are_those_of_the_library():
    own, lib = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN), library()
    for text in [t or "" for t in ODD_TEXTS] + sample()[:100]:
        (ids,) = own.encode([text])
        assert ids.tolist() == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_token_survives_as_a_pre_token():
    own, lib = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN), library()
    for token in list(own.whole)[::7]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert own.encode([text])[0].tolist() == lib.encode_ordinary(text)


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 10)
    own, text = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN), " ".join(sample()[:3])
    assert own.encode([text])[0].tolist() == library().encode_ordinary(text)


def test_round_trip_over_odd_rows(spark):
    out = bpe.digests(bpe.round_trip(docs(spark), RANKS, P.PATTERN))
    assert out.count() == docs(spark).count()
    found, lib = by_id(out), library()
    for i, text in enumerate(ODD_TEXTS):
        ids = lib.encode_ordinary(text or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("op", [lambda d: bpe.round_trip(d, RANKS, P.PATTERN), lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json"), P.PATTERN)])
def test_empty_table(spark, op):
    assert op(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [200_000, 50, 0])
def test_counts_are_those_of_the_library(spark, monkeypatch, frequent):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD_TEXTS, *sample()[:150]]
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    out = token_counts.count_tokens(docs(spark, texts), P.path("byte_bpe_50k.json"), P.PATTERN)
    assert out.count() == docs(spark, texts).count()
    found = by_id(out)
    for i, text in enumerate(texts):
        assert found[i]["n_bytes"] == len((text or "").encode())
        assert found[i]["n_tokens"] == len(lib.encode(text or "", add_special_tokens=False).ids), text


def test_pieces_are_counted_once_for_each_pre_token(spark):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = f.read()
    words = token_counts.with_pieces(token_counts.distinct(docs(spark), file, P.PATTERN), file).collect()
    assert len({r["w"] for r in words}) == len(words) == len({(r["g"], r["h"]) for r in words})
    assert {r["w"]: r["c"] for r in words}[" see"] == 3  # a row and its two copies


def test_the_least_count_of_frequent_rows(spark):
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([900, 500, 500, 40, 3, 3, 3, 1])], "i int, c long")
    for most, reach in ((0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (6, 4), (7, 7), (8, 8)):
        assert counts.where(token_counts.F.col("c") >= token_counts.least_frequent(counts, most)).count() == reach
    assert token_counts.least_frequent(counts.limit(0), 5) == 1
