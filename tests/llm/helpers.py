"""Small document tables with the cases that every operator must bear."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, shard string, hash string"

ODD_TEXTS = [
    None, "", " ", "\n\n  \n", "one", "Don't we'll  see 12 345,6!", "naïve café — “quoted” 東京は日本", "🙂🙂 family 👨‍👩‍👧", "x" * 5000,
    "a\tb\r\nc\x0bd\x0ce\x1ff", "<|endoftext|> inside <|endoftext|>x", "mail a.b@c-d.example.org, ip 10.0.0.1 and 300.1.1.1; +1 (017) 555-7713",
    "<unk> <s> </s> ▁▁ ▁", "1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112", "word " * 3000,
]


def docs(spark, texts=ODD_TEXTS, repeat=True):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src", None if t is None else len(t), "clash", "clash", None) for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[5], rows[5], (None, "a row without an id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
