import random

import duckdb

from tidepool.llm import _common, decontaminate

from .helpers import docs


def items(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "item_id bigint, text string, shard string")


def best_overlap(doc, item):
    """Most matches along any offset, by brute force with the operator's rule."""
    d, t = decontaminate.tokens(doc or ""), decontaminate.tokens(item or "")
    found = 0
    for shift in range(-len(t) + 1, len(d)):
        same = [d[i + shift] == t[i] for i in range(len(t)) if 0 <= i + shift < len(d)]
        score, start, best = 0, 0, (0, 0, 0)
        for i, s in enumerate(same):
            score += 1 if s else -2
            if score > best[0]:
                best = (score, start, i + 1)
            if score < 0:
                score, start = 0, i + 1
        run = same[best[1] : best[2]]
        if sum(run) >= min(decontaminate.MIN_MATCHES, -(-7 * len(t) // 10)) and sum(run) >= 0.7 * len(run):
            found = max(found, sum(run))
    return found


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    tests = [text(rng.randint(15, 50)) for _ in range(25)] + [None, "", "too short", text(10)]
    rows = [text(rng.randint(1, 200)) for _ in range(60)] + [None, ""]
    for t in tests[:25]:
        w = t.split()
        for edits in (0, 1, 2, 3):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = "ZZZ"
            rows.append(text(rng.randint(0, 60)) + " " + ", ".join(v).upper() + ". " + text(rng.randint(0, 60)))
    return rows, tests


def test_leaks_against_brute_force(spark):
    rows, tests = corpus(random.Random(4))
    found = {(r["doc_id"], r["item_id"]): r["n_matches"] for r in decontaminate.leaks(docs(spark, rows, repeat=False), items(spark, tests)).collect()}
    expect = {(i, j): n for i, d in enumerate(rows) for j, t in enumerate(tests) if (n := best_overlap(d, t))}
    assert found.items() <= expect.items()
    missed = expect.keys() - found.keys()  # seeds need some kept positions unbroken
    assert len(missed) <= 0.05 * len(expect)
    assert all(i >= 62 for i, _ in found)


def test_clean_keeps_the_rest(spark):
    rows, tests = corpus(random.Random(5))
    df = docs(spark, rows)
    out = decontaminate.clean(df, items(spark, tests))
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} >= set(range(62)) | {None}
    assert not {r["doc_id"] for r in out.collect()} & {62 + 4 * k for k in range(25)}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows, tests = corpus(random.Random(6))
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["n_matches"]) for r in df.collect())
    one = key(decontaminate.leaks(docs(spark, rows, repeat=False), items(spark, tests)))
    monkeypatch.setattr(_common, "LEAST_BITS", 1 << 8)
    monkeypatch.setattr(_common, "MOST_BITS", 1 << 8)
    assert key(decontaminate.leaks(docs(spark, rows, repeat=False), items(spark, tests))) == one


def test_short_items_are_found_as_whole_lines(spark):
    rows = ["What is it?\nnobody knows", "say what is it now", "first line here\r\n  WHAT -- is, it \nlast", "one two three four five six seven", "x", None, "what is\nit"]
    found = sorted(map(tuple, decontaminate.leaks(docs(spark, rows, repeat=False), items(spark, ["what is it", "One two, three four five six seven!", "", None, "say what"])).drop("text_hash").collect()))
    with duckdb.connect() as con:
        con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
        con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(["what is it", "One two, three four five six seven!", "", None, "say what"])))
        assert sorted(con.sql(decontaminate.SQL).fetchall()) == found
    assert found == [(0, 0, 0, 0, 3, 3, 1.0), (2, 0, 3, 0, 3, 3, 1.0), (3, 1, 0, 0, 7, 7, 1.0)]


def test_columns_with_the_operators_names(spark):
    rows, tests = corpus(random.Random(8))
    df = docs(spark, rows).withColumns({n: decontaminate.F.lit(1) for n in ("leak_id", "_leak_id", "leak_hash", "item_id", "h", "words", "region")})
    out = decontaminate.clean(df, items(spark, tests))
    assert out.columns == df.columns and out.count() == decontaminate.clean(docs(spark, rows), items(spark, tests)).count()


def test_recall_against_all_places_without_masks():
    """Random overlaps that count by the rule, from seeds or not; at least nine of ten hold a seed."""
    rng = random.Random(2)
    held = counted = 0
    for _ in range(4000):
        n, identity = rng.randint(13, 60), rng.uniform(0.7, 1.0)
        same = [rng.random() < identity for _ in range(n)]
        a, b, m = decontaminate.best_run(decontaminate.np.array(same))
        if m < decontaminate.MIN_MATCHES or m < decontaminate.MIN_IDENTITY * (b - a):
            continue
        counted += 1
        held += any(all(same[i + j] for j, c in enumerate(f) if c == "1") for f in decontaminate.MASKS for i in range(n - len(f) + 1))
    assert counted > 1000 and held >= 0.9 * counted, held / counted


def test_empty_tables(spark):
    some, none = docs(spark), docs(spark).limit(0)
    assert decontaminate.leaks(none, items(spark, ["a b c d e f g h i j k l m n o p"])).count() == 0
    assert decontaminate.clean(some, items(spark, ["x"]).limit(0)).count() == some.count()
