import zlib
from collections import Counter, defaultdict

from tidepool.llm import sharding

from .helpers import ODD_TEXTS, docs


def test_places_of_odd_rows(spark):
    placed, places = sharding.shard(docs(spark), shards=4, slots=64)
    rows = placed.collect()
    assert len(rows) == docs(spark).count()
    inside = defaultdict(list)
    for r in rows:
        inside[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            raw = (ODD_TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for slots in inside.values():
        assert sorted(slots) == list(range(len(slots)))
    assert sum(places.loads()) == sum(r["size"] for r in rows)


def test_sizes_are_near_equal(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed, places = sharding.shard(d)
    load = Counter()
    for r in placed.collect():
        load[r["shard"]] += r["size"]
    assert sorted(load.values()) == sorted(places.loads())
    assert len(load) == 16 and max(load.values()) <= 1.01 * min(load.values())


def test_rebalancing_edits_the_map(spark, tmp_path):
    rows = sharding.records(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    first = sharding.make_map(sharding.slot_totals(rows))
    grown = first.rebalanced(17)
    loads = grown.loads()
    assert grown.version == 2 and max(loads) <= 1.05 * sum(loads) / 17
    assert all(a == b for i, (a, b) in enumerate(zip(first.shard_of, grown.shard_of, strict=True)) if i not in set(grown.moved))
    assert {grown.shard_of[i] for i in grown.moved} == {16}
    for m in (first, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 2) == grown and sharding.SlotMap.versions(spark, str(tmp_path / "map")) == [1, 2]


def test_a_stored_map_is_found_again_and_edited(spark, tmp_path):
    d, store = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "map")
    one, first = sharding.shard(d, store=store)
    two, again = sharding.shard(d, store=store)
    assert again == first and sorted(one.collect()) == sorted(two.collect())
    more = d.union(d.where("doc_id < 300").withColumns({"doc_id": sharding.F.col("doc_id") + 10**6}))
    placed, edited = sharding.shard(more, store=store)
    assert edited.version == 2 and sharding.SlotMap.versions(spark, store) == [1, 2]
    kept = [i for i in range(sharding.SLOTS) if i not in set(edited.moved)]
    assert all(first.shard_of[i] == edited.shard_of[i] for i in kept) and len(edited.moved) < 0.2 * 1300
    loads = edited.loads()
    assert sum(loads) == placed.agg(sharding.F.sum("size")).first()[0] and max(loads) <= 1.02 * sum(loads) / 16


def test_a_shard_without_slots_is_kept(spark, tmp_path):
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    _, places = sharding.shard(few, shards=5, slots=8, store=str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == places and places.shards == 5


def test_equal_rows_and_ties(spark):
    rows = spark.createDataFrame([(7, "same")] * 5 + [(None, "same")] * 2 + [(i, "x" * 9) for i in range(40)], "doc_id long, text string")
    placed = sharding.shard(rows, shards=3, slots=16)[0].collect()
    assert len(placed) == 47 and len({(r["shard"], r["slot"]) for r in placed}) == 47
    assert len({r["shard"] for r in placed if r["doc_id"] == 7}) == 1


def test_empty_table(spark):
    placed, places = sharding.shard(docs(spark).limit(0))
    assert placed.count() == 0 and places.loads() == [0] * 16


def test_no_python_in_the_plan(spark):
    plan = sharding.shard(docs(spark))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
