import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.errors import ConflictError, NameConflictError, NotFoundError, ValidationError
from tidepool.sources.storage import Prefix
from tidepool.versions import Manager, ModelDefinition, ModelRegistry
from tidepool.versions.rows import check_once, merged

SCORE = T.StructField("score", T.LongType(), True)


def asset(i):
    return "sha256:" + hashlib.sha256(str(i).encode()).hexdigest()


@pytest.fixture()
def repo(spark, tmp_path):
    r = Manager(spark, f"file://{tmp_path}/m").create_repo("Main")
    r.bind_prefix(Prefix("p", "store", "file", f"file://{tmp_path}/s"))
    return r


def rows(spark, ids, score=1, **tags):
    return spark.createDataFrame([(asset(i), "p", f"f/{i}", None, tags.get("tags", []), score) for i in ids], "asset_id string, storage_prefix_id string, relative_path string, source_uri string, tag_ids array<string>, score long")


def test_names(spark, repo):
    m = repo.manager
    with pytest.raises(NameConflictError):
        m.create_repo(" main ")
    assert m.list_repos() == ["Main"] and m.open_repo("MAIN").path == repo.path
    repo.create_dataset("Cats")
    with pytest.raises(NameConflictError):
        repo.create_dataset("cats")
    with pytest.raises(NotFoundError):
        repo.open_dataset("dogs")
    assert repo.open_dataset("CATS").branches() == ["main"]


def test_commits(spark, repo):
    d = repo.create_dataset("d", [SCORE])
    empty = d.open_branch()
    one = d.commit(empty, rows(spark, [1, 2]), "upsert", checkpoint="v1")
    assert (one.inserted, one.updated, one.removed) == (2, 0, 0)
    with pytest.raises(ConflictError):
        d.commit(empty, rows(spark, [3]))
    patch = d.commit(one.view, rows(spark, [1], 9).select("asset_id", "score"), "patch", fields=["score"])
    assert (patch.inserted, patch.updated) == (0, 1) and patch.view.get_row(asset(1))["score"] == 9
    same = d.commit(patch.view, rows(spark, [2]))
    assert not same.changed and same.view == patch.view
    replaced = d.commit(patch.view, rows(spark, [2, 3]), "replace")
    assert (replaced.inserted, replaced.removed) == (1, 1) and replaced.view.count() == 2
    added = d.commit(replaced.view, rows(spark, [4]), add=[T.StructField("note", T.StringType(), True)], checkpoint="v2")
    assert d.open_checkpoint("v1").frame(["asset_id", "note"]).where("note is null").count() == 2
    back = d.rollback(added.view, "v1")
    assert back.count() == 2 and d.open_branch().snapshot == back.snapshot
    with pytest.raises(ConflictError):
        d.rollback(back, "v2")
    assert [r["asset_id"] for r in added.view.get_rows([asset(4), asset(99)])] == [asset(4)]
    with pytest.raises(NotFoundError):
        added.view.get_row(asset(99))


def test_rejected_rows(spark, repo):
    d = repo.create_dataset("d", [SCORE])
    v = d.commit(d.open_branch(), rows(spark, [1])).view
    bad = [(rows(spark, [2, 2]), {}), (rows(spark, [2]).drop("relative_path"), {}), (rows(spark, [2]).withColumnRenamed("score", "odd"), {}), (rows(spark, [2], tags=["t_x"]), {}), (rows(spark, [2]).replace("p", "q"), {}), (rows(spark, [7]).select("asset_id", "score"), {"mode": "patch", "fields": ["score"]}), (rows(spark, [1]), {"mode": "patch", "fields": ["relative_path"]}), (rows(spark, [1]), {"mode": "odd"}), (rows(spark, [1]), {"fields": ["score"]}), (rows(spark, [2]), {"add": [T.StructField("score", T.StringType(), True)]}), (rows(spark, [2]), {"add": [T.StructField("x", T.StringType(), False)]}), (rows(spark, [2]), {"verify": "submitted"})]
    for frame, more in bad:
        with pytest.raises(ValidationError):
            d.commit(v, frame, **more)
    assert d.open_branch().snapshot == v.snapshot


def test_a_commit_evaluates_its_frame_once(spark, repo):
    d = repo.create_dataset("d", [SCORE])
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    count = F.udf(counted, "long").asNondeterministic()
    one = d.commit(d.open_branch(), rows(spark, range(6)).withColumn("score", count("score")))
    assert seen.value == 6 and one.inserted == 6
    two = d.commit(one.view, rows(spark, [1, 2], 5).select("asset_id", count("score").alias("score")), "patch", fields=["score"])
    assert seen.value == 8 and (two.inserted, two.updated, two.removed) == (0, 2, 0)


def test_a_first_commit_joins_nothing(spark, repo):
    d = repo.create_dataset("d", [SCORE])
    plan = merged(d.open_branch().frame(), rows(spark, [1]), "upsert")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_faults_are_named_and_leave_nothing(spark, repo, monkeypatch):
    d = repo.create_dataset("d", [SCORE])
    v = d.commit(d.open_branch(), rows(spark, [1, 2, 3])).view
    patch = {"mode": "patch", "fields": ["score"]}
    few = lambda *ids: rows(spark, ids, 4).select("asset_id", "score")
    for frame, more, said in [(few(1, 7), patch, "is not in main"), (few(1, 2, 2), patch, "is there twice"), (few(7, 7), patch, "is there twice"), (rows(spark, [4, 4]), {}, "is there twice"), (rows(spark, [1]).replace("p", "q"), {}, "not bound"), (few(1).withColumn("asset_id", F.lit(None).cast("string")), patch, "not a digest")]:
        with pytest.raises(ValidationError, match=said):
            d.commit(v, frame, **more)
    assert d.recover() == []
    # Ids whose hashes are equal are told apart.
    monkeypatch.setattr("tidepool.versions.rows.F.xxhash64", lambda c: F.lit(1).cast("long"))
    assert d.commit(v, few(1, 2), **patch).updated == 2
    with pytest.raises(ValidationError, match="is there twice"):
        check_once(few(1, 2, 2))


def test_branches_clone_materialize(spark, repo):
    d = repo.create_dataset("d", [SCORE])
    v = d.commit(d.open_branch(), rows(spark, [1, 2])).view
    b = d.create_branch(v, "work")
    w = d.commit(b, rows(spark, [3])).view
    assert d.open_branch().count() == 2 and w.count() == 3
    d.create_checkpoint(w, "c")
    for name in ("c", "work"):
        with pytest.raises(NameConflictError):
            d.create_checkpoint(w, name)
    copy = d.clone(w, "copy")
    assert copy.open_branch().count() == 3 and len(copy.snapshots()) == 1
    part = d.materialize(w, w.frame().where(f"asset_id = '{asset(3)}'"), "part", checkpoint="first")
    assert part.open_checkpoint("first").count() == 1
    with pytest.raises(ValidationError):
        d.materialize(v, rows(spark, [77]), "none")
    assert d.recover() == []


def test_tags(spark, repo):
    t = repo.create_tag("red")
    with pytest.raises(NameConflictError):
        repo.create_tag(" RED")
    d = repo.create_dataset("d", [SCORE])
    v = d.commit(d.open_branch(), rows(spark, [1], tags=[t, t])).view
    assert v.get_row(asset(1))["tag_ids"] == [t]
    repo.rename_tag(t, "crimson")
    repo.archive_tag(t)
    assert repo.tags() == {t: "crimson"} and repo.tags(archived=False) == {}
    with pytest.raises(ValidationError):
        d.commit(v, rows(spark, [2], tags=[t]))


def test_vectors(spark, repo):
    models = ModelRegistry()
    m = models.register(ModelDefinition("m", "toy", "x", "1", 2))
    models.provide("toy", lambda d: lambda data: np.array([[len(x), 1] for x in data], np.float32))
    f = repo.create_vector_field("look", "m", m.fingerprint, 2, "l2")
    assert repo.create_vector_field("look", "m", m.fingerprint, 2, "l2") == f
    with pytest.raises(NameConflictError):
        repo.create_vector_field("Look", "m", m.fingerprint, 3, "l2")
    data = [b"a", b"bb", b"ccc"]
    assets = spark.createDataFrame([("sha256:" + hashlib.sha256(x).hexdigest(), bytearray(x)) for x in data], "asset_id string, content binary")
    model = lambda xs: np.array([[len(x), 1] for x in xs], np.float32)
    assert repo.generate_vectors("look", assets.limit(2), model) == {"generated": 2, "updated": 0, "skipped": 0}
    assert repo.generate_vectors("look", assets, model) == {"generated": 1, "updated": 0, "skipped": 2}
    assert repo.generate_vectors("look", assets, model, overwrite=True) == {"generated": 0, "updated": 3, "skipped": 0}
    one = assets.first()["asset_id"]
    assert repo.get_vectors("look", [one, "none"]) == {one: [1.0, 1.0]}
    with pytest.raises(Exception, match="finite|numbers"):
        repo.generate_vectors("look", assets, lambda xs: np.zeros((len(xs), 5), np.float32), overwrite=True)
    assert repo.current_vectors("look").count() == 3
    assert models.runtime("m")([b"xy"]).tolist() == [[2.0, 1.0]]
    with pytest.raises(NameConflictError):
        models.register(ModelDefinition("m", "toy", "x", "2", 2))


def test_a_patch_moves_few_bytes(spark):
    """Bytes shuffled an order where no join is small enough to be sent to all tasks, as over larger tables."""
    import __spark_entry__ as entry

    sc, sf_dir, off = spark.sparkContext._jsc.sc(), "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = moved()
    spark.conf.set(off, "-1")
    try:
        r = entry.queries()["dataset_patch_counts"](spark, sf_dir).first()
    finally:
        spark.conf.unset(off)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert (r["inserted"], r["updated"], r["removed"]) == (0, orders // 10, 0)
    assert 0 < moved() - before < 300 * orders
