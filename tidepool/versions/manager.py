"""Repositories and datasets as folders of Parquet snapshots and a log of small JSON states.

A dataset's state (branches, checkpoints, snapshots, schema) is a numbered file that is created exclusively: a commit writes its
snapshot first and then the next state, so that readers see it wholly or not at all, and of two commits one fails. Snapshots that no
state names are left over from failed commits and can be removed (`recover`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AuthorizationError, ConflictError, NameConflictError, NotFoundError, ValidationError
from ..sources.storage import Prefix, Storage, unverified
from ..storing import JsonFiles
from . import vectors as vec
from .rows import BAD, KEY, OUTSIDE, SYSTEM, add_fields, check_once, check_rows, conform, counters, faults, merged, name_key, outside, relaxed

MAIN = "main"


@dataclass
class _Log:
    """Numbered JSON states in a folder."""

    files: JsonFiles
    path: str

    def read(self) -> tuple[int, dict]:
        names = [n for n in self.files.names(self.path) if n.endswith(".json")]
        if not names:
            raise NotFoundError(self.path)
        return int(names[-1].split(".")[0]), self.files.read(f"{self.path}/{names[-1]}")

    def write(self, after: int, state: dict) -> None:
        self.files.write_new(f"{self.path}/{after + 1:012d}.json", state)


@dataclass(frozen=True)
class CommitResult:
    view: View
    changed: bool
    inserted: int
    updated: int
    removed: int


class Manager:
    """All repositories under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), JsonFiles(spark)

    def create_repo(self, name: str) -> Repository:
        key = name_key(name)
        if any(name_key(n) == key for n in self.list_repos()):
            raise NameConflictError(name)
        path = f"{self.root}/r_{uuid.uuid4().hex[:12]}"
        self.files.write_new(f"{self.root}/names/{_safe(key)}.json", {"name": name, "path": path})
        _Log(self.files, f"{path}/log").write(0, {"name": name, "datasets": {}, "tags": {}, "vector_fields": {}, "prefixes": {}})
        return Repository(self, path)

    def list_repos(self) -> list[str]:
        return sorted(self.files.read(f"{self.root}/names/{n}")["name"] for n in self.files.names(f"{self.root}/names") if n.endswith(".json"))

    def open_repo(self, name: str) -> Repository:
        at = f"{self.root}/names/{_safe(name_key(name))}.json"
        if not self.files.exists(at):
            raise NotFoundError(name)
        return Repository(self, self.files.read(at)["path"])


def _safe(key: str) -> str:
    return key.encode().hex()


@dataclass
class Repository:
    manager: Manager
    path: str

    @property
    def log(self) -> _Log:
        return _Log(self.manager.files, f"{self.path}/log")

    def state(self) -> dict:
        return self.log.read()[1]

    def _change(self, change) -> Any:
        n, state = self.log.read()
        out = change(state)
        self.log.write(n, state)
        return out

    # Storage prefixes.

    def bind_prefix(self, prefix: Prefix) -> Prefix:
        def change(state: dict) -> Prefix:
            for known in state["prefixes"].values():
                if known == asdict(prefix):
                    return prefix
                if known["prefix_id"] == prefix.prefix_id or name_key(known["name"]) == name_key(prefix.name):
                    raise NameConflictError(prefix.name)
            state["prefixes"][prefix.prefix_id] = asdict(prefix)
            return prefix

        return self._change(change)

    def prefixes(self) -> list[Prefix]:
        return [Prefix(**p) for p in self.state()["prefixes"].values()]

    def storage(self, prefix_id: str) -> Storage:
        found = next((p for p in self.prefixes() if p.prefix_id == prefix_id), None)
        if found is None:
            raise AuthorizationError(prefix_id)
        return Storage(self.manager.spark, found)

    # Tags.

    def create_tag(self, name: str) -> str:
        def change(state: dict) -> str:
            if any(name_key(t["name"]) == name_key(name) for t in state["tags"].values()):
                raise NameConflictError(name)
            tag_id = "t_" + uuid.uuid4().hex[:12]
            state["tags"][tag_id] = {"name": name.strip(), "archived": False}
            return tag_id

        return self._change(change)

    def rename_tag(self, tag_id: str, name: str) -> None:
        def change(state: dict) -> None:
            if tag_id not in state["tags"]:
                raise NotFoundError(tag_id)
            if any(i != tag_id and name_key(t["name"]) == name_key(name) for i, t in state["tags"].items()):
                raise NameConflictError(name)
            state["tags"][tag_id]["name"] = name.strip()

        self._change(change)

    def archive_tag(self, tag_id: str) -> None:
        def change(state: dict) -> None:
            if tag_id not in state["tags"]:
                raise NotFoundError(tag_id)
            state["tags"][tag_id]["archived"] = True

        self._change(change)

    def tags(self, archived: bool = True) -> dict[str, str]:
        return {i: t["name"] for i, t in self.state()["tags"].items() if archived or not t["archived"]}

    # Vector fields.

    def create_vector_field(self, name: str, model_id: str, fingerprint: str, dimension: int, distance: str = "cosine") -> vec.VectorField:
        new = vec.VectorField.make(name, model_id, fingerprint, dimension, distance)

        def change(state: dict) -> vec.VectorField:
            for v in state["vector_fields"].values():
                known = vec.VectorField(**v)
                if known.same(new):
                    return known
                if name_key(known.name) == name_key(name):
                    raise NameConflictError(name)
            for d in state["datasets"].values():
                columns = T.StructType.fromJson(_Log(self.manager.files, f"{d['path']}/log").read()[1]["schema"]).fieldNames()
                if name_key(name) in map(name_key, columns):
                    raise NameConflictError(f"{name} is a column of {d['name']}")
            state["vector_fields"][new.field_id] = asdict(new)
            return new

        return self._change(change)

    def vector_fields(self) -> dict[str, vec.VectorField]:
        return {v["name"]: vec.VectorField(**v) for v in self.state()["vector_fields"].values()}

    def current_vectors(self, name: str) -> DataFrame:
        """asset_id and value of a field."""
        f = self._field(name)
        log = _Log(self.manager.files, f"{self.path}/vectors/{f.field_id}/log")
        try:
            at = log.read()[1]["data"]
        except NotFoundError:
            return self.manager.spark.createDataFrame([], "asset_id string, value array<float>")
        return self.manager.spark.read.schema("asset_id string, value array<float>").parquet(at)

    def _field(self, name: str) -> vec.VectorField:
        found = {name_key(n): f for n, f in self.vector_fields().items()}.get(name_key(name))
        if found is None:
            raise NotFoundError(name)
        return found

    def generate_vectors(self, name: str, assets: DataFrame, model, overwrite: bool = False) -> dict[str, int]:
        """Vectors of assets (asset_id, content) that have none (or of all), published together or not at all."""
        f = self._field(name)
        log = _Log(self.manager.files, f"{self.path}/vectors/{f.field_id}/log")
        try:
            n, _ = log.read()
        except NotFoundError:
            n = 0
        now = self.current_vectors(name)
        wanted = vec.targets(assets, now, overwrite)
        if bad := wanted.where(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col(KEY)).first():
            raise ValidationError(f"{bad[KEY]} has other bytes")
        data = f"{self.path}/vectors/{f.field_id}/{uuid.uuid4().hex}"
        made = vec.embed(wanted, model, f.dimension).withColumn("_new", F.lit(True))
        both = now.withColumn("_new", F.lit(False)).unionByName(made).groupBy("asset_id").agg(F.max_by("value", "_new").alias("value"), F.bool_or("_new").alias("_new"), F.count("*").alias("_n"))
        both.write.parquet(f"{data}-marked")
        marked = self.manager.spark.read.parquet(f"{data}-marked")
        marked.select("asset_id", "value").write.parquet(data)
        sums = marked.agg(F.count_if(F.expr("_new and _n = 1")).alias("generated"), F.count_if(F.expr("_new and _n > 1")).alias("updated")).first()
        log.write(n, {"data": data})
        return {"generated": sums["generated"], "updated": sums["updated"], "skipped": assets.count() - sums["generated"] - sums["updated"]}

    def get_vectors(self, name: str, assets: Sequence[str]) -> dict[str, list[float]]:
        return {r["asset_id"]: r["value"] for r in self.current_vectors(name).where(F.col("asset_id").isin(list(assets))).collect()}

    # Datasets.

    def create_dataset(self, name: str, fields: Sequence[T.StructField] = ()) -> Dataset:
        schema = add_fields(SYSTEM, fields, list(self.vector_fields()))

        def change(state: dict) -> str:
            if any(name_key(d["name"]) == name_key(name) for d in state["datasets"].values()):
                raise NameConflictError(name)
            dataset_id = "d_" + uuid.uuid4().hex[:12]
            path = f"{self.path}/{dataset_id}"
            _Log(self.manager.files, f"{path}/log").write(0, {"dataset_id": dataset_id, "schema": json.loads(schema.json()), "branches": {MAIN: None}, "checkpoints": {}, "snapshots": {}})
            state["datasets"][dataset_id] = {"name": name, "path": path}
            return path

        return Dataset(self, self._change(change))

    def list_datasets(self) -> list[str]:
        return sorted(d["name"] for d in self.state()["datasets"].values())

    def open_dataset(self, name: str) -> Dataset:
        found = next((d for d in self.state()["datasets"].values() if name_key(d["name"]) == name_key(name)), None)
        if found is None:
            raise NotFoundError(name)
        return Dataset(self, found["path"])


@dataclass(frozen=True)
class View:
    """A dataset at one snapshot; `branch` is set where it was opened from one."""

    dataset: Dataset = field(compare=False)
    snapshot: str | None
    branch: str | None = None

    def frame(self, fields: Sequence[str] | None = None, vectors: Sequence[str] = ()) -> DataFrame:
        """Rows by today's schema: columns that are newer than the snapshot are null. Vector fields are joined on demand."""
        schema = self.dataset.schema()
        spark = self.dataset.repo.manager.spark
        if self.snapshot is None:
            df = spark.createDataFrame([], relaxed(schema)).limit(0)  # which the optimizer knows to be empty: joins with it move nothing
        else:
            df = spark.read.schema(T.StructType([T.StructField(f.name, relaxed(f.dataType)) for f in schema.fields])).parquet(self.dataset.snapshots()[self.snapshot]["data"])
        for v in vectors:
            df = df.join(self.dataset.repo.current_vectors(v).withColumnRenamed("value", v), KEY, "left")
        if fields is None:
            return df
        if unknown := [f for f in fields if f not in df.columns]:
            raise ValidationError(f"unknown fields: {', '.join(unknown)}")
        return df.select(*fields)

    def count(self) -> int:
        return self.frame().count()

    def preview(self, limit: int = 20) -> DataFrame:
        return self.frame().limit(limit)

    def get_rows(self, assets: Sequence[str]) -> list[Row]:
        return self.frame().where(F.col(KEY).isin(list(assets))).collect()

    def get_row(self, asset: str) -> Row:
        if not (found := self.get_rows([asset])):
            raise NotFoundError(asset)
        return found[0]

    def read_image(self, asset: str) -> bytes:
        r = self.get_row(asset)
        return self.dataset.repo.storage(r["storage_prefix_id"]).read(r["relative_path"])

    def verify_image(self, asset: str) -> None:
        r = self.get_row(asset)
        self.dataset.repo.storage(r["storage_prefix_id"]).verify(asset, r["relative_path"])

    def rows(self):
        return self.frame().toLocalIterator()


@dataclass
class Dataset:
    repo: Repository
    path: str

    @property
    def log(self) -> _Log:
        return _Log(self.repo.manager.files, f"{self.path}/log")

    def state(self) -> dict:
        return self.log.read()[1]

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state()["schema"])

    def snapshots(self) -> dict[str, dict]:
        return self.state()["snapshots"]

    def branches(self) -> list[str]:
        return sorted(self.state()["branches"])

    def checkpoints(self) -> list[str]:
        return sorted(self.state()["checkpoints"])

    def open_branch(self, name: str = MAIN) -> View:
        found = self.state()["branches"]
        if name not in found:
            raise NotFoundError(name)
        return View(self, found[name], name)

    def open_checkpoint(self, name: str) -> View:
        found = self.state()["checkpoints"]
        if name not in found:
            raise NotFoundError(name)
        return View(self, found[name])

    def _head(self, state: dict, base: View, branch: str) -> None:
        if base.dataset.path != self.path:
            raise ValidationError("the view is of another dataset")
        if branch not in state["branches"]:
            raise NotFoundError(branch)
        if base.branch != branch or state["branches"][branch] != base.snapshot:
            raise ConflictError(f"{branch} has moved")

    def _free(self, state: dict, name: str) -> None:
        name_key(name)
        if name in state["branches"] or name in state["checkpoints"]:
            raise NameConflictError(name)

    def commit(self, base: View, frame: DataFrame, mode: str = "upsert", fields: Sequence[str] = (), add: Sequence[T.StructField] = (), checkpoint: str | None = None, verify: str = "none", message: str = "") -> CommitResult:
        """`replace` makes the rows the head, `upsert` replaces whole rows by id, `patch` sets `fields` of ids that are there.
        `verify` reads the files of the submitted rows ("submitted") or of all ("all") and compares their digests."""
        n, state = self.log.read()
        branch = base.branch or MAIN
        self._head(state, base, branch)
        if checkpoint is not None:
            self._free(state, checkpoint)
        if (mode == "patch") != bool(fields):
            raise ValidationError("fields are for patch, and patch needs them")
        old = T.StructType.fromJson(state["schema"])
        schema = add_fields(old, add, list(self.repo.vector_fields()))
        state["schema"] = json.loads(schema.json())
        known = {f.name for f in schema.fields}
        if vector := [v for v in self.repo.vector_fields() if v in frame.columns]:
            raise ValidationError(f"vectors are not committed: {', '.join(vector)}")
        if mode == "patch":
            if bad := [f for f in fields if f not in known or f in SYSTEM.fieldNames()]:
                raise ValidationError(f"cannot patch {', '.join(bad)}")
            frame = frame.select(KEY, *fields)
        new = conform(frame, schema, partial=mode == "patch")
        fault = faults(new.columns, schema, list(self.repo.state()["prefixes"]), list(self.repo.tags(archived=False)))
        now = conform(View(self, base.snapshot, branch).frame(), schema)
        changes = merged(now, new, mode, fields, fault=fault)
        snapshot = uuid.uuid4().hex
        data = f"{self.path}/data/{snapshot}"
        # The submitted frame is evaluated once; what is wrong with its rows is read from what is stored.
        changes.write.parquet(f"{data}-changes")
        changes = self.repo.manager.spark.read.schema(changes.schema).parquet(f"{data}-changes")
        try:
            self._check(changes, branch)
            if verify != "none":
                self._verify(changes.where("change != 'removed'") if verify == "all" else changes.where("change in ('inserted', 'updated', 'same')"))
        except ValidationError:
            self.repo.manager.files.remove(f"{data}-changes")
            raise
        sums = counters(changes).first()
        if not any(sums) and schema == old and checkpoint is None:
            self.repo.manager.files.remove(f"{data}-changes")
            return CommitResult(base, False, 0, 0, 0)
        changes.where("change != 'removed'").drop("change").repartitionByRange(F.col(KEY)).sortWithinPartitions(KEY).write.parquet(data)
        self.repo.manager.files.remove(f"{data}-changes")
        state["snapshots"][snapshot] = {"parent": base.snapshot, "data": data, "mode": mode, "message": message, "at": datetime.now(UTC).isoformat(), "counts": sums.asDict()}
        state["branches"][branch] = snapshot
        if checkpoint is not None:
            state["checkpoints"][checkpoint] = snapshot
        self.log.write(n, state)
        return CommitResult(View(self, snapshot, branch), True, sums["inserted"], sums["updated"], sums["removed"])

    def _check(self, changes: DataFrame, branch: str) -> None:
        if row := changes.where(F.col("change").startswith(BAD)).first():
            raise ValidationError(f"{row[KEY]}: {row['change'].removeprefix(BAD)}")
        check_once(changes.where(F.col("change").isin("inserted", "updated", "same", OUTSIDE)).select(KEY))
        if row := changes.where(F.col("change") == OUTSIDE).first():
            raise ValidationError(f"{row[KEY]} is not in {branch}")

    def _verify(self, rows: DataFrame) -> None:
        for p in self.repo.prefixes():
            if bad := unverified(rows.where(F.col("storage_prefix_id") == p.prefix_id).select(KEY, "relative_path"), p.root).first():
                raise ValidationError(f"{bad[KEY]}: the file is missing or has other bytes")

    def create_checkpoint(self, view: View, name: str) -> View:
        n, state = self.log.read()
        if view.branch is not None:
            self._head(state, view, view.branch)
        if view.snapshot is None:
            raise ValidationError("there is nothing to mark yet")
        self._free(state, name)
        state["checkpoints"][name] = view.snapshot
        self.log.write(n, state)
        return View(self, view.snapshot)

    def create_branch(self, view: View, name: str) -> View:
        n, state = self.log.read()
        self._free(state, name)
        state["branches"][name] = view.snapshot
        self.log.write(n, state)
        return View(self, view.snapshot, name)

    def rollback(self, base: View, checkpoint: str) -> View:
        """Moves the branch back to a checkpoint among its ancestors."""
        n, state = self.log.read()
        branch = base.branch or MAIN
        self._head(state, base, branch)
        if checkpoint not in state["checkpoints"]:
            raise NotFoundError(checkpoint)
        target, at = state["checkpoints"][checkpoint], base.snapshot
        while at is not None and at != target:
            at = state["snapshots"][at]["parent"]
        if at is None:
            raise ConflictError(f"{checkpoint} is not an ancestor of {branch}")
        state["branches"][branch] = target
        self.log.write(n, state)
        return View(self, target, branch)

    def clone(self, view: View, name: str) -> Dataset:
        """A new dataset of the repository with the view's schema and rows and no history; the data is shared, not copied."""
        if view.snapshot is None:
            raise ValidationError("an empty view cannot be cloned")
        new = self.repo.create_dataset(name, [f for f in self.schema().fields if f.name not in SYSTEM.fieldNames()])
        n, state = new.log.read()
        snapshot = uuid.uuid4().hex
        state["snapshots"][snapshot] = {"parent": None, "data": self.snapshots()[view.snapshot]["data"], "mode": "clone", "message": "", "at": datetime.now(UTC).isoformat(), "counts": {}}
        state["branches"][MAIN] = snapshot
        new.log.write(n, state)
        return new

    def materialize(self, view: View, frame: DataFrame, name: str, checkpoint: str | None = None) -> Dataset:
        """A new dataset of a derived table whose rows are assets of the view at the same places."""
        where = [KEY, "storage_prefix_id", "relative_path"]
        if missing := [c for c in where if c not in frame.columns]:
            raise ValidationError(f"missing columns: {', '.join(missing)}")
        if extra := outside(frame.select(*where), view.frame(where), where).first():
            raise ValidationError(f"{extra[KEY]} is not in the source at this place")
        new = self.repo.create_dataset(name, [T.StructField(f.name, f.dataType, True) for f in frame.schema.fields if f.name not in SYSTEM.fieldNames()])
        rows = conform(frame, new.schema())
        check_rows(rows, new.schema())
        n, state = new.log.read()
        snapshot = uuid.uuid4().hex
        rows.write.parquet(f"{new.path}/data/{snapshot}")
        state["snapshots"][snapshot] = {"parent": None, "data": f"{new.path}/data/{snapshot}", "mode": "materialize", "message": "", "at": datetime.now(UTC).isoformat(), "counts": {}}
        state["branches"][MAIN] = snapshot
        if checkpoint:
            state["checkpoints"][checkpoint] = snapshot
        new.log.write(n, state)
        return new

    def recover(self) -> list[str]:
        """Snapshot folders that no state names, left over from commits that failed; the caller deletes them."""
        named = {s["data"].rsplit("/", 1)[-1] for s in self.snapshots().values()}
        return [n for n in self.repo.manager.files.names(f"{self.path}/data") if n not in named]
