"""A cleaning run: rows -> parameters -> evaluations -> final action, as one lazy plan with a table written between the two halves.

The parameter table is written once, so that a run can be resumed and evaluated again with other thresholds without touching images.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, NotFoundError, StateError
from ..operators.checks import POSITION, ConfiguredCheck, evaluate
from ..operators.computers import PER_IMAGE, Registry, builtin, run_parameters
from ..operators.duplicates import relation
from ..operators.merge import action_summary, bucket, merge_actions, operator_summary
from ..sources.tabular import Dataset, fingerprint, sample, with_position
from ..storing import JsonFiles, scratch
from . import config as configs
from .preview import filtered, html

INPUT_COLUMNS = ("image_id", "image_uri")
#: The columns of a run's states by check.
STATE = ("operator_name", "status", "processed_count", "skipped_count", "failed_count", "message")


@dataclass(frozen=True)
class PlanNode:
    name: str
    kind: str  # parameter, evaluation or merge
    needs: tuple[str, ...]
    config_hash: str


@dataclass(frozen=True)
class CleaningPlan:
    nodes: tuple[PlanNode, ...]

    @property
    def plan_hash(self) -> str:
        return hashlib.sha256(json.dumps([[n.name, n.kind, n.needs, n.config_hash] for n in self.nodes], separators=(",", ":")).encode()).hexdigest()

    @property
    def parameter_hash(self) -> str:
        return CleaningPlan(tuple(n for n in self.nodes if n.kind == "parameter")).plan_hash


@dataclass(frozen=True)
class DryRun:
    plan: CleaningPlan
    errors: tuple[str, ...]
    warnings: tuple[str, ...]


class Cleaner(ABC):
    @abstractmethod
    def compile(self, columns: Iterable[str]) -> CleaningPlan: ...

    @abstractmethod
    def run(self, dataset: Dataset | DataFrame, output: str, **options: Any) -> CleanerResult: ...


class BasicCleaner(Cleaner):
    """Runs configured checks. `registry` has the computers; custom ones can be registered on it."""

    def __init__(self, config: configs.CleanConfig | Sequence[Any], registry: Registry | None = None):
        self.config = config if isinstance(config, configs.CleanConfig) else configs.from_list(config)
        self.registry = registry or Registry(builtin())

    @classmethod
    def from_toml(cls, text: str, **more: Any) -> BasicCleaner:
        return cls(configs.from_toml(text), **more)

    @classmethod
    def from_recipe(cls, text: str, **more: Any) -> BasicCleaner:
        return cls(configs.from_yaml(text), **more)

    def export_config_template(self) -> str:
        return configs.template(self.config)

    def wanted(self) -> list[str]:
        return list(dict.fromkeys(p for c in self.config.checks for p in c.check.required))

    def computer_config(self) -> dict[str, dict]:
        """Settings of the checks that computers take, e.g. the distance of perceptual groups; two checks may not differ in one."""
        out: dict[str, dict] = {}
        for c in self.config.checks:
            for p in c.check.required:
                computer = self.registry.producer.get(p)
                for key in computer.config if computer else ():
                    if key in c.config:
                        known = out.setdefault(computer.name, {})
                        if known.setdefault(key, c.config[key]) != c.config[key]:
                            raise ConfigError(f"{computer.name}.{key} is set differently by two checks")
        return out

    def compile(self, columns: Iterable[str]) -> CleaningPlan:
        own = self.computer_config()
        digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
        steps = self.registry.plan(self.wanted(), columns)
        nodes = [PlanNode(f"{c.name}:{p}", "parameter", c.requires, digest(own.get(c.name, {}))) for c, names in steps for p in names]
        nodes += [PlanNode(c.check.qualified, "evaluation", c.check.required, c.config_hash) for c in self.config.checks]
        nodes.append(PlanNode("final_action", "merge", tuple(c.check.qualified for c in self.config.checks), digest([c.check.qualified for c in self.config.checks])))
        return CleaningPlan(tuple(nodes))

    def dry_run(self, columns: Iterable[str]) -> DryRun:
        errors, warnings, columns = [], [], list(columns)
        errors += [f"the table has no column {c}" for c in INPUT_COLUMNS if c not in columns]
        plan = CleaningPlan(())
        try:
            plan = self.compile(columns)
            steps = self.registry.plan(self.wanted(), columns)
            if any(c.mode == PER_IMAGE for c, _ in steps) and "content" not in columns:
                errors.append("image computers need the column content")
            for c, _ in steps:
                if c.before_run:
                    try:
                        c.before_run(self.computer_config().get(c.name, {}))
                    except Exception as e:
                        errors.append(f"{c.name}: {e}")
        except ConfigError as e:
            errors.append(str(e))
        if not self.config.checks:
            warnings.append("no checks are selected; all rows are kept")
        return DryRun(plan, tuple(errors), tuple(warnings))

    def frame(self, df: DataFrame) -> DataFrame:
        """The whole run as one lazy table, without writing anything of its own."""
        df = df if POSITION in df.columns else with_position(df)
        parameters, _ = run_parameters(df, self.wanted(), self.registry, self.computer_config())
        return merge_actions(evaluate(parameters, list(self.config.checks)), self.config.checks)

    def run(self, dataset: Dataset | DataFrame, output: str, spark: SparkSession | None = None, run_id: str | None = None, sample_size: int | Mapping[str, Any] | None = None, label: str | None = None, tags: Sequence[str] = (), progress: Callable[[str, dict], None] | None = None, raise_on_error: bool = False, position: Sequence[str] | None = None) -> CleanerResult:
        spark = spark or SparkSession.active()
        df = dataset.frame(spark) if isinstance(dataset, Dataset) else dataset
        told = progress or (lambda event, facts: None)
        checked = self.dry_run(df.columns)
        if checked.errors:
            raise ConfigError("; ".join(checked.errors))
        run_id = run_id or f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
        result = CleanerResult(spark, f"{output.rstrip('/')}/{run_id}", self)
        files = JsonFiles(spark)
        df = df if POSITION in df.columns else with_position(df, position)
        mark = fingerprint(df.select(*[c for c in df.columns if c not in ("content", "image", POSITION)]))
        rule = dict(sample_size) if isinstance(sample_size, Mapping) else {"n": sample_size} if sample_size is not None else None
        if rule:
            rule.setdefault("seed", hashlib.sha256(f"{mark}:{checked.plan.plan_hash}".encode()).hexdigest())
            df = sample(df, rule["n"], rule["seed"])
        state = {"run_id": run_id, "status": "running", "label": label, "tags": list(tags), "plan_hash": checked.plan.plan_hash, "parameter_hash": checked.plan.parameter_hash, "fingerprint": mark, "sample": rule, "started_at": datetime.now(UTC).isoformat(), "checks": {c.name: dict(c.config) for c in self.config.checks}, "nodes": [n.name for n in checked.plan.nodes], "error": ""}
        if files.exists(f"{result.path}/state.json"):
            known = result.state()
            if (known["plan_hash"], known["fingerprint"], known["sample"]) != (state["plan_hash"], mark, rule):
                raise StateError("the stored run has another plan, table or sample")
            if known["status"] == "completed":
                return result
        else:
            files.write(f"{result.path}/state.json", state)
        told("started", {"run_id": run_id})
        try:
            if not files.exists(f"{result.path}/tables/parameter_table.parquet/_SUCCESS"):
                with scratch():
                    parameters, ran = run_parameters(df, self.wanted(), self.registry, self.computer_config())
                    parameters.drop("content", "image").write.mode("overwrite").parquet(f"{result.path}/tables/parameter_table.parquet")
                told("parameters", {"computers": ran})
                self._relations(spark, result.path, ran)
            self._evaluate(spark, result.path)
            state |= {"status": "completed", "operator_states": self._states(spark, result.path), "finished_at": datetime.now(UTC).isoformat()}
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:2000]
            state |= {"status": "failed", "error": error, "operator_states": self._states(spark, result.path, error), "finished_at": datetime.now(UTC).isoformat()}
            if raise_on_error:
                files.write(f"{result.path}/state.json", state)
                raise
        files.write(f"{result.path}/state.json", state)
        told(state["status"], {"run_id": run_id})
        return result

    def _states(self, spark: SparkSession, path: str, error: str | None = None) -> list[dict]:
        """The rows that each check saw, counted in one aggregation over the stored parameters."""
        files, where, checks = JsonFiles(spark), f"{path}/tables/parameter_table.parquet", self.config.checks
        if error is not None and not files.exists(f"{where}/_SUCCESS"):
            return [dict(zip(STATE, (c.name, "failed", 0, 0, 0, error), strict=True)) for c in checks]
        table = spark.read.parquet(where)
        nothing = lambda c: F.concat(*[F.lit("")] + [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in c.check.required if p in table.columns]) == ""
        n, *lost = table.agg(F.count("*"), *[F.count_if(nothing(c)) for c in checks]).first()
        if error is not None:
            return [dict(zip(STATE, (c.name, "failed", 0, n, 0, error), strict=True)) for c in checks]
        return [dict(zip(STATE, (c.name, "completed", n - k, 0, k, None), strict=True)) for c, k in zip(checks, lost, strict=True)]

    def _relations(self, spark: SparkSession, path: str, ran: Sequence[str]) -> None:
        table = spark.read.parquet(f"{path}/tables/parameter_table.parquet")
        for name in ran:
            c = self.registry.by_name[name]
            for kind, make in c.relations.items():
                relation(make(table), kind, next(iter(c.types)), c.name).write.mode("overwrite").parquet(f"{path}/relations/{kind}.parquet")

    def _evaluate(self, spark: SparkSession, path: str) -> None:
        table = spark.read.parquet(f"{path}/tables/parameter_table.parquet")
        merged = merge_actions(evaluate(table, list(self.config.checks)), self.config.checks)
        own = list(dict.fromkeys(n for c in self.config.checks for n in c.check.evaluation_columns))
        merged.select(POSITION, *INPUT_COLUMNS, "final_action", "final_reason", "triggered_operator_names", *own).write.mode("overwrite").parquet(f"{path}/tables/evaluation_table.parquet")

    def reevaluate(self, result: CleanerResult) -> CleanerResult:
        """Evaluates a stored run again with this cleaner's thresholds; its parameters must be those that this cleaner needs."""
        files, state = JsonFiles(result.spark), result.state()
        have = result.spark.read.parquet(f"{result.path}/tables/parameter_table.parquet").columns
        if missing := [p for p in self.wanted() if p not in have]:
            raise StateError(f"the stored run has no {', '.join(missing)}")
        stored_config = {c.name: dict(c.config) for c in self.config.checks}
        for name, keys in self.computer_config().items():
            for check in stored_config:
                for key in keys:
                    if key in state["checks"].get(check, {}) and state["checks"][check][key] != stored_config[check].get(key):
                        raise StateError(f"{name}.{key} has changed; run the parameters again")
        self._evaluate(result.spark, result.path)
        files.write(f"{result.path}/state.json", state | {"status": "completed", "checks": stored_config, "reevaluated_at": datetime.now(UTC).isoformat()})
        return CleanerResult(result.spark, result.path, self)


@dataclass
class CleanerResult:
    """A stored run. Tables are read lazily."""

    spark: SparkSession
    path: str
    cleaner: BasicCleaner
    _: None = field(default=None, repr=False)

    def state(self) -> dict:
        return JsonFiles(self.spark).read(f"{self.path}/state.json")

    @property
    def status(self) -> str:
        return self.state()["status"]

    def parameters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tables/parameter_table.parquet")

    def evaluations(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tables/evaluation_table.parquet")

    def full(self) -> DataFrame:
        have, made = self.parameters(), self.evaluations()
        return have.join(made.drop(*[c for c in made.columns if c in have.columns and c != POSITION]), POSITION)

    def view(self, kind: str) -> DataFrame:
        """clean, review, dropped, restricted, full, parameters or evaluations."""
        if kind == "parameters":
            return self.parameters()
        return self.evaluations() if kind == "evaluations" else bucket(self.full(), kind)

    def relations(self, kind: str) -> DataFrame:
        if not JsonFiles(self.spark).exists(f"{self.path}/relations/{kind}.parquet"):
            raise NotFoundError(kind)
        return self.spark.read.parquet(f"{self.path}/relations/{kind}.parquet")

    def export(self, kind: str, path: str) -> Dataset:
        return Dataset.write(self.view(kind).drop(POSITION), path)

    def summary(self) -> dict:
        return action_summary(self.evaluations()).first().asDict()

    def operators(self) -> DataFrame:
        return operator_summary(self.evaluations(), self.cleaner.config.checks)

    def operator(self, name: str) -> DataFrame:
        check = next((c for c in self.cleaner.config.checks if c.name == name), None)
        if check is None:
            raise KeyError(name)
        return self.evaluations().select("image_id", *check.check.evaluation_columns)

    def state_frame(self) -> DataFrame:
        """A row for each check as the run left it: its status, the rows it processed, those skipped (the run failed before them) and
        those that failed (their parameters could not be computed, so that the check saw nothing), and the run's error."""
        rows = [tuple(s.get(k) for k in STATE) for s in self.state()["operator_states"]]
        return self.spark.createDataFrame(rows, "operator_name string, status string, processed_count bigint, skipped_count bigint, failed_count bigint, message string")

    def explain(self, image_id: str) -> dict:
        row = self.full().where(F.col("image_id") == image_id).first()
        if row is None:
            raise NotFoundError(image_id)
        return row.asDict(recursive=True) | {"plan_hash": self.state()["plan_hash"]}

    def manifest(self) -> dict:
        """The plan, its settings and what the run holds, as one document."""
        state = self.state()
        return {k: state[k] for k in ("run_id", "status", "plan_hash", "parameter_hash", "fingerprint", "sample", "checks", "nodes", "label", "tags")} | {"summary": self.summary() if state["status"] == "completed" else None}

    def export_debug(self, path: str, rows: int = 200) -> str:
        """A zip file on the driver with the state, the manifest and the first rows of each table."""
        import zipfile

        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("state.json", json.dumps(self.state(), indent=1, default=str))
            z.writestr("manifest.json", json.dumps(self.manifest(), indent=1, default=str))
            for name in ("parameters", "evaluations"):
                z.writestr(f"{name}.jsonl", "\n".join(self.view(name).orderBy(POSITION).limit(rows).toJSON().collect()))
        return path

    def preview(self, operator: str | None = None, **options: Any) -> DataFrame:
        return filtered(self.full(), self._check(operator), **options)

    def preview_html(self, operator: str | None = None, **options: Any) -> str:
        return html(self.full(), self._check(operator), **options)

    def _check(self, name: str | None) -> ConfiguredCheck | None:
        if name is None:
            return None
        with contextlib.suppress(StopIteration):
            return next(c for c in self.cleaner.config.checks if c.name == name)
        raise KeyError(name)
