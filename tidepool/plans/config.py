"""Configuration files: TOML with [select] or [operators], YAML recipes, and templates of the settings in effect."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from ..errors import ConfigError
from ..operators.checks import ConfiguredCheck
from .selection import select


@dataclass(frozen=True)
class NodePolicy:
    """How a node runs. Spark has its own ways for most of it: batch_size is the Arrow batch, retries are those of tasks."""

    batch_size: int = 4096
    retry_max_attempts: int = 1
    retry_backoff_seconds: float = 0.0
    on_failure: str = "fail"
    device: str = "cpu"
    num_workers: int = 0
    cache_scope: str = "run"

    def __post_init__(self) -> None:
        for name in ("batch_size", "retry_max_attempts"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ConfigError(f"{name} must be a positive whole number")
        if self.on_failure not in ("fail", "skip", "review"):
            raise ConfigError("on_failure is fail, skip or review")
        if self.num_workers < 0 or self.retry_backoff_seconds < 0:
            raise ConfigError("num_workers and retry_backoff_seconds are not negative")

    @classmethod
    def of(cls, given: Mapping[str, Any]) -> NodePolicy:
        if unknown := given.keys() - cls.__dataclass_fields__.keys():
            raise ConfigError(f"unknown runtime settings: {', '.join(sorted(unknown))}")
        return cls(**given)


@dataclass(frozen=True)
class CleanConfig:
    checks: tuple[ConfiguredCheck, ...]
    policy: NodePolicy = field(default_factory=NodePolicy)
    policies: Mapping[str, NodePolicy] = field(default_factory=dict)

    def spark_settings(self) -> dict[str, str]:
        return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(min([self.policy.batch_size, *(p.batch_size for p in self.policies.values())]))}


def from_list(selectors: Sequence[Any], **settings: Any) -> CleanConfig:
    return CleanConfig(tuple(select(selectors)), NodePolicy.of(settings))


def from_toml(text: str) -> CleanConfig:
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    if unknown := given.keys() - {"select", "operators", "runtime"}:
        raise ConfigError(f"unknown sections: {', '.join(sorted(unknown))}")
    if "select" in given and "operators" in given:
        raise ConfigError("[select] and [operators] exclude each other")
    policies: dict[str, NodePolicy] = {}
    base = given.get("runtime", {})

    def block(name: str, config: Any) -> dict:
        if not isinstance(config, Mapping):
            raise ConfigError(f"settings of {name} must be a table")
        config = dict(config)
        if run := config.pop("runtime", None):
            policies[name] = NodePolicy.of({**base, **run})
        return config

    blocks = given.get("operators", {})
    if not isinstance(blocks, Mapping) or not isinstance(given.get("select", {}), Mapping):
        raise ConfigError("[select] and [operators] are tables")
    settings = {n: block(n, c) for n, c in blocks.items()}
    if "select" not in given:
        # The checks that have settings, or all of them.
        checks = select([{n: c} for n, c in settings.items()] if settings else ["ALL"])
    else:
        chosen = dict(given["select"])
        names = chosen.pop("categories", None) if "categories" in chosen else chosen.pop("use", None)
        names = [names] if isinstance(names, str) else names
        if not isinstance(names, list) or not names or not all(isinstance(n, str) and n for n in names):
            raise ConfigError("[select] needs `categories` or `use`: a name or a list of names")
        checks = select(names, {n: block(n, c) for n, c in chosen.items()})
    return CleanConfig(tuple(checks), NodePolicy.of(base), policies)


def from_yaml(text: str) -> CleanConfig:
    import yaml

    try:
        given = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from None
    if not isinstance(given, Mapping) or given.get("version") != 1:
        raise ConfigError("a recipe's version is 1")
    entries = given.get("operators")
    if not isinstance(entries, list) or not entries:
        raise ConfigError("a recipe needs operators")
    selectors = []
    for e in entries:
        if not isinstance(e, Mapping) or not isinstance(e.get("use"), str):
            raise ConfigError("each operator of a recipe needs `use`")
        config = dict(e.get("with") or {})
        config.update({k: e[k] for k in ("rules", "drop", "review", "action") if k in e})
        selectors.append({e["use"].rpartition(".")[2]: config})
    return CleanConfig(tuple(select(selectors)), NodePolicy.of(given.get("runtime") or {}))


def _toml(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, Mapping):
        return "{ " + ", ".join(f"{k} = {_toml(v)}" for k, v in value.items() if v is not None) + " }"
    return "[" + ", ".join(_toml(v) for v in value) + "]"


def template(config: CleanConfig) -> str:
    """TOML that gives the same configuration; settings without a value are left out."""
    lines = ["[operators]", *(f"{c.name} = {_toml(c.config)}" for c in config.checks), "", "[runtime]", *(f"{k} = {_toml(v)}" for k, v in asdict(config.policy).items())]
    return "\n".join(lines) + "\n"
