"""Models: immutable definitions with a fingerprint, and runtimes that are made once in each process."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from ..errors import ModelError, NameConflictError, NotFoundError


@dataclass(frozen=True)
class ModelDefinition:
    model_id: str
    kind: str
    uri: str
    version: str
    dimension: int
    dtype: str = "float32"
    normalized: bool = True
    credential_ref: str | None = None
    options: dict = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        """Of what the model is; its id and credentials are not part of that."""
        facts = {k: v for k, v in asdict(self).items() if k not in ("model_id", "credential_ref")}
        return hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class ModelRegistry:
    def __init__(self) -> None:
        self._known: dict[str, ModelDefinition] = {}
        self._factories: dict[str, Callable[[ModelDefinition], Any]] = {}
        self._made: dict[str, Any] = {}

    def register(self, m: ModelDefinition) -> ModelDefinition:
        if m.dtype != "float32":
            raise ModelError("only float32 vectors are supported")
        if m.dimension < 1:
            raise ModelError("a dimension is positive")
        if (known := self._known.get(m.model_id)) and known != m:
            raise NameConflictError(f"{m.model_id} is defined otherwise")
        self._known[m.model_id] = m
        return m

    def get(self, model_id: str) -> ModelDefinition:
        if model_id not in self._known:
            raise NotFoundError(model_id)
        return self._known[model_id]

    def provide(self, kind: str, factory: Callable[[ModelDefinition], Any]) -> None:
        self._factories[kind] = factory

    def runtime(self, model_id: str) -> Any:
        """The model's callable (list of bytes to a float32 matrix), made when it is first asked for."""
        m = self.get(model_id)
        if m.fingerprint not in self._made:
            if m.kind not in self._factories:
                raise ModelError(f"no runtime for {m.kind}")
            self._made[m.fingerprint] = self._factories[m.kind](m)
        return self._made[m.fingerprint]
