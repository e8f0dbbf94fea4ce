"""Which checks run, and with what settings, from names, categories, mappings and check objects."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from ..errors import ConfigError, UnknownOperatorError
from ..operators.checks import CHECKS, Check, ConfiguredCheck

ALL = "all"


def select(selectors: Iterable[Any], overrides: Mapping[str, Mapping] | None = None, checks: Mapping[str, Check] = CHECKS) -> list[ConfiguredCheck]:
    """Selectors are "ALL", a category, a check's name, a mapping {name: settings}, a Check or a ConfiguredCheck. A check that is named
    twice runs once, with the settings of all mentions, later ones over earlier; `overrides` come last."""
    chosen: dict[str, tuple[Check, dict]] = {}
    own: set[str] = set()
    overrides = dict(overrides or {})

    def add(check: Check, config: Mapping | None = None) -> None:
        known = chosen.get(check.name)
        if known and known[0] is not check:
            raise ConfigError(f"two checks are named {check.name}")
        chosen[check.name] = (check, {**(known[1] if known else {}), **dict(config or {})})

    def find(name: str) -> list[Check]:
        if "." in name:
            raise ConfigError(f"use the short name, not {name!r}")
        key = name.strip().lower()
        if key == ALL:
            return list(checks.values())
        if key in checks:
            return [checks[key]]
        if found := [c for c in checks.values() if c.category == key]:
            return found
        raise UnknownOperatorError(f"no check or category {name!r}")

    for s in selectors:
        if isinstance(s, str):
            for c in find(s):
                add(c)
        elif isinstance(s, Mapping):
            if not s:
                raise ConfigError("an empty selector")
            for name, config in s.items():
                if config is not None and not isinstance(config, Mapping):
                    raise ConfigError(f"settings of {name} must be a mapping")
                replace = bool((config or {}).get("override"))
                given = {k: v for k, v in (config or {}).items() if k != "override"}
                for c in find(name):
                    if replace:
                        chosen.pop(c.name, None)
                    add(c, given)
        elif isinstance(s, (Check, ConfiguredCheck)):
            check = s if isinstance(s, Check) else s.check
            if check.name in checks and checks[check.name] is not check and check.name not in own and not overrides.get(check.name, {}).get("override"):
                raise ConfigError(f"{check.name} is a built-in check; set override to replace it")
            own.add(check.name)
            chosen.pop(check.name, None)
            add(check, None if isinstance(s, Check) else s.config)
        else:
            raise ConfigError(f"cannot select by {s!r}")
    if unknown := overrides.keys() - chosen.keys():
        raise UnknownOperatorError(f"settings for checks that are not selected: {', '.join(sorted(unknown))}")
    return [c.configured({**config, **{k: v for k, v in overrides.get(n, {}).items() if k != "override"}}) for n, (c, config) in chosen.items()]
