"""The checks: each turns parameter columns into an action and a reason, as column expressions only.

A check that does not fire gives `keep` and an empty reason. Missing values never fire a check, except in `decode` (missing is
failed) and `dimension` (missing is 0). Thresholds are literals of the plan, so that all checks of a run are one projection; only the
duplicate checks need a join, with the first position of each group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, ValidationError
from ..functions import clean_text, flag, number, two_level_action
from .grouping import attach
from .metrics import METRICS

ACTIONS = ("keep", "review", "drop", "restricted")
#: The column that gives a table its order; "first of a group" refers to it.
POSITION = "_pos"

#: The checks whose evaluations do not repeat their parameters.
PLAIN = ("decode", "dimension")

Config = Mapping[str, Any]
Fires = Callable[[Config], tuple[Column, Column]]


@dataclass(frozen=True)
class Check:
    """`fires(config)` gives the predicate and the reason. `grouped` names the group and count columns of a duplicate check."""

    name: str
    category: str
    required: tuple[str, ...]
    defaults: Config
    fires: Fires
    metric: str | None = None
    extra_columns: tuple[str, ...] = ()
    grouped: tuple[str, str] | None = None
    actions: tuple[str, ...] = ("keep", "review", "drop", "restricted")

    @property
    def action_column(self) -> str:
        return f"{self.name}_action"

    @property
    def reason_column(self) -> str:
        return f"{self.name}_reason"

    @property
    def outcome_columns(self) -> tuple[str, ...]:
        return (self.action_column, self.reason_column, *self.extra_columns)

    @property
    def evaluation_columns(self) -> tuple[str, ...]:
        """The parameters that the check shows, then what it makes of them."""
        return (*(() if self.name in PLAIN else self.required), *self.outcome_columns)

    @property
    def qualified(self) -> str:
        return f"{self.category}.{self.name}"

    def configured(self, config: Config | None = None) -> ConfiguredCheck:
        given = dict(config or {})
        if unknown := given.keys() - self.defaults.keys() - {"rules", "drop", "review", "keep", "action"}:
            raise ConfigError(f"{self.name} has no setting {', '.join(sorted(unknown))}")
        merged = {**self.defaults, **given}
        if merged.get("action", "review") not in self.actions:
            raise ConfigError(f"{self.name}: action {merged.get('action')!r} is not one of {', '.join(self.actions)}")
        if merged.get("keep", "first") != "first":
            raise ConfigError(f"{self.name}: only keep='first' is supported")
        return ConfiguredCheck(self, merged)


@dataclass(frozen=True)
class ConfiguredCheck:
    check: Check
    config: Config = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.check.name

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def columns(self) -> dict[str, Column]:
        """The evaluation columns as expressions over the parameter table."""
        c, config = self.check, self.config
        hit, reason = c.fires(config)
        action = F.when(hit, F.lit(config["action"]))
        if c.grouped:
            # `with_first` gives the position of each group's first row.
            later = F.coalesce(F.col(POSITION) > F.col(self.first_column), F.lit(False))
            action, reason = F.when(later & hit, F.lit(config["action"])), F.when(later & hit, reason)
        else:
            reason = F.when(hit, reason)
        out = {c.action_column: F.coalesce(action, F.lit("keep")), c.reason_column: F.coalesce(reason, F.lit(""))}
        if ranges := self.rule_ranges():
            metric = METRICS.get(c.name)
            span = (metric.absolute_min, metric.absolute_max) if metric and metric.value_type == "relative" and config.get("rules", {}).get("scale", "relative") == "relative" else (None, None)
            ruled = two_level_action(c.metric or c.required[0], ranges.get("drop"), ranges.get("review"), span)
            out = {c.action_column: ruled, c.reason_column: F.when(ruled != "keep", F.concat(F.lit(f"{c.name} in the range of "), ruled)).otherwise(F.lit(""))}
        return out

    @property
    def first_column(self) -> str:
        return f"_first_{self.name}"

    def with_first(self, parameters: DataFrame) -> DataFrame:
        """Adds the position of the first row of each row's group, null outside groups; an aggregation and a join, no window."""
        group, count = clean_text(self.check.grouped[0]), F.coalesce(F.col(self.check.grouped[1]).try_cast("long"), F.lit(1))
        key = F.when(count > 1, group).otherwise("")
        sums = parameters.where(key != "").groupBy(key.alias("group_key")).agg(F.count("*").alias("group_rows"), F.min(POSITION).alias(self.first_column))
        return attach(parameters, key, sums, POSITION).drop("group_key", "group_rows")

    def rule_ranges(self) -> dict[str, str]:
        """Intervals for drop and review from `rules` or from the blocks of these names."""
        found = {}
        for level in ("drop", "review"):
            block = (self.config.get("rules") or {}).get(level, self.config.get(level))
            if isinstance(block, Mapping):
                block = block.get("range") or block.get(self.check.metric or "")
            if block:
                found[level] = block
        return found

    def evaluate(self, parameters: DataFrame) -> DataFrame:
        """image_id and the evaluation columns."""
        return evaluate(parameters, [self]).select("image_id", *self.check.evaluation_columns)


def _real(config: Config, key: str) -> float:
    v = config[key]
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise TypeError(f"{key} must be a number, not {v!r}")
    return float(v)


def _whole(config: Config, key: str) -> int:
    v = config[key]
    if isinstance(v, bool) or not isinstance(v, int):
        raise TypeError(f"{key} must be a whole number, not {v!r}")
    return v


def _outside(column: str, low: str, high: str, said: str) -> Fires:
    def fires(c: Config) -> tuple[Column, Column]:
        a, b, x = _real(c, low), _real(c, high), number(column)
        return (x < a) | (x > b), F.lit(f"{said} outside {a}..{b}")

    return fires


def _bound(column: str, key: str, compare: Callable[[Column, float], Column], said: str) -> Fires:
    def fires(c: Config) -> tuple[Column, Column]:
        bound = _real(c, key)
        return compare(number(column), bound), F.lit(said.format(bound))

    return fires


def _dimension(c: Config) -> tuple[Column, Column]:
    w, h = _whole(c, "min_width"), _whole(c, "min_height")
    side = lambda n: F.coalesce(number(n), F.lit(0.0))
    return (side("width") < w) | (side("height") < h), F.lit(f"smaller than {w}x{h}")


def _megapixel(c: Config) -> tuple[Column, Column]:
    x = number("megapixels")
    hit = x < _real(c, "min_megapixels")
    if c.get("max_megapixels") is not None:
        hit = hit | (x > _real(c, "max_megapixels"))
    return hit, F.lit("megapixels outside configured range")


def _exposure(c: Config) -> tuple[Column, Column]:
    sides = [(number(f"{n}_pixel_ratio"), _real(c, f"max_{n}_pixel_ratio"), n) for n in ("dark", "bright", "clipped")]
    clauses = F.concat_ws("; ", *[F.when(x > most, F.lit(f"{n} pixel ratio above {most}")) for x, most, n in sides])
    return clauses != "", clauses


def _border(c: Config) -> tuple[Column, Column]:
    colors = [c["colors"]] if isinstance(c["colors"], str) else list(c["colors"])
    ratio, sides, color = _real(c, "max_ratio"), clean_text("border_padding_sides"), clean_text("border_padding_color")
    said = F.concat(F.lit(f"border padding ratio above {ratio} sides="), sides, F.lit(" color="), color)
    return (number("border_padding_ratio") > ratio) & (sides != "") & color.isin(colors), said


def _orientation(c: Config) -> tuple[Column, Column]:
    known = F.col("exif_orientation").try_cast("int")
    return flag("orientation_risk"), F.coalesce(F.concat(F.lit("exif orientation "), known.cast("string")), F.lit(""))


def _whole_text(c: Column) -> Column:
    return F.coalesce(number(c).cast("long").cast("string"), F.lit(""))


def _check(name: str, category: str, required: str, defaults: Config, fires: Fires, **more: Any) -> Check:
    return Check(name, category, tuple(required.split()), defaults, fires, **more)


#: Names, categories, columns, default settings and reason texts of the checks.
CHECKS: dict[str, Check] = {
    c.name: c
    for c in (
        _check("decode", "format", "decode_ok decode_error", {"action": "drop"}, lambda c: (~flag("decode_ok"), F.lit("decode_error"))),
        _check("dimension", "size", "width height", {"min_width": 1, "min_height": 1, "action": "drop"}, _dimension, metric="width"),
        _check("aspect_ratio", "size", "aspect_ratio", {"min_ratio": 0.2, "max_ratio": 5.0, "action": "review"}, _outside("aspect_ratio", "min_ratio", "max_ratio", "aspect ratio"), metric="aspect_ratio"),
        _check("megapixel", "size", "megapixels", {"min_megapixels": 0.01, "max_megapixels": None, "action": "review"}, _megapixel, metric="megapixels"),
        _check("blur", "quality", "blur_score", {"min_score": 100.0, "action": "review"}, _bound("blur_score", "min_score", lambda x, b: x < b, "blur score below {}"), metric="blur_score"),
        _check("brightness", "quality", "brightness_score", {"min_score": 30.0, "max_score": 225.0, "action": "review"}, _outside("brightness_score", "min_score", "max_score", "brightness"), metric="brightness_score"),
        _check("contrast", "quality", "contrast_score", {"min_score": 10.0, "action": "review"}, _bound("contrast_score", "min_score", lambda x, b: x < b, "contrast score below {}"), metric="contrast_score"),
        _check("blank", "content", "blank_score", {"threshold": 0.98, "action": "drop"}, _bound("blank_score", "threshold", lambda x, b: x >= b, "blank score at least {}"), metric="blank_score"),
        _check("exposure", "quality", "dark_pixel_ratio bright_pixel_ratio clipped_pixel_ratio", {"max_dark_pixel_ratio": 0.95, "max_bright_pixel_ratio": 0.95, "max_clipped_pixel_ratio": 0.98, "action": "review"}, _exposure, metric="dark_pixel_ratio"),
        _check("noise", "quality", "noise_score", {"max_score": 0.75, "action": "review"}, _bound("noise_score", "max_score", lambda x, b: x > b, "noise score above {}"), metric="noise_score"),
        _check("mono_color", "content", "mono_color_score", {"threshold": 0.98, "action": "review"}, _bound("mono_color_score", "threshold", lambda x, b: x >= b, "mono color score at least {}"), metric="mono_color_score"),
        _check("border_padding", "content", "border_padding_ratio border_padding_sides border_padding_color", {"max_ratio": 0.25, "min_side_ratio": 0.08, "colors": ["white", "black", "solid"], "action": "review"}, _border, metric="border_padding_ratio"),
        _check("animated", "format", "frame_count animated", {"action": "review"}, lambda c: (flag("animated"), F.lit("animated image"))),
        _check("orientation", "metadata", "exif_orientation orientation_risk", {"action": "review"}, _orientation),
        _check("exact_duplicate", "duplicate", "exact_duplicate_group_id exact_duplicate_count", {"keep": "first", "action": "drop"}, lambda c: (F.lit(True), F.concat(F.lit("duplicate in group "), clean_text("exact_duplicate_group_id"))), grouped=("exact_duplicate_group_id", "exact_duplicate_count"), actions=("drop",)),
        _check("perceptual_duplicate", "duplicate", "perceptual_duplicate_group_id perceptual_duplicate_count perceptual_duplicate_distance", {"max_distance": 10, "keep": "first", "action": "drop"}, lambda c: (F.lit(True), F.concat(F.lit("perceptual duplicate in group "), clean_text("perceptual_duplicate_group_id"), F.lit(" distance "), _whole_text(F.col("perceptual_duplicate_distance")))), grouped=("perceptual_duplicate_group_id", "perceptual_duplicate_count"), actions=("drop",)),
        _check("semantic_duplicate", "duplicate", "semantic_duplicate_group_id semantic_duplicate_count semantic_duplicate_score semantic_duplicate_nearest_image_id", {"threshold": 0.92, "keep": "first", "action": "drop", "provider": "default", "model_id": None, "index": "exact", "batch_size": 32}, lambda c: (F.lit(True), F.concat(F.lit("semantic duplicate in group "), clean_text("semantic_duplicate_group_id"), F.lit(" score "), F.format_string("%.4f", F.coalesce(number("semantic_duplicate_score"), F.lit(0.0))), F.lit(" nearest "), clean_text("semantic_duplicate_nearest_image_id"))), grouped=("semantic_duplicate_group_id", "semantic_duplicate_count"), actions=("drop", "review")),
    )
}


def evaluate(parameters: DataFrame, checks: list[ConfiguredCheck]) -> DataFrame:
    """The parameter table with all evaluation columns, in one projection."""
    have = set(parameters.columns)
    made: dict[str, Column] = {}
    for c in checks:
        if missing := [n for n in c.check.required if n not in have]:
            raise ValidationError(f"{c.name} needs {', '.join(missing)}")
        for n, column in c.columns().items():
            if n in made:
                raise ValidationError(f"{n} has two owners")
            made[n] = column
    grouped = [c for c in checks if c.check.grouped]
    for c in grouped:
        parameters = c.with_first(parameters)
    return parameters.withColumns(made).drop(*[c.first_column for c in grouped])
