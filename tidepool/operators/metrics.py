"""What the checks' metrics mean: kind of value, which end is bad, and the range that relative thresholds refer to."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ConfigError


@dataclass(frozen=True)
class MetricSpec:
    name: str
    value_type: str = "absolute"
    direction: str = "higher_is_worse"
    absolute_min: float | None = None
    absolute_max: float | None = None


#: The ranges of the metrics (from 0 to the number given, or to 1) and which end is bad.
_RELATIVE = {"blur": ("lower_is_worse", 300.0), "contrast": ("lower_is_worse", 100.0), "perceptual_duplicate": ("lower_is_worse", 100.0)}
_SHARES = ("blank", "exposure", "noise", "mono_color", "border_padding", "semantic_duplicate")
_CATEGORIES = ("decode", "animated", "orientation", "exact_duplicate")
_PLAIN = ("dimension", "aspect_ratio", "megapixel", "brightness")

METRICS: dict[str, MetricSpec] = (
    {n: MetricSpec(n, "relative", d, 0.0, top) for n, (d, top) in _RELATIVE.items()}
    | {n: MetricSpec(n, "relative", "higher_is_worse", 0.0, 1.0) for n in _SHARES}
    | {n: MetricSpec(n, "categorical", "none") for n in _CATEGORIES}
    | {n: MetricSpec(n, "absolute", "outside_is_worse") for n in _PLAIN}
)


def relative_to_absolute(metric: str, share: float) -> float:
    """The value at a share (0 to 1) of the metric's range."""
    spec = METRICS.get(metric)
    if spec is None or spec.absolute_min is None or spec.absolute_max is None:
        raise ConfigError(f"{metric!r} has no range for relative values")
    if not 0 <= share <= 1:
        raise ConfigError("a relative value lies between 0 and 1")
    return spec.absolute_min + share * (spec.absolute_max - spec.absolute_min)
