"""Intervals such as `(0.3, 0.6]` as predicates, and two-level actions made of them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from .values import number

_FORM = re.compile(r"\s*([\[(])\s*([^,\s]+)\s*,\s*([^,\s]+)\s*([\])])\s*")


@dataclass(frozen=True)
class ActionRange:
    low: float
    high: float
    low_closed: bool
    high_closed: bool

    @classmethod
    def parse(cls, text: str) -> ActionRange:
        m = _FORM.fullmatch(text) if isinstance(text, str) else None
        if not m:
            raise ConfigError(f"not an interval: {text!r}")
        try:
            low, high = float(m[2]), float(m[3])
        except ValueError:
            raise ConfigError(f"bounds must be numbers: {text!r}") from None
        if not (math.isfinite(low) and math.isfinite(high)):
            raise ConfigError(f"bounds must be finite: {text!r}")
        if low > high:
            raise ConfigError(f"bounds are in the wrong order: {text!r}")
        return cls(low, high, m[1] == "[", m[4] == "]")

    def holds(self, value: float) -> bool:
        return (value >= self.low if self.low_closed else value > self.low) and (value <= self.high if self.high_closed else value < self.high)

    def column(self, c: Column) -> Column:
        return (c >= self.low if self.low_closed else c > self.low) & (c <= self.high if self.high_closed else c < self.high)


def scaled(c: Column, low: float | None, high: float | None) -> Column:
    """A value of a metric with a known range on the scale from 0 to 1; of a range without extent only the low end is subtracted."""
    if low is None or high is None:
        return c
    return (c - low) / (high - low) if high != low else c - low


def two_level_action(metric: Column | str, drop: str | None = None, review: str | None = None, span: tuple[float | None, float | None] = (None, None)) -> Column:
    """`drop`, else `review`, else `keep`, by intervals on the scaled metric; missing values are kept."""
    c = scaled(number(metric), *span)
    out = F.lit("keep")
    if review:
        out = F.when(ActionRange.parse(review).column(c), "review").otherwise(out)
    if drop:
        out = F.when(ActionRange.parse(drop).column(c), "drop").otherwise(out)
    return out
