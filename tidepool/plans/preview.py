"""Previews of results: filters, order, groups with their context, limits, and a page of figures."""

from __future__ import annotations

import base64
import html as markup
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text
from ..operators.checks import POSITION, ConfiguredCheck
from ..operators.merge import BUCKETS


#: The limits of 200 rows, 50 groups and 20 rows a group.
@dataclass(frozen=True)
class PreviewPolicy:
    """What a check's preview shows where the caller does not say."""

    actions: tuple[str, ...] = ("review", "drop")
    captions: tuple[str, ...] = ("image_id", "final_action", "final_reason")
    group_by: str | None = None
    sort_by: tuple[str, ...] = ()
    ascending: bool = True
    max_rows: int = 200
    max_groups: int = 50
    max_per_group: int = 20


_HIGH = {"noise": "noise_score", "blank": "blank_score", "mono_color": "mono_color_score"}
_LOW = {"blur": "blur_score", "brightness": "brightness_score", "contrast": "contrast_score", "megapixel": "megapixels", "aspect_ratio": "aspect_ratio"}
POLICIES: dict[str, PreviewPolicy] = (
    {n: PreviewPolicy(sort_by=(c,), ascending=False, captions=("image_id", c, f"{n}_reason")) for n, c in _HIGH.items()}
    | {n: PreviewPolicy(sort_by=(c,), captions=("image_id", c, f"{n}_reason")) for n, c in _LOW.items()}
    | {f"{k}_duplicate": PreviewPolicy(("keep", "review", "drop"), ("image_id", f"{k}_duplicate_reason"), f"{k}_duplicate_group_id") for k in ("exact", "perceptual", "semantic")}
)


def actions_of(names: str | Sequence[str] | None) -> list[str] | None:
    """Action values of a filter; None is no filter. `clean` is keep; `full` stands alone."""
    if not names:
        return None
    given = [n.strip().lower() for n in ([names] if isinstance(names, str) else names)]
    if "full" in given:
        if len(given) > 1:
            raise ValueError("full cannot be combined")
        return None
    known = {"keep": "keep", "review": "review", "drop": "drop", "clean": BUCKETS["clean"], "dropped": BUCKETS["dropped"]}
    if unknown := [n for n in given if n not in known]:
        raise ValueError(f"unknown actions: {', '.join(unknown)}")
    return list(dict.fromkeys(known[n] for n in given))


def filtered(df: DataFrame, check: ConfiguredCheck | None = None, actions: str | Sequence[str] | None = None, where: Mapping[str, Any] | None = None, sort_by: Sequence[str] | None = None, ascending: bool | None = None, group_by: str | None = None, include_group_context: bool = False, max_rows: int | None = None, max_groups: int | None = None, max_per_group: int | None = None) -> DataFrame:
    policy = POLICIES.get(check.name, PreviewPolicy()) if check else PreviewPolicy()
    column = check.check.action_column if check else "final_action"
    chosen = actions_of(actions if actions is not None else policy.actions)
    hit = df.where(F.col(column).isin(chosen)) if chosen is not None else df
    for name, value in (where or {}).items():
        if name in df.columns:
            hit = hit.where(F.col(name) == F.lit(value))
    group = group_by if group_by is not None else policy.group_by
    if group and group in df.columns:
        if include_group_context:
            # All rows of every group that has a hit.
            hit = df.join(hit.where(clean_text(group) != "").select(group).distinct(), group, "left_semi")
        return group_head(hit, group, max_groups or policy.max_groups, max_per_group or policy.max_per_group).limit(max_rows or policy.max_rows)
    keys = list(sort_by if sort_by is not None else policy.sort_by)
    up = policy.ascending if ascending is None else ascending
    order = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k in keys if k in df.columns]
    return hit.orderBy(*order, POSITION).limit(max_rows if max_rows is not None else policy.max_rows)


def group_head(df: DataFrame, group: str, max_groups: int, max_per_group: int) -> DataFrame:
    """The first rows of the first groups, groups in order of their first row; rows without a group name are skipped."""
    named = df.where(clean_text(group) != "")
    first = named.groupBy(group).agg(F.min(POSITION).alias("_first")).orderBy("_first").limit(max_groups)
    # At most `max_groups` rows are on this side.
    rows = named.join(F.broadcast(first), group)
    place = F.row_number().over(Window.partitionBy(group).orderBy(POSITION))
    return rows.withColumn("_n", place).where(F.col("_n") <= max_per_group).orderBy("_first", POSITION).drop("_n", "_first")


def html(df: DataFrame, check: ConfiguredCheck | None = None, title: str = "Preview", image_column: str = "image_uri", content: Mapping[str, bytes] | None = None, **options: Any) -> str:
    """A page of figures of the rows that `filtered` gives, which are a bounded number. `content` has image bytes by image id."""
    policy = POLICIES.get(check.name, PreviewPolicy()) if check else PreviewPolicy()
    group = options.get("group_by") or policy.group_by
    shown = filtered(df, check, **options)
    rows = [r.asDict() for r in shown.collect()]
    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{markup.escape(title)}</title><h1>{markup.escape(title)}</h1>"]
    last = None
    for r in rows:
        if group and group in r and r[group] != last:
            last = r[group]
            parts.append(f"<h2>{markup.escape(str(last))}</h2>")
        parts.append(figure(r, policy.captions, image_column, (content or {}).get(r.get("image_id"))))
    return "\n".join(parts)


def figure(row: Mapping[str, Any], captions: Sequence[str], image_column: str = "image_uri", content: bytes | None = None) -> str:
    said = "<br>".join(f"{markup.escape(c)}: {markup.escape(str(row[c]))}" for c in captions if row.get(c) not in (None, ""))
    if content is None and not row.get(image_column):
        image = "<div class='error'>no image</div>"
    else:
        source = "data:image/*;base64," + base64.b64encode(content).decode() if content else str(row[image_column])
        image = f"<img loading='lazy' width='160' src='{markup.escape(source, quote=True)}'>"
    return f"<figure>{image}<figcaption>{said}</figcaption></figure>"


def grid(df: DataFrame, rows: int, columns: int, max_num: int = 100, captions: Sequence[str] = ("image_id",)) -> str:
    """A table of figures of the first rows."""
    from ..sources.tabular import grid_limit

    found = [r.asDict() for r in df.limit(grid_limit(rows, columns, max_num)).collect()]
    lines = ["".join(f"<td>{figure(r, captions)}</td>" for r in found[i : i + columns]) for i in range(0, len(found), max(columns, 1))]
    return "<table>" + "".join(f"<tr>{x}</tr>" for x in lines) + "</table>"
