"""Parameter computers: what each produces, needs and is configured by, and how a plan of them is ordered and run.

Row-local image computers of one run share one pass over the bytes: each image is decoded once (JPEG, PNG and GIF inside the JVM) and a
single mapInPandas returns only the columns that are asked for. Where grouping computers follow, which read their table more than once, that pass's
columns are stored first, with the rows' positions. Table computers are column expressions, aggregate computers are joins with grouped sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, ModelError
from ..functions import number
from ..storing import stored
from . import duplicates, pixels
from .rasters import RASTER, with_raster

PER_IMAGE, TABLE, AGGREGATE = "per_image", "table", "dataset_aggregate"
_MODES = (PER_IMAGE, TABLE, AGGREGATE)


@dataclass
class Image:
    """One image of a batch: bytes, decoded pixels (RGB) and what went wrong, shared by all computers of the pass."""

    data: bytes | None
    rgb: np.ndarray | None = None
    error: str = ""

    @property
    def gray(self) -> np.ndarray | None:
        if not hasattr(self, "_gray"):
            self._gray = None if self.rgb is None else pixels.gray(self.rgb)
        return self._gray


@dataclass(frozen=True)
class Computer:
    """`types` gives the produced columns. `image(image, config)` or, for batches, `images(images, config)` is for PER_IMAGE,
    `table(df, config)` for the others."""

    name: str
    mode: str
    types: Mapping[str, str]
    requires: tuple[str, ...] = ()
    config: tuple[str, ...] = ()
    image: Callable[[Image, Mapping], Mapping[str, Any]] | None = None
    images: Callable[[list[Image], Mapping], list[Mapping[str, Any]]] | None = None
    table: Callable[[DataFrame, Mapping], DataFrame] | None = None
    before_run: Callable[[Mapping], None] | None = None
    relations: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def _metadata(x: Image, _: Mapping) -> dict:
    if x.rgb is None:
        return {"width": None, "height": None, "format": "", "decode_ok": False, "decode_error": x.error, "file_size": None if x.data is None else len(x.data)}
    return {"width": x.rgb.shape[1], "height": x.rgb.shape[0], "format": pixels.image_format(x.data or b""), "decode_ok": True, "decode_error": "", "file_size": len(x.data or b"")}


def _format_detail(x: Image, _: Mapping) -> dict:
    if x.data is None:
        return {"frame_count": None, "animated": None, "exif_orientation": None, "orientation_risk": None}
    turn, n = pixels.exif(x.data).get(274), pixels.frame_count(x.data)
    turn = int(turn) if isinstance(turn, int) else None
    return {"frame_count": n, "animated": n > 1, "exif_orientation": turn, "orientation_risk": turn not in (None, 1)}


def _content_hash(x: Image, _: Mapping) -> dict:
    import hashlib

    return {"content_hash": hashlib.sha256(x.data).hexdigest() if x.data is not None else ""}


def _derived(df: DataFrame, _: Mapping) -> DataFrame:
    w, h = number("width"), number("height")
    both = (w > 0) & (h > 0)
    return df.withColumns({"aspect_ratio": F.when(both, w / h), "megapixels": F.when(both, w * h / 1e6)})


def _only(names: Iterable[str], made: Callable[[Image], Mapping]) -> Callable[[Image, Mapping], Mapping]:
    names = tuple(names)
    return lambda x, c: dict.fromkeys(names) if x.rgb is None else made(x, c)


#: What the computers are called and produce (here and in `builtin`).
_QUALITY = ("blur_score", "brightness_score", "contrast_score", "blank_score")
_DETAIL = ("dark_pixel_ratio", "bright_pixel_ratio", "clipped_pixel_ratio", "noise_score", "mono_color_score")
_BORDER = {"border_padding_ratio": "double", "border_padding_sides": "string", "border_padding_color": "string"}


def builtin(embed: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> list[Computer]:
    """The twelve computers. `embed` turns a list of images into a float32 matrix; without it the embedding computer cannot run."""

    def check_provider(_: Mapping) -> None:
        if embed is None:
            raise ModelError("no embedding provider is given")

    def embedding(xs: list[Image], c: Mapping) -> list[dict]:
        out: list[dict] = [{"embedding": None, "semantic_embedding_ref": ""} for _ in xs]
        some, size = [i for i, x in enumerate(xs) if x.rgb is not None], int(c.get("batch_size", 32))
        for at in range(0, len(some), size):
            part = some[at : at + size]
            v = np.asarray(embed([xs[i].rgb for i in part]), np.float32)
            if v.ndim != 2 or len(v) != len(part) or not np.isfinite(v).all():
                raise ModelError("a provider must return one finite vector for each image")
            for i, row in zip(part, v, strict=True):
                out[i] = {"embedding": row.tolist(), "semantic_embedding_ref": "embedding"}
        return out

    return [
        Computer("image_metadata_computer", PER_IMAGE, {"width": "int", "height": "int", "format": "string", "decode_ok": "boolean", "decode_error": "string", "file_size": "bigint"}, image=_metadata),
        Computer("table_derived_computer", TABLE, {"aspect_ratio": "double", "megapixels": "double"}, ("width", "height"), table=_derived),
        Computer("image_quality_computer", PER_IMAGE, dict.fromkeys(_QUALITY, "double"), image=_only(_QUALITY, lambda x, c: pixels.quality(x.gray))),
        Computer("image_quality_detail_computer", PER_IMAGE, dict.fromkeys(_DETAIL, "double"), image=_only(_DETAIL, lambda x, c: pixels.detail(x.rgb, x.gray))),
        Computer("image_border_computer", PER_IMAGE, _BORDER, config=("min_side_ratio",), image=_only(_BORDER, lambda x, c: pixels.border(x.rgb, min_side_ratio=c.get("min_side_ratio", 0.08)))),
        Computer("image_format_detail_computer", PER_IMAGE, {"frame_count": "int", "animated": "boolean", "exif_orientation": "int", "orientation_risk": "boolean"}, image=_format_detail),
        Computer("image_hash_computer", PER_IMAGE, {"content_hash": "string"}, image=_content_hash),
        Computer("image_perceptual_hash_computer", PER_IMAGE, {"phash": "string"}, image=lambda x, c: {"phash": "" if x.gray is None else pixels.phash(x.gray)}),
        Computer("duplicate_group_computer", AGGREGATE, {"exact_duplicate_group_id": "string", "exact_duplicate_count": "bigint"}, ("content_hash",), table=lambda df, c: duplicates.exact_groups(df), relations={"exact_duplicate": duplicates.exact_pairs}),
        Computer("perceptual_duplicate_group_computer", AGGREGATE, {"perceptual_duplicate_group_id": "string", "perceptual_duplicate_count": "bigint", "perceptual_duplicate_distance": "bigint"}, ("phash",), ("max_distance",), table=lambda df, c: duplicates.perceptual_groups(df, c.get("max_distance", 10)), relations={"perceptual_duplicate": duplicates.perceptual_pairs}),
        Computer("semantic_embedding_computer", PER_IMAGE, {"embedding": "array<float>", "semantic_embedding_ref": "string"}, config=("provider", "model_id", "batch_size"), images=embedding, before_run=check_provider),
        Computer("semantic_duplicate_group_computer", AGGREGATE, {"semantic_duplicate_group_id": "string", "semantic_duplicate_count": "bigint", "semantic_duplicate_score": "double", "semantic_duplicate_nearest_image_id": "string"}, ("embedding",), ("threshold",), table=lambda df, c: duplicates.semantic_groups(df, c.get("threshold", 0.92)), relations={"semantic_duplicate": duplicates.semantic_pairs}),
    ]


class Registry:
    """Computers by name and by what they produce."""

    def __init__(self, computers: Iterable[Computer] = ()):
        self.by_name: dict[str, Computer] = {}
        self.producer: dict[str, Computer] = {}
        for c in computers:
            self.register(c)

    def register(self, c: Computer) -> None:
        if c.name in self.by_name:
            raise ConfigError(f"{c.name} is registered already")
        if c.mode not in _MODES:
            raise ConfigError(f"{c.name}: unknown mode {c.mode!r}")
        for p in c.types:
            if p in self.producer:
                raise ConfigError(f"{p} is produced by {self.producer[p].name} and {c.name}")
        self.by_name[c.name] = c
        self.producer.update(dict.fromkeys(c.types, c))

    def plan(self, wanted: Sequence[str], given: Iterable[str]) -> list[tuple[Computer, tuple[str, ...]]]:
        """The computers to run, each with the outputs that are asked for: what `wanted` needs beyond the `given` columns, in
        dependency order (ties: by mode, then name)."""
        have, asked, open_, seen = set(given), {}, list(wanted), []

        def need(parameter: str, trail: tuple[str, ...]) -> None:
            if parameter in have:
                return
            c = self.producer.get(parameter)
            if c is None:
                raise ConfigError(f"nothing produces {parameter}")
            if c.name in trail:
                raise ConfigError("computers depend on each other: " + " -> ".join([*trail, c.name]))
            asked.setdefault(c.name, set()).add(parameter)
            for p in c.requires:
                need(p, (*trail, c.name))

        for p in open_:
            need(p, ())
        left = dict(asked)
        while left:
            ready = [n for n in left if all(p in have or self.producer[p].name in seen for p in self.by_name[n].requires)]
            n = min(ready, key=lambda n: (_MODES.index(self.by_name[n].mode), n))
            seen.append(n)
            left.pop(n)
        return [(self.by_name[n], tuple(p for p in self.by_name[n].types if p in asked[n])) for n in seen]


def decode(data: bytes | None, raster: bytes | None = None) -> tuple[np.ndarray | None, str]:
    """RGB pixels, or an error. `raster` has the samples that the JVM found (`rasters`); without them uncompressed images are read (BMP of 24
    or 32 bits, binary PGM and PPM) and PNG of 8 bits without interlacing."""
    if data is None:
        return None, "no data"
    try:
        return (_decode(data) if raster is None else pixels.from_raster(data, raster)), ""
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def _decode(data: bytes) -> np.ndarray:
    import re
    import struct
    import zlib

    if m := re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data):
        w, h, channels = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
        x = np.frombuffer(data, np.uint8, w * h * channels, m.end()).reshape(h, w, channels)
        return np.repeat(x, 3, 2) if channels == 1 else x
    if data[:2] == b"BM":
        (start,), (w, h, _, bits, packed) = struct.unpack("<I", data[10:14]), struct.unpack("<iiHHI", data[18:34])
        if bits not in (24, 32) or packed not in (0, 3):
            raise ValueError("unsupported BMP")
        line = (w * bits // 8 + 3) // 4 * 4
        x = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
        return (x[::-1] if h > 0 else x)[:, :, 2::-1]
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", data[16:29])
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth != 8 or lace:
            raise ValueError("unsupported PNG")
        parts = list(pixels._png_chunks(data))
        raw = np.frombuffer(zlib.decompress(b"".join(c for k, c in parts if k == b"IDAT")), np.uint8).reshape(h, 1 + w * channels)
        out = np.zeros((h, w * channels), np.int64)
        for y in range(h):
            kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(w * channels, np.int64)
            if kind == 0:
                out[y] = line
            elif kind == 2:
                out[y] = (line + up) & 255
            elif kind == 1:
                out[y] = (np.cumsum(line.reshape(w, channels), 0) & 255).ravel()
            else:
                for i in range(w * channels):
                    a = out[y, i - channels] if i >= channels else 0
                    b, c = up[i], up[i - channels] if i >= channels else 0
                    if kind == 3:
                        p = (a + b) // 2
                    else:
                        p = min((a, b, c), key=lambda v: abs(a + b - c - v))
                    out[y, i] = (line[i] + p) & 255
        x = out.astype(np.uint8).reshape(h, w, channels)
        if color == 3:
            palette = np.frombuffer(next(c for k, c in parts if k == b"PLTE"), np.uint8).reshape(-1, 3)
            return palette[x[:, :, 0]]
        return np.repeat(x[:, :, :1], 3, 2) if channels < 3 else x[:, :, :3]
    kind = pixels.image_format(data)
    raise ValueError(f"cannot decode {kind} data" if kind else "cannot identify image data")


def _pixels_of(row: Mapping) -> tuple[np.ndarray | None, str]:
    """Pixels of Spark's image struct (BGR, one to four channels)."""
    if row is None or row["height"] < 0:
        return None, "cannot decode image data"
    x = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return (np.repeat(x, 3, 2) if x.shape[2] == 1 else x[:, :, 2::-1]), ""


def run_images(df: DataFrame, steps: Sequence[tuple[Computer, tuple[str, ...]]], config: Mapping[str, Mapping]) -> DataFrame:
    """Adds the asked columns of the PER_IMAGE steps. `df` has `content` (bytes), and `image` (Spark's struct) where it is decoded already."""
    asked = [(c, names, dict(config.get(c.name, {}))) for c, names in steps]
    columns = [(n, c.types[n]) for c, names, _ in asked for n in names]
    keep = [c for c in df.columns if c not in ("content", "image", RASTER) and c not in {n for n, _ in columns}]
    has_image = "image" in df.columns
    if not has_image:
        df = with_raster(df)
    extra = [f"`{n}` {t}" for n, t in columns]
    pandas_int = {"int": "Int32", "bigint": "Int64", "boolean": "boolean"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made: dict[str, list] = {n: [] for n, _ in columns}
            all_images = []
            for i in range(len(frame)):
                data = frame["content"].iat[i]
                data = bytes(data) if data is not None else None
                rgb, error = _pixels_of(frame["image"].iat[i]) if has_image else decode(data, frame[RASTER].iat[i])
                all_images.append(Image(data, rgb, error))
            for c, names, conf in asked:
                for got in c.images(all_images, conf) if c.images else (c.image(x, conf) for x in all_images):
                    for n in names:
                        made[n].append(got[n])
            out = frame[keep].copy()
            for n, t in columns:
                out[n] = pd.array(made[n], pandas_int[t]) if t in pandas_int else made[n]
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields] + extra)
    return df.select(*keep, "content", "image" if has_image else RASTER).mapInPandas(run, schema)


def run_parameters(df: DataFrame, wanted: Sequence[str], registry: Registry, config: Mapping[str, Mapping] | None = None) -> tuple[DataFrame, list[str]]:
    """The table with all wanted parameters and the computers that ran. Image computers come first, in one pass over the bytes."""
    config = config or {}
    steps = registry.plan(wanted, df.columns)
    for c, _ in steps:
        if c.before_run:
            c.before_run(config.get(c.name, {}))
    images = [s for s in steps if s[0].mode == PER_IMAGE]
    if images:
        if "content" not in df.columns:
            raise ConfigError("image computers need the column `content`")
        df = run_images(df, images, config)
        if any(c.mode == AGGREGATE for c, _ in steps):
            df = stored(df, "parameters")
    for c, _ in steps:
        if c.mode != PER_IMAGE:
            df = c.table(df, config.get(c.name, {}))
    return df, [c.name for c, _ in steps]
