"""Images as rows: bytes by path, decoded pixels, raw facts, and reads by address column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels
from . import places

#: The image suffixes and their content types.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp")
MIME = {"JPEG": "image/jpeg", "PNG": "image/png", "GIF": "image/gif", "BMP": "image/bmp", "WEBP": "image/webp"}


def directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """image_uri and content of all image files under a path, by suffix whatever its case; in order of the paths."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in SUFFIXES) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(path)
    return df.select(F.col("path").alias("image_uri"), F.col("path").alias("source_uri"), F.col("length").alias("file_size_bytes"), "content")


def local_path(uri: str) -> str:
    """A file system path of a plain path or a file address (percent-decoded, drive letters kept); other schemes are errors."""
    if len(uri) > 1 and uri[1] == ":" and uri[0].isalpha():
        return uri
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        found = unquote(parts.path) if parts.scheme else uri
        return found[1:] if len(found) > 2 and found[0] == "/" and found[2] == ":" else found
    raise ValueError(f"unsupported scheme {parts.scheme!r}")


def object_parts(uri: str) -> tuple[str, str]:
    """Bucket and key of an s3 address."""
    parts = urlparse(uri)
    if parts.scheme != "s3" or not parts.netloc or not parts.path.strip("/"):
        raise ValueError(f"not an object address: {uri!r}")
    return parts.netloc, unquote(parts.path.lstrip("/"))


def read_by_uri(df: DataFrame, column: str = "image_uri") -> DataFrame:
    """Adds ok, content and error by reading each row's address in the tasks; nothing is listed, and a row that cannot be read is an error of its own."""
    rest = [f for f in df.schema.fields if f.name not in ("ok", "content", "error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data, errors = [], []
            for uri in frame[column]:
                try:
                    data.append(places.read(uri or ""))
                    errors.append("")
                except Exception as e:
                    data.append(None)
                    errors.append(f"cannot read {uri or ''}: {type(e).__name__}")
            yield frame.assign(ok=[e == "" for e in errors], content=data, error=errors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", ok boolean, content binary, error string"
    return df.select(*[f.name for f in rest]).mapInPandas(run, schema)


RAW_FACTS = {
    "file_size_bytes": "bigint", "image_content_hash": "string", "mime_type": "string", "image_format": "string", "width": "int", "height": "int", "channels": "int", "color_mode": "string",
    "has_alpha": "boolean", "animated": "boolean", "frame_count": "int", "dpi_x": "double", "dpi_y": "double", "icc_profile_present": "boolean", "exif_orientation": "int",
    "exif_datetime": "string", "camera_make": "string", "camera_model": "string", "gps_present": "boolean", "gps_latitude": "double", "gps_longitude": "double",
}


def raw_facts(data: bytes) -> dict:
    """What an image's bytes say about it; raises ValueError where they are no image."""
    shape = pixels.size_and_mode(data)
    if shape is None:
        raise ValueError("not a readable image")
    w, h, channels, mode, alpha = shape
    tags, (icc, x, y) = pixels.exif(data), pixels.icc_and_dpi(data)
    lat, lon = pixels.gps(tags)
    kind, n = pixels.image_format(data), pixels.frame_count(data)
    turn = tags.get(274)
    return {
        "file_size_bytes": len(data), "image_content_hash": "sha256:" + hashlib.sha256(data).hexdigest(), "mime_type": MIME.get(kind), "image_format": kind, "width": w, "height": h, "channels": channels,
        "color_mode": mode, "has_alpha": alpha, "animated": n > 1, "frame_count": n, "dpi_x": x, "dpi_y": y, "icc_profile_present": icc, "exif_orientation": turn if isinstance(turn, int) else None,
        "exif_datetime": tags.get((0x8769, 0x9003)) or tags.get(0x0132), "camera_make": tags.get(0x010F), "camera_model": tags.get(0x0110), "gps_present": lat is not None and lon is not None,
        "gps_latitude": lat, "gps_longitude": lon,
    }


def with_raw_facts(df: DataFrame) -> DataFrame:
    """Adds `facts` (null where the bytes are no image) and `facts_error`, in one pass over `content`."""
    kind = ", ".join(f"{n}: {t}" for n, t in RAW_FACTS.items())
    schema = f"facts struct<{kind}>, facts_error string"

    @F.pandas_udf(schema.replace("facts struct", "facts struct"))
    def read(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in content:
            facts, errors = [], []
            for data in batch:
                try:
                    if data is None:
                        raise ValueError("no data")
                    facts.append(raw_facts(bytes(data)))
                    errors.append("")
                except ValueError as e:
                    facts.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"facts": facts, "facts_error": errors})

    return df.withColumn("_read", read("content")).withColumns({"facts": F.col("_read.facts"), "facts_error": F.col("_read.facts_error")}).drop("_read")


def content_id(content: Column | str = "content") -> Column:
    """An asset's identity: the digest of its bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
