"""The raw image table: its columns and what makes a row valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import tag_problems

SCHEMA_VERSION = "raw.v1"
#: The names, types and order of the raw table's columns.
RAW_COLUMNS = {
    "image_id": "string",
    "source_uri": "string",
    "source_type": "string",
    "source_file_name": "string",
    "storage_name": "string",
    "image_uri": "string",
    "file_size_bytes": "bigint",
    "image_content_hash": "string",
    "file_extension": "string",
    "mime_type": "string",
    "image_format": "string",
    "width": "int",
    "height": "int",
    "pixel_count": "bigint",
    "aspect_ratio": "double",
    "orientation": "string",
    "channels": "int",
    "color_mode": "string",
    "has_alpha": "boolean",
    "animated": "boolean",
    "frame_count": "int",
    "dpi_x": "double",
    "dpi_y": "double",
    "icc_profile_present": "boolean",
    "exif_orientation": "int",
    "exif_datetime": "string",
    "camera_make": "string",
    "camera_model": "string",
    "gps_present": "boolean",
    "gps_latitude": "double",
    "gps_longitude": "double",
    "import_status": "string",
    "imported_at": "string",
    "schema_version": "string",
    "tags": "array<string>",
}


def validate(df: DataFrame) -> None:
    """Raises unless all columns are there and every tag is a path of non-empty parts."""
    if missing := [c for c in RAW_COLUMNS if c not in df.columns]:
        raise ValidationError(f"missing columns: {', '.join(missing)}")
    if not dict(df.dtypes)["tags"].startswith("array"):
        raise ValidationError("tags must be lists")
    bad = df.select(tag_problems("tags").alias("bad")).where(F.size("bad") > 0).first()
    if bad:
        raise ValidationError(f"invalid tags: {bad['bad']}")
