"""Import: images from a source are checked, described, copied into storage and listed as raw rows; failures are listed beside them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import orientation_of
from ..storing import JsonFiles, forget, stored
from . import images, places, raw


@dataclass(frozen=True)
class ImportResult:
    raw_path: str
    failure_path: str
    report_path: str
    report: dict


def from_directory(spark: SparkSession, path: str) -> DataFrame:
    return images.directory(spark, path).select("source_uri", "content", F.lit("local_path").alias("source_type"), F.lit("").alias("error"))


def from_table(df: DataFrame, image_column: str = "image_uri", source_column: str | None = None) -> DataFrame:
    """Rows of a table by its address column; the source is the source column, or the address where that is empty."""
    source = F.coalesce(F.nullif(F.trim(source_column), F.lit("")), F.col(image_column)) if source_column else F.col(image_column)
    read = images.read_by_uri(df.select(F.col(image_column).alias("image_uri"), source.alias("source_uri")))
    return read.select("source_uri", "content", F.lit("dataset").alias("source_type"), "error")


def from_urls(urls: DataFrame, get: Callable[[str], bytes] | None = None) -> DataFrame:
    from . import urls as web

    got = web.download(urls, get) if get else web.download(urls)
    return got.select(F.col("url").alias("source_uri"), "content", F.lit("url_path").alias("source_type"), "error")


def take_in(source: DataFrame, staging: str) -> DataFrame:
    """Reads each source row once: its facts, and its bytes into a file of its own under `staging`. source_uri, source_type, image_id, stage (where it
    failed; empty where it did not), error and facts, without the bytes."""
    facts = ", ".join(f"{n}: {t}" for n, t in images.RAW_FACTS.items())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uri, kind, data, error in zip(frame["source_uri"], frame["source_type"], frame["content"], frame["error"], strict=True):
                image_id, found, stage = str(uuid.uuid4()), None, ""
                if error or data is None:
                    stage, error = "source", error or "no data"
                else:
                    stage = "metadata"
                    try:
                        found = images.raw_facts(bytes(data))
                        stage = "storage"
                        places.write(f"{staging}/{image_id}", bytes(data))
                        stage, error = "", ""
                    except (OSError, ValueError) as e:
                        error = str(e) or type(e).__name__
                out.append((uri, kind, image_id, stage, error, found))
            yield pd.DataFrame(out, columns=["source_uri", "source_type", "image_id", "stage", "error", "facts"])

    return source.select("source_uri", "source_type", "content", "error").mapInPandas(run, f"source_uri string, source_type string, image_id string, stage string, error string, facts struct<{facts}>")


def put_in_place(df: DataFrame, staging: str, root: str) -> DataFrame:
    """Moves each row's file to root/relative_path; adds copy_error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            errors = []
            for image_id, name in zip(frame["image_id"], frame["relative_path"], strict=True):
                try:
                    places.move(f"{staging}/{image_id}", f"{root.rstrip('/')}/{name}")
                    errors.append("")
                except OSError as e:
                    try:  # a task that is run again finds it moved
                        places.read(f"{root.rstrip('/')}/{name}")
                        errors.append("")
                    except OSError:
                        errors.append(str(e))
            yield frame.assign(copy_error=errors)

    return df.mapInPandas(run, "image_id string, relative_path string, copy_error string")


def run_import(source: DataFrame, storage_root: str, output: str, storage_name: str = "local", prefix: str = "images", tags: Sequence[str] = (), max_shard_size: int = 1000) -> ImportResult:
    """`source` has source_uri, content, source_type and error. Shards are numbered over the rows that succeed, in order of their sources.

    The source is read once: its bytes go to a staging folder of the storage and are moved to their places, which only names take part in."""
    spark = source.sparkSession
    now = datetime.now(UTC)
    day = now.strftime("%Y-%m-%d")
    staging = f"{storage_root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    read = stored(take_in(source, staging), "taken")
    good = read.where("stage = ''")
    ext = F.lower(F.regexp_extract("source_uri", r"(\.[A-Za-z0-9]+)(?:[?#].*)?$", 1))
    # Row numbers over all rows are the sums of earlier partitions' counts, so that no task sees all rows.
    numbered = _numbered(good.select("source_uri", "image_id"), "source_uri")
    shard = F.format_string("shard_%03d", (F.floor(F.col("_n") / max_shard_size) + 1).cast("int"))
    placed = numbered.select("image_id", F.concat_ws("/", F.lit(prefix), F.lit(day), shard, F.concat("image_id", ext)).alias("relative_path"))
    moved = stored(put_in_place(placed, staging, storage_root), "imported")
    done = good.join(moved, "image_id").withColumn("file_extension", ext)
    row = {
        "source_file_name": F.regexp_extract("source_uri", r"([^/]*)$", 1), "storage_name": F.lit(storage_name), "image_uri": F.concat(F.lit(storage_root.rstrip("/") + "/"), F.col("relative_path")),
        "pixel_count": F.col("facts.width").cast("long") * F.col("facts.height"), "aspect_ratio": F.expr("try_divide(facts.width, facts.height)"), "orientation": orientation_of("facts.width", "facts.height"),
        "import_status": F.lit("imported"), "imported_at": F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")), "schema_version": F.lit(raw.SCHEMA_VERSION),
        "tags": F.array_distinct(F.array(*map(F.lit, tags)).cast("array<string>")),
    }
    rows = done.where("copy_error = ''").withColumns(row)
    columns = [(F.col(f"facts.{c}") if c in images.RAW_FACTS else F.col(c)).cast(t).alias(c) for c, t in raw.RAW_COLUMNS.items()]
    failures = read.where("stage != ''").select("source_uri", "stage", "error").union(moved.where("copy_error != ''").join(good, "image_id").select("source_uri", F.lit("storage"), "copy_error"))
    rows.select(*columns).write.mode("overwrite").parquet(f"{output}/raw.parquet")
    failures.write.mode("overwrite").json(f"{output}/failure_manifest.jsonl")
    ok, bad = spark.read.parquet(f"{output}/raw.parquet").count(), failures.count()
    report = {"total": ok + bad, "succeeded": ok, "failed": bad, "imported_at": now.isoformat()}
    spark.createDataFrame([(ok + bad, ok, bad, now.isoformat())], "total bigint, succeeded bigint, failed bigint, imported_at string").coalesce(1).write.mode("overwrite").json(f"{output}/import_report.json")
    JsonFiles(spark).remove(staging)
    for df in (read, moved):
        forget(df)
    return ImportResult(f"{output}/raw.parquet", f"{output}/failure_manifest.jsonl", f"{output}/import_report.json", report)


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds `_n`, the row's number from 0 in the order: a range partitioning, a count for each partition, and their running sum."""
    dealt = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    kept = stored(dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("_part").agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return kept.join(F.broadcast(sums.select("_part", "_base")), "_part").withColumn("_n", F.col("_base") + F.col("_at")).drop("_part", "_base", "_at")
