"""The row-local part of a cleaning run on streams of images. Groups of duplicates need the whole table and stay with batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ConfigError
from ..operators.checks import evaluate
from ..operators.computers import AGGREGATE, run_parameters
from ..operators.merge import merge_actions
from ..plans.cleaner import BasicCleaner
from ..sources.images import content_id

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def images(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """image_id (of the bytes), image_uri and content of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(content_id().alias("image_id"), F.col("path").alias("image_uri"), "content")


def cleaned(rows: DataFrame, cleaner: BasicCleaner) -> DataFrame:
    """The final action of each row, from checks that look at one row only."""
    grouped = [c.name for c, _ in cleaner.registry.plan(cleaner.wanted(), rows.columns) if c.mode == AGGREGATE]
    if grouped:
        raise ConfigError(f"these need the whole table: {', '.join(grouped)}")
    parameters, _ = run_parameters(rows, cleaner.wanted(), cleaner.registry, cleaner.computer_config())
    return merge_actions(evaluate(parameters, list(cleaner.config.checks)), cleaner.config.checks)


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
