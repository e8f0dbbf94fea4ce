"""Tables of files as handles: a path and a format by suffix, read lazily with pruning and pushdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import POSITION

FORMATS = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json", ".json": "json"}


#: Other formats by suffix: how a path is read and how a table is written to it.
_OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Callable[[DataFrame, str], None] | None]] = {}


def register_format(suffix: str, read: Callable[[SparkSession, str], DataFrame], write: Callable[[DataFrame, str], None] | None = None) -> None:
    """Makes tables of another suffix known, e.g. by a data source of the caller's."""
    if suffix in FORMATS or not suffix.startswith("."):
        raise ValueError(f"{suffix!r} cannot be registered")
    _OTHERS[suffix] = (read, write)


def format_of(path: str) -> str:
    for suffix, kind in (FORMATS | {s: s for s in _OTHERS}).items():
        if path.rstrip("/").lower().endswith(suffix):
            return kind
    raise ValueError(f"no table format for {path!r}; known are {', '.join(FORMATS)}")


def with_position(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Adds `_pos`, the table's order as a unique long. By `order` columns where given; else the order in which files hold the rows."""
    if order:
        if len(order) == 1 and dict(df.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint"):
            return df.withColumn(POSITION, F.col(order[0]).cast("long"))
        df = df.orderBy(*order)
    # Partitions are numbered in order, and rows within them, without moving any.
    return df.withColumn(POSITION, F.monotonically_increasing_id())


@dataclass(frozen=True)
class Dataset:
    path: str
    format: str

    @classmethod
    def load(cls, path: str, format: str | None = None) -> Dataset:
        return cls(path, format or format_of(path))

    @classmethod
    def write(cls, df: DataFrame, path: str, mode: str = "overwrite", format: str | None = None) -> Dataset:
        kind = format or format_of(path)
        if kind in _OTHERS:
            if _OTHERS[kind][1] is None:
                raise ValueError(f"{kind} tables are only read")
            _OTHERS[kind][1](df, path)
            return cls(path, kind)
        writer = df.write.mode(mode)
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
        return cls(path, kind)

    def frame(self, spark: SparkSession, columns: Sequence[str] | None = None) -> DataFrame:
        if self.format in _OTHERS:
            df = _OTHERS[self.format][0](spark, self.path)
            return df.select(*columns) if columns is not None else df
        reader = spark.read.option("header", True).option("inferSchema", True) if self.format == "csv" else spark.read
        df = reader.format(self.format).load(self.path)
        return df.select(*columns) if columns is not None else df

    def scan(self, spark: SparkSession, columns: Sequence[str] | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Rows that equal all filters; a filter's column need not be selected."""
        df = self.frame(spark)
        for name, value in (filters or {}).items():
            df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        return df.select(*dict.fromkeys(columns)) if columns is not None else df

    def preview(self, spark: SparkSession, limit: int = 100) -> DataFrame:
        return self.frame(spark).limit(limit)

    def count(self, spark: SparkSession) -> int:
        return self.frame(spark).count()

    def validate_readable(self, spark: SparkSession) -> None:
        self.frame(spark).limit(1).collect()

    def rows(self, spark: SparkSession, columns: Sequence[str] | None = None) -> Iterator[Row]:
        """Rows one partition at a time; repeated columns are named once."""
        return self.scan(spark, columns).toLocalIterator()

    def fingerprint(self, spark: SparkSession) -> str:
        return fingerprint(self.frame(spark))

    def export(self, spark: SparkSession, path: str, drop: Sequence[str] = ("source_uri",)) -> Dataset:
        return self.write(self.frame(spark).drop(*drop), path)


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows whatever their order and partitions are, from one aggregation: the count and two sums of row hashes."""
    import hashlib

    names = sorted(df.columns)
    row = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    a, b = F.xxhash64(row), F.xxhash64(F.lit("second"), row)
    sums = df.select(a.cast("decimal(38,0)").alias("a"), b.cast("decimal(38,0)").alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(repr((names, *map(str, sums))).encode()).hexdigest()


def sorted_by(df: DataFrame, columns: Sequence[str], direction: str = "asc") -> DataFrame:
    """By one column, missing values last in both directions, ties in table order."""
    if len(columns) != 1:
        raise ValueError("sorting is by one column")
    if direction not in ("asc", "desc"):
        raise ValueError(f"direction must be asc or desc, not {direction!r}")
    c = F.col(columns[0])
    if dict(df.dtypes)[columns[0]] in ("double", "float"):
        c = F.nanvl(c, F.lit(None))
    order = [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()]
    return df.orderBy(*order, *([POSITION] if POSITION in df.columns else []))


def grid_limit(rows: int, columns: int, most: int) -> int:
    if min(rows, columns, most) < 0:
        raise ValueError("sizes of a grid are not negative")
    return min(rows * columns, most)


def sample(df: DataFrame, n: int, seed: str, key: str = "image_id") -> DataFrame:
    """n rows chosen by hash, the same for the same seed whatever the partitions are, in table order."""
    if n < 0:
        raise ValueError("a sample's size is not negative")
    chosen = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
    return chosen.orderBy(POSITION) if POSITION in df.columns else chosen
