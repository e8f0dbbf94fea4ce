"""Grouped facts joined back to their rows without bringing a large group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups from this size on are joined by broadcast: there are at most rows / LARGE of them.
LARGE = 100_000


def attach(rows: DataFrame, key: Column, sums: DataFrame, position: str) -> DataFrame:
    """Left-joins `sums` (group_key, group_rows and further columns, one row a group) to rows by `key`; an empty key is no group.

    Large groups' facts, which are few whatever the rows are, go to all tasks; their rows, and those without a group, then have keys
    of their own in the join with the other groups."""
    facts = [c for c in sums.columns if c != "group_key"]
    large = F.broadcast(sums.where(F.col("group_rows") >= LARGE).select(F.col("group_key").alias("large_key"), *[F.col(c).alias(f"large_{c}") for c in facts]))
    out = rows.join(large, key == F.col("large_key"), "left")
    own = F.when(F.col("large_key").isNull() & (key != ""), key).otherwise(F.concat(F.lit("\0"), F.col(position).cast("string")))
    out = out.withColumn("own_key", own).join(sums.where(F.col("group_rows") < LARGE), F.col("own_key") == F.col("group_key"), "left")
    made = {c: F.coalesce(f"large_{c}", c) for c in facts} | {"group_key": F.coalesce("large_key", "group_key")}
    return out.withColumns(made).drop("own_key", "large_key", *[f"large_{c}" for c in facts])
