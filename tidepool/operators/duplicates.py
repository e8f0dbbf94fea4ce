"""Duplicate groups: equal hashes, hashes within a Hamming distance, vectors above a similarity; and the relation tables of their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_text
from .checks import POSITION
from .grouping import attach
from .leaders import hamming_edges, lead, similarity_edges

#: The columns of a relation table.
RELATION = ("relation_type", "source_image_id", "target_image_id", "score", "group_id", "parameter_name", "computer_name", "artifact_ref", "created_at")


def exact_groups(rows: DataFrame, key: str = "content_hash") -> DataFrame:
    """Adds exact_duplicate_group_id and _count. Counts are aggregated before they are joined back, and empty hashes take no part."""
    h = clean_text(key)
    sums = rows.where(h != "").groupBy(h.alias("group_key")).agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    out = attach(rows, h, sums, POSITION)
    made = {"exact_duplicate_group_id": F.coalesce(F.concat(F.lit("exact-"), F.col("group_key")), F.lit("")), "exact_duplicate_count": F.coalesce("group_rows", F.lit(1)).cast("long")}
    return out.withColumns(made).drop("group_key", "group_rows")


def relation(pairs: DataFrame, kind: str, parameter: str, computer: str, artifact: str = "") -> DataFrame:
    """Pairs (source_image_id, target_image_id, score, group_id) as a relation table."""
    made = {"relation_type": F.lit(kind), "parameter_name": F.lit(parameter), "computer_name": F.lit(computer), "artifact_ref": F.lit(artifact), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return pairs.withColumns(made).select(*RELATION)


def exact_pairs(grouped: DataFrame) -> DataFrame:
    """A pair from each member to the first row of its group; rows follow members, not pairs of members."""
    members = grouped.where("exact_duplicate_group_id != ''")
    first = members.groupBy("exact_duplicate_group_id").agg(F.min_by("image_id", POSITION).alias("_keeper"), F.min(POSITION).alias("_first"))
    pairs = members.join(first, "exact_duplicate_group_id").where(F.col(POSITION) != F.col("_first"))
    return pairs.select(F.col("_keeper").alias("source_image_id"), F.col("image_id").alias("target_image_id"), F.lit(1.0).alias("score"), F.col("exact_duplicate_group_id").alias("group_id"))


def _attach(rows: DataFrame, led: DataFrame) -> DataFrame:
    """Adds the outcome of `lead`: keeper_pos, keeper_id, value and size of the group (null outside groups)."""
    sized = led.groupBy("keeper_pos").agg(F.count("*").alias("_size"))
    named = led.join(sized, "keeper_pos").select(F.col("pos").alias(POSITION), "keeper_pos", "keeper_id", "value", "_size")
    return rows.join(named.where("_size > 1"), POSITION, "left")


def perceptual_groups(rows: DataFrame, max_distance: int = 10, key: str = "phash") -> DataFrame:
    """Adds perceptual_duplicate_group_id, _count and _distance: each row belongs to the nearest earlier keeper within the distance."""
    used = rows.where(clean_text(key).rlike("^[0-9a-fA-F]{16}$")).select(F.col(POSITION).alias("pos"), "image_id", F.lower(key).alias("hash"))
    led = lead(used.select("pos", "image_id"), hamming_edges(used, max_distance), best_is_least=True, own=0.0)
    hashes = used.select(F.col("pos").alias("keeper_pos"), F.col("hash").alias("_keeper_hash"))
    out = _attach(rows, led).join(hashes, "keeper_pos", "left")
    made = {
        "perceptual_duplicate_group_id": F.coalesce(F.concat(F.lit("perceptual-"), F.col("_keeper_hash")), F.lit("")),
        "perceptual_duplicate_count": F.coalesce("_size", F.lit(1)).cast("long"),
        "perceptual_duplicate_distance": F.col("value").cast("long"),
    }
    return out.withColumns(made).drop("keeper_pos", "keeper_id", "value", "_size", "_keeper_hash")


def perceptual_pairs(grouped: DataFrame) -> DataFrame:
    first = Window.partitionBy("perceptual_duplicate_group_id").orderBy(POSITION)
    members = grouped.where("perceptual_duplicate_group_id != ''").withColumn("_keeper", F.first("image_id").over(first)).withColumn("_n", F.row_number().over(first))
    return members.where("_n > 1").select(F.col("_keeper").alias("source_image_id"), F.col("image_id").alias("target_image_id"), (1 - F.col("perceptual_duplicate_distance") / 64).alias("score"), F.col("perceptual_duplicate_group_id").alias("group_id"))


def semantic_groups(rows: DataFrame, threshold: float = 0.92, key: str = "embedding") -> DataFrame:
    """Adds semantic_duplicate_group_id, _count, _score and semantic_duplicate_nearest_image_id: each row belongs to the most similar earlier keeper."""
    fine = F.col(key).isNotNull() & (F.size(key) > 0) & F.forall(key, lambda x: x.isNotNull() & ~F.isnan(x))
    used = rows.where(fine).select(F.col(POSITION).alias("pos"), "image_id", F.col(key).cast("array<double>").alias("vector"))
    led = lead(used.select("pos", "image_id"), similarity_edges(used, threshold), best_is_least=False, own=1.0)
    out = _attach(rows, led)
    made = {
        "semantic_duplicate_group_id": F.coalesce(F.concat(F.lit("semantic-"), F.col("keeper_id")), F.lit("")),
        "semantic_duplicate_count": F.coalesce("_size", F.lit(1)).cast("long"),
        "semantic_duplicate_score": F.col("value"),
        "semantic_duplicate_nearest_image_id": F.coalesce("keeper_id", F.lit("")),
    }
    return out.withColumns(made).drop("keeper_pos", "keeper_id", "value", "_size")


def semantic_pairs(grouped: DataFrame) -> DataFrame:
    members = grouped.where("semantic_duplicate_group_id != '' and semantic_duplicate_nearest_image_id != image_id")
    return members.select(F.col("semantic_duplicate_nearest_image_id").alias("source_image_id"), F.col("image_id").alias("target_image_id"), F.col("semantic_duplicate_score").alias("score"), F.col("semantic_duplicate_group_id").alias("group_id"))
