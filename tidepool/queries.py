"""Every operator on the sample tables, with SQL that gives the same rows.

The tables have no images, so that each query projects one of them to the shape that an operator reads: part sizes as image sizes, event
values as scores, documents as contents, embeddings as vectors, hashes or small rasters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import hamming, hex_halves, sorted_unique, tag_problems, two_level_action
from .operators import computers, duplicates
from .operators.checks import CHECKS, POSITION, Check, ConfiguredCheck, evaluate
from .operators.merge import action_summary, bucket, merge_actions, operator_summary
from .operators.metrics import METRICS, relative_to_absolute
from .plans.preview import filtered, group_head
from .sources.annotations import to_pixels, to_relative
from .sources.storage import Prefix
from .sources.tabular import Dataset, sample, sorted_by
from .sources.urls import url_error
from .storing import shared_dir
from .versions import Manager
from .versions.rows import counters, merged, outside
from .versions.vectors import nearest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_images(df: DataFrame, key: str, **columns: F.Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("image_id"), F.col(key).cast("long").alias(POSITION), F.concat(F.lit("file:///"), F.col(key).cast("string")).alias("image_uri"), *[c.alias(n) for n, c in columns.items()])


def shown(df: DataFrame, *checks: ConfiguredCheck) -> DataFrame:
    return df.select("image_id", *[n for c in checks for n in c.check.outcome_columns])


# Checks on one column each.

_PART = "WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_size * 20 AS width, p_partkey % 1000 AS height FROM part), d AS (SELECT *, CASE WHEN width > 0 AND height > 0 THEN width / height END AS aspect_ratio, CASE WHEN width > 0 AND height > 0 THEN width * height / 1e6 END AS megapixels FROM t)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = as_images(table(spark, sf_dir, "part"), "p_partkey", width=F.col("p_size") * 20, height=(F.col("p_partkey") % 1000).cast("int"))
    return computers.Registry(computers.builtin()).by_name["table_derived_computer"].table(sized, {})


def _simple(name: str, source: Callable[[SparkSession, str], DataFrame], config: dict, start: str, hit: str, reason: str) -> None:
    check = CHECKS[name].configured(config)
    sql = f"{start} SELECT image_id, CASE WHEN {hit} THEN '{check.config['action']}' ELSE 'keep' END AS {name}_action, CASE WHEN {hit} THEN {reason} ELSE '' END AS {name}_reason FROM d"
    query(f"check_{name}", sql)(lambda spark, sf_dir: shown(evaluate(source(spark, sf_dir), [check]), check))


_simple("dimension", parts, {"min_width": 200, "min_height": 100}, _PART, "width < 200 OR height < 100", "'smaller than 200x100'")
_simple("aspect_ratio", parts, {}, _PART, "aspect_ratio < 0.2 OR aspect_ratio > 5.0", "'aspect ratio outside 0.2..5.0'")
_simple("megapixel", parts, {"min_megapixels": 0.05, "max_megapixels": 0.6}, _PART, "megapixels < 0.05 OR megapixels > 0.6", "'megapixels outside configured range'")


@query("table_derived", _PART + " SELECT image_id, round(aspect_ratio, 6) AS aspect_ratio, round(megapixels, 6) AS megapixels FROM d")
def table_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("image_id", F.round("aspect_ratio", 6).alias("aspect_ratio"), F.round("megapixels", 6).alias("megapixels"))


_DOCS = "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, n_chars >= 50 AS decode_ok FROM documents)"


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_images(table(spark, sf_dir, "documents"), "doc_id", decode_ok=F.col("n_chars") >= 50, decode_error=F.lit(""), content_hash=F.sha2("text", 256))


_simple("decode", doc_rows, {}, _DOCS, "NOT coalesce(decode_ok, false)", "'decode_error'")

#: Scores are missing for views, to see that missing values fire nothing.
_EVENTS = "WITH e AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events), d AS (SELECT CAST(event_id AS VARCHAR) AS image_id, v AS blur_score, v AS brightness_score, v / 4 AS contrast_score, v / 490 AS blank_score, v / 490 AS dark_pixel_ratio, 1 - v / 490 AS bright_pixel_ratio, v / 480 AS clipped_pixel_ratio, v / 490 AS noise_score, v / 490 AS mono_color_score, event_id % 5 = 0 AS animated, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 8 AS INTEGER) END AS exif_orientation FROM e)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    turn = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 8).cast("int"))
    return as_images(
        table(spark, sf_dir, "events"), "event_id", blur_score=v, brightness_score=v, contrast_score=v / 4, blank_score=v / 490, dark_pixel_ratio=v / 490, bright_pixel_ratio=1 - v / 490, clipped_pixel_ratio=v / 480,
        noise_score=v / 490, mono_color_score=v / 490, animated=F.col("event_id") % 5 == 0, frame_count=F.lit(1), exif_orientation=turn, orientation_risk=F.coalesce(turn != 1, F.lit(False)),
    )


_simple("blur", scores, {}, _EVENTS, "blur_score < 100", "'blur score below 100.0'")
_simple("brightness", scores, {}, _EVENTS, "brightness_score < 30 OR brightness_score > 225", "'brightness outside 30.0..225.0'")
_simple("contrast", scores, {}, _EVENTS, "contrast_score < 10", "'contrast score below 10.0'")
_simple("blank", scores, {"threshold": 0.5}, _EVENTS, "blank_score >= 0.5", "'blank score at least 0.5'")
_simple("noise", scores, {"max_score": 0.25}, _EVENTS, "noise_score > 0.25", "'noise score above 0.25'")
_simple("mono_color", scores, {"threshold": 0.3}, _EVENTS, "mono_color_score >= 0.3", "'mono color score at least 0.3'")
_simple("exposure", scores, {"max_dark_pixel_ratio": 0.3, "max_bright_pixel_ratio": 0.9, "max_clipped_pixel_ratio": 0.4}, _EVENTS, "coalesce(dark_pixel_ratio > 0.3, false) OR coalesce(bright_pixel_ratio > 0.9, false) OR coalesce(clipped_pixel_ratio > 0.4, false)", "concat_ws('; ', CASE WHEN dark_pixel_ratio > 0.3 THEN 'dark pixel ratio above 0.3' END, CASE WHEN bright_pixel_ratio > 0.9 THEN 'bright pixel ratio above 0.9' END, CASE WHEN clipped_pixel_ratio > 0.4 THEN 'clipped pixel ratio above 0.4' END)")
_simple("animated", scores, {}, _EVENTS, "animated", "'animated image'")
_simple("orientation", scores, {}, _EVENTS, "coalesce(exif_orientation <> 1, false)", "'exif orientation ' || exif_orientation")

_ORDERS = "WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS image_id, (o_totalprice % 1000) / 1000 AS ratio, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'top,left' END AS sides, CASE o_orderstatus WHEN 'F' THEN 'white' WHEN 'O' THEN 'solid' ELSE 'unknown' END AS color FROM orders)"


def bordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = F.when(F.col("o_orderstatus") == "F", "white").when(F.col("o_orderstatus") == "O", "solid").otherwise("unknown")
    return as_images(table(spark, sf_dir, "orders"), "o_orderkey", border_padding_ratio=(F.col("o_totalprice") % 1000) / 1000, border_padding_sides=F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("top,left"), border_padding_color=color)


_simple("border_padding", bordered, {}, _ORDERS, "ratio > 0.25 AND sides <> '' AND color IN ('white', 'black', 'solid')", "'border padding ratio above 0.25 sides=' || sides || ' color=' || color")


@query("rules_two_level", _EVENTS + " SELECT image_id, CASE WHEN blur_score / 300 >= 0 AND blur_score / 300 <= 0.3 THEN 'drop' WHEN blur_score / 300 > 0.3 AND blur_score / 300 <= 0.6 THEN 'review' ELSE 'keep' END AS action FROM d")
def rules_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("image_id", two_level_action("blur_score", "[0, 0.3]", "(0.3, 0.6]", (0.0, 300.0)).alias("action"))


# The final action.

_SAID = [("quality.blur", "blur_score < 100", "review", "'blur score below 100.0'"), ("content.blank", "blank_score >= 0.5", "drop", "'blank score at least 0.5'"), ("format.animated", "animated", "review", "'animated image'"), ("custom.blocked", "CAST(image_id AS BIGINT) % 97 = 0", "restricted", "'blocked'"), ("metadata.orientation", "coalesce(exif_orientation <> 1, false)", "review", "'exif orientation ' || exif_orientation")]
_RANK = {"review": 1, "drop": 2, "restricted": 3}


def _merged_sql() -> str:
    hits = ", ".join(f"CASE WHEN {hit} THEN {{'p': {-_RANK[a]}, 'i': {i}, 'n': '{n}', 'r': {r}}} END" for i, (n, hit, a, r) in enumerate(_SAID))
    own = ", ".join(f"CASE WHEN {hit} THEN '{a}' ELSE 'keep' END AS {n.split('.')[1]}_action" for n, hit, a, _ in _SAID)
    return f"{_EVENTS}, h AS (SELECT image_id, {own}, list_sort(list_filter([{hits}], lambda x: x IS NOT NULL)) AS h FROM d), m AS (SELECT *, CASE h[1].p WHEN -3 THEN 'restricted' WHEN -2 THEN 'drop' WHEN -1 THEN 'review' ELSE 'keep' END AS final_action, coalesce(array_to_string(list_transform(h, lambda x: x.r), '; '), '') AS final_reason, coalesce(array_to_string(list_transform(h, lambda x: x.n), ';'), '') AS triggered_operator_names FROM h)"


def _merge_checks() -> list[ConfiguredCheck]:
    blocked = Check("blocked", "custom", ("image_id",), {"action": "restricted"}, lambda c: (F.col("image_id").cast("long") % 97 == 0, F.lit("blocked")))
    return [CHECKS["blur"].configured(), CHECKS["blank"].configured({"threshold": 0.5}), CHECKS["animated"].configured(), blocked.configured(), CHECKS["orientation"].configured()]


def final(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _merge_checks()
    return merge_actions(evaluate(scores(spark, sf_dir), checks), checks)


_FINAL = ("image_id", "final_action", "final_reason", "triggered_operator_names")


@query("merge_final_action", _merged_sql() + " SELECT image_id, final_action, final_reason, triggered_operator_names FROM m")
def merge_final_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final(spark, sf_dir).select(*_FINAL)


@query("action_summary", _merged_sql() + " SELECT count(*) AS total, count(*) FILTER (final_action = 'keep') AS clean, count(*) FILTER (final_action = 'review') AS review, count(*) FILTER (final_action = 'drop') AS dropped, count(*) FILTER (final_action = 'restricted') AS restricted FROM m")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return action_summary(final(spark, sf_dir))


@query("operator_summary", _merged_sql() + " " + " UNION ALL ".join(f"SELECT '{n}' AS operator, " + ", ".join(f"count(*) FILTER ({n}_action = '{a}') AS {a}" for a in ("keep", "review", "drop", "restricted")) + " FROM m" for n in ("blur", "blank", "animated", "blocked", "orientation")))
def by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _merge_checks()
    return operator_summary(evaluate(scores(spark, sf_dir), checks), checks).select("operator", "keep", "review", "drop", "restricted")


for _kind, _action in (("clean", "keep"), ("review", "review"), ("dropped", "drop"), ("restricted", "restricted")):
    query(f"export_{_kind}", _merged_sql() + f" SELECT image_id, final_action, final_reason, triggered_operator_names FROM m WHERE final_action = '{_action}'")(lambda spark, sf_dir, k=_kind: bucket(final(spark, sf_dir), k).select(*_FINAL))


@query("preview_filtered", _merged_sql() + " SELECT m.image_id, final_action, round(blur_score, 6) AS blur_score FROM m JOIN d USING (image_id) WHERE blur_action IN ('review', 'drop') ORDER BY d.blur_score, CAST(image_id AS BIGINT) LIMIT 200")
def preview_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(final(spark, sf_dir), _merge_checks()[0]).select("image_id", "final_action", F.round("blur_score", 6).alias("blur_score"))


# Duplicates.

_EXACT = "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS keeper FROM h)"


@query("exact_duplicate", _EXACT + " SELECT CAST(doc_id AS VARCHAR) AS image_id, CASE WHEN n > 1 THEN 'exact-' || h ELSE '' END AS exact_duplicate_group_id, n AS exact_duplicate_count, CASE WHEN n > 1 AND k > 1 THEN 'drop' ELSE 'keep' END AS exact_duplicate_action, CASE WHEN n > 1 AND k > 1 THEN 'duplicate in group exact-' || h ELSE '' END AS exact_duplicate_reason FROM g")
def exact_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = CHECKS["exact_duplicate"].configured()
    out = evaluate(duplicates.exact_groups(doc_rows(spark, sf_dir)), [check])
    return out.select("image_id", "exact_duplicate_group_id", "exact_duplicate_count", *check.check.outcome_columns)


@query("exact_pairs", _EXACT + " SELECT CAST(keeper AS VARCHAR) AS source_image_id, CAST(doc_id AS VARCHAR) AS target_image_id, CAST(1.0 AS DOUBLE) AS score, 'exact-' || h AS group_id FROM g WHERE n > 1 AND k > 1")
def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_pairs(duplicates.exact_groups(doc_rows(spark, sf_dir)))


@query("value_counts", "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_rows(spark, sf_dir).groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")


def _leader_sql(value: str, holds: str, best: str) -> str:
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, embedding AS e, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
edge AS MATERIALIZED (SELECT y.i AS bi, x.i AS ai, {value} AS val FROM v x JOIN v y ON x.i < y.i AND {holds}),
adj AS MATERIALIZED (SELECT bi, list(ai) AS nb FROM edge GROUP BY bi),
seq AS MATERIALIZED (SELECT v.i, coalesce(adj.nb, []::BIGINT[]) AS nb FROM v LEFT JOIN adj ON adj.bi = v.i),
walk(i, ks) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(s.nb, w.ks) THEN w.ks ELSE list_append(w.ks, w.i + 1) END FROM walk w JOIN seq s ON s.i = w.i + 1),
k AS MATERIALIZED (SELECT unnest(ks) AS i FROM (SELECT ks FROM walk ORDER BY i DESC LIMIT 1)),
m AS MATERIALIZED (SELECT bi AS i, ai AS kp, val FROM (SELECT *, row_number() OVER (PARTITION BY bi ORDER BY {best}, ai) AS r FROM edge WHERE ai IN (SELECT i FROM k) AND bi NOT IN (SELECT i FROM k)) WHERE r = 1),
s AS MATERIALIZED (SELECT kp, count(*) + 1 AS n FROM m GROUP BY kp)"""


_HAMMING = "CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) AS BIGINT)"
_HEX = "array_to_string(list_transform(range(0, 16), lambda q: substr('0123456789abcdef', CAST(8 * b[4 * q + 1] + 4 * b[4 * q + 2] + 2 * b[4 * q + 3] + b[4 * q + 4] + 1 AS BIGINT), 1)), '')"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return as_images(table(spark, sf_dir, "embeddings"), "vec_id", embedding=F.col("embedding"), phash=F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")))


@query("perceptual_duplicate", _leader_sql(_HAMMING, f"{_HAMMING} <= 18", "val") + f", hx AS (SELECT i, {_HEX} AS h FROM v) SELECT CAST(v.vec_id AS VARCHAR) AS image_id, CASE WHEN s.n IS NULL THEN '' ELSE 'perceptual-' || hx.h END AS perceptual_duplicate_group_id, coalesce(s.n, 1) AS perceptual_duplicate_count, CASE WHEN s.n IS NOT NULL THEN coalesce(m.val, 0) END AS perceptual_duplicate_distance, CASE WHEN m.i IS NOT NULL THEN 'drop' ELSE 'keep' END AS perceptual_duplicate_action FROM v LEFT JOIN m ON m.i = v.i LEFT JOIN s ON s.kp = coalesce(m.kp, v.i) LEFT JOIN hx ON hx.i = s.kp")
def perceptual_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = CHECKS["perceptual_duplicate"].configured({"max_distance": 18})
    out = evaluate(duplicates.perceptual_groups(vectors(spark, sf_dir), 18), [check])
    return out.select("image_id", "perceptual_duplicate_group_id", "perceptual_duplicate_count", "perceptual_duplicate_distance", "perceptual_duplicate_action")


_DOT = "list_dot_product(CAST(x.e AS DOUBLE[]), CAST(y.e AS DOUBLE[]))"


@query("semantic_duplicate", _leader_sql(_DOT, f"{_DOT} >= 0.3", "val DESC") + " SELECT CAST(v.vec_id AS VARCHAR) AS image_id, CASE WHEN s.n IS NULL THEN '' ELSE 'semantic-' || kv.vec_id END AS semantic_duplicate_group_id, coalesce(s.n, 1) AS semantic_duplicate_count, round(CASE WHEN s.n IS NOT NULL THEN coalesce(m.val, 1) END, 6) AS semantic_duplicate_score, CASE WHEN s.n IS NULL THEN '' ELSE CAST(kv.vec_id AS VARCHAR) END AS semantic_duplicate_nearest_image_id, CASE WHEN m.i IS NOT NULL THEN 'drop' ELSE 'keep' END AS semantic_duplicate_action FROM v LEFT JOIN m ON m.i = v.i LEFT JOIN s ON s.kp = coalesce(m.kp, v.i) LEFT JOIN v kv ON kv.i = s.kp")
def semantic_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = CHECKS["semantic_duplicate"].configured({"threshold": 0.3})
    out = evaluate(duplicates.semantic_groups(vectors(spark, sf_dir), 0.3), [check])
    return out.select("image_id", "semantic_duplicate_group_id", "semantic_duplicate_count", F.round("semantic_duplicate_score", 6).alias("semantic_duplicate_score"), "semantic_duplicate_nearest_image_id", "semantic_duplicate_action")


@query("perceptual_duplicate_near", _leader_sql(_HAMMING, f"{_HAMMING} <= 10", "val") + " SELECT CAST(v.vec_id AS VARCHAR) AS image_id, coalesce(s.n, 1) AS perceptual_duplicate_count, CASE WHEN s.n IS NOT NULL THEN coalesce(m.val, 0) END AS perceptual_duplicate_distance, CASE WHEN m.i IS NOT NULL THEN 'drop' ELSE 'keep' END AS perceptual_duplicate_action FROM v LEFT JOIN m ON m.i = v.i LEFT JOIN s ON s.kp = coalesce(m.kp, v.i)")
def perceptual_duplicate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the check's own distance, where hashes meet by bands."""
    check = CHECKS["perceptual_duplicate"].configured()
    out = evaluate(duplicates.perceptual_groups(vectors(spark, sf_dir)), [check])
    return out.select("image_id", "perceptual_duplicate_count", "perceptual_duplicate_distance", "perceptual_duplicate_action")


@query("hamming_distance", f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings) SELECT y.vec_id, {_HAMMING} AS distance FROM v x JOIN v y ON x.vec_id + 1 = y.vec_id")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = hex_halves("phash")
    v = vectors(spark, sf_dir).select(F.col(POSITION).alias("vec_id"), a.alias("a"), b.alias("b"))
    w = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("c"), F.col("b").alias("d"))
    return v.join(w, "vec_id").select("vec_id", hamming((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).cast("long").alias("distance"))


@query("vector_nearest", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7) SELECT CAST(vec_id AS VARCHAR) AS asset_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC LIMIT 10")
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("asset_id"), F.col("embedding").alias("value"))
    q = rows.where("asset_id = '7'").first()["value"]
    return nearest(rows, q, 10).select("asset_id", F.round("distance", 6).alias("distance"))


_RASTER = "WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 127.5))) AS DOUBLE)) AS p FROM embeddings)"


_INSIDE = "list_transform(list_transform(range(0, 36), lambda k: CAST((k // 6 + 1) * 8 + k % 6 + 2 AS BIGINT)), lambda i: p[i - 1] + p[i + 1] + p[i - 8] + p[i + 8] - 4 * p[i])"
_FILE = "unhex('503520382038203235350A' || array_to_string(list_transform(p, lambda x: printf('%02x', CAST(x AS INTEGER))), ''))"


@query("pixel_metrics", _RASTER + f""", m AS (SELECT vec_id, p, list_avg(p) AS mean, {_INSIDE} AS l FROM r), d AS (SELECT *, sqrt(list_avg(list_transform(p, lambda x: (x - mean) * (x - mean)))) AS deviation, list_avg(l) AS lm FROM m)
SELECT CAST(vec_id AS VARCHAR) AS image_id, round(list_avg(list_transform(l, lambda x: (x - lm) * (x - lm))), 4) AS blur_score, round(mean, 6) AS brightness_score, round(deviation, 6) AS contrast_score, CAST(CASE WHEN deviation <= 1 THEN 1 ELSE 0 END AS DOUBLE) AS blank_score,
round(len(list_filter(p, lambda x: x <= 16)) / 64, 6) AS dark_pixel_ratio, round(len(list_filter(p, lambda x: x >= 239)) / 64, 6) AS bright_pixel_ratio, round(len(list_filter(p, lambda x: x <= 2 OR x >= 253)) / 64, 6) AS clipped_pixel_ratio, round(least(1, greatest(0, 1 - deviation / 64)), 6) AS mono_color_score,
round(least(1, (list_avg(list_transform(range(0, 56), lambda k: abs(p[CAST(k // 7 * 8 + k % 7 + 2 AS BIGINT)] - p[CAST(k // 7 * 8 + k % 7 + 1 AS BIGINT)]))) + list_avg(list_transform(range(0, 56), lambda k: abs(p[CAST(k + 9 AS BIGINT)] - p[CAST(k + 1 AS BIGINT)])))) / 510), 6) AS noise_score,
8 AS width, 8 AS height, true AS decode_ok, '' AS decode_error, CAST(75 AS BIGINT) AS file_size, sha256({_FILE}) AS content_hash, CAST(0 AS INTEGER) AS frame_count, false AS animated FROM d""")
def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as gray images of 8 x 8 pixels in a binary format, through the fused image pass and its kernels."""
    header = F.lit("P5 8 8 255\n").cast("binary")
    pixels = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int")), 2, "0"))
    rows = as_images(table(spark, sf_dir, "embeddings"), "vec_id", content=F.concat(header, F.unhex(F.array_join(pixels, ""))))
    scores = ["blur_score", "brightness_score", "contrast_score", "blank_score", "dark_pixel_ratio", "bright_pixel_ratio", "clipped_pixel_ratio", "mono_color_score", "noise_score"]
    facts = ["width", "height", "decode_ok", "decode_error", "file_size", "content_hash", "frame_count", "animated"]
    out, _ = computers.run_parameters(rows, scores + facts, computers.Registry(computers.builtin()))
    return out.select("image_id", *[F.round(c, 4 if c == "blur_score" else 6).alias(c) for c in scores], *facts)


#: A pattern of 16 x 16 pixels inside a frame whose depth and gray follow the id.
_FRAMED = "WITH f AS (SELECT vec_id, vec_id % 5 AS deep, CASE vec_id % 3 WHEN 0 THEN 255 WHEN 1 THEN 0 ELSE 120 END AS tone FROM embeddings)"


@query("border_metrics", _FRAMED + " SELECT CAST(vec_id AS VARCHAR) AS image_id, CASE WHEN deep >= 2 THEN round(1 - (16.0 - 2 * deep) * (16 - 2 * deep) / 256, 6) ELSE 0 END AS border_padding_ratio, CASE WHEN deep >= 2 THEN 'top,bottom,left,right' ELSE '' END AS border_padding_sides, CASE WHEN deep < 2 THEN 'unknown' WHEN tone = 255 THEN 'white' WHEN tone = 0 THEN 'black' ELSE 'solid' END AS border_padding_color FROM f")
def border_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.col("vec_id") % 5
    tone = F.when(F.col("vec_id") % 3 == 0, "ff").when(F.col("vec_id") % 3 == 1, "00").otherwise("78")

    def pixel(i):
        x, y = i % 16, F.floor(i / 16)
        inside = (x >= deep) & (x < 16 - deep) & (y >= deep) & (y < 16 - deep)
        return F.when(inside, F.when((x + y) % 2 == 0, "32").otherwise("b4")).otherwise(tone)

    pixels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), pixel), "")
    rows = as_images(table(spark, sf_dir, "embeddings"), "vec_id", content=F.concat(F.lit("P5 16 16 255\n").cast("binary"), F.unhex(pixels)))
    wanted = ["border_padding_ratio", "border_padding_sides", "border_padding_color"]
    out, _ = computers.run_parameters(rows, wanted, computers.Registry(computers.builtin()))
    return out.select("image_id", F.round(wanted[0], 6).alias(wanted[0]), *wanted[1:])


# Commits.

_COMMIT = "WITH c AS (SELECT o_orderkey AS asset_id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 < 6), n AS (SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 10 = 5 THEN o_orderstatus ELSE 'N' END AS status, CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice ELSE o_totalprice + 1 END AS price FROM orders WHERE o_orderkey % 10 >= 4)"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 10
    now = o.where(k < 6).select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = o.where(k >= 4).select(F.col("o_orderkey").alias("asset_id"), F.when(k == 5, F.col("o_orderstatus")).otherwise("N").alias("status"), F.when(k == 5, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("price"))
    return now, new


_BOTH = ", f AS (SELECT coalesce(c.asset_id, n.asset_id) AS asset_id, c.asset_id IS NULL AS fresh, n.asset_id IS NULL AS only_old, CASE WHEN n.asset_id IS NULL THEN c.status ELSE n.status END AS status, CASE WHEN n.asset_id IS NULL THEN c.price ELSE n.price END AS price, c.status IS NOT DISTINCT FROM n.status AND c.price IS NOT DISTINCT FROM n.price AS same FROM c FULL JOIN n ON c.asset_id = n.asset_id)"


def _change_sql(gone: str) -> str:
    return _COMMIT + _BOTH + f", z AS (SELECT asset_id, status, price, CASE WHEN only_old THEN '{gone}' WHEN fresh THEN 'inserted' WHEN same THEN 'same' ELSE 'updated' END AS change FROM f)"


_PATCH = _COMMIT + ", z AS (SELECT c.asset_id, CASE WHEN n.asset_id IS NULL THEN c.status ELSE n.status END AS status, c.price, CASE WHEN n.asset_id IS NULL THEN 'kept' WHEN c.status = n.status THEN 'same' ELSE 'updated' END AS change FROM c LEFT JOIN n ON c.asset_id = n.asset_id)"
_COUNTS = " SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'removed') AS removed FROM z"

for _mode, _start in (("upsert", _change_sql("kept")), ("replace", _change_sql("removed")), ("patch", _PATCH)):
    _made = lambda spark, sf_dir, m=_mode: merged(*sides(spark, sf_dir), m, ["status"] if m == "patch" else ())
    query(f"commit_{_mode}", _start + " SELECT asset_id, status, price, change FROM z")(_made)
    query(f"commit_{_mode}_counts", _start + _COUNTS)(lambda spark, sf_dir, f=_made: counters(f(spark, sf_dir)))


@query("subset_test", _COMMIT + " SELECT n.asset_id FROM n WHERE n.asset_id NOT IN (SELECT asset_id FROM c)")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, new = sides(spark, sf_dir)
    return outside(new, now, ["asset_id"]).select("asset_id")


# Versioned datasets: each query has a repository of its own in the shared folder and goes through its commits.


class Versions:
    """A dataset of orders: a first commit of those whose key ends in 0 to 5, marked `first`, then one of those from 4 on by `mode`."""

    def __init__(self, spark: SparkSession, sf_dir: str, mode: str | None = "upsert"):
        root = f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}"
        self.repo = Manager(spark, root).create_repo("orders")
        self.repo.bind_prefix(Prefix("p", "store", "file", f"{root}/store"))
        self.data = self.repo.create_dataset("orders", [T.StructField("status", T.StringType(), True), T.StructField("price", T.DoubleType(), True)])
        now, new = sides(spark, sf_dir)
        self.view = self.data.commit(self.data.open_branch(), self.assets(now), checkpoint="first").view
        if mode:
            # The orders that are there are found by their short keys.
            sent = self.assets(new.join(now, "asset_id", "left_semi")).select("asset_id", "status") if mode == "patch" else self.assets(new)
            self.result = self.data.commit(self.view, sent, mode, ["status"] if mode == "patch" else ())
            self.view = self.result.view

    @staticmethod
    def assets(rows: DataFrame) -> DataFrame:
        key = F.col("asset_id").cast("string")
        return rows.select(F.concat(F.lit("sha256:"), F.sha2(key, 256)).alias("asset_id"), F.lit("p").alias("storage_prefix_id"), F.concat(F.lit("o/"), key).alias("relative_path"), F.lit(None).cast("string").alias("source_uri"), F.array().cast("array<string>").alias("tag_ids"), "status", F.col("price").cast("double").alias("price"))

    def shown(self, view) -> DataFrame:
        return view.frame(["asset_id", "relative_path", "status", "price"])


_ASSET = "SELECT 'sha256:' || sha256(CAST(asset_id AS VARCHAR)) AS asset_id, 'o/' || asset_id AS relative_path, status, CAST(price AS DOUBLE) AS price FROM "
for _mode, _start in (("upsert", _change_sql("kept")), ("replace", _change_sql("removed")), ("patch", _PATCH)):
    query(f"dataset_{_mode}", f"{_start} {_ASSET} z WHERE change <> 'removed'")(lambda spark, sf_dir, m=_mode: (v := Versions(spark, sf_dir, m)).shown(v.data.open_branch()))
    query(f"dataset_{_mode}_counts", _start + _COUNTS)(lambda spark, sf_dir, m=_mode: spark.createDataFrame([(r := Versions(spark, sf_dir, m).result) and (r.inserted, r.updated, r.removed)], "inserted bigint, updated bigint, removed bigint"))


@query("dataset_checkpoint", f"{_COMMIT} {_ASSET} c")
def dataset_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Versions(spark, sf_dir)
    return v.shown(v.data.open_checkpoint("first"))


@query("dataset_rollback", f"{_COMMIT} {_ASSET} c")
def dataset_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Versions(spark, sf_dir)
    v.data.rollback(v.view, "first")
    return v.shown(v.data.open_branch())


@query("dataset_branch", f"{_change_sql('removed')} {_ASSET} z WHERE change <> 'removed' UNION ALL {_ASSET} c")
def dataset_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch takes a commit that the main one does not see; the rows of both."""
    v = Versions(spark, sf_dir, None)
    work = v.data.create_branch(v.view, "work")
    v.data.commit(work, v.assets(sides(spark, sf_dir)[1]), "replace")
    return v.shown(v.data.open_branch("work")).unionByName(v.shown(v.data.open_branch()))


@query("dataset_clone", f"{_change_sql('kept')} {_ASSET} z")
def dataset_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Versions(spark, sf_dir)
    return v.shown(v.data.clone(v.view, "copy").open_branch())


@query("dataset_materialize", f"{_change_sql('kept')} {_ASSET} z WHERE status = 'N'")
def dataset_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Versions(spark, sf_dir)
    return v.shown(v.data.materialize(v.view, v.view.frame().where("status = 'N'"), "new").open_branch())


@query("dataset_schema_addition", f"{_COMMIT} SELECT 'sha256:' || sha256(CAST(asset_id AS VARCHAR)) AS asset_id, CAST(NULL AS VARCHAR) AS note FROM c WHERE asset_id NOT IN (SELECT asset_id FROM n) UNION ALL SELECT 'sha256:' || sha256(CAST(asset_id AS VARCHAR)), status FROM n")
def dataset_schema_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Versions(spark, sf_dir, None)
    new = v.assets(sides(spark, sf_dir)[1]).withColumn("note", F.col("status"))
    return v.data.commit(v.view, new, add=[T.StructField("note", T.StringType(), True)]).view.frame(["asset_id", "note"])


@query("dataset_lookup", f"{_COMMIT} {_ASSET} c WHERE asset_id IN (1, 2, 32, 999999999)")
def dataset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Versions(spark, sf_dir, None)
    wanted = ["sha256:" + hashlib.sha256(str(i).encode()).hexdigest() for i in (1, 2, 32, 999999999)]
    rows = [(r["asset_id"], r["relative_path"], r["status"], r["price"]) for r in v.data.open_branch().get_rows(wanted)]
    return spark.createDataFrame(rows, "asset_id string, relative_path string, status string, price double")


@query("dataset_vectors", f"{_COMMIT} SELECT 'sha256:' || sha256(CAST(asset_id AS VARCHAR)) AS asset_id, CASE WHEN asset_id % 2 = 0 THEN CAST(length(CAST(asset_id AS VARCHAR)) AS DOUBLE) END AS first_value FROM c")
def dataset_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the assets with even keys, in two runs of which the second finds the first's; joined to all rows on demand."""
    v = Versions(spark, sf_dir, None)
    v.repo.create_vector_field("look", "m", "f", 2, "l2")
    key = F.substring("relative_path", 3, 30)
    files = v.view.frame().where(key.cast("bigint") % 2 == 0).select("asset_id", key.cast("binary").alias("content"), key.cast("bigint").alias("k"))
    for part in (files.where("k % 4 = 0"), files):
        v.repo.generate_vectors("look", part.select("asset_id", "content"), _lengths)
    return v.view.frame(["asset_id", "look"], vectors=["look"]).select("asset_id", F.get("look", F.lit(0)).cast("double").alias("first_value"))


def _lengths(contents: list[bytes]) -> list[list[float]]:
    return [[len(c), 1.0] for c in contents]


@query("dataset_tags", "SELECT 'sha256:' || sha256(CAST(o_orderkey AS VARCHAR)) AS asset_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS tags FROM orders WHERE o_orderkey % 10 < 6")
def dataset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by id, given twice to a row and kept once, shown by their names of today."""
    v = Versions(spark, sf_dir, None)
    ids = {n: v.repo.create_tag(n) for n in ("done", "unfinished")}
    tag = F.when(F.col("status") == "F", ids["done"]).otherwise(ids["unfinished"])
    view = v.data.commit(v.view, v.view.frame().withColumn("tag_ids", F.array(tag, tag))).view
    v.repo.rename_tag(ids["unfinished"], "open")
    names = F.create_map(*[F.lit(x) for pair in v.repo.tags().items() for x in pair])
    return view.frame(["asset_id", "tag_ids"]).select("asset_id", F.array_join(F.transform("tag_ids", lambda t: names[t]), ",").alias("tags"))


# Scans, order and groups.


@query("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset.load(f"{sf_dir}/lineitem.parquet").scan(spark, ["l_orderkey", "l_linenumber", "l_quantity"], {"l_returnflag": "R", "l_linestatus": "F"})


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7 AND o_orderstatus = 'O'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset.load(f"{sf_dir}/orders.parquet").scan(spark, None, {"o_orderkey": 7, "o_orderstatus": "O"})


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias(POSITION))
    return sorted_by(o, ["o_totalprice"], "desc").limit(100).drop(POSITION)


@query("group_head", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders), g AS (SELECT DISTINCT f FROM t ORDER BY f LIMIT 50) SELECT o_orderkey, o_custkey FROM t WHERE k <= 3 AND f IN (SELECT f FROM g)")
def head_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias(POSITION))
    return group_head(o, "o_custkey", 50, 3).select("o_orderkey", "o_custkey")


@query("group_context", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate = '1995-06-17') ORDER BY min(o_orderkey) OVER (PARTITION BY o_custkey), o_orderkey LIMIT 400")
def group_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the groups that have a hit, as a preview shows them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderkey").alias(POSITION))
    return filtered(o, actions="full", where={"day": "1995-06-17"}, group_by="o_custkey", include_group_context=True, max_rows=400, max_groups=1000, max_per_group=1000).select("o_orderkey", "o_custkey")


@query("sample_n", "SELECT CAST(o_orderkey AS VARCHAR) AS image_id FROM orders ORDER BY md5('seed:' || o_orderkey), CAST(o_orderkey AS VARCHAR) LIMIT 100")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(as_images(table(spark, sf_dir, "orders"), "o_orderkey"), 100, "seed").select("image_id")


@query("url_check", r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, lower(regexp_extract(url, '^[^?#]*\.([A-Za-z0-9]+)(?:[?#]|$)', 1)) AS suffix FROM pages)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme must be http or https' WHEN host = '' THEN 'no host' WHEN host = 'localhost' THEN 'host is not public' WHEN suffix NOT IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp') THEN 'suffix is not that of an image' ELSE '' END AS error FROM u""")
def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_error("url").alias("error"))


_TAGS = "WITH t AS (SELECT event_id, [event_type || '/' || CAST(event_id % 3 AS VARCHAR), CASE WHEN event_id % 5 = 0 THEN event_type || '//x' ELSE event_type END, event_type, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'b' END] AS tags FROM events)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    tags = F.array(F.concat_ws("/", t, (e % 3).cast("string")), F.when(e % 5 == 0, F.concat(t, F.lit("//x"))).otherwise(t), t, F.when(e % 11 == 0, "").otherwise("b"))
    return table(spark, sf_dir, "events").select("event_id", tags.alias("tags"))


@query("tag_validate", _TAGS + " SELECT event_id, array_to_string(list_filter(tags, lambda t: len(list_filter(string_split(t, '/'), lambda p: p = '')) > 0), '|') AS bad FROM t")
def tag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("event_id", F.array_join(tag_problems("tags"), "|").alias("bad"))


@query("tag_dedup", _TAGS + " SELECT event_id, array_to_string(list_sort(list_distinct(tags)), '|') AS tags FROM t")
def tag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("event_id", F.array_join(sorted_unique("tags"), "|").alias("tags"))


@query("voc_boxes", "WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS x, 1 - l_tax AS y FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(least(greatest(round_even(x * 640, 0), 0), 640) AS INTEGER) AS xmin, CAST(least(greatest(round_even(y * 480, 0), 0), 480) AS INTEGER) AS ymax FROM b")
def voc_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.col("l_discount").alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(1.0).alias("x_max"), (1 - F.col("l_tax")).alias("y_max"))
    none = F.lit(None).cast("int")
    boxes = F.array(F.struct(F.lit("a").alias("label"), box.alias("bbox"), none.alias("truncated"), none.alias("difficult"), F.lit(None).cast("string").alias("pose")))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", to_pixels(boxes, F.lit(640), F.lit(480))[0].alias("o"))
    return made.select("l_orderkey", "l_linenumber", F.col("o.bndbox.xmin").alias("xmin"), F.col("o.bndbox.ymax").alias("ymax"))


# The flagship: a cleaning run from end to end.

_CLEAN = "WITH h AS (SELECT doc_id, n_chars, sha256(text) AS h FROM documents), g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM h), d AS (SELECT doc_id, n_chars < 50 AS broken, n_chars < 300 AS small, n > 1 AND k > 1 AS dup, h FROM g)"


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.cleaner import BasicCleaner

    docs = as_images(table(spark, sf_dir, "documents"), "doc_id", decode_ok=F.col("n_chars") >= 50, decode_error=F.lit(""), content_hash=F.sha2("text", 256), width=F.col("n_chars").cast("int"), height=F.col("n_chars").cast("int"))
    cleaner = BasicCleaner(["decode", {"dimension": {"min_width": 300, "min_height": 300, "action": "review"}}, "exact_duplicate"])
    return cleaner.frame(docs).select("image_id", "final_action", "final_reason", "triggered_operator_names")


query("clean_documents", _CLEAN + " SELECT CAST(doc_id AS VARCHAR) AS image_id, CASE WHEN broken OR dup THEN 'drop' WHEN small THEN 'review' ELSE 'keep' END AS final_action, concat_ws('; ', CASE WHEN broken THEN 'decode_error' END, CASE WHEN dup THEN 'duplicate in group exact-' || h END, CASE WHEN small THEN 'smaller than 300x300' END) AS final_reason, concat_ws(';', CASE WHEN broken THEN 'format.decode' END, CASE WHEN dup THEN 'duplicate.exact_duplicate' END, CASE WHEN small THEN 'size.dimension' END) AS triggered_operator_names FROM d")(clean_documents)


# Configuration files, evaluation columns and ranges of metrics.

query("config_categories", _EVENTS + " SELECT image_id, CASE WHEN coalesce(blur_score < 100 OR brightness_score < 30 OR brightness_score > 225 OR contrast_score < 10 OR noise_score > 0.75 OR dark_pixel_ratio > 0.95 OR bright_pixel_ratio > 0.95 OR clipped_pixel_ratio > 0.98, false) THEN 'review' ELSE 'keep' END AS final_action FROM d")(
    lambda spark, sf_dir: _cleaner('[select]\ncategories = ["QUALITY"]\n').frame(scores(spark, sf_dir)).select("image_id", "final_action")
)


def _cleaner(text: str):
    from .plans.cleaner import BasicCleaner

    return BasicCleaner.from_toml(text)


@query("evaluation_columns", _EVENTS + " SELECT image_id, noise_score, CASE WHEN noise_score > 0.25 THEN 'review' ELSE 'keep' END AS noise_action, CASE WHEN noise_score > 0.25 THEN 'noise score above 0.25' ELSE '' END AS noise_reason FROM d")
def evaluation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CHECKS["noise"].configured({"max_score": 0.25}).evaluate(scores(spark, sf_dir))


@query("metric_ranges", "SELECT * FROM (VALUES ('blur', 75.0), ('contrast', 25.0), ('perceptual_duplicate', 25.0), ('blank', 0.25), ('exposure', 0.25), ('noise', 0.25), ('mono_color', 0.25), ('border_padding', 0.25), ('semantic_duplicate', 0.25)) t(metric, quarter)")
def metric_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, relative_to_absolute(n, 0.25)) for n, m in METRICS.items() if m.absolute_max is not None], "metric string, quarter double")


@query("relative_boxes", "SELECT l_orderkey, l_linenumber, l_quantity / 640 AS x_min, (l_quantity + 50) / 640 AS x_max FROM lineitem")
def relative_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    box = F.struct(q.alias("xmin"), F.lit(0.0).alias("ymin"), (q + 50).alias("xmax"), F.lit(480.0).alias("ymax"))
    objects = F.array(F.struct(F.lit("a").alias("name"), F.lit("x").alias("pose"), F.lit(0).alias("truncated"), F.lit(0).alias("difficult"), box.alias("bndbox")))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", to_relative(objects, F.lit(640), F.lit(480))[0]["bbox"].alias("b"))
    return made.select("l_orderkey", "l_linenumber", "b.x_min", "b.x_max")
