"""Rows of a versioned dataset: their schema, what makes them valid, and how commits merge them - as plans, so that queries can use them too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions import sorted_unique

#: The columns that every dataset has.
SYSTEM = T.StructType([
    T.StructField("asset_id", T.StringType(), False),
    T.StructField("storage_prefix_id", T.StringType(), False),
    T.StructField("relative_path", T.StringType(), False),
    T.StructField("source_uri", T.StringType(), True),
    T.StructField("tag_ids", T.ArrayType(T.StringType(), False), False),
])
KEY = "asset_id"
MODES = ("replace", "upsert", "patch")
#: What `merged` says of rows that make a commit fail.
BAD, OUTSIDE = "bad: ", "outside"
_ATOMS = (T.BooleanType, T.IntegerType, T.LongType, T.DoubleType, T.StringType)


def name_key(name: str) -> str:
    """What names are compared by."""
    key = name.strip().casefold()
    if not key:
        raise ValidationError("a name must not be empty")
    return key


def check_type(kind: T.DataType, at: str) -> None:
    """boolean, integer, long, double, string, and lists and structs of these."""
    if isinstance(kind, T.ArrayType):
        check_type(kind.elementType, f"{at}[]")
    elif isinstance(kind, T.StructType):
        keys = [name_key(f.name) for f in kind.fields]
        if not keys or len(set(keys)) < len(keys):
            raise ValidationError(f"{at}: a struct needs fields with different names")
        for f in kind.fields:
            check_type(f.dataType, f"{at}.{f.name}")
    elif not isinstance(kind, _ATOMS):
        raise ValidationError(f"{at}: {kind.simpleString()} is not supported")


def add_fields(schema: T.StructType, new: Sequence[T.StructField], taken: Sequence[str] = ()) -> T.StructType:
    """The schema with optional fields added; the same field again changes nothing, another of its name is an error."""
    out = list(schema.fields)
    for f in new:
        check_type(f.dataType, f.name)
        same = next((x for x in out if name_key(x.name) == name_key(f.name)), None)
        if same is not None and same.name == f.name and same.dataType == f.dataType and same.nullable:
            continue
        if same is not None:
            raise ValidationError(f"{f.name} is there already")
        if not f.nullable:
            raise ValidationError(f"{f.name} must be optional")
        if name_key(f.name) in {name_key(t) for t in taken}:
            raise ValidationError(f"{f.name} is the name of a vector field")
        out.append(f)
    return T.StructType(out)


def fits(c: Column, kind: T.DataType, nullable: bool) -> Column:
    """Whether a value, taken as this type, is a proper one: no NaN or infinity, no missing required part."""
    ok = F.lit(True) if nullable else c.isNotNull()
    if isinstance(kind, T.DoubleType):
        return ok & (c.isNull() | (~F.isnan(c) & (F.abs(c) < float("inf"))))
    if isinstance(kind, T.ArrayType):
        return ok & (c.isNull() | F.forall(c, lambda x: fits(x, kind.elementType, kind.containsNull)))
    if isinstance(kind, T.StructType):
        inner = F.lit(True)
        for f in kind.fields:
            inner = inner & fits(c[f.name], f.dataType, f.nullable)
        return ok & (c.isNull() | inner)
    return ok


def relaxed(kind: T.DataType) -> T.DataType:
    """The type with all parts optional, which any value can be cast to; `check_rows` looks at required parts."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(relaxed(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in kind.fields])
    return kind


def conform(df: DataFrame, schema: T.StructType, partial: bool = False) -> DataFrame:
    """Columns of the schema in its order and types. Unknown columns are errors; missing optional ones become null unless `partial`."""
    if len(set(df.columns)) < len(df.columns):
        raise ValidationError("a column is there twice")
    known = {f.name: f for f in schema.fields}
    if unknown := [c for c in df.columns if c not in known]:
        raise ValidationError(f"unknown columns: {', '.join(unknown)}")
    if missing := [f.name for f in schema.fields if f.name not in df.columns and (not f.nullable or f.name == KEY) and not (partial and f.name != KEY)]:
        raise ValidationError(f"missing columns: {', '.join(missing)}")
    fields = [f for f in schema.fields if f.name in df.columns or not partial]
    made = [(sorted_unique(F.col("tag_ids")) if f.name == "tag_ids" else F.col(f"`{f.name}`")).cast(relaxed(f.dataType)).alias(f.name) if f.name in df.columns else F.lit(None).cast(relaxed(f.dataType)).alias(f.name) for f in fields]
    return df.select(*made)


def faults(columns: Sequence[str], schema: T.StructType, prefixes: Sequence[str] | None = None, tags: Sequence[str] | None = None) -> Column:
    """What is wrong with a row of these columns, or null."""
    bad = F.when(~F.coalesce(F.col(KEY).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)), "asset_id is not a digest")
    if prefixes is not None and "storage_prefix_id" in columns:
        bad = bad.when(~F.coalesce(F.col("storage_prefix_id").isin(list(prefixes) or [""]), F.lit(False)), "storage prefix is not bound")
    if tags is not None and "tag_ids" in columns:
        bad = bad.when(F.size(F.array_except("tag_ids", F.array(*map(F.lit, tags)).cast("array<string>"))) > 0, "a tag is unknown or archived")
    for f in schema.fields:
        if f.name in columns:
            bad = bad.when(~fits(F.col(f"`{f.name}`"), f.dataType, f.nullable), f"{f.name} is missing or not valid")
    return bad


def check_once(rows: DataFrame) -> None:
    """Ids are grouped by a hash of 64 bits, so that the long ids stay where they are; those of hashes that are there twice are compared."""
    hashed = F.xxhash64(KEY)
    twice = rows.groupBy(hashed.alias("h")).count().where("count > 1").select("h")
    if twice.first() and (row := rows.withColumn("h", hashed).join(twice, "h", "left_semi").groupBy(KEY).count().where("count > 1").first()):
        raise ValidationError(f"{row[KEY]} is there twice")


def check_rows(df: DataFrame, schema: T.StructType, prefixes: Sequence[str] | None = None, tags: Sequence[str] | None = None) -> None:
    """One pass over the rows for all rules, and one for repeated ids."""
    if row := df.select(KEY, faults(df.columns, schema, prefixes, tags).alias("bad")).where("bad is not null").first():
        raise ValidationError(f"{row[KEY]}: {row['bad']}")
    check_once(df.select(KEY))


def merged(current: DataFrame, submitted: DataFrame, mode: str, fields: Sequence[str] = (), key: str = KEY, fault: Column | None = None) -> DataFrame:
    """All rows of both sides with `change` (inserted, updated, same, removed, kept) and the columns of `current`; removed rows are
    marked, not left out. One full join by the key.

    With `fault`, of submitted rows, `change` is BAD and what it says where it is not null, and a patch's rows that `current` has not are OUTSIDE."""
    if mode not in MODES:
        raise ValidationError(f"mode must be one of {', '.join(MODES)}")
    names = [c for c in current.columns if c != key]
    old = current.select(F.col(key), F.struct(*names).alias("_old"))
    sent = [c for c in (fields if mode == "patch" else names) if c in submitted.columns]
    new = submitted.select(F.col(key), F.struct(*[F.col(c) for c in sent]).alias("_new"), (F.lit(None).cast("string") if fault is None else fault).alias("_fault"))
    both = old.join(new, key, "left" if mode == "patch" and fault is None else "full")

    def value(c: str) -> Column:
        given = F.col(f"_new.{c}") if c in sent else F.col(f"_old.{c}")
        return F.when(F.col("_new").isNotNull(), given).otherwise(F.col(f"_old.{c}"))

    gone = "removed" if mode == "replace" else "kept"
    same = F.lit(True)
    for c in names:
        same = same & value(c).eqNullSafe(F.col(f"_old.{c}"))
    change = F.when(F.col("_fault").isNotNull(), F.concat(F.lit(BAD), "_fault")).when(F.col("_new").isNull(), gone)
    change = change.when(F.col("_old").isNull(), OUTSIDE if mode == "patch" else "inserted").when(same, "same").otherwise("updated")
    return both.select(key, *[value(c).alias(c) for c in names], change.alias("change"))


def outside(rows: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys are not among those of the other table."""
    return rows.join(of.select(*keys), list(keys), "left_anti")


def counters(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated", "removed")])
