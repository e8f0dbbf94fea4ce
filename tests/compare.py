"""A query's rows against those of its SQL, as the driver compares them: columns by name, rows in any order."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    found = con.sql(sql)
    theirs = rows_of(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} and {sorted(found.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    return next((f"{a} and {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")
