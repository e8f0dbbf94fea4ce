"""Operator 3: sharding over fixed virtual slots, in DataFrame functions only.

Records are hashed into a fixed number of virtual slots. One grouped aggregation gives bytes and rows of each slot; from
these a versioned slot-to-shard map is made, largest slot first to the lightest shard. The map alone decides where records
go: rebalancing edits it, slot by slot, into a new version that is stored beside the old ones, and records are never hashed anew.
Only the slots' sums reach the driver, one row a slot whatever the input is, and the map reaches the plan as a constant array.

The law that holds is `bytes`: shards' sizes are near equal, as far as single records and slots allow. A row's place in its
shard (`slot`) is its virtual slot's offset there plus its number within the virtual slot, so that no task numbers a whole shard.

The map's versions lie beside each other in the shared folder, under a name that follows from the table's. A run takes the newest: as it is where the
slots hold what they held then, else rebalanced for what they hold now, as a further version.

Null texts have 0 bytes (size 1, CRC of nothing). Null ids are hashed with their text. Rows equal in id and text fall into one virtual
slot, each with a place of its own; rows of equal text and other ids may lie in several shards, since `bytes` binds sizes alone. Very long texts are rows like others: a shard
with one heavier than the mean gets nothing else. Slots of equal size go in order of their numbers, to the first of equally light shards.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storing import JsonFiles
from ._common import shared_dir, table, utf8_bytes

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot belongs to, and what the slot held when the version was made."""

    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard_of, self.bytes_of, strict=True):
            out[s] += b
        return out

    def offsets(self) -> list[int]:
        """Rows of the same shard in slots before each slot."""
        seen, out = [0] * self.shards, []
        for s, n in zip(self.shard_of, self.rows_of, strict=True):
            out.append(seen[s])
            seen[s] += n
        return out

    def rebalanced(self, shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard until the heaviest is within the tolerance of the mean, or no move helps."""
        n = shards or self.shards
        if n < self.shards:
            raise ValueError("shards cannot be taken away")
        to, loads = list(self.shard_of), self.loads() + [0] * (n - self.shards)
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for slot, s in enumerate(to):
            if self.bytes_of[slot]:
                held[s].append((self.bytes_of[slot], slot))
        mean, moved = sum(loads) / n, []
        targets = range(self.shards, n) if n > self.shards else range(n)  # growth moves slots into new shards only
        for _ in range(len(to)):
            high, low = max(range(n), key=loads.__getitem__), min(targets, key=loads.__getitem__)
            room, excess = loads[high] - loads[low], loads[high] - mean
            fit = [x for x in held[high] if x[0] < room]
            if excess <= mean * tolerance or not fit:
                break
            size, slot = best = max((x for x in fit if x[0] <= excess), default=min(fit))
            held[high].remove(best)
            held[low].append(best)
            loads[high] -= size
            loads[low] += size
            to[slot] = low
            moved.append(slot)
        return replace(self, shards=n, shard_of=tuple(to), version=self.version + 1, moved=tuple(sorted(set(moved))))

    def frame(self, spark: SparkSession) -> DataFrame:
        slots = spark.range(len(self.shard_of)).select(F.col("id").cast("int").alias("virtual_slot"))
        return slots.select(F.lit(self.version).alias("version"), "virtual_slot", at(self.shard_of, F.col("virtual_slot")).cast("int").alias("shard"), at(self.bytes_of, F.col("virtual_slot")).alias("bytes"), at(self.rows_of, F.col("virtual_slot")).alias("rows"), F.lit(self.shards).alias("shards"), F.col("virtual_slot").isin(list(self.moved)).alias("moved"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the map's table; versions that are there stay."""
        self.frame(spark).coalesce(1).write.mode("error").parquet(f"{path}/map_version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{path}/map_version={version}").collect(), key=lambda r: r["virtual_slot"])
        column = lambda name: tuple(r[name] for r in rows)
        return SlotMap(rows[0]["shards"], column("shard"), column("bytes"), column("rows"), version, tuple(r["virtual_slot"] for r in rows if r["moved"]))

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions that are stored whole."""
        files = JsonFiles(spark)
        return sorted(int(n.rpartition("=")[2]) for n in files.names(path) if n.startswith("map_version=") and files.exists(f"{path}/{n}/_SUCCESS"))

    def holding(self, bytes_of: tuple[int, ...], rows_of: tuple[int, ...], shards: int) -> SlotMap:
        """This version where the slots hold this already, else the next one, rebalanced for it."""
        if (bytes_of, rows_of, shards) == (self.bytes_of, self.rows_of, self.shards):
            return self
        return replace(self, bytes_of=bytes_of, rows_of=rows_of).rebalanced(shards)


def at(values, index: Column) -> Column:
    """values[index] as a long, with the values a constant of the plan."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), index + 1)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1) and virtual_slot of each row."""
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("t"), F.coalesce(F.sha2("text", 256), F.lit("")))).otherwise(F.col("doc_id").cast("string"))
    slot = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % slots
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", "text", (utf8_bytes() + 1).alias("size"), slot.cast("int").alias("virtual_slot"))


def slot_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def make_map(totals: DataFrame, shards: int = 16, slots: int = SLOTS) -> SlotMap:
    """The first version. `totals` has one row a slot at most, so that its size does not depend on the input."""
    size, count = [0] * slots, [0] * slots
    for r in totals.collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    to = [0] * slots
    light = [(0, s) for s in range(shards)]
    for slot in sorted(range(slots), key=lambda i: (-size[i], i)):
        load, s = heapq.heappop(light)
        to[slot] = s
        heapq.heappush(light, (load + size[slot], s))
    return SlotMap(shards, tuple(to), tuple(size), tuple(count))


def assign(rows: DataFrame, places: SlotMap) -> DataFrame:
    """Adds shard and slot, the row's place in its shard (gapless from 0)."""
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    narrow = rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "virtual_slot")
    return narrow.select(
        "*",
        at(places.shard_of, F.col("virtual_slot")).cast("int").alias("shard"),
        (at(places.offsets(), F.col("virtual_slot")) + F.row_number().over(within) - 1).cast("long").alias("slot"),
    )


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """The rows' places and the map. With `store` the newest map there is taken, and a new version is stored where one is made."""
    rows, spark = records(docs, slots), docs.sparkSession
    places = make_map(slot_totals(rows), shards, slots)
    if store and (known := SlotMap.versions(spark, store)):
        last = SlotMap.load(spark, store, known[-1])
        places = last.holding(places.bytes_of, places.rows_of, shards)
        if places is last:
            return assign(rows, places), places
    if store:
        places.save(spark, store)
    return assign(rows, places), places


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    name = hashlib.sha256(f"{sf_dir}/documents".encode()).hexdigest()[:16]
    placed, places = shard(table(spark, sf_dir, "documents"), store=f"{shared_dir(spark)}/slot_map-{name}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(places.version).alias("map_version"))


#: The first version's places: the CRC byte by byte, and slots dealt one by one to the lightest shard.
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v FROM range(0, 256) r(b))
), d AS MATERIALIZED (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h,
    CASE WHEN doc_id IS NULL THEN 't' || coalesce(sha256(text), '') ELSE CAST(doc_id AS VARCHAR) END AS key FROM documents
), r AS MATERIALIZED (
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {SLOTS} AS v,
    xor(list_reduce(list_transform(range(0, size - 1), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, crc
), q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sum(size) DESC, v) AS i, v, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM r GROUP BY v
), walk(i, loads, shard) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(0, 16), lambda x: CAST(0 AS BIGINT)), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT q.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + q.bytes ELSE x END), CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT) FROM walk JOIN q ON q.i = walk.i + 1
), m AS (
  SELECT q.v, walk.shard, sum(q.n) OVER (PARTITION BY walk.shard ORDER BY q.v ROWS UNBOUNDED PRECEDING) - q.n AS before FROM q JOIN walk USING (i)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(before + row_number() OVER (PARTITION BY r.v ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, CAST(r.v AS INTEGER) AS virtual_slot, 1 AS map_version FROM r JOIN m ON m.v = r.v
"""
