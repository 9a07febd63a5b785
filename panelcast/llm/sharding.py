"""Sharding by fixed virtual slots: records are hashed into thousands of slots, bytes are summed per
slot, and a versioned slot-to-shard map is stored, which rebalancing edits.

The law is ``bytes``: shards are near equal in bytes, as slots are dealt, largest first, to the
shard that has the least. A slot holds about one in ``n_slots`` of all rows whatever the source or
text, since the id is hashed (a null id: the text's checksum), so no shard or window meets one hot
key. The slot table has at most ``n_slots`` rows, which is the bound of all that is collected or
broadcast. Null texts count as empty; a text of any length is one row of its size; rows of a slot are ranked by id and checksum, equal
ones in any order; of shards with equal bytes the first gets the slot; repeated rows share a slot and get places of their own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import shared_dir, table, texts

N_SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and the virtual slot of every row."""
    crc = F.crc32(F.encode("text", "UTF-8"))
    return texts(docs).select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), crc)), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def build_map(sizes: list[tuple[int, int, int]], n_shards: int, version: int = 1, n_slots: int = N_SLOTS) -> list[tuple]:
    """Rows of the map from (slot, bytes, rows), a row for every one of the slots: largest slot first, each to the shard with the fewest bytes; then the empty ones, each to the shard with the fewest slots."""
    known = {slot: (size, n) for slot, size, n in sizes}
    loads, counts, out = [(0, s) for s in range(n_shards)], [0] * n_shards, []
    for slot, (size, n) in sorted(known.items(), key=lambda x: (-x[1][0], x[0])):
        load, shard = heapq.heappop(loads)
        out.append((version, slot, shard, size, n))
        counts[shard] += 1
        heapq.heappush(loads, (load + size, shard))
    fewest = [(n, s) for s, n in enumerate(counts)]
    heapq.heapify(fewest)
    for slot in (s for s in range(n_slots) if s not in known):
        n, shard = heapq.heappop(fewest)
        out.append((version, slot, shard, 0, 0))
        heapq.heappush(fewest, (n + 1, shard))
    return out


def rebalance(rows: list[tuple], n_shards: int) -> list[tuple]:
    """The next version of a map for more shards: each new shard takes slots from the fullest ones until it has its even share; no other slot moves."""
    total = sum(r[3] for r in rows)
    share, by = total / n_shards, {s: [] for s in range(n_shards)}
    for _, slot, shard, size, n in rows:
        by[shard].append((size, slot, n))
    load = {s: sum(x[0] for x in v) for s, v in by.items()}
    have = {r[2] for r in rows}
    for new in (s for s in range(n_shards) if s not in have):
        heap = [(-load[s], s) for s in have]
        heapq.heapify(heap)
        while heap and load[new] < share:
            _, old = heapq.heappop(heap)
            fits = [x for x in by[old] if x[0] > 0 and load[new] + x[0] <= share]
            if not fits:
                continue
            moved = max(fits)
            by[old].remove(moved)
            by[new].append(moved)
            load[old] -= moved[0]
            load[new] += moved[0]
            heapq.heappush(heap, (-load[old], old))
        have.add(new)
    version = max((r[0] for r in rows), default=0) + 1
    return [(version, slot, s, size, n) for s, v in by.items() for size, slot, n in v]


def store_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append one version of the map to the table at ``path``."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)  # at most n_slots rows


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest if none is named."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add the shard and the place in it, gapless from 0, to any rows: the map says where slots go, not which rows there are.

    A row's place is its rank in its virtual slot, one window over a small partition, after all rows of the shard's earlier slots, a running sum over
    the counts of the rows at hand (a row a slot). A row whose slot the map doesn't have is an error.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    here = slot_map.select("virtual_slot", "shard").join(rows.groupBy("virtual_slot").agg(F.count("*").alias("_n")), "virtual_slot", "left")
    starts = here.select("virtual_slot", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")) - 1
    missing = F.raise_error(F.concat(F.lit("the map has no slot "), F.col("virtual_slot").cast("string"))).cast("boolean")
    placed = rows.join(F.broadcast(starts), "virtual_slot", "left").where(F.when(F.col("shard").isNull(), missing).otherwise(F.lit(True)))
    return placed.select(*rows.columns, "shard", (F.col("_start") + rank).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot of every row by version 1 of a new map, stored at ``path`` (by default a new folder among the shared ones) and read from there."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/panelcast/slot-map-{uuid.uuid4().hex}"
    rows = slotted(docs, n_slots)
    sizes = [tuple(r) for r in slot_sizes(rows).collect()]  # at most n_slots rows
    store_map(spark, build_map(sizes, n_shards, n_slots=n_slots), path)
    return assign(rows, load_map(spark, path, 1))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
