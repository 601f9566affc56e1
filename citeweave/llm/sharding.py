"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's hash puts it into one of ``SLOTS`` virtual slots for good.  Bytes are
summed per slot, and only the map from slot to shard (``SLOTS`` rows, whatever
the corpus) is decided and edited: version 1 deals the slots to shards in
order of their bytes, each to the lightest shard; every later version is the
newest stored one edited by ``rebalanced``, which moves slots from heavy to light
shards, into an added shard or out of dropped ones, and leaves all others.  Where
nothing is to move, no version is written.
Versions are kept side by side as ``version=N`` folders of one table.  Equal
texts have equal checksums but may lie in different shards under the law ``bytes``.

Rows: a null text has no bytes (size 1); a null doc_id is hashed as its own
value; repeated rows fall into one slot and get places of their own.  An empty
table gives no rows and a map of empty slots.  Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, ensure_checkpoint_dir, small_table

SLOTS = 4096


def slot_of(slots: int = SLOTS) -> Column:
    """Virtual slot of a record, from its doc_id and text."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                             F.col("text_crc32")), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n): at most one row per slot and map task is shuffled."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def dealt(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: heaviest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return out


def rebalanced(current: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """The map edited for new loads or more shards: slots go one by one from the
    heaviest to the lightest shard, the largest that narrows their gap first,
    until none does.  Every move lowers the sum of squared loads.  Slots of shards
    that are no more go first, heaviest first, to the lightest shard."""
    out, total = list(current), [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(out):
        if shard < shards:
            total[shard] += loads.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-loads.get(s, 0), s)):
        out[slot] = min(range(shards), key=lambda s: (total[s], s))
        total[out[slot]] += loads.get(slot, 0)
        held[out[slot]].append(slot)
    while True:
        light = min(range(shards), key=lambda s: (total[s], s))
        heavy = max(range(shards), key=lambda s: (total[s], -s))
        gap = total[heavy] - total[light]
        fits = [s for s in held[heavy] if 0 < loads.get(s, 0) < gap]
        if not fits:
            return out
        # closest to half of the gap evens the two best
        slot = min(fits, key=lambda s: (abs(2 * loads[s] - gap), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        total[heavy] -= loads[slot]
        total[light] += loads[slot]
        out[slot] = light


def write_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Store one version of the map; a stored version is never rewritten."""
    rows = [(s, shard) for s, shard in enumerate(shard_of)]
    (small_table(spark, rows, "virtual_slot int, shard int").coalesce(1)
     .write.mode("errorifexists").parquet(f"{path}/version={version}"))


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def newest_version(spark: SparkSession, path: str) -> int:
    """The largest version stored at ``path``; 0 where there is none yet."""
    try:
        stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return stored.agg(F.max("version")).first()[0] or 0


def edited_map(spark: SparkSession, path: str, loads: dict[int, int], shards: int,
               slots: int = SLOTS) -> int:
    """Version of the map at ``path`` that fits ``loads``: the newest one, or the
    next, written as an edit of it."""
    version = newest_version(spark, path)
    if not version:
        version = 1
        write_map(spark, path, version, dealt(loads, shards, slots))
    stored = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, version).collect()}  # ``slots`` rows
    if sorted(stored) != list(range(slots)):
        raise ValueError(f"the map at {path} does not have slots 0 to {slots - 1}")
    current = [stored[s] for s in range(slots)]
    edited = rebalanced(current, loads, shards)
    if edited == current:
        return version
    write_map(spark, path, version + 1, edited)
    return version + 1


def shard_documents(documents: DataFrame, shards: int = 8, slots: int = SLOTS,
                    map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot.

    ``slot`` is the row's place in its shard, gapless from 0: virtual slots of
    a shard follow each other (their counts are the map's few rows), and rows are
    numbered inside their virtual slot only.  ``map_path`` names a stored map to
    keep and edit; without it the map is a new one.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    records = cut_lineage(documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
        .withColumn("virtual_slot", slot_of(slots)))
    per_slot = slot_bytes(records).collect()          # at most ``slots`` rows
    loads = {r["virtual_slot"]: r["bytes"] for r in per_slot}
    counts = {r["virtual_slot"]: r["n"] for r in per_slot}
    path = map_path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/shard-map-{_stamp()}"
    version = edited_map(spark, path, loads, shards, slots)
    table = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, version).collect()}
    heads, at = [], [0] * shards
    for slot in range(slots):
        shard = table[slot]
        heads.append((slot, shard, at[shard]))
        at[shard] += counts.get(slot, 0)
    head = small_table(spark, heads, "virtual_slot int, shard int, head bigint")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (records.withColumn("place", F.row_number().over(order) - 1)
            .join(F.broadcast(head), "virtual_slot")      # ``slots`` rows
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("head") + F.col("place")).cast("long").alias("slot"), "virtual_slot"))


def _stamp() -> str:
    import uuid
    return uuid.uuid4().hex
