"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots (thousands, however large the
table).  Bytes are summed per slot, and a versioned map, one row per slot and
version, says which shard holds which slot.  Rebalancing edits the map: a new
version moves single slots; records never hash anew.  Only the per-slot sums
(bounded by the slot count) reach the driver.

A first version deals the slots out in turn, before anything is known of them.
Once the bytes are summed the map is edited: single slots move from full shards
to empty ones until the shards' bytes are near equal.  Each version is stored,
and records are placed by the version that is read back.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import cut

#: Virtual slots; a power of two well above any shard count.
SLOTS = 8192
#: Bytes counted for each record besides its text.
RECORD_OVERHEAD = 16

MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the record's overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(RECORD_OVERHEAD)).cast("long")


def virtual_slot(columns: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of the given columns.  Hashing content along with the id
    spreads rows that share one id."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def slot_sizes(keyed: DataFrame, slot_col: str = "virtual_slot", size_col: str = "size") -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots that hold records; at most as many as there are slots."""
    return sorted((r[0], r[1], r[2]) for r in keyed.groupBy(slot_col).agg(F.sum(size_col), F.count("*")).collect())


def first_map(shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int, int]]:
    """Version 0: the slots in turn, without sizes.  Every slot has a shard, so records may come
    before anything was measured."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return [(0, slot, slot % shards, 0, 0) for slot in range(slots)]


def even_out(current: list[tuple[int, int, int, int, int]], sizes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The next version, with the measured sizes: slots move, the largest that fits first, from the
    fullest shard to the emptiest until no move brings the two closer.  Each move lessens the sum of
    squared bytes, so this ends; the shards then differ by less than a small slot."""
    measured = {s: (b, n) for s, b, n in sizes}
    shards = sorted({shard for _, _, shard, _, _ in current})
    held = {shard: [] for shard in shards}  # (bytes, slot), ascending
    for _, slot, shard, _, _ in current:
        insort(held[shard], (measured.get(slot, (0, 0))[0], slot))
    load = {shard: sum(b for b, _ in held[shard]) for shard in shards}
    while True:
        full, empty = max(shards, key=lambda s: (load[s], -s)), min(shards, key=lambda s: (load[s], s))
        at = bisect_left(held[full], ((load[full] - load[empty] + 1) // 2 + 1,)) - 1  # moves less than the difference
        while at >= 0 and held[full][at][0] >= load[full] - load[empty]:
            at -= 1
        if at < 0 or not held[full][at][0]:
            break
        weight, slot = held[full].pop(at)
        insort(held[empty], (weight, slot))
        load[full] -= weight
        load[empty] += weight
    version = max((v[0] for v in current), default=-1) + 1
    return sorted((version, slot, shard, *measured.get(slot, (0, 0))) for shard in shards for _, slot in held[shard])


def rebalance(current: list[tuple[int, int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """The next version for another number of shards, as an edit of the current one.  Growing
    moves slots only into new shards; shrinking moves only the slots of dropped shards."""
    version = current[0][0] + 1 if current else 0
    place = {slot: shard for _, slot, shard, _, _ in current}
    size = {slot: (b, n) for _, slot, _, b, n in current}
    load = dict.fromkeys(range(shards), 0)
    for slot, shard in place.items():
        if shard < shards:
            load[shard] += size[slot][0]
    target = sum(b for b, _ in size.values()) / shards
    had = {s for s in place.values()}
    fresh = [s for s in range(shards) if s not in had]
    homeless = sorted((s for s, shard in place.items() if shard >= shards), key=lambda s: (-size[s][0], s))
    for slot in homeless:
        shard = min(load, key=lambda s: (load[s], s))
        place[slot] = shard
        load[shard] += size[slot][0]
    for slot in sorted(place, key=lambda s: (-size[s][0], s)) if fresh else ():
        to = min(fresh, key=lambda s: (load[s], s))
        at, weight = place[slot], size[slot][0]
        if at not in fresh and weight and load[at] - weight >= target - weight / 2 and load[to] + weight <= target + weight / 2:
            place[slot] = to
            load[at] -= weight
            load[to] += weight
    return sorted((version, slot, shard, *size[slot]) for slot, shard in place.items())


def map_frame(spark: SparkSession, versions: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(versions, MAP_SCHEMA)


def save_map(spark: SparkSession, versions: list[tuple[int, int, int, int, int]], path: str) -> None:
    """Append a version to the stored map; each version has a folder of its own."""
    map_frame(spark, versions).coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """One version of the stored map, the last one by default; none where no map is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).select("version", "slot", "shard", "bytes", "rows").collect()
    return sorted(tuple(r) for r in rows)


def assign(keyed: DataFrame, versions: list[tuple[int, int, int, int, int]], order: list[Column], slot_col: str = "virtual_slot") -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard (0, 1, ... without gaps).

    The map (one row per slot) is broadcast.  A place is the rows of the shard's earlier slots,
    known from the map, plus the rank within the record's own slot, so the only window is over
    a slot: one part in thousands of the table, never a whole shard."""
    spark = keyed.sparkSession
    before: dict[int, int] = {}
    rows = []
    for _, slot, shard, _, n in versions:
        rows.append((slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    places = F.broadcast(spark.createDataFrame(rows, f"{slot_col} int, shard int, places_before long"))
    rank = F.row_number().over(Window.partitionBy(slot_col).orderBy(*order)) - 1
    return keyed.withColumn("rank_in_slot", rank).join(places, slot_col).withColumn("slot", (F.col("places_before") + F.col("rank_in_slot")).cast("long")).drop("places_before", "rank_in_slot")


def shard_documents(docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Shard all records so that the shards' bytes are near equal.  The map's versions are stored at
    ``map_path``; where a map lies there already, its last version is the one that is edited, and
    records stay where they are unless their slot moves.

    Columns: the id, ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``slot``; others are left
    out.  A null text has size 16 and the crc of no bytes.  Rows that repeat under one id share a
    virtual slot and take consecutive places; rows without id, which may be many, are spread by the
    part of the input that they come from as well.  An empty table gives no rows (its map is stored
    all the same).  The texts are read once; the narrow rows are written, so that sums and places
    are taken from the same ones, and shuffled once."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    narrow = docs.select(F.col(id_col), record_size(F.col(text_col)).alias("size"), crc.cast("long").alias("text_crc32"))
    spread = F.when(F.col(id_col).isNull(), F.spark_partition_id())
    keyed = cut(narrow.withColumn("virtual_slot", virtual_slot([F.col(id_col), F.col("text_crc32"), F.col("size"), spread], slots)))
    current = load_map(spark, map_path)
    if not current:
        current = first_map(shards, slots)
        save_map(spark, current, map_path)
    elif max(v[2] for v in current) + 1 != shards:
        current = rebalance(current, shards)
        save_map(spark, current, map_path)
    save_map(spark, even_out(current, slot_sizes(keyed)), map_path)
    return assign(keyed, load_map(spark, map_path), [F.col(id_col), F.col("text_crc32"), F.col("size")])
