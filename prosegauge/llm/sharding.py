"""Sharding by fixed virtual slots (operator 12).

Every document hashes to one of a fixed number of virtual slots, for good.
Bytes are summed by slot, and a map says which shard holds a slot. The map is
small, has a version, and is stored; growing or rebalancing edits it and
moves whole slots, the fewest that it takes, while records keep their slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prosegauge.llm.common import materialise

SLOTS = 8_192
SHARDS = 8
COPIES = 100_000  # of one row that one task numbers at a time
MAP = "version int, shards int, virtual_slot int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot. ``version`` counts the edits from 1."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def moved(self, new: SlotMap) -> list[int]:
        """The slots that another map holds elsewhere."""
        return [s for s, (a, b) in enumerate(zip(self.shard_of, new.shard_of, strict=True)) if a != b]


def balanced(loads: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """The first map: slots by bytes, largest first, each to the shard with the fewest bytes, then fewest slots, then smallest number."""
    shard_of, bytes_of, slots_of = [0] * slots, [0] * shards, [0] * shards
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        to = min(range(shards), key=lambda i: (bytes_of[i], slots_of[i], i))
        shard_of[slot], bytes_of[to], slots_of[to] = to, bytes_of[to] + loads.get(slot, 0), slots_of[to] + 1
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced(old: SlotMap, loads: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: single slots move from the fullest to the emptiest shard until both are within ``tolerance`` of the mean, or no move brings them nearer.

    With more shards than before, slots move only into the new ones. Bytes of
    all shards but two stay, so each edit moves little.
    """
    shards = old.shards if shards is None else shards
    if shards < old.shards:
        raise ValueError("a map never has fewer shards than before")
    shard_of = list(old.shard_of)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        held[shard][slot] = loads.get(slot, 0)
    total = [sum(h.values()) for h in held]
    mean = sum(total) / shards
    into = range(old.shards, shards) if shards > old.shards else range(shards)
    while True:
        fullest, emptiest = max(range(shards), key=lambda i: (total[i], -i)), min(into, key=lambda i: (total[i], i))
        gap = total[fullest] - total[emptiest]
        if max(total[fullest] - mean, mean - total[emptiest]) <= tolerance * mean:
            break
        # a slot of more than the gap would only turn it round; the one nearest half the gap closes it best
        fits = [s for s, n in held[fullest].items() if 0 < n < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(2 * held[fullest][s] - gap), s))
        n = held[fullest].pop(slot)
        held[emptiest][slot] = n
        total[fullest], total[emptiest], shard_of[slot] = total[fullest] - n, total[emptiest] + n, emptiest
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Write a version beside the earlier ones; a version that is there already is an error, never overwritten."""
    rows = [(slot_map.version, slot_map.shards, s, k) for s, k in enumerate(slot_map.shard_of)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={slot_map.version:06d}")


def read_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.schema(MAP).parquet(f"{path.rstrip('/')}/version={version:06d}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are stored."""
    rows = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/version=*").select(F.col("version").cast("int").alias("v")).distinct().collect()
    return sorted(r.v for r in rows)


def in_slots(docs: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """(doc_id, size, text_crc32, text_md5, copy, key, virtual_slot): the documents, numbered among whole repeats, with their slots.

    Repeats of a row are counted before they are dealt, and get their numbers
    in portions of ``copies``, so that any number of them is dealt evenly.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"))
    kinds = rows.groupBy("doc_id", "size", "text_crc32", "text_md5").agg(F.count(F.lit(1)).alias("n"))
    portions = kinds.withColumn("portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / copies).cast("long"))))
    portions = portions.repartition("text_md5", "doc_id", "portion")
    begin = F.col("portion") * copies
    each = portions.withColumn("copy", F.explode(F.sequence(begin, F.least(F.col("n"), begin + copies) - 1)))
    key = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5", "copy")), 1, 15)
    each = each.withColumn("key", F.conv(key, 16, 10).cast("long"))
    return each.select("doc_id", "size", "text_crc32", "text_md5", "copy", "key", (F.col("key") % slots).cast("int").alias("virtual_slot"))


def loads_of(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each slot that has any; at most as many as there are slots."""
    return {r.virtual_slot: (r.n, r.bytes) for r in rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}


def placed(rows: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """``in_slots`` rows with shard, and slot: the row's place in its shard, from 0 without gaps.

    The places before a virtual slot are the rows of its shard's earlier ones,
    known from ``counts``; inside one, rows stand by key.
    """
    spark, before, start = rows.sparkSession, [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.shard_of):
        start.append((slot, shard, before[shard]))
        before[shard] += counts.get(slot, 0)
    starts = spark.createDataFrame(start, "virtual_slot int, shard int, before long")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("key", "doc_id", "text_md5", "copy"))
    return rows.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("before") + inside - 1).drop("before")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, slot_map: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each row of ``docs(doc_id, text)``.

    The law is ``bytes``: a map made here gives the shards near equal bytes,
    as the largest slots go first and no slot is split; a map handed in is
    used as it is, and ``store`` keeps the map that was used. A null
    text has no bytes and counts as empty; a null id is an id. Whole repeats
    are told apart by number, so they spread over slots like any rows; ties
    in key go by id, text and number. A text of any length is one record, and
    shards differ at least by what one record holds beyond its share. An
    empty table gives an empty result; other columns are not read.
    """
    rows = materialise(in_slots(docs, slots))
    loads = loads_of(rows)
    chosen = slot_map or balanced({s: b for s, (_, b) in loads.items()}, shards, slots)
    if store:
        store_map(docs.sparkSession, chosen, store)
    out = placed(rows, chosen, {s: n for s, (n, _) in loads.items()})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(chosen.version).alias("map_version"), "text_md5")


def write_shards(docs: DataFrame, placed_rows: DataFrame, path: str, files: int = 1) -> None:
    """Write (doc_id, text, slot) of ``assign``'s rows, a folder for each shard, in order of slot inside its files.

    Texts are read once for each id and text; a third of all rows with one text and id is a skewed join, which Spark splits.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.md5(text).alias("__md5"), text.alias("text")).groupBy("__id", "__md5").agg(F.first("text").alias("text"))
    rows = placed_rows.select("doc_id", "shard", "slot", "text_md5").join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_md5") == F.col("__md5")))
    rows = rows.select("shard", "slot", "doc_id", "text").repartitionByRange(SHARDS * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


def crc32_sql(text: str) -> str:
    """CRC-32 of ``text`` in DuckDB, which has no such function, over a table ``l`` of the 256 remainders."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def assign_sql(table: str = "documents", shards: int = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for :func:`assign`: the map is made slot by slot, in a recursion over a list of loads."""
    zeros = ", ".join(["0"] * shards)
    return f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS l FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, {crc32_sql('t')} AS text_crc32, md5(t) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM {table}), crc
),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h) - 1 AS copy FROM d),
k AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || h || ':' || copy), 1, 15))::BIGINT AS key FROM n),
v AS (SELECT *, (key % {slots})::INT AS vs FROM k),
loads AS (SELECT vs, sum(size)::BIGINT AS b, row_number() OVER (ORDER BY sum(size) DESC, vs) AS i FROM v GROUP BY vs),
fill(i, vs, shard, held) AS (
  SELECT 0::BIGINT, NULL::INT, NULL::BIGINT, [{zeros}]::BIGINT[]
  UNION ALL
  SELECT i, vs, s, list_transform(held, lambda x, j: CASE WHEN j = s THEN x + b * {2 * slots} + 1 ELSE x END)
  FROM (SELECT l.i, l.vs, l.b, f.held, list_position(f.held, list_min(f.held))::BIGINT AS s FROM fill f JOIN loads l ON l.i = f.i + 1)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, (shard - 1)::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY v.vs, key, doc_id, h, copy) - 1 AS slot,
  NULL::INT AS grown_shard, v.vs AS virtual_slot, 1 AS map_version
FROM v JOIN fill ON v.vs = fill.vs
"""
