"""Sharding by fixed virtual slots.

A record is hashed into one of ``n_slots`` virtual slots, a number that never
changes.  Bytes and rows are aggregated for each slot, and a versioned map
deals slots to shards: largest slot first, to the lightest shard.  When shards
are added or sizes drift, :meth:`SlotMap.rebalance` edits the map instead of
building another: it moves the fewest bytes that bring the shards level.  The registered
query stores two versions, for 24 shards and edited for 25, and says where each
row lies in either.

Only slot totals reach the driver: ``n_slots`` rows, whatever the input.  The
text never moves; ranking inside a slot shuffles four narrow columns.

Cases: a null text is empty (size 8, checksum 0); a null key is placed by the
text's hash; repeated rows are placed one after another; ties in a slot are
ordered by key, checksum and size; an empty table gives no rows; other columns
are neither read nor returned.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.shared import shared_dir

N_SLOTS = 4096
_MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_rows long, slot_bytes long"


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def virtual_slot(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The first 32 bits of a digest that other systems have too, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), text))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


@dataclass
class SlotMap:
    """Slot-to-shard map; ``rows`` and ``bytes`` are the totals it was made for."""

    version: int
    n_shards: int
    shard: list[int]
    rows: list[int]
    bytes: list[int]
    moved: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, rows: list[int], sizes: list[int], n_shards: int) -> SlotMap:
        """Largest slot first to the lightest shard; slots without rows go round-robin."""
        load = [(0, s) for s in range(n_shards)]
        shard = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            total, to = heapq.heappop(load)
            shard[slot] = to if sizes[slot] else slot % n_shards
            heapq.heappush(load, (total + sizes[slot], to))
        return cls(1, n_shards, shard, rows, sizes)

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, to in enumerate(self.shard):
            out[to] += self.bytes[slot]
        return out

    def rebalance(self, n_shards: int | None = None, rows=None, sizes=None) -> SlotMap:
        """The next version: slots leave shards above the mean for the lightest ones.

        With more shards and unchanged sizes, slots move only into new shards.
        Shards that are taken away are emptied first.
        """
        n = n_shards or self.n_shards
        new = SlotMap(self.version + 1, n, list(self.shard), rows or self.rows, sizes or self.bytes)
        mean = sum(new.bytes) / n
        load = [0] * max(n, self.n_shards)
        held: list[list[int]] = [[] for _ in load]
        for slot, at in enumerate(new.shard):
            load[at] += new.bytes[slot]
            held[at].append(slot)
        grown = range(self.n_shards, n)
        open_to = list(grown) or list(range(n))
        heap = [(load[s], s) for s in open_to]
        heapq.heapify(heap)
        for at in range(len(load)):
            held[at].sort(key=lambda s: (new.bytes[s], s))
            while held[at] and (at >= n or load[at] > mean):
                total, to = heapq.heappop(heap)
                if total != load[to]:
                    heapq.heappush(heap, (load[to], to))
                    continue
                slot = held[at].pop()
                size = new.bytes[slot]
                if at < n and (to == at or load[to] + size >= load[at]):
                    heapq.heappush(heap, (load[to], to))
                    if to == at or not size:
                        break
                    continue
                load[at] -= size
                load[to] += size
                new.shard[slot] = to
                new.moved.append(slot)
                heapq.heappush(heap, (load[to], to))
        return new

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, s, self.shard[s], self.rows[s], self.bytes[s]) for s in range(len(self.shard))]
        return spark.createDataFrame(rows, _MAP_SCHEMA).coalesce(1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Each version is a folder of its own and is never written over."""
        self.table(spark).drop("version").write.parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int, n_shards: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
        return cls(version, n_shards, *([r[c] for r in rows] for c in ("shard", "slot_rows", "slot_bytes")))


def slot_totals(docs: DataFrame, key: str = "doc_id", n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Rows and bytes of every slot: ``n_slots`` rows at most reach the driver."""
    text = text_of(docs)
    slot = virtual_slot(docs[key], text, n_slots)
    size = F.octet_length(text).cast("long") + 8
    rows, sizes = [0] * n_slots, [0] * n_slots
    for s, n, b in docs.groupBy(slot.alias("s")).agg(F.count(F.lit(1)), F.sum(size)).collect():
        rows[s], sizes[s] = n, b
    return rows, sizes


def place(docs: DataFrame, slots: SlotMap, key: str = "doc_id", later: SlotMap | None = None) -> DataFrame:
    """Key, size, checksum, shard, place in the shard (from 0, no gaps), virtual slot and map version.

    With a ``later`` map also its version and shard.
    """
    spark, n_slots = docs.sparkSession, len(slots.shard)
    before, start = [0] * slots.n_shards, []
    for s, to in enumerate(slots.shard):
        start.append(before[to])
        before[to] += slots.rows[s]
    after = later or slots
    deal = spark.createDataFrame(
        [(s, slots.shard[s], start[s], after.shard[s]) for s in range(n_slots)],
        "virtual_slot int, shard int, start long, next_shard int",
    )
    text = text_of(docs)
    rows = docs.select(
        docs[key].alias(key),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        virtual_slot(docs[key], text, n_slots).alias("virtual_slot"),
    )
    within = W.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    # n_slots rows: the size of this side does not depend on the input
    return ranked.join(F.broadcast(deal), "virtual_slot").select(
        key,
        "size",
        "text_crc32",
        "shard",
        (F.col("start") + F.col("rank")).alias("slot"),
        "virtual_slot",
        F.lit(slots.version).alias("map_version"),
        *([F.lit(after.version).alias("next_version"), "next_shard"] if later else []),
    )


def shard_documents(
    docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, path: str | None = None, grown: int | None = None
) -> DataFrame:
    """Builds, stores and applies the first version of a map for ``docs``.

    ``grown``: number of shards for which a second version is edited, stored and applied beside it.
    """
    spark = docs.sparkSession
    slots = SlotMap.build(*slot_totals(docs, n_slots=n_slots), n_shards)
    if path is None:
        import uuid

        path = f"{shared_dir(spark)}/folio/slot-map-{uuid.uuid4().hex}"
    slots.save(spark, path)
    stored = SlotMap.load(spark, path, slots.version, n_shards)
    if grown is None:
        return place(docs, stored)
    stored.rebalance(grown).save(spark, path)
    return place(docs, stored, later=SlotMap.load(spark, path, slots.version + 1, grown))


def sql(n_shards: int = 24, n_slots: int = N_SLOTS) -> str:
    """The query in DuckDB SQL: the map by recursion over slots, the checksum from its bit rule."""
    return f"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT n::UINTEGER, n::UINTEGER, 0 FROM range(256) r(n) UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS l FROM bits WHERE k = 8
), b AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, text, ''))[1:8])::BIGINT % {n_slots} AS vs,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER) AS bytes
  FROM documents
), d AS (
  SELECT doc_id, size, vs, xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes),
         lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS crc
  FROM b, tab
), tot AS (
  SELECT r.vs, count(d.vs) AS n, coalesce(sum(size), 0)::BIGINT AS size
  FROM range({n_slots}) r(vs) LEFT JOIN d ON d.vs = r.vs GROUP BY r.vs
), ord AS (SELECT vs, size, row_number() OVER (ORDER BY size DESC, vs) AS k FROM tot
), build(k, loads, vs, shard) AS (
  SELECT 0::BIGINT, list_transform(range({n_shards}), lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT UNION ALL
  SELECT o.k, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + o.size ELSE v END),
         o.vs, CASE WHEN o.size > 0 THEN list_position(loads, list_min(loads)) - 1 ELSE o.vs % {n_shards} END
  FROM build JOIN ord o ON o.k = build.k + 1
), map1 AS (SELECT b.vs, shard, n, size FROM build b JOIN tot USING (vs)
), held AS (
  SELECT vs, shard, size, row_number() OVER (ORDER BY shard, size DESC, vs DESC) AS k,
         sum(size) OVER (PARTITION BY shard) AS load, sum(size) OVER () AS total
  FROM map1
), edit(k, shard, load, new, vs, moved) AS (
  SELECT 0::BIGINT, -1::BIGINT, 0::HUGEINT, 0::HUGEINT, NULL::BIGINT, false UNION ALL
  SELECT k, shard, CASE WHEN moves THEN now - size ELSE now END, CASE WHEN moves THEN new + size ELSE new END, vs, moves
  FROM (SELECT *, now * {n_shards + 1} > total AND new + size < now AS moves
        FROM (SELECT h.k, h.shard, h.vs, h.size, h.total, e.new, CASE WHEN h.shard = e.shard THEN e.load ELSE h.load END AS now
              FROM edit e JOIN held h ON h.k = e.k + 1))
), map AS (
  SELECT m.vs, m.shard, CASE WHEN moved THEN {n_shards} ELSE m.shard END AS next_shard,
         sum(n) OVER (PARTITION BY m.shard ORDER BY m.vs) - n AS start
  FROM map1 m JOIN edit e ON e.vs = m.vs
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       (start + row_number() OVER (PARTITION BY d.vs ORDER BY doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard, d.vs::INT AS virtual_slot, 1 AS map_version, 2 AS next_version, next_shard::INT AS next_shard
FROM d JOIN map ON map.vs = d.vs
"""
