"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hashed order, form blocks of ``block_bytes`` bytes
(a document belongs to the block in which its first byte lies).  A source of
weight w releases its block i at slot floor(i / w) and has to send it before
slot ceil((i + 1) / w); every slot takes the released block of the earliest
deadline.  On one sequence earliest deadline first meets all deadlines, so at
any slot t a source has sent t w blocks but for less than one.

Weights are not rounded to a frame (only to parts of 1e-15), so a source does
not drift off its target however long a phase is.  When a source runs out, a
phase ends: the others' weights are scaled up and a new schedule begins.  No
document is dropped or repeated, so weights hold exactly until the first source
ends and among the rest from there on.

Scale.  A block has ``block_bytes`` bytes or 1 / ``MAX_BLOCKS`` of all bytes,
whichever is more, so the driver's schedule has ``MAX_BLOCKS`` rows or so for
any input.  The ``MAX_SOURCES`` sources of the largest weight are scheduled one
by one; all others together are one more source, the tail, with the sum of
their weights, whose documents come in hashed order.  Ranks within a source are
found in ``SPREAD`` hash ranges of it, whose totals are summed, so a hot source
is ranked by many tasks on narrow rows.  :func:`mixed_documents` finds a
document's block from the blocks' first hashes, which are as few as the blocks,
where it is read, and so shuffles text once, into its place.

Cases: a null source is a source of its own; a null text has size 0; ties and
repeated rows are ranked one after another; sources without target weight get
the smallest one given; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize

BLOCK_BYTES = 1 << 16
MAX_BLOCKS = 1 << 20
POWER = 0.5
GRID = 10**15
SPREAD = 256
MAX_SOURCES = 1000
_SLOTS = pa.schema([("s", pa.int32()), ("b", pa.int64()), ("phase", pa.int32()), ("slot", pa.int64())])


def exact_shares(weights: dict) -> dict:
    """Weights as whole parts of their sum, on a grid of ``GRID`` parts."""
    total = sum(weights.values())
    return {s: max(1, round(w / total * GRID)) for s, w in weights.items()}


@dataclass
class Phase:
    base_slot: int
    quota: dict[str, int]
    slots: dict[str, array]
    first_block: dict[str, int]
    blocks: dict[str, int]


def schedule(quota: dict[str, int], left: dict[str, int]) -> tuple[int, dict[str, array]]:
    """Slots of each source's blocks, earliest deadline first among released ones, until a source has none left for its turn."""
    total = sum(quota.values())
    waiting = [(0, s, 0) for s in sorted(quota)]  # release, source, block
    ready: list[tuple[int, str, int]] = []
    out = {s: array("q") for s in quota}
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // quota[s]), s, i))
        deadline, s, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        if i == left[s]:
            return slot, out
        out[s].append(slot)
        heapq.heappush(waiting, ((i + 1) * total // quota[s], s, i + 1))
        slot += 1


def phases(blocks: dict, weights: dict) -> list[Phase]:
    """Phases until every source has sent all its blocks."""
    left = {s: n for s, n in blocks.items() if n}
    sent = dict.fromkeys(left, 0)
    out, base = [], 0
    while left:
        quota = exact_shares({s: weights[s] for s in left})
        end, slots = schedule(quota, left)
        part = {s: len(x) for s, x in slots.items()}
        out.append(Phase(base, quota, slots, dict(sent), part))
        base += end
        for s, n in part.items():
            sent[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out


def _slot_table(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """(s, b, phase, slot) of every block."""
    parts = [pa.table({"s": [], "b": [], "phase": [], "slot": []}, _SLOTS)]
    for k, p in enumerate(plan):
        for s, at in p.slots.items():
            n = len(at)
            slot = np.frombuffer(at, dtype=np.int64) + p.base_slot if n else np.zeros(0, dtype=np.int64)
            block = np.arange(n, dtype=np.int64) + p.first_block[s]
            columns = [pa.array(np.full(n, s, dtype=np.int32)), pa.array(block), pa.array(np.full(n, k, dtype=np.int32)), pa.array(slot)]
            parts.append(pa.Table.from_arrays(columns, schema=_SLOTS))
    return spark.createDataFrame(pa.concat_tables(parts).combine_chunks())


def _groups(rows: DataFrame, weights: dict | None, power: float) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(name, g) of the sources scheduled one by one; bytes and weight of every group, the tail's included."""
    spark = rows.sparkSession
    per = rows.groupBy("source").agg(F.sum("size").alias("n"))
    if weights is None:
        per = per.withColumn("weight", F.pow(F.greatest("n", F.lit(1)), F.lit(power)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, given double")
        weight = F.coalesce("given", F.lit(min(map(float, weights.values()), default=1.0)))
        per = per.join(given, per["source"].eqNullSafe(given["name"]), "left").select("source", "n", weight.alias("weight"))
    per = materialize(per, "sources")
    order = F.desc("weight"), F.desc("n"), F.col("source").asc_nulls_first()
    top = per.orderBy(*order).limit(MAX_SOURCES).collect()
    names = spark.createDataFrame([(r["source"], g) for g, r in enumerate(top)], "name string, g int")
    sizes = {g: r["n"] for g, r in enumerate(top)}
    target = {g: r["weight"] for g, r in enumerate(top)}
    left = per.join(F.broadcast(names), per["source"].eqNullSafe(names["name"]), "left_anti")  # MAX_SOURCES rows
    tail = left.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if tail["weight"] is not None:
        sizes[MAX_SOURCES], target[MAX_SOURCES] = tail["n"], tail["weight"]
    return names, sizes, target


def _rows(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Key, source, text_hash, size and the place in hashed order: part, then h."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(body).alias("text_hash"),
        F.octet_length(body).cast("long").alias("size"),
    )
    return rows.withColumn("h", F.xxhash64("key", "text_hash")).withColumn("part", F.pmod("h", F.lit(SPREAD)))


def _grouped(rows: DataFrame, names: DataFrame) -> DataFrame:
    both = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["name"]), "left").drop("name")  # MAX_SOURCES rows
    return both.withColumn("g", F.coalesce("g", F.lit(MAX_SOURCES)))


def _placed(rows: DataFrame, block_bytes: int, weights: dict | None, power: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with group, offset and block; (s, b, phase, slot) of every block; names of the groups."""
    names, sizes, target = _groups(rows, weights, power)
    unit = max(block_bytes, -(-sum(sizes.values()) // MAX_BLOCKS))
    # a source's last block may hold no first byte; its slot is then empty
    blocks = _slot_table(rows.sparkSession, phases({s: n // unit + 1 for s, n in sizes.items()}, target))
    rows = _grouped(rows, names)
    totals = rows.groupBy("g", "part").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col("g").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("g", "part").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = ranked.join(starts, (F.col("g") == F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    placed = placed.withColumn("offset", F.col("start") + F.col("within"))
    return placed.withColumn("block", F.floor(F.col("offset") / unit).cast("long")), blocks, names


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    power: float = POWER,
) -> DataFrame:
    """Key, source, text_hash, size, offset (bytes of the source before it), block, phase and slot of every row.

    Without ``weights`` a source's target is in proportion to its bytes to the ``power``.
    """
    placed, blocks, _ = _placed(_rows(docs, key, source, text), block_bytes, weights, power)
    out = placed.join(blocks, (F.col("g") == F.col("s")) & (F.col("block") == F.col("b")))
    return out.select(F.col("key").alias(key), "source", "text_hash", "size", "offset", "block", "phase", "slot")


def mixed_documents(
    docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, power: float = POWER
) -> DataFrame:
    """``docs`` in scheduled order: sorted by slot over all partitions, then by place in the source."""
    placed, blocks, names = _placed(_rows(docs, "doc_id", "source", "text"), block_bytes, weights, power)
    first = placed.groupBy("g", "part", "block").agg(F.min("h").alias("h"))
    first = first.join(blocks, (F.col("g") == F.col("s")) & (F.col("block") == F.col("b")))
    # about MAX_BLOCKS first hashes in all, one row for each range
    ranges = first.groupBy("g", "part").agg(F.sort_array(F.collect_list(F.struct("h", "slot"))).alias("firsts"))
    ranges = ranges.withColumnsRenamed({"g": "__g", "part": "__p"})
    h = F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = [F.col(c).alias(f"__own_{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col("source").cast("string").alias("source"), h.alias("h"))
    rows = _grouped(rows.withColumn("part", F.pmod("h", F.lit(SPREAD))), names)
    found = rows.join(F.broadcast(materialize(ranges, "ranges")), (F.col("g") == F.col("__g")) & (F.col("part") == F.col("__p")))
    before = F.size(F.filter("firsts", lambda x: x["h"] <= F.col("h")))
    found = found.withColumn("__slot", F.element_at("firsts", before)["slot"]).drop("firsts")
    order = ("__slot", "part", "h")
    found = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return found.select(*(F.col(f"__own_{k}").alias(c) for k, c in enumerate(docs.columns)))
