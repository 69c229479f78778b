"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct two-word shingles (parameter ``words_in``)
of ASCII-lower-cased words.  Two collections of ``M`` short signatures, each of
``R`` minhashes, are computed: 2 M R hash functions.  Table (i, j) of M * M
keys on signature i of the first and j of the second collection, 2 R minhashes
together; direct banding would need M * M * 2 R functions for as many tables.
Two sets of similarity s meet in some table with probability
(1 - (1 - s^R)^M)^2: 0.9996 at s = 0.8 with R = 3 and M = 12, and documents of
a group meet along many pairs.

Steps.  1. Sets are hashed in one pass; equal sets collapse to one node, so
exact copies never enter a bucket twice.  2. Table keys are sorted, and a
streaming pass pairs each member of a bucket with its first one: rows stay
linear in the bucket's size and memory is constant.  3. Every pair is confirmed
on the full sets.  4. Links become components.  5. The rest is exact: members
of buckets that hold several components are joined by prefixes.  With shingles
in one order, rare ones first, two sets of that similarity share one among the
first of both; the prefixes of documents that only share a long passage hold
their own shingles and don't meet.  In a shuffled order each member of a prefix
shingle is first tried with ``STEPS`` members behind it, which joins most
components, and what then are still pairs of different components are all
formed, in blocks that many tasks share.  So no link between members of a
bucket is left, and no number of rounds or partners is set.

Shuffles carry ids and hashes.  Sets are shuffled only for documents that met
another one; a bitmap with 8 to 16 bits for each of them, up to ``MAX_BITS``
in all, is broadcast and spares most others the work.  An exact join on the
set's identity follows it, so a full bitmap costs time, never a link.

Cases: a null text, or one without words, has an empty set and links with
nothing; a document of one word has that word as its only shingle; equal sets
share a component whatever their texts; repeated rows each return; two texts
under one id are two sets, each with its own links; rows without id are linked like
others and take the smallest id of their component; a component without any id
has none, and of its sets one is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.shared import materialize
from foliospark.llm.words import U64, Words, mix, slices
from foliospark.session import ship

THRESHOLD = 80  # per cent
M = 12
R = 3
MAX_BITS = 28
BLOCK = 512
STEPS = 32
_WITHIN = 2
_ALONE = U64(0x51ED270B2A6B3C5D)
_C = U64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(80).integers(1, 2**63, size=2 * M * R, dtype=np.uint64) | U64(1)


def shingles(hashes: np.ndarray, words_in: int = 2) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(hashes)
    if n < words_in:
        if not n:
            return hashes
        out = _ALONE
        for h in hashes:
            out = mix((out * _C + h)[None])[0]
        return out[None]
    out = hashes[: n - words_in + 1]
    for k in range(1, words_in):
        out = mix(out * _C + hashes[k : n - words_in + 1 + k])
    return np.unique(out)


def sets_of(column: pa.Array, words_in: int = 2) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for a, b in slices(column):
            words = Words.of(column.slice(a, b - a), lower=True)
            for k in range(b - a):
                yield shingles(words.hashes[words.first[k] : words.first[k + 1]], words_in)


def signature(s: np.ndarray) -> np.ndarray:
    """2 M R minhashes of 32 bits."""
    out = np.full(len(_SEEDS), 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(out, ((s[at : at + 4096, None] * _SEEDS) >> U64(32)).min(axis=0), out=out)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """M short signatures of each collection, with their place hashed in."""
    parts = sig.reshape(len(sig), 2 * M, R)
    out = np.broadcast_to(np.arange(1, 2 * M + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(R):
        out = mix(out * _C + parts[:, :, k])
    return out.view(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


_SIGNED = "key long, text_hash long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def signed(docs: DataFrame, words_in: int = 2) -> DataFrame:
    """Set size, set identity (128 bits) and short signatures of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, identity, sigs = [], [], []
                for s in sets_of(part.column(2), words_in):
                    sizes.append(len(s))
                    identity.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(signature(s))
                two = np.frombuffer(b"".join(identity), dtype="<i8").reshape(-1, 2)
                sig = np.array(sigs)
                none = np.array(sizes) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(two[:, 0], pa.int64(), mask=none),
                        pa.array(two[:, 1], pa.int64(), mask=none),
                        _lists(_bands(sig), pa.int64()),
                    ],
                    ["key", "text_hash", "n_shingles", "set_hi", "set_lo", "bands"],
                )

    return docs.mapInArrow(run, _SIGNED)


def table_keys(reps: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each of the M * M table keys of a document."""
    first, second = F.slice("bands", 1, M), F.slice("bands", M + 1, M)
    keys = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b))))
    return reps.select(*keep, F.explode(keys).alias("k"))


_PAIR = "a long, b long"


def _pairs_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (k, rep) sorted by both: each member with the bucket's first one."""
    key = first = None
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        d = batch.column(1).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        if key is not None:  # carry the open bucket's state in front
            k, d = np.concatenate([[key], k]), np.concatenate([[first], d])
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        head = d[starts][np.cumsum(new) - 1]
        inner = np.flatnonzero(~new)
        key, first = k[-1], head[-1]
        yield _distinct(head[inner], d[inner])


def open_members(labels: DataFrame) -> DataFrame:
    """(rep) of buckets that hold untried pairs of different components; ``labels`` has rep, component and bands.

    Each member was tried with the bucket's first one, so two members leave no pair.
    """
    keyed = table_keys(labels, ["rep", "component"])
    counts = F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")
    mixed = keyed.groupBy("k").agg(*counts).where("n > 2 and lo < hi").select("k")
    return keyed.join(mixed, "k", "left_semi").select("rep").distinct()


def _whole_keys(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first column, cut where it changes."""
    held: list[list[np.ndarray]] = []  # of the open key
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if not len(new[0]):
            continue
        at = int(np.searchsorted(new[0], new[0][-1]))
        if held and at == 0 and held[0][0][0] == new[0][0]:
            held.append(new)
            continue
        if held or at:
            yield [np.concatenate(x) for x in zip(*held, [x[:at] for x in new], strict=True)]
        held = [[x[at:] for x in new]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def prefixes(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(token, rep, n, at): a set's first shingles in the order of frequency and hash.

    Sets of sizes n and m that reach the threshold share max(n, m) threshold / 100 or more, so
    one of each set's first n - threshold n / 100 + 1 at least.  Shingles that only one set holds
    count in the places ``at`` but meet nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                each = [_unpacked(x).view(np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(each))], ["rep", "token"])

    own = sets.join(members.select(F.col("rep").alias("id")), "id", "left_semi")
    rows = own.select("id", "s").mapInArrow(run, "rep long, token long")
    # written, so that a shingle of many sets is a skewed join key that adaptive execution may split
    often = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("f")), "often")
    ordered = rows.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    n = F.size("t")
    first = F.expr(f"slice(t, 1, size(t) - cast(ceil({threshold} * size(t) / 100) as int) + 1)")
    out = ordered.select("rep", n.cast("long").alias("n"), F.posexplode(first).alias("at", "x")).where("x.f > 1")
    return out.select(F.col("x.token").alias("token"), "rep", "n", F.col("at").cast("long").alias("at"))


def _pairs_by_prefix(threshold: int, most_at_once: int = 1 << 20):
    """From rows (k, side, rep, component, n, at) sorted by k and side: pairs of different components that can reach the threshold.

    Rows of side 0 meet those of side 1, rows of side ``_WITHIN`` each other.  What two sets share
    from a common shingle on is no more than what either has left there.  At their first common one
    that is all they share, so it never drops a link.  Pairs are formed ``most_at_once`` at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, e, d, c, n, p in _whole_keys(batches, 6):
            left = n - p
            end = np.searchsorted(k, k, side="right")
            low = np.arange(1, len(k) + 1)  # a row within its block meets the ones behind it
            ones = np.cumsum(e == 1) - (e == 1)
            first = end - (np.concatenate([ones, [ones[-1] + (e[-1] == 1)]])[end] - ones)  # of the key's rows of side 1
            low = np.where(e == 0, first, np.where(e == 1, end, low))
            until = np.cumsum(end - low)
            at = 0
            while at < len(k):
                done = until[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(until, done + most_at_once, side="right")))
                counts = (end - low)[at:stop]
                a = np.repeat(np.arange(at, stop), counts)
                b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[at:stop], counts)
                at = stop
                most = np.minimum(left[a], left[b])
                hit = (c[a] != c[b]) & ((100 + threshold) * most >= threshold * (n[a] + n[b]))
                if hit.any():
                    yield _distinct(d[a[hit]], d[b[hit]])

    return run


def _pairs_beside(threshold: int, steps: int):
    """From rows (token, rep, component, n, at) sorted by token and a shuffled order: pairs at most ``steps`` apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 5
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            k, d, c, n, p = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            known = len(held[0])
            held = [x[-steps:] for x in (k, d, c, n, p)]
            left = n - p
            for step in range(1, steps + 1):
                b = np.arange(max(step, known), len(k))
                a = b - step
                fits = (100 + threshold) * np.minimum(left[a], left[b]) >= threshold * (n[a] + n[b])
                hit = (k[a] == k[b]) & (c[a] != c[b]) & fits
                if hit.any():
                    yield _distinct(d[a[hit]], d[b[hit]])

    return run


def pairs_beside(rows: DataFrame, threshold: int, parts: int, steps: int = STEPS) -> DataFrame:
    """Pairs (a, b) of different components that stand near each other among a shingle's rows, in shuffled order.

    Range partitions cut a shingle of many rows anywhere; what is missed there is left to :func:`prefix_pairs`.
    """
    order = rows.select("token", "rep", "component", "n", "at", F.xxhash64("rep", "token").alias("h"))
    order = order.repartitionByRange(parts, "token", "h").sortWithinPartitions("token", "h").drop("h")
    return order.mapInArrow(_pairs_beside(threshold, steps), _PAIR).distinct()


def prefix_pairs(rows: DataFrame, threshold: int, parts: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different components that meet in ``prefixes``.

    Of a shingle's rows, those of its largest component meet only the rest; the rest meets all.  Either
    is dealt into blocks of some ``block`` rows, and two blocks meet under a key of their own: all
    pairs are still formed, by many tasks, but none within a large group of copies.
    """
    per = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("token").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("parts")
    )
    deal = lambda n: F.ceil(n / block).cast("long")
    mixed = mixed.where("parts > 1").select(
        "token", F.col("m.component").alias("top"), deal(F.col("m.n")).alias("g"), deal(F.col("all") - F.col("m.n")).alias("r")
    )
    # written for the same reason as the frequencies
    joined = rows.join(materialize(mixed, "mixed"), "token")
    h, zero = F.xxhash64("rep"), F.lit(0).cast("long")
    key = lambda kind, x, y, side: F.struct(F.xxhash64("token", F.lit(kind), x, y).alias("k"), F.lit(side).cast("long").alias("side"))
    own, other = F.pmod(h, F.col("g")), F.pmod(h, F.col("r"))
    top = F.transform(F.sequence(zero, F.col("r") - 1), lambda j: key(0, own, j, 0))
    rest = F.transform(F.sequence(zero, F.col("g") - 1), lambda i: key(0, i, other, 1))

    def among(j: Column) -> Column:
        side = F.when(other == j, _WITHIN).when(other < j, 0).otherwise(1).cast("long").alias("side")
        return F.struct(F.xxhash64("token", F.lit(1), F.least(other, j), F.greatest(other, j)).alias("k"), side)

    rest = F.concat(rest, F.transform(F.sequence(zero, F.col("r") - 1), among))
    keyed = joined.select(F.explode(F.when(F.col("component") == F.col("top"), top).otherwise(rest)).alias("x"), "rep", "component", "n", "at")
    keyed = keyed.select("x.k", "x.side", "rep", "component", "n", "at")
    keyed = keyed.repartition(parts, "k").sortWithinPartitions("k", "side")
    return keyed.mapInArrow(_pairs_by_prefix(threshold), _PAIR).distinct()


def _distinct(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def bits_for(n: int) -> int:
    """Exponent of a bitmap for ``n`` ids: 8 to 16 bits for each, between 2**16 and 2**MAX_BITS."""
    return max(16, min(MAX_BITS, (8 * n).bit_length()))


def bitmap(hashed: DataFrame, bits: int) -> bytes:
    """Bitmap of numbers below 2**bits (column h): 2**bits bits reach the driver, whatever the input."""
    words = hashed.groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("n")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("m")
    )
    out = bytearray((1 << bits) // 8)
    for n, m in words.collect():  # 2**MAX_BITS / 8 bytes at most
        # Spark counts positive numbers from 1: h + 1 is bit h % 32768 of bucket 1 + h // 32768
        at = (n - 1) * 4096
        out[at : at + len(m)] = m
    return bytes(out)


def _packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray((s >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def sets_table(docs: DataFrame, met: DataFrame, words_in: int = 2) -> DataFrame:
    """(id, s): the sets of the nodes in ``met`` (rep, key, set_hi, set_lo) as sorted 48-bit hashes.

    ``docs`` has key and text.  A set is known by its identity, so one key may stand over several.
    """
    spark = docs.sparkSession
    bits = bits_for(met.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).alias("h")
    seen = spark.sparkContext.broadcast(bitmap(met.select(place("key")), bits))  # 2**MAX_BITS / 8 bytes at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(seen.value, dtype=np.uint8)
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((known[h >> 3] >> (h & 7).astype(np.uint8)) & 1)
            for at in range(0, len(hit), 1024):
                part = batch.take(pa.array(hit[at : at + 1024]))
                identity, sets = [], []
                for s in sets_of(part.column(0), words_in):
                    identity.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sets.append(_packed(s))
                two = np.frombuffer(b"".join(identity), dtype="<i8").reshape(-1, 2)
                columns = [pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["set_hi", "set_lo", "s"])

    made = docs.select("text", place("key")).mapInArrow(run, "set_hi long, set_lo long, s binary")
    found = made.join(met.select("set_hi", "set_lo", F.col("rep").alias("id")), ["set_hi", "set_lo"])
    return found.dropDuplicates(["set_hi", "set_lo"]).select("id", "s")


def _confirm(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = _unpacked(s), _unpacked(t)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= threshold * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    s, t = sets.select(F.col("id").alias("a"), F.col("s")), sets.select(F.col("id").alias("b"), F.col("s").alias("t"))
    return pairs.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(_confirm(threshold), "u long, v long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words_in: int = 2,
    threshold: int = THRESHOLD,
    text_hash: bool = False,
) -> DataFrame:
    """Key, n_shingles, component_id (smallest linked key), kept and, if asked for, text_hash of every row."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("key"), body.alias("text"))
    hashed = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(body, F.lit(""))), body)
    s = materialize(signed(hashed, words_in), "signed")
    unique = s.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    # a set's number is fixed as the table is written
    reps = materialize(
        unique.select(F.monotonically_increasing_id().alias("rep"), "set_hi", "set_lo", "key", "bands"), "sets"
    )
    keyed = table_keys(reps, ["rep"]).select("k", "rep").repartition(int(parts), "k").sortWithinPartitions("k", "rep")
    pairs = materialize(keyed.mapInArrow(_pairs_in_order, _PAIR).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    met = materialize(reps.join(ids, "rep", "left_semi"), "met")
    sets = materialize(sets_table(rows, met, words_in), "shingles")
    groups = components(confirmed(pairs, sets, threshold))

    def labelled(nodes: DataFrame) -> DataFrame:
        named = groups.select(F.col("node").alias("rep"), "component")
        return nodes.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def joined(found: DataFrame) -> DataFrame:
        return components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found))

    rest = materialize(open_members(labelled(met.select("rep", "bands"))), "open")
    firsts = materialize(prefixes(rest, sets, threshold), "prefixes")
    tried = materialize(pairs_beside(labelled(firsts), threshold, int(parts)).join(pairs, ["a", "b"], "left_anti"), "tried")
    groups = joined(confirmed(tried, sets, threshold))
    across = prefix_pairs(labelled(firsts), threshold, int(parts)).join(pairs.union(tried), ["a", "b"], "left_anti")
    groups = joined(confirmed(across, sets, threshold))
    # a component is known by its smallest key; nodes alone keep their own
    nodes = groups.union(groups.select("component", "component").distinct()).withColumnsRenamed({"node": "rep"})
    least = nodes.join(reps.select("rep", "key"), "rep").groupBy("component").agg(F.min("key").alias("least"))
    named = nodes.join(materialize(least, "least"), "component").select("rep", "component", "least")
    final = reps.select("set_hi", "set_lo", "rep", "key").join(named, "rep", "left")
    # of a component without any id, the set with the component's number is kept
    first = F.col("rep") == F.coalesce("component", "rep")
    final = final.select("set_hi", "set_lo", F.coalesce("least", "key").alias("component"), first.alias("first"))
    out = s.select("key", "text_hash", "n_shingles", "set_hi", "set_lo").join(final, ["set_hi", "set_lo"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("component"))
    return out.select(
        F.col("key").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, component.isNull() & F.coalesce("first", F.lit(True)), F.lit(False)).alias("kept"),
        *(["text_hash"] if text_hash else []),
    )
