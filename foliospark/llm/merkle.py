"""Merkle manifest of a dataset: leaves by row, trees by source, one root.

H is the lowercase hex sha256 of the concatenated inputs.  A row is a leaf: H
of its fields, each ``-`` if null and otherwise its number of UTF-8 bytes, a
colon and its value.  In each source leaves ascend by id; while there are
several nodes, each 16 consecutive ones become their H (the last run may be
shorter, even a single node).  The nodes that remain, ordered by source, give
the root in the same way.

Traversal.  Nodes are cut into aligned blocks of ``BLOCK`` (two levels).  A
block is walked recursively in postorder by one task: a subtree returns its
digest, and while the recursion unwinds, each subtree's siblings are appended
to the leaves under it.  The roots of aligned blocks are the nodes of another
distributed traversal, until a tree has one node.  Then the way back: the
siblings above a block meet its nodes, pass by pass, down to the rows.

Scale.  Text is hashed where it is read and never moves.  What moves is a digest
and a position: once to be sorted, once to meet the other nodes of its block, and
once to meet the block's path.  A task holds one block, whatever the size of a
source; positions come from counts by range partition, so no source is ranked in
one task.  There are log256 passes, each 256 times smaller than the one before.

Cases: null fields are ``-`` (a null id comes first in its source; a null source
is a tree of its own and comes first); rows with the same source and id are
ordered by their leaves, and those with equal leaves, which then are equal rows,
stand side by side; one row alone has its leaf as root and no siblings, whose H is
that of nothing; an empty table gives no rows; other columns are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize
from foliospark.session import ship

FAN = 16
#: Levels that one task walks, and the nodes of a block.
LEVELS = 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Siblings to the left and to the right of a node, level by level.
Path = list[tuple[str, str]]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """H over fields; strings and integers."""
    as_text = [f.cast("string") for f in fields]
    return F.sha2(
        F.concat(*(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in as_text)), 256
    )


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def height(n: int) -> int:
    """Levels until ``n`` nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def traverse(nodes: list[str], levels: int) -> tuple[str, list[Path]]:
    """Root of the subtree over ``nodes``, ``levels`` high, and the siblings of each node below it."""
    if levels == 0:
        return nodes[0], [[]]
    width = FAN ** (levels - 1)
    parts = [traverse(nodes[k : k + width], levels - 1) for k in range(0, len(nodes), width)]
    digests = [d for d, _ in parts]
    paths: list[Path] = []
    for k, (_, below) in enumerate(parts):
        siblings = ("".join(digests[:k]), "".join(digests[k + 1 :]))
        for path in below:
            path.append(siblings)
        paths += below
    return digest(*digests), paths


def fold(leaf: str, path: Path) -> str:
    """Root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def path_text(path: Path) -> str:
    return ";".join(f"{left},{right}" for left, right in path)


def path_of(text: str) -> Path:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


def joined(path: Path, above: str) -> str:
    """Text of a path and of what follows it; a bar stands before what is above the tree."""
    own = path_text(path)
    return own + (";" if own and above and above[0] != "|" else "") + above


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos, the place in its tree (from 0) in the order given, and n, the nodes of the tree.

    Rows are dealt by range and numbered inside their partition; counts by partition and tree, summed up,
    say where a partition's share of a tree starts.  Equal rows are told apart by where they were read, so that
    they too can lie in several ranges.
    """
    ordered = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("tie")
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    dealt = materialize(dealt, name)
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    upto = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("__tree"), F.col("part").alias("__part"), "first",
        F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("start"), F.sum("c").over(W.partitionBy("tree")).alias("n"),
    )
    both = dealt.join(starts, (F.col("tree") == F.col("__tree")) & (F.col("part") == F.col("__part")))
    return both.withColumn("pos", F.col("at") - F.col("first") + F.col("start")).drop("__tree", "__part", "part", "at", "first", "start")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of consecutive rows with the same (tree, block), whatever the batches."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        edge = (batch["tree"].ne(batch["tree"].shift()) | batch["block"].ne(batch["block"].shift())).to_numpy().nonzero()[0].tolist()
        for a, b in zip(edge, [*edge[1:], len(batch)], strict=True):
            piece = batch.iloc[a:b]
            if kept and (kept[0]["tree"].iat[0], kept[0]["block"].iat[0]) != (piece["tree"].iat[0], piece["block"].iat[0]):
                yield pd.concat(kept, ignore_index=True)
                kept = []
            kept.append(piece)
    if kept:
        yield pd.concat(kept, ignore_index=True)


def _by_block(nodes: DataFrame) -> DataFrame:
    """Nodes of a block side by side in one partition, in order of pos."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block(pos: str) -> Column:
    return F.floor(F.col(pos) / BLOCK).cast("long").alias("block")


def _levels(nodes: pd.DataFrame) -> int:
    return min(LEVELS, height(int(nodes["n"].iat[0])))


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roots of the blocks: nodes of the next pass."""
    for b in _blocks(batches):
        levels = _levels(b)
        root, _ = traverse(b["digest"].tolist(), levels)
        n = -(-int(b["n"].iat[0]) // FAN**levels)
        yield pd.DataFrame({"tree": b["tree"].iloc[:1], "pos": b["block"].iloc[:1], "n": n, "digest": root})


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A path from each node to the last root, behind the one of its block."""
    for b in _blocks(batches):
        above, nodes = b["path"].iat[0], b.iloc[1:]
        _, paths = traverse(nodes["digest"].tolist(), _levels(nodes))
        full = [joined(p, above) for p in paths]
        yield pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "digest": nodes["digest"], "extra": nodes["extra"], "path": full})


def _with_paths(nodes: DataFrame, paths: DataFrame, **extra: Column) -> DataFrame:
    """Nodes of a pass and, before each block (pos -1), the path of its root."""
    names = list(extra) or ["extra"]
    text = F.lit(None).cast("string")
    own = (extra.get(c, text).alias(c) for c in names)
    rows = nodes.select("tree", "pos", "n", "digest", _block("pos"), *own, text.alias("path"))
    head = (F.lit(v).cast("long").alias(c) for c, v in (("p", -1), ("n", 0)))
    heads = paths.select("tree", *head, text, F.col("pos").alias("block"), *(text for _ in names), "path")
    return _by_block(rows.union(heads))


class Forest:
    """Trees over ``nodes`` (tree, pos, n, digest); the roots are computed pass by pass and stored."""

    def __init__(self, nodes: DataFrame):
        self.passes = [nodes]
        while not self.passes[-1].where("n > 1").isEmpty():
            now = self.passes[-1].select("tree", "pos", "n", "digest", _block("pos"))
            above = _by_block(now).mapInPandas(_roots, "tree string, pos long, n long, digest string")
            self.passes.append(materialize(above, "blocks"))
        #: (tree, digest) of every tree's root
        self.roots = self.passes[-1].select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, pos, path) of the roots of the first pass' blocks; ``above`` (tree, path) is what follows a tree's root."""
        known = above.select("tree", F.lit(0).cast("long").alias("pos"), "path")
        for nodes in reversed(self.passes[1:-1]):
            known = _with_paths(nodes, known).mapInPandas(_paths, _PATHS)
            known = materialize(known.select("tree", "pos", "path"), "paths")
        return known


_PATHS = "tree string, pos long, digest string, extra string, path string"


def manifest(rows: DataFrame, leaf: Column, source: Column, key: Column, altered: Column | None = None, with_path: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``folded_root`` is what ``altered`` (where it is null, the leaf) gives with the stored siblings.
    ``with_path`` adds them as text: ``left,right`` level by level, joined by semicolons.
    """
    ship(rows.sparkSession)
    tree = F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))
    altered = F.lit(None).cast("string") if altered is None else altered
    leaves = rows.select(tree.alias("tree"), key.alias("key"), leaf.alias("digest"), altered.alias("altered"))
    kind = leaves.schema["key"].dataType
    # written before it is sorted: dealing by range samples its input, and text should be read once
    leaves = materialize(leaves, "digests")
    leaves = materialize(positions(leaves, ["key", "digest"], "leaves"), "leaves")
    forest = Forest(leaves)
    tops = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    tops = materialize(positions(tops, ["source"], "subroots"), "subroots")
    top = Forest(tops)
    # what follows a tree's root, behind bars: its siblings, the root of all, the tree's root
    root = top.roots.select("tree", F.concat(F.lit("|"), "digest").alias("path"))
    above = _with_paths(tops, top.paths(root), extra=F.col("source")).mapInPandas(_paths, _PATHS)
    above = above.select(F.col("extra").alias("tree"), F.concat(F.lit("|"), "path", F.lit("|"), "digest").alias("path"))
    final = _with_paths(leaves, forest.paths(materialize(above, "tops")), altered=F.col("altered"), key=F.col("key").cast("string"))
    out = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    proofs = final.mapInPandas(_proofs(with_path), out + ", path string" * with_path)
    return proofs.withColumn("key", F.col("key").cast(kind))


def _proofs(with_path: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches):
            inner, outer, root, subroot = b["path"].iat[0].split("|")
            above, nodes = path_of(inner) + path_of(outer), b.iloc[1:]
            _, paths = traverse(nodes["digest"].tolist(), _levels(nodes))
            out = {"key": nodes["key"].array, "leaf": nodes["digest"].array, "subroot": subroot, "root": root}
            paths = [p + above for p in paths]
            out["proof_sha256"] = [digest(*(x for pair in p for x in pair)) for p in paths]
            now = nodes["altered"].where(nodes["altered"].notna(), nodes["digest"])
            out["folded_root"] = [fold(leaf, p) for leaf, p in zip(now, paths, strict=True)]
            out["verified"] = [x == root for x in out["folded_root"]]
            if with_path:
                out["path"] = [path_text(p) for p in paths]
            yield pd.DataFrame(out)

    return run


def manifest_query(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``; where 5 divides the id's checksum, text is lower-cased before folding."""
    fields = [docs[c] for c in FIELDS]
    tampered = F.crc32(F.encode(docs["doc_id"].cast("string"), "utf-8")) % 5 == 0
    altered = F.when(tampered, leaf_digest(*fields[:-1], lowered(docs["text"])))
    return manifest(docs, leaf_digest(*fields), docs["source"], docs["doc_id"], altered).withColumnRenamed("key", "doc_id")


def sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """The query in DuckDB SQL, for sources of up to 16 ** source_levels rows."""
    bits = """bits(n, c, k) AS (
  SELECT n::UINTEGER, n::UINTEGER, 0 FROM range(256) r(n) UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS l FROM bits WHERE k = 8)"""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x} END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(field, FIELDS[:-1]))
    steps = [f"""d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, sha256({head} || {field("text")}) AS leaf,
         sha256({head} || {field("CASE WHEN text IS NOT NULL THEN " + lower + " END")}) AS low,
         list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::UINTEGER) AS bytes
  FROM documents
), c AS (
  SELECT rid, doc_id, source, leaf, CASE WHEN xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes),
         lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295::UINTEGER) % 5 = 0 THEN low ELSE leaf END AS now
  FROM d, tab
), x0 AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, now AS folded, '' AS proof FROM c
), n0 AS (SELECT source AS tree, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM x0)"""]

    def climb(n: str, x: str, levels: int, tree: str) -> tuple[str, str]:
        """Levels of a tree over n, and rows of x folded along."""
        for k in range(levels):
            steps.append(f"""{n}{k + 1}r AS (
  SELECT tree, pos // 16 AS pos, list(digest ORDER BY pos) AS run, any_value(n) AS n FROM {n}{k} GROUP BY tree, pos // 16
), {n}{k + 1} AS (
  SELECT tree, pos, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest, (n + 15) // 16 AS n FROM {n}{k + 1}r
), {x}{k + 1} AS (
  SELECT x.* REPLACE (x.pos // 16 AS pos,
           CASE WHEN r.n > 1 THEN sha256(array_to_string(run[:x.pos % 16], '') || folded || array_to_string(run[x.pos % 16 + 2:], '')) ELSE folded END AS folded,
           proof || array_to_string(run[:x.pos % 16], '') || array_to_string(run[x.pos % 16 + 2:], '') AS proof)
  FROM {x}{k} x JOIN {n}{k + 1}r r ON {tree} IS NOT DISTINCT FROM r.tree AND x.pos // 16 = r.pos
)""")
        return f"{n}{levels}", f"{x}{levels}"

    subs, rows = climb("n", "x", source_levels, "x.source")
    steps.append(f"""subs AS (
  SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM {subs}
), m0 AS (SELECT 0 AS tree, pos, subroot AS digest, n FROM subs
), y0 AS (SELECT x.* REPLACE (s.pos AS pos), subroot FROM {rows} x JOIN subs s ON x.source IS NOT DISTINCT FROM s.source)""")
    roots, rows = climb("m", "y", top_levels, "0")
    return "WITH RECURSIVE " + bits + ", " + ", ".join(steps) + f"""
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM {rows}, {roots} r
"""
