"""Quality rules: counts for each document and cross-document line frequency.

Native: DataFrame functions only.  Words are runs outside ``20 09-0D``.

Counts.  Repeated three-word windows are found inside the row: windows and
their positions are zipped into structs and sorted, so equal windows stand
together; no row is exploded and nothing is shuffled.

Line frequency.  Lines are normalised (lower case, blanks collapsed, trimmed)
and hashed; for each host (``source``) the distinct documents that hold a line
are counted.  The limit of a host is ``MAX_LINE_SHARE`` of its documents, but
``MIN_LINE_DOCS`` at least, so it means the same at every size.  Lines above it
are removed from all documents of the host.  A document that lost lines is
depleted, and rejected, if fewer than ``min_words`` words remain or less than
``min_share`` of its words.

Two parameters, off by default, soften the rule: ``copies_once`` counts exact
copies of a text as one document (for use before deduplication, where a clean
document's copies would make its own lines frequent), and ``keep_first`` leaves
a line in the document with the smallest id.

Scale.  A first pass counts a line's rows, combined on the map side, and drops
what can't be above a limit; what is left, a few lines, is counted by distinct
documents.  So narrow rows are shuffled once for each line of text, and
documents only meet the lines they lose.  Hot hosts and lines are join keys
between stored tables, which adaptive execution may split, or broadcast where a
side was measured as small.

Cases: a null text is empty: no words, base_failed; a null host is a host of
its own; repeated rows are one document and each keep the same result; rows
without id are told apart by their text; an empty table gives no rows; other
columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_LINE_DOCS = 5
MAX_LINE_SHARE = 0.05
MIN_SHARE = 0.5
MIN_WORDS = 50


def words(text: Column) -> Column:
    """Words of a text; none for a null or blank one."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", none).otherwise(F.split(trimmed, BLANK_RUN, -1))


def n_repeat_words(sorted_windows: Column, size: int = 3) -> Column:
    """Words under windows that occur twice or more, from sorted (word, word, word, position) structs."""
    rest = F.slice(sorted_windows, 2, F.greatest(F.size(sorted_windows), F.lit(1)))
    none = F.array().cast("array<int>")

    def both(a: Column, b: Column) -> Column:
        same = (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])
        return F.when(same, F.array(a["at"], b["at"])).otherwise(none)

    repeated = F.flatten(F.zip_with(sorted_windows, rest, both))
    covered = F.transform(repeated, lambda p: F.array(*(p + k for k in range(size))))
    return F.size(F.array_distinct(F.flatten(covered)))


def base_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(docs["text"], F.lit(""))
    split = docs.select(*keep, text.alias("text")).withColumn("words", words(F.col("text")))
    n = F.size("words")
    after = lambda k: F.slice("words", k + 1, F.greatest(n, F.lit(1)))
    zipped = F.arrays_zip(
        F.col("words").alias("w0"),
        after(1).alias("w1"),
        after(2).alias("w2"),
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("at"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = split.select(
        *keep,
        n.cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.sort_array(F.slice(zipped, 1, F.greatest(n - 2, F.lit(0)))).alias("windows"),
    )
    counted = staged.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("windows") < 2, F.lit(0))
        .otherwise(n_repeat_words(F.col("windows")))
        .cast("long")
        .alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def line_hash(line: Column) -> Column:
    """Hash of a normalised line; null if it is blank."""
    plain = F.btrim(F.regexp_replace(F.lower(line), BLANK_RUN, " "))
    return F.when(plain != "", F.xxhash64(plain))


def line_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, place, hash and number of words of each non-blank line."""
    rows = docs.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    rows = rows.select(*keep, "place", F.btrim(F.regexp_replace(F.lower("line"), BLANK_RUN, " ")).alias("line"))
    words = (F.regexp_count("line", F.lit(" ")) + 1).cast("long")
    return rows.where("line != ''").select(*keep, "place", F.xxhash64("line").alias("line_hash"), words.alias("words"))


def marked(docs: DataFrame) -> DataFrame:
    """id, text hash, host and text of every row; ``doc`` tells documents apart."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text_hash.alias("text_hash"), F.col("source").alias("host"), "text")
    return rows.withColumn("doc", F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("t")))


def _same(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def _renamed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in columns})


def removed_lines(
    docs: DataFrame,
    min_line_docs: int = MIN_LINE_DOCS,
    max_line_share: float = MAX_LINE_SHARE,
    copies_once: bool = False,
    keep_first: bool = False,
) -> DataFrame:
    """What documents lose: doc_id, text_hash, host, n_lines, n_words and the set of line hashes (removed)."""
    rows = marked(docs)
    who = F.col("text_hash") if copies_once else F.col("doc")
    hosts = rows.groupBy("host").agg(F.count_distinct(who).alias("n"))
    hosts = hosts.select("host", F.greatest(F.lit(min_line_docs), F.col("n") * max_line_share).alias("limit"))
    often = line_rows(rows, ["host"]).groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n"))
    often = materialize(often.where(F.col("n") > min_line_docs), "often")
    hosts = _renamed(materialize(hosts, "hosts"), ("host",))
    often = often.join(hosts, _same(often, hosts, ("host",))).where("n > limit").select("host", "line_hash", "limit")
    often = _renamed(materialize(often, "candidates"), ("host", "line_hash"))
    lines = line_rows(rows, ["doc_id", "text_hash", "host", "doc"])
    hits = lines.join(often, _same(lines, often, ("host", "line_hash")))
    hits = hits.select("doc_id", "text_hash", "host", "doc", "place", "line_hash", "words", "limit").distinct()
    hits = materialize(hits, "hits")
    hot = hits.groupBy("host", "line_hash").agg(
        F.count_distinct(who).alias("n"), F.min("doc_id").alias("first"), F.first("limit").alias("limit")
    )
    hot = hot.where("n > limit").select("host", "line_hash", "first")
    hot = _renamed(materialize(hot, "lines"), ("host", "line_hash"))
    gone = hits.join(hot, _same(hits, hot, ("host", "line_hash")))
    if keep_first:
        gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "text_hash", "host").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("words").alias("n_words"), F.collect_set("line_hash").alias("removed")
    )


def _with_removed(rows: DataFrame, docs: DataFrame, **rule) -> DataFrame:
    """``rows`` (doc_id, text_hash, host, ...) with n_removed_lines, n_removed_words and removed.

    Documents that lose lines grow with the corpus, so they are merged, never broadcast.
    """
    lost = materialize(removed_lines(docs.select("doc_id", "text", "source"), **rule), "lost")
    key = ("doc_id", "text_hash", "host")
    lost = _renamed(lost, (*key, "n_lines", "n_words")).hint("merge")
    lines, words = (F.coalesce(f"__n_{x}", F.lit(0)).cast("long") for x in ("lines", "words"))
    both = rows.join(lost, _same(rows, lost, key), "left").drop(*(f"__{c}" for c in key))
    return both.withColumns({"n_removed_lines": lines, "n_removed_words": words}).drop("__n_lines", "__n_words")


def _kept(min_share: float, min_words: int) -> Column:
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < min_words) | (left < F.lit(min_share) * F.col("n_words"))
    return ~F.col("base_failed") & ~((F.col("n_removed_words") > 0) & depleted)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def quality_columns(docs: DataFrame, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS, **rule) -> DataFrame:
    """Counts and verdict for every row of ``docs``; ``rule`` goes to :func:`removed_lines`.  Text isn't shuffled."""
    rows = docs.select("doc_id", "text", F.col("source").alias("host"), _text_hash())
    counted = _with_removed(base_features(rows, ["doc_id", "text_hash", "host"]), docs, **rule)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        _kept(min_share, min_words).alias("kept"), "n_removed_lines", "n_removed_words",
    )


def quality_query(docs: DataFrame) -> DataFrame:
    return quality_columns(docs)


def clean_documents(docs: DataFrame, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS, **rule) -> DataFrame:
    """Documents that pass, with their columns and without the lines above the limit.

    Text is shuffled once, to meet its removed lines: a set of line hashes, no longer than the document.
    """
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(
        *(F.col(c).alias(o) for c, o in own.items()), "doc_id", "text", F.col("source").alias("host"), _text_hash()
    )
    rows = _with_removed(rows, docs, **rule)
    rows = base_features(rows, ["n_removed_words", "removed", *own.values()])
    # a row number that isn't deterministic keeps the filter from moving below the counts, which would be computed for each condition
    rows = rows.withColumns({"__kept": _kept(min_share, min_words), "__row": F.monotonically_increasing_id()})
    rows = rows.where("__kept and __row >= 0")
    text = F.col(own["text"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.coalesce(F.array_contains("removed", line_hash(x)), F.lit(False)))
    cut = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(lines, "\n"))
    return rows.select(*(cut.alias(c) if c == "text" else F.col(o).alias(c) for c, o in own.items()))


_SEPARATED = "regexp_split_to_array(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\\x20\\x09-\\x0D]+')"

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text,
         list_filter({_SEPARATED}, lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), tri AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS pos, words FROM w WHERE len(words) >= 3
), twice AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, words[pos], words[pos + 1], words[pos + 2]) AS c FROM tri
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM twice WHERE c > 1) GROUP BY rid
), l AS (
  SELECT rid, doc_id, source, text,
         trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM d
), size AS (
  SELECT source, count(DISTINCT coalesce(doc_id::VARCHAR, 'text ' || text)) AS n FROM d GROUP BY source
), hot AS (
  SELECT l.source, line FROM l JOIN size ON l.source IS NOT DISTINCT FROM size.source WHERE line <> ''
  GROUP BY l.source, line
  HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'text ' || text)) > greatest({MIN_LINE_DOCS}, any_value(size.n) * {MAX_LINE_SHARE}::DOUBLE)
), lost AS (
  SELECT l.rid, count(*) AS n_lines, sum(len(string_split(l.line, ' '))) AS n_gone
  FROM l JOIN hot ON l.source IS NOT DISTINCT FROM hot.source AND l.line = hot.line GROUP BY l.rid
), f AS (
  SELECT w.rid, doc_id, len(words) AS n_words,
         length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS blanks, text,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(lost.n_lines, 0) AS n_lines, coalesce(lost.n_gone, 0) AS n_gone
  FROM w LEFT JOIN covered ON w.rid = covered.rid LEFT JOIN lost ON w.rid = lost.rid
)
SELECT doc_id, n_words::BIGINT AS n_words, (length(text) - blanks)::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (n_gone > 0 AND (n_words - n_gone < {MIN_WORDS} OR n_words - n_gone < {MIN_SHARE} * n_words)) AS kept,
       n_lines::BIGINT AS n_removed_lines, n_gone::BIGINT AS n_removed_words
FROM f
"""
