"""URL filters: prefix rules, and block lists as a cascade of Bloom filters.

Native: DataFrame functions only.

A cascade answers membership in a list without a join.  Level 0 holds the
listed keys, level 1 those keys of the corpus that level 0 takes for listed by
mistake, level 2 the listed keys that level 1 takes for mistakes, and so on
until a level makes no mistake.  A key is listed if the first level that lacks
it has an odd number, or if no level lacks it and their number is odd.  That
is exact for the keys the cascade was built over: the complete universe of
keys that the corpus has.

Keys.  A url has up to four: the last two and the last three labels of its
host, the host, and host with path (trailing slashes don't count).  So listed
domains of two or three labels hold for their subdomains, longer ones for the
host itself, and pages for themselves.

Scale.  Building shuffles the distinct keys once; levels then shrink by the
false-positive rate (about 1 in 30), so there are three to five for millions of
keys.  A bitmap is summed by words of 64 bits on the map side and reaches the
plan as a scalar subquery.  Its size is bounded: keys are dealt by hash into
parts of at most ``PART_BITS`` bits a level, and each part is tested in a pass
of its own.  Looking up neither shuffles nor joins.

Cases: a null url, or one without ``://``, has an empty host and path and no
keys, so that it is allowed; null keys and null listed keys are ignored; keys
listed twice count once; listed keys that the corpus lacks change nothing; an
empty list blocks nothing; a rule needs its path, so one with ``/`` doesn't fit
a url that ends with its host; repeated rows each keep their result; an empty
table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize

#: Bits and probes for a key of a level, bits of a level of one part (32 MB).
KEY_BITS = 10
PROBES = 4
PART_BITS = 1 << 28

#: Prefix rules of the query: host, path and verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Words in a label of a domain that put the domain on the query's list.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict, or nulls.

    Of equally long rules the one with the longer host wins, then ``allow``.  Rules are a parameter, tried one
    after another, so there should be at most some hundreds; long lists belong into a cascade.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "allow"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def page_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("/"), F.regexp_replace(path, "^/|/+$", ""))


def url_keys(host: Column, path: Column) -> list[Column]:
    """Keys under which a url may be listed; nulls where the host is empty."""
    some = lambda c: F.when(host != "", c)
    return [*(some(F.substring_index(host, ".", -k)) for k in (2, 3)), some(host), some(page_key(host, path))]


def _spot(key: Column, seed: int, words: int) -> tuple[Column, Column]:
    """The word of a key in a level, and its bits there: ``PROBES`` of 64, from six bits of a hash each."""
    at, deal = (F.xxhash64(F.lit(seed), F.lit(k), key) for k in (0, 1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(deal, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return F.pmod(at, F.lit(words)).cast("int"), reduce(Column.bitwiseOR, bits)


class Level:
    """One Bloom filter of 64-bit words; a key's bits all lie in one word, so a lookup reads one."""

    def __init__(self, keys: DataFrame, n: int, seed: int):
        self.words = max(1, -(-n * KEY_BITS // 64))
        self.seed = seed
        at, bits = _spot(F.col("key"), seed, self.words)
        spots = keys.select(at.cast("long").alias("at"), bits.alias("word"))
        every = keys.sparkSession.range(self.words).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
        words = spots.union(every).groupBy("at").agg(F.bit_or("word").alias("word"))
        # the bitmap of a part is one row: at most PART_BITS bits
        packed = words.agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
        stored = materialize(packed.select(F.transform("w", lambda x: x["word"]).alias("w")), "bloom")
        self.bitmap = stored.scalar()

    def has(self, key: Column) -> Column:
        at, bits = _spot(key, self.seed, self.words)
        return F.get(self.bitmap, at).bitwiseAND(bits) == bits


class Cascade:
    """Membership of listed keys over a universe of keys: ``marked`` has (key, listed), each key once."""

    def __init__(self, marked: DataFrame):
        self.levels: list[Level] = []
        ins, outs = marked.where("listed").select("key"), marked.where("not listed").select("key")
        n = ins.count()
        while n:
            level = Level(ins, n, len(self.levels))
            self.levels.append(level)
            # what this level must hold, and what it takes for that by mistake, which the next must hold
            mistakes = materialize(outs.where(level.has(F.col("key"))), "mistakes")
            ins, outs, n = mistakes, ins, mistakes.count()

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.has(key) & ~found
        return F.coalesce(found, F.lit(False))


def mark_keys(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) of each key in ``universe``; both sides are one column, combined before they are shuffled."""
    both = universe.toDF("key").select("key", F.lit(True).alias("seen"), F.lit(False).alias("listed"))
    both = both.union(listed.toDF("key").select("key", F.lit(False), F.lit(True))).where("key is not null")
    once = both.groupBy("key").agg(F.bool_or("seen").alias("seen"), F.bool_or("listed").alias("listed"))
    return once.where("seen").select("key", "listed")


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def with_listed(rows: DataFrame, keys: list[str], listed: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """``rows`` with ``listed``: whether any of the ``keys`` columns is in ``listed`` (one column).

    Parts: enough that neither the listed keys nor the expected mistakes among the others exceed ``part_bits``.
    """
    marked = materialize(mark_keys(rows.select(F.explode(F.array(*keys))), listed), "keys")
    n, n_listed = marked.agg(F.count(F.lit(1)), F.count_if("listed")).first()
    parts = -(-max(n_listed, n // 20) * KEY_BITS // part_bits) or 1
    out = rows.withColumn("listed", F.lit(False))
    for part in range(parts):
        mine = lambda k: _part(k, parts) == part if parts > 1 else F.lit(True)  # noqa: B023, E731
        cascade = Cascade(marked.where(mine(F.col("key"))))
        if cascade.levels:
            hit = reduce(lambda a, b: a | b, (F.coalesce(mine(F.col(k)), F.lit(False)) & cascade.has(F.col(k)) for k in keys))
            out = out.withColumn("listed", F.col("listed") | hit)
        if part + 1 < parts:
            out = materialize(out, "listed")
    return out


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, part_bits: int = PART_BITS) -> DataFrame:
    """page_id, host, path, rule, listed and verdict of every row; ``listed`` has one column of keys.

    A rule decides first, the list where none fits.
    """
    host, path = url_parts(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = [c.alias(f"key{k}") for k, c in enumerate(url_keys(F.col("host"), F.col("path")))]
    names = [f"key{k}" for k in range(len(keys))]
    rows = with_listed(rows.select("*", *keys), names, listed, part_bits)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, method).alias("verdict")
    )


def listed_keys(pages: DataFrame) -> DataFrame:
    """The query's list, from the table itself: domains with a listed word, and each sixteenth page by digest."""
    host, path = url_parts(pages["url"])
    parts = pages.select(host.alias("host"), path.alias("path")).where("host != ''")
    domain = F.substring_index("host", ".", -3)
    words = f"(^|[-.])({'|'.join(LISTED_WORDS)})([-.]|$)"
    page = page_key(F.col("host"), F.col("path"))
    return parts.select(domain.alias("key")).where(F.col("key").rlike(words)).union(
        parts.select(page.alias("key")).where(F.startswith(F.md5("key"), F.lit("0")))
    )


def filter_query(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, listed_keys(pages))


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
WITH rest AS (
  SELECT row_number() OVER () AS rid, page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages
), p AS (
  SELECT rid, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), u AS (
  SELECT rid, page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p
), k AS (
  SELECT *, string_split(host, '.') AS labels, host || '/' || regexp_replace(path, '^/|/+$', '', 'g') AS page FROM u
), s AS (
  SELECT *, array_to_string(labels[-2:], '.') AS two, array_to_string(labels[-3:], '.') AS three FROM k
), listed AS (
  SELECT three AS key FROM s WHERE host <> '' AND regexp_matches(three, '(^|[-.])({'|'.join(LISTED_WORDS)})([-.]|$)')
  UNION SELECT page FROM s WHERE host <> '' AND md5(page)[1] = '0'
), rules(h, p, v) AS (VALUES {_RULES}), fits AS (
  SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC) AS k
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), judged AS (
  SELECT s.*, fits.rule, fits.v, host <> '' AND (two IN (FROM listed) OR three IN (FROM listed) OR host IN (FROM listed)
         OR page IN (FROM listed)) AS listed
  FROM s LEFT JOIN fits ON s.rid = fits.rid AND fits.k = 1
)
SELECT page_id, host, path, rule, listed, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
