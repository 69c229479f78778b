"""Column functions from raw HTML to clean text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.lexicon import BLOCK_TAGS, INJECTION, INJECTION_WORDS, STOPWORDS

#: White space of the web platform; the same class in Java's and RE2's syntax.
WS = r"[\t\n\x0B\f\r \x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters as they are.
SPACES = "\t\n\x0b\f\r \u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: ASCII word limits; Java's \b also counts letters of other scripts.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: Page furniture that every crawl policy removes.
NOISE = tuple(rf"(?is)<{t}\b.*?</{t}>" for t in ("nav", "aside", "footer"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for a row, however often ``then`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), then), 0)


def sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def decode_entities(text: Column) -> Column:
    """Six entities, one after another, so doubly encoded ones are decoded twice."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def sub_where(text: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """``sub`` of a text with one of the marks, which every match holds; others are not searched by the pattern."""

    def rewritten(t: Column) -> Column:
        some = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            some = some | F.contains(t, F.lit(m))
        return F.when(some, sub(t, pattern, by)).otherwise(t)

    return let(text, rewritten)


def normalize_whitespace(text: Column) -> Column:
    text = F.replace(text, F.lit("\r"), F.lit(""))
    text = sub_where(text, (" \n", "\t\n"), r"[ \t]+\n", "\n")
    text = sub_where(text, ("\n\n\n",), r"\n{3,}", "\n\n")
    return trim_ws(sub_where(text, ("  ", " \t", "\t ", "\t\t"), r"[ \t]{2,}", " "))


def strip_tags(text: Column) -> Column:
    return sub(text, "<[^>]+>", " ")


def _inner(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def main_html(html: Column) -> Column:
    """The inside of main, else article, else body, else everything; empty mains and articles count as missing."""
    body = F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), _inner(html, "body")).otherwise(html)
    return F.coalesce(F.nullif(_inner(html, "main"), F.lit("")), F.nullif(_inner(html, "article"), F.lit("")), body)


def page_title(html: Column, url: Column) -> Column:
    """Decoded title without what follows a pipe on its line; the URL if there is none."""
    raw = _inner(html, "title")
    cut = sub(decode_entities(raw), rf"{WS}*\|[^\n\r\x{{2028}}\x{{2029}}]*(?=[\n\r\x{{2028}}\x{{2029}}]|\z)", "")
    return F.when(raw == "", url).otherwise(normalize_whitespace(cut))


def _per_match(text: Column, pattern: str, one) -> Column:
    """Rewrites each match: pieces between marks are transformed where they stand inside a pair."""
    marked = sub(text, pattern, "\x01$0\x02")
    pieces = F.split(marked, "\x01", -1)

    def rewrite(piece: Column) -> Column:
        end = F.instr(piece, "\x02")
        inside = F.substring(piece, F.lit(1), end - 1)
        return F.when(end == 0, piece).otherwise(F.concat(one(inside), F.substring(piece, end + 1, F.length(piece))))

    return F.array_join(F.transform(pieces, rewrite), "")


_PRE = r"(?is)<pre[^>]*>\s*<code([^>]*)>(.*?)</code>\s*</pre>"
_HEADING = r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"


def _fence(match: Column) -> Column:
    attributes = F.regexp_extract(match, _PRE, 1)
    lang = F.lower(F.regexp_extract(attributes, r"(?i)class=[\"'][^\"']*language-([a-z0-9_+-]+)[^\"']*[\"']", 1))
    code = sub(decode_entities(F.regexp_extract(match, _PRE, 2)), r"(?i)<br\s*/?\s*>", "\n")
    code = trim_ws(F.replace(sub(code, "<[^>]+>", ""), F.lit("\r"), F.lit("")))
    return F.concat(F.lit("\n\n```"), lang, F.lit("\n"), code, F.lit("\n```\n\n"))


def _heading(match: Column) -> Column:
    text = normalize_whitespace(decode_entities(strip_tags(F.regexp_extract(match, _HEADING, 2))))
    return F.when(text == "", F.lit("\n")).otherwise(F.concat(F.lit("\n\n## "), text, F.lit("\n\n")))


def html_to_text(html: Column) -> Column:
    """Text of a page: fenced code, ``## `` heading lines, a line for each block."""
    html = sub(html, "[\x01\x02]", "")
    for tag in ("script", "style", "noscript"):
        html = sub(html, rf"(?is)<{tag}.*?</{tag}>", "")
    html = _per_match(html, _PRE, _fence)
    html = _per_match(html, _HEADING, _heading)
    html = sub(html, rf"(?i)</({'|'.join(BLOCK_TAGS)})>", "</$1>\n")
    html = sub(html, r"(?i)<br\s*/?\s*>", "\n")
    return normalize_whitespace(decode_entities(strip_tags(html)))


def strip_html_noise(html: Column, patterns: tuple[str, ...] = NOISE) -> Column:
    for p in patterns:
        html = sub(html, p, " ")
    return html


def strip_noise_lines(text: Column, patterns: tuple[str, ...]) -> Column:
    """Drops lines that match a pattern, and blank ones; no patterns, no change."""
    if not patterns:
        return text

    def stays(line: Column) -> Column:
        trimmed = trim_ws(line)
        keep = trimmed != ""
        for p in patterns:
            keep = keep & ~trimmed.rlike(p)
        return keep

    return normalize_whitespace(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))


def injection_pattern(name: str) -> str:
    """The family's pattern with ASCII word limits, which Java's \\b doesn't have."""
    parts = INJECTION[name].split(r"\b")
    out = parts[0]
    for k, part in enumerate(parts[1:]):
        out += (LEFT if k % 2 == 0 else RIGHT) + part  # limits come in pairs around a group
    return f"(?i){out}"


def injection_signals(text: Column) -> Column:
    """Ids of the injection families found in a text; patterns run only where a word they begin with occurs."""

    def found(low: Column) -> Column:
        hits = []
        for name in INJECTION:
            some = F.lit(False)
            for w in INJECTION_WORDS[name]:
                some = some | F.contains(low, F.lit(w))
            hits.append(F.when(some & text.rlike(injection_pattern(name)), F.lit(name)))
        return F.array_compact(F.array(*hits))

    return let(F.lower(text), found)


def sanitize_lines(text: Column) -> Column:
    """Struct of the text without short lines that carry signals, their number and their signals."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), injection_signals(x).alias("found")))
    bad = lambda s: (F.size(s["found"]) > 0) & (F.length(trim_ws(s["line"])) <= 300)

    def split(all_: Column) -> Column:
        kept = F.transform(F.filter(all_, lambda s: ~bad(s)), lambda s: s["line"])
        gone = F.filter(all_, bad)
        return F.struct(
            normalize_whitespace(F.array_join(kept, "\n")).alias("text"),
            F.size(gone).cast("long").alias("removed_lines"),
            F.array_distinct(F.flatten(F.transform(gone, lambda s: s["found"]))).alias("findings"),
        )

    return let(lines, split)


#: White space other than a blank and a line feed.
_RARE = WS.replace(r"\n", "").replace(" ", "")
#: A wider class that is looked for in less time.
_MAYBE_RARE = r"[\t\x0B\f\r\x{A0}\x{1680}-\x{FEFF}]"


def word_count(text: Column) -> Column:
    """Words between white space; only a text with other than single blanks and line feeds is split by the pattern."""

    def counted(t: Column) -> Column:
        def gaps(x: Column) -> Column:
            split = F.size(F.filter(F.split(x, rf"{WS}+", -1), lambda w: w != ""))
            single = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
            return F.when((x == "") | F.contains(x, F.lit("  ")) | (x.rlike(_MAYBE_RARE) & x.rlike(_RARE)), split).otherwise(single)

        return let(F.replace(t, F.lit("\n"), F.lit(" ")), gaps)

    return let(trim_ws(text), counted)


def token_count(text: Column) -> Column:
    return F.greatest(word_count(text), F.ceil(F.length(text) / 4)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def diff_form(text: Column) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.btrim(sub(F.translate(F.lower(text), SPACES, " " * len(SPACES)), " {2,}", " "))


# Query terms --------------------------------------------------------------------------------------


def tokens(text: Column, split: str = r"[^a-z0-9_]+") -> Column:
    """Lower-cased terms of two characters and more that are no stopwords, in order."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(F.lower(text), split, -1), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def synonyms(terms: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Terms and their synonyms, distinct, first seen first."""
    none = F.array().cast("array<string>")
    more = [F.when(F.array_contains(terms, w), F.array(*map(F.lit, others))).otherwise(none) for w, others in table.items()]
    return F.array_distinct(F.concat(terms, *more))


def bigrams(terms: Column) -> Column:
    """Distinct pairs of neighbouring terms."""
    rest = F.slice(terms, 2, F.greatest(F.size(terms) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(terms, 1, F.greatest(F.size(terms) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def share_found(haystack: Column, needles: Column) -> Column:
    """Share of needles that occur in the text; 0 without needles."""
    hits = F.size(F.filter(needles, lambda n: F.contains(haystack, n)))
    return F.when(F.size(needles) == 0, F.lit(0.0)).otherwise(hits / F.greatest(F.size(needles), F.lit(1)))
