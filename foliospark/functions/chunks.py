"""Sections and bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.lexicon import MAX_CHARS
from foliospark.functions.text import let, normalize_whitespace, trim_ws

_NONE = "array<string>"


def _parts(text: Column) -> Column:
    """A text cut before its ``## `` lines, which begin behind \\n only; one without the mark isn't searched for them."""
    return F.when(F.contains(text, F.lit("## ")), F.split(text, r"(?md)(?=^## )", -1)).otherwise(F.array(text))


def outline(text: Column) -> Column:
    """All parts of a text cut at line breaks before ``## `` as (text, heading_path), whether they are blank or not.

    What stands before the first cut has no heading; headings are as they stand.  As in the SQL, which marks
    cuts by it, a \\x01 in a text is one.
    """

    def part(p: Column, i: Column) -> Column:
        body = F.when(i > 0, F.concat(F.lit("## "), p)).otherwise(p)
        return F.struct(normalize_whitespace(body).alias("text"), F.when(i > 0, F.split(p, "\n", 2)[0]).alias("heading_path"))

    return F.transform(F.split(F.replace(text, F.lit("\n## "), F.lit("\x01")), "\x01", -1), part)


def sections(text: Column) -> Column:
    """Sections at ``## `` lines as (text, heading_path, code_lang); the heading line stays in the text."""
    parts = _parts(text)

    def section(part: Column) -> Column:
        first = F.split(part, "\n", 2)[0]
        heading = F.when(part.startswith("## "), F.nullif(trim_ws(F.substring(first, F.lit(4), F.length(first))), F.lit("")))
        named = lambda body: F.nullif(F.lower(F.regexp_extract(body, r"(?i)```([a-z0-9_+-]+)\n", 1)), F.lit(""))
        lang = lambda body: F.when(F.contains(body, F.lit("```")), named(body))
        made = lambda body: F.struct(body.alias("text"), heading.alias("heading_path"), lang(body).alias("code_lang"))
        return let(normalize_whitespace(part), made)

    made = F.filter(F.transform(parts, section), lambda s: s["text"] != "")
    none = F.lit(None).cast("string")
    # only a text without visible characters has no section
    alone = F.array(F.struct(F.lit("").alias("text"), none.alias("heading_path"), none.alias("code_lang")))
    return F.when(text.isNotNull(), let(made, lambda all_: F.when(F.size(all_) > 0, all_).otherwise(alone)))


def pack_paragraphs(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Greedy packing of paragraphs up to ``max_chars``; longer paragraphs are sliced."""
    parts = F.when(F.contains(text, F.lit("\n\n")), F.split(text, r"\n\n+", -1)).otherwise(F.array(text))
    paragraphs = F.filter(F.transform(parts, trim_ws), lambda p: p != "")
    start = F.struct(F.array().cast(_NONE).alias("done"), F.lit("").alias("open"))

    def slices(p: Column) -> Column:
        count = F.ceil(F.length(p) / max_chars).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(p, i * max_chars + 1, F.lit(max_chars)))

    def step(acc: Column, p: Column) -> Column:
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        long = F.length(p) > max_chars
        over = F.length(joined) > max_chars
        return F.struct(
            F.when(long, F.concat(closed, slices(p))).when(over, closed).otherwise(acc["done"]).alias("done"),
            F.when(long, F.lit("")).when(over, p).otherwise(joined).alias("open"),
        )

    end = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    return F.aggregate(paragraphs, start, step, end)


def chunks(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Chunks (text, heading_path, code_lang) of all sections, in order."""

    def cut(s: Column) -> Column:
        texts = F.when(F.length(s["text"]) <= max_chars, F.array(s["text"])).otherwise(pack_paragraphs(s["text"], max_chars))
        return F.transform(texts, lambda t: F.struct(t.alias("text"), s["heading_path"].alias("heading_path"), s["code_lang"].alias("code_lang")))

    return F.flatten(F.transform(sections(text), cut))


def diff_sections(text: Column) -> Column:
    """Sections for change detection as (heading, body): heading lines excluded, empty bodies dropped."""
    parts = _parts(text)

    def section(part: Column) -> Column:
        headed = part.startswith("## ")
        first = F.split(part, "\n", 2)[0]
        title = trim_ws(F.substring(first, F.lit(4), F.length(first)))
        rest = F.when(headed, F.substring(part, F.length(first) + 2, F.length(part))).otherwise(part)
        heading = F.when(~headed, F.lit("Document")).when(title == "", F.lit("Untitled")).otherwise(title)
        return F.struct(heading.alias("heading"), trim_ws(rest).alias("body"))

    return F.filter(F.transform(parts, section), lambda s: s["body"] != "")
