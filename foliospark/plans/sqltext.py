"""DuckDB counterparts of the text functions, as SQL fragments."""

from __future__ import annotations

from foliospark.functions.lexicon import BLOCK_TAGS, STOPWORDS
from foliospark.functions.text import WS


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by if by.startswith('chr') else q(by)}, 'g')"


def trim_ws(x: str) -> str:
    return sub(sub(x, rf"^{WS}+", ""), rf"{WS}+$", "")


def normalize(x: str) -> str:
    x = f"replace({x}, chr(13), '')"
    x = sub(x, r"[ \t]+\n", "chr(10)")
    x = sub(x, r"\n{3,}", "chr(10) || chr(10)")
    return trim_ws(sub(x, r"[ \t]{2,}", " "))


def decode(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = f"replace({x}, {q(name)}, {q(char)})"
    return x


def inner(x: str, tag: str) -> str:
    return f"regexp_extract({x}, {q(rf'(?is)<{tag}[^>]*>(.*?)</{tag}>')}, 1)"


def main_html(x: str) -> str:
    body = f"CASE WHEN regexp_matches({x}, '(?is)<body[^>]*>.*?</body>') THEN {inner(x, 'body')} ELSE {x} END"
    return f"coalesce(nullif({inner(x, 'main')}, ''), nullif({inner(x, 'article')}, ''), {body})"


def denoise(x: str) -> str:
    for t in ("nav", "aside", "footer"):
        x = sub(x, rf"(?is)<{t}\b.*?</{t}>", " ")
    return x


def page_text(x: str) -> str:
    """Text of a page without fenced code, which the testdata doesn't have."""
    for t in ("script", "style", "noscript"):
        x = sub(x, rf"(?is)<{t}.*?</{t}>", "")
    # headings: tags inside become blanks, the rest is kept; each level on its own as RE2 has no back-references
    for k in (1, 2, 3):
        x = sub(x, rf"(?is)<h{k}[^>]*>\s*(.*?)\s*</h{k}>", "chr(10) || chr(10) || '## \\1' || chr(10) || chr(10)")
    tags = "|".join(BLOCK_TAGS)
    x = f"regexp_replace({x}, {q(f'(?i)</({tags})>')}, '</\\1>' || chr(10), 'g')"
    x = sub(x, r"(?i)<br\s*/?\s*>", "chr(10)")
    return normalize(decode(sub(x, "<[^>]+>", " ")))


def encoded(x: str, pattern: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {q(pattern)}) THEN array_to_string(list_transform(string_split({x}, ''), "
        f"lambda c: CASE WHEN regexp_matches(c, {q(pattern)}) THEN url_encode(c) ELSE c END), '') ELSE {x} END"
    )


def canonical(x: str) -> str:
    url = q(r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$")
    part = lambda k: f"regexp_extract({x}, {url}, {k})"
    host = f"regexp_replace(lower({part(2)}), CASE lower({part(1)}) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')"
    raw = f"CASE WHEN {part(3)} = '' THEN '/' WHEN length({part(3)}) > 1 AND ends_with({part(3)}, '/') THEN left({part(3)}, -1) ELSE {part(3)} END"
    path = encoded(f"({raw})", r'[^!-~]|["<>^`{}]')
    pairs = (
        f"list_filter(string_split(substr({part(4)}, 2), '&'), lambda p: p <> '' AND NOT "
        f"regexp_full_match(p, '(?:utm_[^=&]*|ref|source)(?:=[^&]*)?'))"
    )
    query = encoded(f"array_to_string({pairs}, '&')", r"""[^!-~]|["<>']""")
    return (
        f"CASE WHEN regexp_matches({x}, {url}) THEN lower({part(1)}) || '://' || {host} || {path} || "
        f"CASE WHEN coalesce({query}, '') = '' THEN '' ELSE '?' || {query} END END"
    )


#: Written by hand, so that a wrong constant of the engine shows.
_FAMILIES = {
    "override_instructions": r"(?i)\b(ignore|disregard|override|bypass)\b.{0,50}\b(instruction|system|developer|prompt|policy|guardrail|previous)\b",
    "reveal_sensitive": r"(?i)\b(reveal|exfiltrate|leak|print|expose)\b.{0,50}\b(secret|token|api key|credential|system prompt|hidden prompt)\b",
    "do_not_follow_policy": r"(?i)\b(do not|don't)\b.{0,40}\b(follow|obey)\b.{0,40}\b(instruction|policy|guardrail|system|developer)\b",
    "tool_abuse": r"(?i)\b(call|run|execute)\b.{0,30}\b(tool|function)\b.{0,60}\b(delete|transfer|override|bypass)\b",
    "prompt_tag_payload": r"(?i)<\s*(system|assistant|developer)\s*>|BEGIN\s+(SYSTEM|PROMPT)",
}


def signals(x: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({x}, {q(p)}) THEN {q(name)} END" for name, p in _FAMILIES.items())
    return f"list_filter([{parts}], lambda s: s IS NOT NULL)"


def tokens(x: str, split: str = "[^a-z0-9_]+") -> str:
    stop = ", ".join(q(w) for w in STOPWORDS)
    return f"list_filter(regexp_split_to_array(lower({x}), {q(split)}), lambda t: length(t) >= 2 AND t NOT IN ({stop}))"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def synonyms(terms: str, table: dict[str, tuple[str, ...]]) -> str:
    """Terms and their synonyms, sorted, distinct."""
    more = " || ".join(
        f"CASE WHEN list_contains({terms}, {q(w)}) THEN [{', '.join(map(q, others))}] ELSE []::VARCHAR[] END"
        for w, others in table.items()
    )
    return f"list_sort(list_distinct({terms} || {more}))"


def bigrams(terms: str) -> str:
    return f"list_sort(list_distinct(list_transform(range(1, len({terms})), lambda i: {terms}[i] || ' ' || {terms}[i + 1])))"


def diff_form(x: str) -> str:
    return trim_ws(sub(f"lower({x})", rf"{WS}+", " "))


def _shape(x: str) -> str:
    """Consonants as 0 and vowels as 1; y after a consonant is a vowel."""
    marked = f"regexp_replace(regexp_replace(regexp_replace({x}, '([^aeiouy])y', '\\1Y', 'g'), '^yy', 'yY'), '([aeiouY]y)y', '\\1Y', 'g')"
    return f"regexp_replace(regexp_replace({marked}, '[^aeiouY]', '0', 'g'), '[aeiouY]', '1', 'g')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, '1+0+'))"


def _short(x: str) -> str:
    return f"(regexp_matches({_shape(x)}, '010$') AND NOT regexp_matches({x}, '[wxy]$'))"


def stems(words: str) -> str:
    """Tables ``stem0`` to ``stem`` (w, s): the Porter stem of each distinct w in the table ``words``."""
    from foliospark.operators.rank import _STEP2, _STEP3, _STEP4

    cut = lambda k: f"s[:-{k + 1}]"
    ends = lambda e: f"ends_with(s, '{e}')"

    def table(rows) -> str:
        cases = (f"WHEN {ends(e)} THEN CASE WHEN {_measure(cut(len(e)))} > 0 THEN {cut(len(e))} || '{by}' ELSE s END" for e, by in sorted(rows, key=lambda r: -len(r[0])))
        return f"CASE {' '.join(cases)} ELSE s END"

    after = f" AND regexp_matches({cut(3)}, '[st]$')"
    last = " ".join(
        f"WHEN {ends(e)} THEN CASE WHEN {_measure(cut(len(e)))} > 1{after if e == 'ion' else ''} THEN {cut(len(e))} ELSE s END"
        for e in sorted(_STEP4, key=len, reverse=True)
    )
    vowel = lambda x: f"contains({_shape(x)}, '1')"
    base = f"CASE WHEN {ends('ed')} AND {vowel(cut(2))} THEN {cut(2)} WHEN {ends('ing')} AND {vowel(cut(3))} THEN {cut(3)} END"
    steps = (
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut(1)} ELSE s END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {_measure(cut(3))} > 0 THEN {cut(1)} ELSE s END WHEN ({base}) IS NOT NULL THEN '<' || ({base}) ELSE s END",
        f"""CASE WHEN s[1] <> '<' THEN s WHEN regexp_matches(s, '(at|bl|iz)$') THEN s[2:] || 'e'
  WHEN length(s) > 2 AND s[-1] = s[-2] AND {_shape('s[2:]')}[-1] = '0' AND NOT regexp_matches(s, '[lsz]$') THEN s[2:-2]
  WHEN {_measure('s[2:]')} = 1 AND {_short('s[2:]')} THEN s[2:] || 'e' ELSE s[2:] END""",
        f"CASE WHEN {ends('y')} AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE s END",
        table(_STEP2),
        table(_STEP3),
        f"CASE {last} ELSE s END",
        f"CASE WHEN {ends('e')} AND ({_measure(cut(1))} > 1 OR ({_measure(cut(1))} = 1 AND NOT {_short(cut(1))})) THEN {cut(1)} ELSE s END",
        f"CASE WHEN {ends('ll')} AND {_measure('s')} > 1 THEN {cut(1)} ELSE s END",
    )
    out = [f"stem0 AS (SELECT w, w AS s, regexp_matches(w, '^[a-z]{{3,}}$') AS ok FROM (SELECT DISTINCT w FROM {words}))"]
    for k, step in enumerate(steps):
        out.append(f"stem{k + 1} AS (SELECT w, ok, CASE WHEN ok THEN {step} ELSE s END AS s FROM stem{k})")
    return ", ".join(out) + f", stem AS (SELECT w, s FROM stem{len(steps)})"
