"""Personal data: patterns propose, validators confirm, context adjusts.

Each kind has a proposing pattern, an optional validator (Luhn for cards,
mod-97 for IBANs, octet range for addresses, digit count for phones, area and
group rules for social security numbers) and a base score.  Whole words within
``CONTEXT`` characters move the score; a span is reported when its score
reaches ``threshold``.  The base kinds (email, ip, card, phone) score above it
once validated, so context raises them but never drops them; the added kinds
(iban, ssn, passport) depend on their validator and on context.

Every pattern runs in linear time on any text: runs are matched possessively
and never rescanned, and an e-mail's local part is found backwards from its @.

Cases: a null text is empty and has no spans; spans count code points, end
exclusive; matches of one kind never overlap, those of two kinds may; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship

CONTEXT = 48
THRESHOLD = 0.6

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{7,8}(?![A-Za-z0-9])")
_DIGITS = re.compile(r"[^0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

_NEAR = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "tax"),
    "passport": ("passport", "passeport", "pasaporte", "reisepass"),
}
#: Words that speak against the added kinds.
_AGAINST = ("version", "example", "invoice", "order", "isbn", "part no")
_BASE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.7, "ssn": 0.5, "passport": 0.3}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "passport")
BASE_KINDS = KINDS[:4]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += _DOUBLED[int(d)] if i % 2 else int(d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; the local part is the run before an @, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        found = m[0]
        while found:  # a word after the number may have been taken in: shorten at blanks until the check holds
            plain = found.replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield m.start(), m.start() + len(found)
                break
            found = found[: max(found.rfind(" "), 0)]


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _passports(text: str) -> Iterator[tuple[int, int]]:
    for m in _PASSPORT.finditer(text):
        yield m.span()


_FIND = {
    "email": emails, "ip": _ips, "card": _cards, "phone": _phones,
    "iban": _ibans, "ssn": _ssns, "passport": _passports,
}
#: a kind is looked for only where its pattern can match at all
_HAS_DIGIT = re.compile(r"[0-9]")


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    inner = "|".join(map(re.escape, words))
    return re.compile(rf"(?<![^\W_])(?:{inner})(?![^\W_])", re.I)


_NEAR_WORDS = {k: _any_word(w) for k, w in _NEAR.items()}
_AGAINST_WORDS = _any_word(_AGAINST)


def near(words: re.Pattern, text: str, start: int, end: int) -> bool:
    """Whether a whole word stands within ``CONTEXT`` characters before or after a span."""
    if words.search(text, max(0, start - CONTEXT), start):  # a look-behind sees what is before the window
        return True
    after = words.search(text, end, end + CONTEXT + 1)  # one more character, so that a word cut off doesn't count
    return after is not None and (after.end() <= end + CONTEXT or after.end() == len(text))


def score(kind: str, text: str, start: int, end: int) -> float:
    """Base score of a confirmed span, moved by words near it, within 0 and 1."""
    value = _BASE[kind]
    if near(_NEAR_WORDS[kind], text, start, end):
        value += 0.35
    if kind not in BASE_KINDS and near(_AGAINST_WORDS, text, start, end):
        value -= 0.25
    return max(0.0, min(1.0, value))


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by kind as listed, then start."""
    out = []
    if not text:
        return out
    digits = _HAS_DIGIT.search(text) is not None
    for kind in KINDS:
        if not (digits or kind == "email"):
            continue
        for start, end in _FIND[kind](text):
            s = score(kind, text, start, end)
            if s >= threshold:
                out.append((kind, start, end, s))
    return out


SPANS = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "n_spans long, min_score double, redacted_sha256 string"
)


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Replaces each run of overlapping spans by the kind of its first span in brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _row(text: str | None) -> tuple:
    spans = find(text)
    said = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
    base = [x for x, s in zip(said, spans, strict=True) if s[0] in BASE_KINDS]
    counts = [sum(s[0] == k for s in spans) for k in BASE_KINDS]
    clean = redact(text or "", spans)
    return (
        *counts,
        hashlib.sha256(",".join(base).encode()).hexdigest(),
        ",".join(said),
        len(spans),
        min((s[3] for s in spans), default=None),
        hashlib.sha256(clean.encode()).hexdigest(),
    )


def pii_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, spans, lowest score and the digest of the redacted text, one row for each row."""
    ship(docs.sparkSession)
    fields = [p.split() for p in SPANS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = list(zip(*(_row(t.as_py()) for t in part.column(1)), strict=True))
                arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["key", *(n for n, _ in fields)])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key long, {SPANS}").withColumnRenamed("key", key)
