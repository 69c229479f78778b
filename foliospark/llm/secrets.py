"""Secret scans: fixed patterns and a linear-chain conditional random field.

Patterns find assignments, access key ids and long hexadecimal runs; they
always stand.  The field tags each word B (a secret begins), I (it goes on) or
O from its shape (length, digits, case mix, class changes, symbols, links with
a password in them), the words beside it and features of the whole file (how
many credential words and how much code it has), and adds the spans it decodes
outside the patterns' ones.

What a word says is learned, not looked up: a linear model over hashed
character runs of three and four gives each word scores as credential word
("password"), link ("is"), ordinary word and value.  The listed words only
make training sentences, so words that share parts with them
("PGPASSWORD", "passphrase") count as well.

Words of four bytes or more have learned scores; shorter ones have the
constant score ``_PLAIN``, in training and decoding alike, and come out as O.

Training maximises the conditional log-likelihood over ``TRAINING`` generated
sentences with a fixed seed, on the driver, in some 20 seconds; the corpus isn't
used.  The weights, under a megabyte, travel with the function.

Decoding is exact Viterbi, but cheap.  If a word's O score leads by more than
twice the spread of the transition scores, changing any path to O there
improves it, so the best path is O; and a chain of B and I between two O must
hold a word whose lead is below the best transition's gain, or it would lose
against all O.  Runs without such a word are skipped.  Features are computed for all words of many texts at once from
prefix sums over bytes; no Python object is made for a word.

Cases: a null text is empty and has no spans; spans count code points, end
exclusive; patterns are linear in the text's length; repeated rows each
return; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import Words, slices, texts_of
from foliospark.session import ship

TRAINING = 1500
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A
)
_HINT = re.compile(r"pass|secret|token|api", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
KINDS = ("assign", "access", "hex", "crf")
O, B, I = 0, 1, 2  # noqa: E741

#: Words of the training sentences (fixed values): what announces a secret, ...
CREDENTIAL_WORDS = (
    "password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access", "auth", "bearer",
    "credential", "credentials", "private", "signature", "client_secret", "access_token", "secret_key",
    "passphrase", "passcode",
)
#: ... what stands between it and the value, ...
LINKS = ("is", "was", "=", ":", ":=", "->", "=>", "to", "as", "set")
#: ... how ordinary long words end, ...
ENDINGS = (
    "ed", "ng", "on", "ly", "le", "nt", "al", "er", "rs", "ty", "us", "ve", "es", "ns", "ts", "ce", "ic", "cs", "or",
    "ry", "re", "te", "ss", "ge",
)
#: ... and ordinary words, among them some that look like credential words.
ORDINARY = (
    "about", "above", "account", "across", "after", "again", "against", "always", "among", "another", "answer", "author",
    "authority", "because", "before", "behind", "below", "between", "book", "broken", "build", "business", "called",
    "carry", "change", "children", "city", "close", "common", "compass", "could", "country", "course", "data", "design",
    "different", "document", "during", "early", "earth", "either", "enough", "every", "example", "family", "father",
    "field", "figure", "first", "follow", "friend", "general", "government", "great", "group", "hockey", "house",
    "however", "important", "interest", "jockey", "keen", "keep", "keyboard", "knowledge", "language", "large", "learn",
    "letter", "light", "little", "local", "making", "market", "matter", "measure", "member", "minute", "model", "moment",
    "money", "monkey", "morning", "mother", "mountain", "music", "never", "nothing", "number", "often", "order", "other",
    "paper", "party", "passage", "passed", "passenger", "passive", "people", "perhaps", "person", "picture", "place",
    "plant", "point", "power", "present", "private", "problem", "process", "program", "public", "question", "quickly",
    "rather", "reason", "report", "result", "river", "school", "science", "secretary", "section", "several", "should",
    "signal", "simple", "small", "social", "something", "sound", "special", "state", "still", "story", "street",
    "strong", "study", "system", "taken", "their", "there", "these", "thing", "think", "those", "thought", "through",
    "together", "toward", "turkey", "under", "until", "value", "village", "water", "where", "which", "while", "white",
    "whole", "without", "woken", "woman", "world", "would", "write", "years", "young",
)
_DRESS = ("{}", "{}:", "{}=", '"{}":', "'{}':", '"{}"', "({})", "{},", "{}.", "--{}", "<{}>")
_BEFORE = ("db_", "my", "user", "admin_", "app-", "old", "PG", "MYSQL_", "x-", "root")
_BEHIND = ("_id", "2", "_value", "s", "-v1", "_prod", "Text")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, by start, then kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# Features of words --------------------------------------------------------------------------------

_DIGIT, _UPPER, _LOWER, _VALUE, _CODE, _HEXD = range(6)
_KINDS = np.zeros((6, 256), dtype=bool)
for _k, _chars in (
    (_DIGIT, b"0123456789"),
    (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (_LOWER, b"abcdefghijklmnopqrstuvwxyz"),
    (_VALUE, b"+/_=-"),
    (_CODE, b"{};=<>()[]"),
    (_HEXD, b"0123456789abcdefABCDEF"),
):
    _KINDS[_k, list(_chars)] = True
_KINDS[_LOWER, 128:] = True  # bytes of other scripts
_CLASS = np.full(256, 4, dtype=np.uint8)
for _k in (_DIGIT, _UPPER, _LOWER, _VALUE):
    _CLASS[_KINDS[_k]] = _k

NAMES = (
    "bias", "len6", "len8", "len12", "len16", "len20", "len32", "len64", "digit", "digits20", "digits50", "no_letter",
    "upper", "mixed_case", "mixed_all", "changes3", "changes6", "changes_dense", "symbol", "hex16", "other", "plain",
    "near1", "near2", "after1", "shape_near", "shape_file", "code_file", "credential_file", "linked", "plain_linked",
    "plain12_linked", "plain16_linked", "plain20_linked", "inner_upper", "digit_linked", "opened", "digit_near1",
    "own_word", "own_assigned", "ordinary", "ordinary_plain", "ordinary_linked", "link_before", "url", "url_login",
    "mail", "score1", "score2", "linked_score", "no_letter_near", "foreign", "plain_alone", "no_digit_alone",
    "own_linked",
)

_BITS = 15
_ALPHABET = np.full(256, 28, dtype=np.uint32)  # a mark or blank
_ALPHABET[97:123] = np.arange(1, 27)
_ALPHABET[65:91] = np.arange(1, 27)
_ALPHABET[48:58] = 27
_ALPHABET[list(b":=>")] = 29
_ALPHABET[128:] = 30
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b"\"'),;:.!?>]}")] = True
_OPENING = np.frombuffer(b"\"'`<(", dtype=np.uint8)
_ASSIGNING = np.frombuffer(b":=>", dtype=np.uint8)


def gram_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of three and of four characters from each place on; a blank stands before each text.

    Byte i of text d is at place i + d + 1, so the run that takes in the byte before it starts at i + d.
    """
    codes = np.insert(_ALPHABET[raw], offsets[:-1], 28)
    codes = np.concatenate([codes, np.full(4, 28, dtype=np.uint32)])
    n = len(codes) - 3
    three = codes[:n] << np.uint32(10) | codes[1 : n + 1] << np.uint32(5) | codes[2 : n + 2]
    four = ((three << np.uint32(5) | codes[3:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    return three.astype(np.int32), four.astype(np.int32)


def word_scores(w: Words, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Three rows: how much more each word looks like a credential word, a link and a value than like an ordinary word.

    A score is the mean over the word's runs, with the bytes before and behind it.
    """
    out = np.zeros((3, len(w.starts)))
    if not len(w.starts):
        return out
    three, four = gram_buckets(w.bytes, offsets)
    at = w.starts + w.doc
    size = w.ends - w.starts
    bounds = np.stack([at, at + np.maximum(size - 1, 1)], axis=1).ravel()
    for k in range(3):
        sums = np.add.reduceat(table[0, :, k][three] + table[1, :, k][four], bounds)[::2]
        out[k] = np.where(size == 1, table[0, three[at], k], sums) / np.maximum(size - 1, 1)
    return out


def features(column: pa.Array, table: np.ndarray | None = None) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of some texts, indices of those with learned scores, and their feature rows."""
    raw, offsets = texts_of(column)
    w = Words(raw, offsets)
    n = len(w.starts)
    size = w.ends - w.starts
    lead, link, value = word_scores(w, offsets, lexicon() if table is None else table)
    credential = (lead > 0) & (lead > link) & (lead > value)
    links = (link > 0) & (link > lead) & (link > value)
    strength = np.clip(lead - np.maximum(value, 0), -1, 1)

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums

    def count(flags: np.ndarray) -> np.ndarray:
        sums = within(flags)
        return sums[w.ends] - sums[w.starts]

    hit = np.flatnonzero(size >= 4)
    doc, s = w.doc[hit], size[hit]
    digits, upper, lower, symbols, hexes = (
        count(_KINDS[k][raw])[hit] for k in (_DIGIT, _UPPER, _LOWER, _VALUE, _HEXD)
    )
    kind = _CLASS[raw]
    change = np.zeros(len(raw), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    sums = within(change)
    changes = sums[w.ends[hit]] - sums[w.starts[hit] + 1]
    per_doc = np.zeros(len(offsets) - 1, dtype=np.int64)
    np.add.at(per_doc, w.doc[credential], 1)
    code = within(_KINDS[_CODE][raw])
    codes = code[offsets[1:]] - code[offsets[:-1]]
    chars = np.maximum(np.diff(offsets), 1)

    def beside(step: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(hit + step, 0, max(n - 1, 0))
        ok = (hit + step >= 0) & (hit + step < n) & (w.doc[at] == doc)
        return ok, at

    def said(step: int) -> tuple[np.ndarray, np.ndarray]:
        ok, at = beside(step)
        return ok & credential[at], np.where(ok, strength[at], -1)

    (near1, score1), (n2, s2), (n3, s3), (after1, _) = said(-1), said(-2), said(-3), said(1)
    near2, score2 = n2 | n3, np.maximum(s2, s3)
    ok, before = beside(-1)
    linking = ok & links[before]
    assigned = near1 & np.isin(raw[w.ends[before] - 1], _ASSIGNING)
    linked = (linking & near2) | assigned
    plain = digits + symbols == 0
    inner = within(_KINDS[_UPPER][raw])
    inner = inner[w.ends[hit]] - inner[w.starts[hit] + 1] > 0
    opened = np.isin(raw[w.starts[hit]], _OPENING)
    ordinary = np.clip(-value[hit], -1, 1)
    at_slash = np.zeros(len(raw), dtype=bool)
    at_slash[:-2] = (raw[:-2] == 58) & (raw[1:-1] == 47) & (raw[2:] == 47)
    url, mail = count(at_slash)[hit] > 0, count(raw == 64)[hit] > 0
    marks = count(raw == 58)[hit] > 1
    sign = count(np.isin(raw, _ASSIGNING))[hit] > 0
    letters = upper + lower > 0
    login = url & mail & marks
    foreign = count(raw >= 128)[hit] > 0
    near = near1 | near2
    columns = (
        True, s >= 6, s >= 8, s >= 12, s >= 16, s >= 20, s >= 32, s >= 64,
        digits > 0, digits * 5 > s, digits * 2 > s, ~letters, upper > 0, (upper > 0) & (lower > 0),
        (upper > 0) & (lower > 0) & (digits > 0), changes >= 3, changes >= 6, changes * 4 > s, symbols > 0,
        (hexes >= s - 2) & (s >= 16) & (digits > 0) & (digits < s), s - digits - upper - lower - symbols > 2, plain,
        near1, near2, after1, (s >= 16) & (changes >= 4) & near, (s >= 16) & (changes >= 6) & (digits > 0),
        codes[doc] * 50 > chars[doc], per_doc[doc] > 0, linked, plain & linked, plain & linked & (s >= 12),
        plain & linked & (s >= 16), plain & linked & (s >= 20), inner & (lower > 0), (digits > 0) & letters & linked,
        opened, (digits > 0) & letters & near1, credential[hit], credential[hit] & sign & (s >= 12), ordinary,
        ordinary * plain, ordinary * linked, linking, url & ~login, login, mail & ~url, score1, score2,
        linked * np.maximum(score1, score2), ~letters & near, foreign, plain & ~near, (digits == 0) & ~near,
        credential[hit] & linked & (s >= 12),
    )
    x = np.empty((len(columns), len(hit)), dtype=np.float32)
    for k, c in enumerate(columns):
        x[k] = c
    return w, hit, x.T


# The field ----------------------------------------------------------------------------------------


_ORDINARY, _LEAD, _LINK, _SECRET = range(4)


def _parts(count: int, seed: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Words of generated sentences, the tag and the role of each."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    accents = letters + "áéíñóúäöüßàèêç"
    base62 = letters + letters.upper() + "0123456789"
    pick = lambda s: s[int(rng.integers(len(s)))]
    run = lambda s, a, b: "".join(pick(s) for _ in range(int(rng.integers(a, b))))

    def word() -> str:
        if rng.random() < 0.5:
            w = pick(ORDINARY)
        else:
            w = run(letters if rng.random() < 0.6 else accents, 2, 16 if rng.random() < 0.2 else 11)
        if rng.random() < 0.1:
            w += run(letters, 2, 6) + pick(ENDINGS)
        k = rng.random()
        w = w.upper() if k < 0.06 else w.capitalize() if k < 0.16 else w
        return w + (pick([",", ".", ";", "!!", "?", ")", '"']) if rng.random() < 0.14 else "")

    def link() -> str:
        host = f"{pick(['https', 'http', 'ftp'])}://{run(letters, 3, 9)}.{pick(['org', 'com', 'net'])}/"
        k = rng.random()
        if k < 0.4:
            return f"{host}{run(letters, 3, 9)}/{rng.integers(9999)}"
        if k < 0.7:
            return host + run(base62, 8, 40)
        return f"{host}{run(letters, 3, 9)}?{run(letters, 1, 4)}={run(base62, 3, 20)}"

    def login() -> str:
        head = f"{pick(['postgres', 'mysql', 'redis', 'amqp', 'https', 'mongodb'])}://{run(letters, 3, 8)}"
        return f"{head}:{run(base62 + '!$%', 6, 20)}@{run(letters, 2, 8)}.{run(letters, 2, 8)}" + pick(["", "/" + run(letters, 2, 8), ":5432/" + run(letters, 1, 6)])

    def plain() -> str:
        k = rng.random()
        if k < 0.78:
            return word()
        if k < 0.82:
            return f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"
        if k < 0.86:
            return run("0123456789", 1, 14) + pick([".", ",", ""])
        if k < 0.88:
            return f"{run(letters, 3, 9)}{rng.integers(99)}@{run(letters, 3, 9)}.com"
        if k < 0.92:
            return link()
        if k < 0.94:
            return f"+{rng.integers(10, 99)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
        if k < 0.96:
            return f"{run(letters, 3, 12)}_{run(letters, 3, 12)}({run(letters, 1, 5)});"
        if k < 0.97:
            return f"{pick(ORDINARY)}{rng.integers(99)}"
        if k < 0.99:
            return "-".join(piece() for _ in range(int(rng.integers(2, 6))))
        return ".".join(str(rng.integers(256)) for _ in range(4))

    def ordinary() -> str:
        w = pick(ORDINARY) if rng.random() < 0.4 else run(letters, 2, 10) + pick(ENDINGS)
        return w + (pick(",.;") if rng.random() < 0.3 else "")

    def lead() -> str:
        w = pick(CREDENTIAL_WORDS)
        k = rng.random()
        w = pick(_BEFORE) + w if k < 0.15 else w + pick(_BEHIND) if k < 0.25 else w
        k = rng.random()
        return w.upper() if k < 0.15 else w.capitalize() if k < 0.25 else w

    def secret() -> list[str]:
        k = rng.random()
        if k < 0.45:
            return [run(base62, 20, 48)]
        if k < 0.60:
            return [pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + run(base62, 20, 40)]
        if k < 0.75:
            return [run(base62 + "+/", 32, 72) + pick(["", "=", "=="])]
        if k < 0.85:
            return [".".join(run(base62 + "_-", 18, 40) for _ in range(3))]
        return [run(base62 + "+/", 60, 65) for _ in range(int(rng.integers(2, 4)))]

    def piece() -> str:
        k = rng.random()
        return pick(ORDINARY) if k < 0.5 else pick(CREDENTIAL_WORDS).replace("_", "") if k < 0.58 else run(letters, 3, 8)

    def chosen() -> str:
        """A secret that a person made up."""
        k = rng.random()
        if k < 0.38:
            own = [pick(_BEFORE[:6]).strip("_-"), lead(), pick(_BEHIND[2:]).strip("_-")]
            return "".join(own if rng.random() < 0.1 else (piece() for _ in range(int(rng.integers(3, 5)))))
        if k < 0.52:
            return "-".join(piece() for _ in range(int(rng.integers(3, 5))))
        if k < 0.62:
            return run(letters, 3, 9).capitalize() + run(letters + letters.upper(), 5, 14)
        if k < 0.85:
            return (piece() + piece() if rng.random() < 0.3 else piece()) + run("0123456789", 1, 5)
        return piece() + run("0123456789", 1, 5) + run("!@#$%&*", 1, 3)

    for _ in range(count):
        words: list[str] = []
        tags: list[int] = []
        roles: list[int] = []

        def add(w: str, tag: int = O, role: int = _ORDINARY) -> None:
            words.append(w)
            tags.append(tag)
            roles.append(role)

        for _ in range(int(rng.integers(6, 16))):
            k = rng.random()
            if k < 0.07:
                if rng.random() < 0.85:
                    add(pick(_DRESS).format(lead()), O, _LEAD)
                else:
                    add(word())
                if rng.random() < 0.4:
                    add(pick(["is", "=", ":", "->"]), O, _LINK)
                for at, v in enumerate(secret()):
                    add(v, I if at else B, _SECRET)
            elif k < 0.12:
                if rng.random() < 0.6:
                    add(lead(), O, _LEAD)
                    add(pick(LINKS), O, _LINK)
                else:
                    add(lead() + pick(":=") if rng.random() < 0.5 else lead().upper(), O, _LEAD)
                add(chosen() if rng.random() < 0.9 else piece() + run("0123456789", 2, 5), B, _SECRET)
            elif k < 0.20:
                add(lead(), O, _LEAD)
                if rng.random() < 0.7:
                    add(pick(["is", "was", "to", "as"]), O, _LINK)
                if rng.random() < 0.1:
                    add(run("0123456789", 1, 5))
                elif rng.random() < 0.1:
                    add(link())
                else:
                    add(ordinary())
            elif k < 0.24:
                add(lead(), O, _LEAD)
                if rng.random() < 0.5:
                    add(word())
                    add(pick(LINKS), O, _LINK)
                    add(plain())
            elif k < 0.29:
                add(pick(LINKS), O, _LINK)
                add(plain() if rng.random() < 0.6 else "".join(piece() for _ in range(3)))
            elif k < 0.31:
                add(login(), B, _SECRET)
            else:
                add(plain())
        yield words, tags, roles


def _sentences(count: int, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """Generated sentences and the tag of each word."""
    for words, tags, _ in _parts(count, seed):
        yield " ".join(words), tags


@lru_cache(maxsize=2)
def lexicon(count: int = TRAINING, rounds: int = 50, rate: float = 0.5) -> np.ndarray:
    """Weights (run length, bucket, role) of hashed character runs: logistic regression on the roles of generated words."""
    kinds = {(w, r) for words, _, roles in _parts(count, 12) for w, r in zip(words, roles, strict=True)}
    rng = np.random.default_rng(13)
    letters = np.array(list("etaoinshrdlucmfwypvbgkjqxz" + "etaoinshr" * 3))
    kinds |= {("".join(rng.choice(letters, k)), _ORDINARY) for k in rng.integers(2, 9, 6 * count).tolist()}
    halves = [w[: len(w) // 2] for w in CREDENTIAL_WORDS if len(w) >= 8]
    for k, half in zip(rng.integers(2, 8, count // 8).tolist(), halves * count, strict=False):
        kinds.add((half + "".join(rng.choice(letters, k)), _LEAD))
    listed = {*CREDENTIAL_WORDS, *LINKS}
    kinds = sorted(k for k in kinds if k[1] != _ORDINARY or k[0].lower() not in listed)
    texts, roles = zip(*kinds, strict=True)
    raw, offsets = texts_of(pa.array(texts))
    w = Words(raw, offsets)  # each text is one word
    truth = np.eye(4)[list(roles)]
    weigh = (truth / truth.sum(axis=0)).sum(axis=1, keepdims=True)  # every role weighs the same
    runs = np.maximum(w.ends - w.starts - 1, 1)
    owner = np.repeat(np.arange(len(texts)), runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + (w.starts + w.doc)[owner]
    three, four = (b[place] for b in gram_buckets(raw, offsets))
    whole = (w.ends - w.starts)[owner] > 1  # a single byte has no run of four
    table = np.zeros((2, 1 << _BITS, 4))
    square = np.full_like(table, 1e-8)
    for _ in range(rounds):
        score = np.zeros((len(texts), 4))
        for r in range(4):
            score[:, r] = np.bincount(owner, table[0, three, r] + whole * table[1, four, r], len(texts)) / runs
        p = np.exp(score - _logsum(score, 1)[:, None])
        error = ((truth - p) * weigh / runs[:, None])[owner]
        slope = np.empty_like(table)
        for r in range(4):
            slope[0, :, r] = np.bincount(three, error[:, r], 1 << _BITS)
            slope[1, :, r] = np.bincount(four, error[:, r] * whole, 1 << _BITS)
        slope -= 2e-6 * table
        square += slope**2
        table += rate * slope / np.sqrt(square)
    return (table[:, :, 1:] - table[:, :, :1]).astype(np.float32)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


#: O to I can't start a path; the score is finite so that the bound in :func:`decode` holds.
_BARRED = -6.0
#: Scores of words under four bytes.
_PLAIN = np.array([20.0, -20.0, -20.0])


@lru_cache(maxsize=2)
def train(count: int = TRAINING, rounds: int = 150, rate: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission weights (features, 3), transitions (3, 3) by gradient ascent on the log-likelihood, and the word model."""
    texts, tags = zip(*_sentences(count), strict=True)
    table = lexicon()
    w, hit, rows = features(pa.array(texts), table)
    wide = max(map(len, tags))
    y = np.zeros((count, wide), dtype=np.int64)
    live = np.zeros((count, wide), dtype=bool)
    for k, t in enumerate(tags):
        y[k, : len(t)] = t
        live[k, : len(t)] = True
    place = np.arange(len(w.starts)) - w.first[w.doc]
    where = (w.doc[hit], place[hit])
    rows = np.asarray(rows, dtype=np.float64, order="C")
    score = np.tile(_PLAIN, (count, wide, 1))
    weight, move = np.zeros((len(NAMES), 3)), np.zeros((3, 3))
    square_w, square_m = np.full_like(weight, 1e-6), np.full_like(move, 1e-6)
    truth = np.eye(3)[y] * live[:, :, None]
    steps = np.zeros((3, 3))
    first = np.concatenate([np.full((count, 1), O), y[:, :-1]], axis=1)
    np.add.at(steps, (first[live], y[live]), 1)
    for _ in range(rounds):
        score[where] = rows @ weight
        alpha = np.zeros((count, wide, 3))
        alpha[:, 0] = score[:, 0] + move[O]
        for t in range(1, wide):
            step = _logsum(alpha[:, t - 1, :, None] + move, 1) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        total = _logsum(alpha[:, -1], 1)
        beta = np.zeros((count, wide, 3))
        for t in range(wide - 2, -1, -1):
            step = _logsum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], step, 0)
        share = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        pair = np.exp(
            alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        seen = (pair * live[:, 1:, None, None]).sum(axis=(0, 1))
        seen[O] += share[:, 0].sum(axis=0)
        slope_w = rows.T @ (truth - share)[where] / count - 1e-3 * weight
        slope_m = (steps - seen) / count - 2e-3 * move
        square_w += slope_w**2
        square_m += slope_m**2
        weight += rate * slope_w / np.sqrt(square_w)
        move += rate * slope_m / np.sqrt(square_m)
    move[O, I] = min(move[O, I], _BARRED)
    return weight, move, table


def viterbi(score: np.ndarray, move: np.ndarray, last: bool = True) -> list[int]:
    """Best tags of a run that follows an O and, if ``last`` is false, is followed by one."""
    steps = move.T.tolist()
    back: list[list[int]] = []
    best = (move[O] + score[0]).tolist()
    for row in score[1:].tolist():
        came, reached = [], []
        for into, own in zip(steps, row, strict=True):
            through = [b + m for b, m in zip(best, into, strict=True)]
            top = max(through)
            came.append(through.index(top))
            reached.append(top + own)
        back.append(came)
        best = reached
    if not last:
        best = [b + m for b, m in zip(best, steps[O], strict=True)]
    out = [best.index(max(best))]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def decode(w: Words, hit: np.ndarray, rows: np.ndarray, model: tuple) -> list[tuple[int, int]]:
    """(first word, end word) of each decoded secret, by exact Viterbi on the words O can't be fixed for."""
    weight, move = model[:2]
    score = np.tile(_PLAIN, (len(w.starts), 1))
    score[hit] = rows @ weight
    lead = score[:, O] - score[:, 1:].max(axis=1)
    gain = move[:, 1:].max() - move[O, O] + max(0.0, move[1:, O].max() - move[O, O])
    seeds = np.flatnonzero(lead <= gain)
    if not len(seeds):
        return []
    opened = lead <= 2 * (move.max() - move.min())
    # runs of open words of one text: where a run begins, and behind it ends
    begins = opened.copy()
    begins[1:] &= ~opened[:-1] | (w.doc[1:] != w.doc[:-1])
    ends = opened.copy()
    ends[:-1] &= ~opened[1:] | (w.doc[1:] != w.doc[:-1])
    lows, highs = np.flatnonzero(begins), np.flatnonzero(ends)
    out = []
    for k in np.unique(np.searchsorted(lows, seeds, side="right") - 1).tolist():
        low, high = int(lows[k]), int(highs[k])
        tags = viterbi(score[low : high + 1], move, last=high + 1 == w.first[w.doc[high] + 1])
        begin = None
        for at, tag in enumerate([*tags, O]):
            if begin is not None and tag != I:
                out.append((low + begin, low + at))
                begin = None
            if tag == B or (tag == I and begin is None):
                begin = at
    return out


_NAME = re.compile(rb"[\"'(<\[{]*+(?:[A-Za-z_-]{1,32}[\"']?(?::(?!//)|=)[\"']?)?")
_LOGIN = re.compile(rb"[a-z+]{2,12}://[^\s:/@]{0,64}:([^\s/@]{1,128})@")
_TAIL = b"\"'),;:.<>[]{}"


def scan(column: pa.Array, model: tuple) -> Iterator[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, by start, then kind; code points."""
    for a, b in slices(column):
        part = column.slice(a, b - a)
        w, hit, rows = features(part, model[2])
        found: dict[int, list[tuple[int, int]]] = {}
        for first, end in decode(w, hit, rows, model):
            found.setdefault(int(w.doc[first]), []).append((int(w.starts[first]), int(w.ends[end - 1])))
        _, offsets = texts_of(part)
        points = np.zeros(len(w.bytes) + 1, dtype=np.int64)  # code points before each byte
        np.cumsum((w.bytes & 0xC0) != 0x80, out=points[1:])
        for k, text in enumerate(part):
            base = base_spans(text.as_py() or "")
            more = []
            for s, e in found.get(k, ()):
                raw = w.bytes[s:e].tobytes()
                login = _LOGIN.search(raw[:256])
                lead, size = login.span(1) if login else (_NAME.match(raw).end(), len(raw.rstrip(_TAIL)))
                if size > lead:
                    begin = points[offsets[k]]
                    more.append((int(points[s + lead] - begin), 3, int(points[s + size] - begin)))
            yield sorted(base + _apart(more, base)) if more else base


def _apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``spans`` that overlap none of ``base``, which is sorted."""
    starts = [s for s, _, _ in base]
    until = list(accumulate((e for _, _, e in base), max))
    out = []
    for s, k, e in spans:
        n = bisect_left(starts, e)
        if not n or until[n - 1] <= s:
            out.append((s, k, e))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replaces each run of overlapping spans by one mark; of an assignment the name stays."""
    out, at = [], 0
    for start, kind, end in spans:
        if kind == 0:
            start = _ASSIGN.match(text, start).start(1)
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_ROW = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, redacted_sha256 string"
)


def secret_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, spans and digests of every row."""
    ship(docs.sparkSession)
    model = train()
    names = ["key", *(p.split()[0] for p in _ROW.split(", "))]

    def row(body: str | None, spans: list[tuple[int, int, int]]) -> tuple:
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in spans]
        base = [x for x, p in zip(said, spans, strict=True) if p[1] < 3]
        n = [sum(p[1] == k for p in spans) for k in range(4)]
        digest = hashlib.sha256(",".join(base).encode()).hexdigest()
        clean = redact(body or "", spans)
        return (*n[:3], digest, ",".join(said), n[3], hashlib.sha256(clean.encode()).hexdigest())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [row(t.as_py(), s) for t, s in zip(part.column(1), scan(part.column(1), model), strict=True)]
                cols = [
                    pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in zip(*rows, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key long, {_ROW}").withColumnRenamed("key", key)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in its text; a null text stays null."""
    ship(docs.sparkSession)
    model = train()
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(at)
            clean = [
                redact(t.as_py(), s) if s else t.as_py() for t, s in zip(body, scan(body, model), strict=True)
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
