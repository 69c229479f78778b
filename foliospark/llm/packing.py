"""Packing documents into token sequences by order-preserving dynamic programming.

Tokens of the documents of a partition stand in input order; cuts may fall at
document ends (free), sentence ends or, where no other place is near, inside a
sentence.  For cut places p_0 < p_1 < ... with penalties c_j the cheapest way
to cut before p_j is

    f(j) = c_j + min over p_j - W <= p_i < p_j of  f(i) + W - (p_j - p_i)

that is a sliding-window minimum of f(i) + p_i, which a monotone queue serves
in constant time for each place.  The recursion runs over blocks of about
``BLOCK`` tokens; the last open window of a block is carried into the next, so
memory is bounded and no shuffle is needed.  A task leaves at most one short
sequence; its rows depend on its input split alone, so a lost task is redone
with the same result.

Tokens.  The tokenizer never joins text across white space, nor across the
classes letter, digit and punctuation.  So texts are cut into such units with
the vectorised word kernel, each new unit is encoded once for a worker (in a
bounded cache) and ids are gathered by index.  Units whose class is in doubt
(other scripts, apostrophes, special-token brackets) stay whole words.  This
holds for vocabularies whose file names the pipeline in ``PIPELINE``; the file is
checked, and with any other one whole texts are encoded.  Texts of over
``LONG_TEXT`` bytes are cut at blanks, which gives the same ids in bounded memory.

Cases: a null or empty text is the closing id alone; repeated rows are packed
once for each row; a document longer than a sequence or a block is cut into
consecutive pieces; a null id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.words import _BASE, _INVERSE, _LOWER, _SPACE, _TABLE, U64, mix, powers, slices, texts_of
from foliospark.session import ship

WINDOW = 2048
BLOCK = 1 << 17
END_ID = 1
SENTENCE_PENALTY = 4
INSIDE_PENALTY = 40
CACHE = 500_000
LONG_TEXT = 1 << 22

#: Normaliser, splitting pattern and word end that cutting into units relies on.
PIPELINE = (
    ("NFC", "Replace", "Lowercase"),
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "</w>",
)

_LETTER, _DIGIT, _OTHER, _DOUBT = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[128:] = _DOUBT
_CLASS[ord("'")] = _DOUBT


def _byte_chars() -> list[str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


def pipeline(path: str) -> tuple | None:
    """Normaliser, splitting pattern and word end of a vocabulary file, None where they are of another form."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    try:
        split, byte_level = parts["pre_tokenizer"]["pretokenizers"]
        if (split["behavior"], split["invert"], byte_level["type"], byte_level["add_prefix_space"]) != ("Removed", True, "ByteLevel", False):
            return None
        names = tuple(n["type"] for n in parts["normalizer"]["normalizers"])
        return names, split["pattern"]["Regex"], parts["model"]["end_of_word_suffix"]
    except (KeyError, TypeError, ValueError):
        return None


class Encoder:
    """Ids of texts by units, each encoded once; the cache is emptied when it is full."""

    def __init__(self, path: str, size: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_units = pipeline(path) == PIPELINE
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {0: 0}  # unit 0: a document's end
        self.ids = np.array([END_ID], dtype=np.uint32)
        self.start = np.array([0], dtype=np.int64)
        self.count = np.array([1], dtype=np.int64)
        self.stops = np.array([False])

    def _encode(self, unit: str) -> list[int]:
        """Ids of a unit that the tokenizer keeps in one piece: the model's own merges, without its pipeline."""
        if not unit.isascii():
            unit = "".join(map(_BYTE_CHARS.__getitem__, unit.lower().encode()))
        return [t.id for t in self.model.tokenize(unit)]

    def _learn(self, hashes: list[int], units: list[bytes], plain: list[bool]) -> None:
        texts = [u.decode() for u in units]
        odd = [k for k, p in enumerate(plain) if not p]
        whole = self.tokenizer.encode_batch([texts[k] for k in odd], add_special_tokens=False)
        doubtful = {k: e.ids for k, e in zip(odd, whole, strict=True)}
        got = [doubtful[k] if k in doubtful else self._encode(t) for k, t in enumerate(texts)]
        base = len(self.count)
        counts = np.array([len(g) for g in got], dtype=np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum()))])
        self.stops = np.concatenate([self.stops, np.array([u[-1:] in (b".", b"!", b"?") for u in units])])
        self.known.update(zip(hashes, range(base, base + len(units)), strict=True))

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache index of each unit, document ends included, and units for each text."""
        n = len(raw)
        if len(self.count) > self.size:
            self.clear()
        space = np.ones(n + 2, dtype=bool)
        space[1:-1] = _SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        inside = ~space[1:-1]
        first = inside & (space[:-2] | edge[:-1])
        kind = _CLASS[raw]
        # U+00C0..U+017F are letters but for the two signs and the dotted capital I
        lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5)) if n else np.zeros(0, dtype=np.int64)
        tail = raw[lead + 1] if n else lead
        ok = ~(((raw[lead] == 0xC3) & ((tail == 0x97) | (tail == 0xB7))) | ((raw[lead] == 0xC4) & (tail == 0xB0)))
        kind[lead[ok]] = _LETTER
        kind[lead[ok] + 1] = _LETTER
        opened = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))) if n else lead
        kind[opened] = _DOUBT
        words = np.flatnonzero(first)
        number = np.cumsum(first) - 1
        doubtful = np.zeros(len(words), dtype=bool)
        odd = np.flatnonzero((kind == _DOUBT) & inside)
        doubtful[number[odd]] = True
        whole = doubtful[number] & inside if len(words) else inside
        before = np.zeros(n, dtype=np.uint8)
        before[1:] = kind[:-1]
        begins = first | (inside & ~whole & ((kind != before) | (kind == _DIGIT)))
        starts = np.flatnonzero(begins)
        after = np.ones(n + 1, dtype=bool)
        after[:n] = begins | ~inside | edge[:-1]
        closes = np.flatnonzero(after)
        ends = closes[np.searchsorted(closes, starts + 1)] if len(starts) else starts
        text = np.where(whole, raw, _LOWER[raw])
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[text] * powers(_BASE, n), out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
        hashes |= U64(1)
        codes, unique = pd.factorize(hashes)
        index = np.empty(len(unique), dtype=np.int64)
        fresh = []
        keys = unique.tolist()
        known = self.known
        for k, h in enumerate(keys):
            at = known.get(h, -1)
            index[k] = at
            if at < 0:
                fresh.append(k)
        if fresh:
            seen = np.full(len(unique), -1, dtype=np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            buffer = text.tobytes()
            places = seen[fresh]
            a, b = starts[places], ends[places]
            base = len(self.count)
            self._learn(
                [keys[k] for k in fresh],
                [buffer[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                (~whole[a]).tolist(),
            )
            index[fresh] = np.arange(base, base + len(fresh))
        found = index[codes]
        per_text = np.searchsorted(starts, offsets)
        found = np.insert(found, per_text[1:], 0)
        return found, np.diff(per_text) + 1

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, closing id included; ids for each text; places after a sentence's end."""
        found, per_text = self.units(raw, offsets)
        counts = self.count[found]
        until = np.cumsum(counts)
        ids = self.ids[np.repeat(self.start[found] - (until - counts), counts) + np.arange(until[-1] if len(until) else 0)]
        lengths = np.add.reduceat(counts, np.cumsum(per_text) - per_text) if len(per_text) else per_text
        return ids, lengths, until[self.stops[found]]


def cuts(places: np.ndarray, penalties: np.ndarray, window: int, final: bool) -> list[int]:
    """Cheapest chosen places, ascending; the last place is forced if ``final``.

    ``places`` ascend from above 0 with steps of at most ``window``; 0 is the start.
    """
    p = [0, *places.tolist()]
    c = [0, *penalties.tolist()]
    n = len(p)
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # value f(i) + p_i, place, index
    for j in range(1, n):
        at = p[j]
        low = at - window
        while queue[0][1] < low:
            queue.popleft()
        value, _, i = queue[0]
        back[j] = i
        best = f[j] = value + window - at + c[j]
        value = best + at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    j = n - 1
    if not final:
        j = min((k for k in range(n) if p[k] > p[-1] - window), key=lambda k: (f[k], -k))
    out = []
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Collects documents of one partition and yields finished pieces."""

    def __init__(self, partition: int, window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        self.sequence = partition << 32
        self.parts: list[tuple] = []  # doc_id, doc tokens, start in document, ids, sentence ends
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        self.parts.append((doc_id, len(ids), 0, ids, stops))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, final: bool) -> Iterator[tuple]:
        if not self.parts:
            return
        sizes = np.array([len(p[3]) for p in self.parts], dtype=np.int64)
        until = np.cumsum(sizes)
        begin = until - sizes
        total = int(until[-1])
        penalty = np.full(total + 1, -1, dtype=np.int64)
        for p, at in zip(self.parts, begin.tolist(), strict=True):
            penalty[p[4] + at] = SENTENCE_PENALTY
        penalty[until] = 0
        penalty[0] = 0
        natural = np.flatnonzero(penalty >= 0)
        step = max(1, self.window // 64)
        wide = np.flatnonzero(np.diff(natural) > self.window // 32)
        for k in wide.tolist():
            penalty[natural[k] + step : natural[k + 1] : step] = INSIDE_PENALTY
        penalty[0] = -1
        places = np.flatnonzero(penalty >= 0)
        chosen = cuts(places, penalty[places], self.window, final)
        ids = np.concatenate([p[3] for p in self.parts])
        at, k = 0, 0
        for end in chosen:
            offset = 0
            while at < end:
                doc_id, doc_tokens, start, own, _ = self.parts[k]
                stop = min(end, int(until[k]))
                here = start + at - int(begin[k])
                piece = ids[at:stop]
                yield doc_id, here, stop - at, zlib.crc32(piece), doc_tokens, self.sequence, offset
                offset += stop - at
                at = stop
                if stop == until[k]:
                    k += 1
            self.sequence += 1
        left = []
        for k in range(k, len(self.parts)):
            doc_id, doc_tokens, start, own, stops = self.parts[k]
            skip = max(0, at - int(begin[k]))
            left.append((doc_id, doc_tokens, start + skip, own[skip:], stops[stops > skip] - skip))
        self.parts, self.held = left, total - at


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _long(enc: Encoder, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one very long text, cut at blanks so that memory stays bounded."""
    parts, stops, at, done = [], [], 0, 0
    while at < len(raw):
        end = min(len(raw), at + LONG_TEXT)
        while end < len(raw):
            blank = np.flatnonzero(_SPACE[raw[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
                break
            end = min(len(raw), end + LONG_TEXT)
        ids, _, s = enc.encode(raw[at:end], np.array([0, end - at]))
        parts.append(ids[:-1])
        stops.append(s + done)
        done += len(ids) - 1
        at = end
    return np.concatenate([*parts, np.array([END_ID], dtype=np.uint32)]), np.concatenate(stops)


def _whole(enc: Encoder, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for text, e in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        ends = [k + 1 for k, (_, stop) in enumerate(e.offsets) if text[stop - 1 : stop] in (".", "!", "?")]
        yield np.array([*e.ids, END_ID], dtype=np.uint32), np.array(ends, dtype=np.int64)


def encoded(enc: Encoder, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and sentence ends of each text of a column, in order."""
    for a, b in slices(column):
        if not enc.by_units:
            yield from _whole(enc, [t or "" for t in column.slice(a, b - a).to_pylist()])
            continue
        raw, offsets = texts_of(column.slice(a, b - a))
        if len(raw) > LONG_TEXT:
            yield _long(enc, raw)
            continue
        ids, lengths, stops = enc.encode(raw, offsets)
        until = np.cumsum(lengths)
        marks = np.searchsorted(stops, until)
        at = low = 0
        for end, high in zip(until.tolist(), marks.tolist(), strict=True):
            yield ids[at:end], stops[low:high] - at
            at, low = end, high


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, order: Sequence[Column] = ()
) -> DataFrame:
    """A row for each piece of a document in a sequence; partitions are packed on their own, in order.

    With an ``order`` rows are dealt by range first, so that sequences, by their ids, follow it from first to last.
    """
    names = ["key", *(p.split()[0] for p in PIECES.split(", "))]
    ship(docs.sparkSession)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, rows = encoder(tokenizer), Packer(TaskContext.get().partitionId(), window), []
        for batch in batches:
            for doc_id, (ids, stops) in zip(batch.column(0).to_pylist(), encoded(enc, batch.column(1)), strict=True):
                rows += packer.add(doc_id, ids, stops)
                if len(rows) >= 8192:
                    yield table(rows)
                    rows = []
        rows += packer.flush(True)
        if rows:
            yield table(rows)

    places = [c.alias(f"__place{k}") for k, c in enumerate(order)]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *places)
    if places:
        names_of = [f"__place{k}" for k in range(len(places))]
        rows = rows.repartitionByRange(*names_of).sortWithinPartitions(*names_of).drop(*names_of)
    return rows.mapInArrow(run, f"key long, {PIECES}").withColumnRenamed("key", key)
