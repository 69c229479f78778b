"""Substring deduplication with suffix automata of reference shards.

A word is removed if a window of ``window`` consecutive words that covers it
also starts anywhere else.  The reference is the corpus itself, so it is cut
into shards such that every two equal windows meet in one shard: each window
is keyed by its minimizer, the smallest hash among its runs of ``ANCHOR``
words (leftmost if equal), a function of the window's words alone.  Successive
windows with the same minimizer form a region, about one for 14 words.

1. Regions are counted by minimizer: 16 bytes a region are shuffled, combined
on the map side.  A minimizer seen once has no repeats.
2. If all regions of a minimizer have one content, all of it repeats; its
automaton would be a single path that is walked as often as the content occurs.
3. Otherwise the distinct contents are a reference shard: a suffix automaton is
built over their words, where each prefix adds its content's number of
occurrences; contents stream through it, and a window repeats if the state of
its matching statistic counts two occurrences or more.  A shard holds at most
``SHARD`` contents.  A larger one is dealt anew by the 2, then 4, 8, ... smallest
hashes of each window, still functions of the window's words alone, until its
parts fit or all hashes are used; so no answer comes from a count of windows.
4. Spans go back to their documents, whose kept words are hashed.

An automaton of every shard sent to every document would cost documents times
shards; keyed shards give the same spans.  :func:`reference_spans` is the plain
form for a reference of proven size: its automata are broadcast shard by shard
and documents stream past them.

Cases: a null text has no words; repeated rows and copies repeat each other
and lose every word under a window; documents shorter than a window keep all;
documents without id are told apart by their text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.near_dedup import bitmap, bits_for
from foliospark.llm.shared import materialize
from foliospark.llm.words import _BASE, _INVERSE, U64, Words, mix, powers, slices, windows
from foliospark.session import ship

WINDOW = 35
ANCHOR = 8
SHARD = 1024  # contents of some 60 words: an automaton of about 100,000 states, some 10 MB
MAX_REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``count`` holds occurrences once :meth:`close` ran.

    States are places in arrays.  Most have one way on, which is kept in them; a dictionary holds those that branch.
    """

    def __init__(self) -> None:
        self.ids: dict = {}
        self.word, self.to = array("q", [-1]), array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.count = array("q", [-1]), array("q", [0]), array("q", [0])

    def _state(self, length: int, like: int, link: int) -> int:
        """A new state with the ways on of ``like``, or with none."""
        new = len(self.link)
        self.word.append(-1 if like < 0 else self.word[like])
        self.to.append(-1 if like < 0 else self.to[like])
        if like in self.more:
            self.more[new] = dict(self.more[like])
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return new

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(word, -1)

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _split(self, p: int, q: int, word: int) -> int:
        """The part of state q that holds strings reached from p."""
        clone = self._state(self.length[p] + 1, q, self.link[q])
        self.link[q] = clone
        while p >= 0 and self._next(p, word) == q:
            self._lead(p, word, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self._next(last, word)
        if q >= 0:  # another sequence has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, -1, 0)
        p = last
        while p >= 0 and self._next(p, word) < 0:
            self._lead(p, word, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, word)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def add(self, words: list, weight: int = 1) -> None:
        last = 0
        for w in words:
            last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
            self.count[last] += weight

    def close(self) -> None:
        """Adds each state's occurrences to its suffixes, longest first."""
        for s in np.argsort(np.frombuffer(self.length, dtype=np.int64), kind="stable")[:0:-1].tolist():
            self.count[self.link[s]] += self.count[s]

    def statistics(self, words: list) -> Iterator[tuple[int, int]]:
        """For each place the longest match that ends there, and its state."""
        state = matched = 0
        for w in words:
            k = self.ids.get(w, -2)
            q = self._next(state, k)
            while state and q < 0:
                state = self.link[state]
                matched = self.length[state]
                q = self._next(state, k)
            if q >= 0:
                state = q
                matched += 1
            yield matched, state

    def repeats(self, words: list, window: int, least: int = 2) -> list[int]:
        """Starts of windows that occur ``least`` times or more."""
        out = []
        for at, (matched, state) in enumerate(self.statistics(words)):
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if self.count[state] >= least:
                    out.append(at - window + 1)
        return out


def covered(starts: Iterable[int], window: int) -> list[int]:
    """Flat [start, end, start, end, ...] of the words under windows with ascending starts."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + window
        else:
            out += [s, s + window]
    return out


def regions(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(minimizer hash, content hash, text number, first word, end word) of each region of some texts."""
    h = words.hashes
    n = len(h)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    value = windows(h, anchor)
    place = np.arange(len(value))
    span, want = 1, window - anchor + 1
    while span < want:
        step = min(span, want - span)
        a, b = value[:-step], value[step:]
        left = a <= b
        value = np.where(left, a, b)
        place = np.where(left, place[:-step], place[step:])
        span += step
    last = words.first[1:][words.doc] - window  # last window start of the word's text
    starts = np.flatnonzero(np.arange(n) <= last)
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    at = place[starts]
    doc = words.doc[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    until = np.append(first[1:], len(starts)) - 1
    s, e = starts[first], starts[until] + window
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(_BASE, n), out=sums[1:])
    content = mix((sums[e] - sums[s]) * powers(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
    return value[starts][first], content, doc[first], s, e


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & U64(8 * len(bits) - 1)
    return np.flatnonzero((bits[(h >> U64(3)).astype(np.int64)] >> (h & U64(7)).astype(np.uint8)) & 1)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _walk(column: pa.Array, window: int) -> Iterator[tuple]:
    for a, b in slices(column):
        words = Words.of(column.slice(a, b - a))
        yield a, words, regions(words, window)


def _counts(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, (m, c, *_) in _walk(batch.column(0), window):
                yield pa.RecordBatch.from_arrays([_signed(m), _signed(c)], ["m", "c"])

    return run


def _places(bits, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for row, words, (m, c, doc, s, e) in _walk(batch.column(2), window):
                k = _hits(seen, m)
                take = pa.array(doc[k] + row)
                base = words.first[doc[k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        _signed(m[k]),
                        _signed(c[k]),
                        pa.array((s[k] - base).astype(np.int32)),
                        pa.array((e[k] - base).astype(np.int32)),
                    ],
                    ["key", "h", "m", "c", "s", "e"],
                )

    return run


def _contents(bits, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for _, words, (m, c, _, s, e) in _walk(batch.column(0), window):
                k = _hits(seen, m)
                if not len(k):
                    continue
                _, one, n = np.unique(c[k], return_index=True, return_counts=True)
                raw = words.bytes.tobytes()
                k = k[one]
                ends = words.ends[e[k] - 1].tolist()
                text = [b" ".join(raw[x:y].split()) for x, y in zip(words.starts[s[k]].tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(m[k]), _signed(c[k]), pa.array(text, pa.binary()), pa.array(n.astype(np.int64))],
                    ["m", "c", "w", "n"],
                )

    return run


_FOUND = "m long, c long, spans array<int>"


def _found(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    m, c, spans = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], ["m", "c", "spans"]
    )


def _through_automata(window: int):
    """Rows (m, c, w, n) sorted by m: one automaton for each m."""

    def solve(group: list[tuple]) -> Iterator[tuple[int, int, list[int]]]:
        automaton = SuffixAutomaton()
        texts = [w.split() for _, _, w, _ in group]
        for words, (_, _, _, n) in zip(texts, group, strict=True):
            automaton.add(words, n)
        automaton.close()
        for words, (m, c, _, _) in zip(texts, group, strict=True):
            starts = automaton.repeats(words, window)
            if starts:
                yield m, c, covered(starts, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += solve(group)
                    group = []
                group.append(row)
            yield _found(out)
        if group:
            yield _found(list(solve(group)))

    return run


def _keys_by_level(value: np.ndarray, at: np.ndarray, width: int, level: int) -> np.ndarray:
    """For windows that begin at ``at``, a hash of the ``level`` smallest distinct ones of their ``width`` run hashes."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    each = np.sort(np.lib.stride_tricks.sliding_window_view(value, width)[at], axis=1)
    new = np.ones(each.shape, dtype=bool)
    new[:, 1:] = each[:, 1:] != each[:, :-1]
    rank = np.cumsum(new, axis=1)
    marked = mix(each + rank.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return np.where(new & (rank <= level), marked, U64(0)).sum(axis=1, dtype=np.uint64)


def _dealt_anew(window: int, level: int, anchor: int = ANCHOR):
    """Rows (m, c, w, n): the parts of each content whose windows have the same key of ``level`` hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.string())
            for a, b in slices(texts):
                words = Words.of(texts.slice(a, b - a))
                h, n = words.hashes, len(words.hashes)
                last = words.first[1:][words.doc] - window
                starts = np.flatnonzero(np.arange(n) <= last)
                key = _keys_by_level(windows(h, anchor), starts, window - anchor + 1, level)
                doc = words.doc[starts]
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                s = starts[first]
                e = starts[np.append(first[1:], len(starts)) - 1] + window if len(first) else s
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(h * powers(_BASE, n), out=sums[1:])
                content = mix((sums[e] - sums[s]) * powers(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
                raw = words.bytes.tobytes()
                text = [b" ".join(raw[x:y].split()) for x, y in zip(words.starts[s].tolist(), words.ends[e - 1].tolist(), strict=True)]
                of = pa.array(doc[first] + a)
                yield pa.RecordBatch.from_arrays(
                    [_signed(key[first]), _signed(content), pa.array(text, pa.binary()), batch.column(3).take(of), batch.column(0).take(of),
                     batch.column(1).take(of), pa.array((s - words.first[doc[first]]).astype(np.int32))],
                    ["m", "c", "w", "n", "pm", "pc", "at"],
                )

    return run


def repeated_contents(contents: DataFrame, window: int, parts: int) -> DataFrame:
    """Spans (m, c, spans) of repeated words in the contents (m, c, w, n) of each shard m; a content may have several rows."""
    width = window - ANCHOR + 1
    levels = [*(1 << k for k in range(1, width.bit_length()) if 1 << k < width), width]
    rounds, pieces, parted = [], contents, []
    for level in [*levels, None]:
        # written, so that the shards of many contents are joined by size
        large = materialize(pieces.groupBy("m").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD).select("m"), "large")
        last = level is None or large.isEmpty()
        small = pieces if last else pieces.join(large, "m", "left_anti")
        small = small.select("m", "c", "w", "n").repartition(parts, "m").sortWithinPartitions("m", "c")
        rounds.append(small.mapInArrow(_through_automata(window), _FOUND))
        if last:
            break
        big = pieces.join(large, "m", "left_semi").select("m", "c", "w", "n")
        kinds = "m long, c long, w binary, n long, pm long, pc long, at int"
        cut = materialize(big.mapInArrow(_dealt_anew(window, level), kinds), "parts")
        parted.append(cut.select("m", "c", "pm", "pc", "at"))
        pieces = materialize(cut.groupBy("m", "c").agg(F.min("w").alias("w"), F.sum("n").alias("n")), "contents")
    found = rounds.pop()
    while rounds:  # back to the contents that were parted
        up = found.join(parted.pop(), ["m", "c"])
        up = up.select(F.col("pm").alias("m"), F.col("pc").alias("c"), F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
        found = rounds.pop().union(up)
    return found


def _digest(spans: list[int] | None, words: list[bytes]) -> tuple[int, int, str]:
    """Words, removed words and digest of the kept ones; spans are flat, any order, may overlap."""
    gone, kept, at = 0, [], 0
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
        if s > at:
            kept += words[at:s]
        if e > at:
            gone += e - max(s, at)
            at = e
    kept += words[at:]
    return len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()


def spans_of_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, h, spans) of rows that lose words; ``docs`` has key, h (text hash) and text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select("text").mapInArrow(_counts(window), "m long, c long")
    seen = counted.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("a"), F.max("c").alias("b"))
    seen = materialize(seen.where("n > 1").select("m", (F.col("a") == F.col("b")).alias("uniform")), "minimizers")
    size = bits_for(seen.count())
    low = F.col("m").bitwiseAND((1 << size) - 1).alias("h")
    bits = spark.sparkContext.broadcast(bitmap(seen.select(low), size))  # 2**MAX_BITS / 8 bytes at most
    mixed = seen.where("not uniform")
    mixed_bits = spark.sparkContext.broadcast(bitmap(mixed.select(low), size))
    contents = docs.select("text").mapInArrow(_contents(mixed_bits, window), "m long, c long, w binary, n long")
    # those of further minimizers, which a bitmap lets pass, are solved for nothing; joining them away would gather a
    # frequent minimizer's contents in one task
    contents = contents.groupBy("m", "c").agg(F.min("w").alias("w"), F.sum("n").alias("n"))
    found = materialize(repeated_contents(materialize(contents, "contents"), window, parts), "repeats")
    places = docs.select("key", "h", "text").mapInArrow(
        _places(bits, window), "key long, h long, m long, c long, s int, e int"
    )
    places = places.join(seen, "m")
    whole = places.where("uniform").select("key", "h", F.array("s", "e").alias("spans"))
    part = places.where("not uniform").join(found, ["m", "c"]).select(
        "key", "h", F.transform("spans", lambda x: x + F.col("s")).alias("spans")
    )
    spans = whole.union(part).groupBy("key", "h").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Key, n_words, n_removed and kept_sha256 of every row."""
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(body).alias("h"), body.alias("text"))
    spans = materialize(spans_of_documents(rows, window), "spans").withColumnsRenamed({"key": "k", "h": "g"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, found = part.column(1), part.column(2)
                rows = [_digest(s.as_py(), t.as_py().encode().split()) for t, s in zip(texts, found, strict=True)]
                n, gone, sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
                    ["key", "n_words", "n_removed", "kept_sha256"],
                )

    joined = rows.join(spans, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g")), "left")
    out = joined.select("key", "text", "spans").mapInArrow(
        run, "key long, n_words long, n_removed long, kept_sha256 string"
    )
    return out.withColumnRenamed("key", key)


def reference_spans(
    docs: DataFrame, reference: list[str], key: str = "doc_id", text: str = "text", least: int = WINDOW
) -> DataFrame:
    """(key, spans): maximal word spans of each row that match the reference over ``least`` words or more.

    The reference's size is checked; its automata are broadcast in shards of a
    tenth of the bound, and each document's spans over all shards are merged.
    """
    texts = [t.encode().split() for t in reference if t]
    if sum(map(len, texts)) > MAX_REFERENCE_WORDS:
        raise ValueError(f"a broadcast reference may hold {MAX_REFERENCE_WORDS} words; key larger ones as remove_repeats does")
    ship(docs.sparkSession)
    shards, size = [], MAX_REFERENCE_WORDS // 10
    room = 0
    for words in texts:
        if room < len(words):
            shards.append(SuffixAutomaton())
            room = max(size, len(words))
        shards[-1].add(words)
        room -= len(words)
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def spans(words: list[bytes]) -> list[int]:
        starts = set()
        for automaton in sent.value:
            for at, (matched, _) in enumerate(automaton.statistics(words)):
                if matched >= least:
                    starts.add(at - least + 1)
        return covered(sorted(starts), least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans((t.as_py() or "").encode().split()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["key", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, spans array<int>").withColumnRenamed("key", key)
