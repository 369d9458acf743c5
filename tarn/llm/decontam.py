"""Benchmark decontamination by a generalised suffix automaton.

Automata of all normalised test items (see :mod:`.textvec` for words) are built
by Spark tasks, in blocks of at most ``max_block_words`` words, and written as
arrays to the shared folder; an item of more words is cut into pieces that
overlap by a word less than the window, so that every window is whole in one of
them.  The corpus is streamed once: a task loads the automata, or so many of
them at a time as ``LOADED_BYTES`` hold, and runs all of them over its rows.

While a document streams through, an automaton tracks the length of the longest
suffix read so far that occurs in any item.  Where that length reaches
``window`` words, the last ``window`` words are a passage of a test item.
Items shorter than the window count as wholes.  Every state knows the state that
holds its last ``window`` words and the nearest one at which a short item ends,
so a word takes constant time, amortised, however words repeat.

Stretches in which no such length can arise are skipped: every two adjacent
words of a match are adjacent in an item, so only runs of known word pairs are
streamed.  Pairs are recognised by hashes, which can only let too much through;
the automaton decides on the words themselves.
"""

from __future__ import annotations

import io
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .lookup import Lookup, deal
from .names import at, col, columns_of, free_name, map_rows
from .textvec import Words, find_words, mix, words_of


@dataclass(frozen=True)
class Limits:
    """``window``: matches of so many words are removed.  ``coverage``: documents with a larger share of hit words go."""

    window: int = 10
    coverage: float = 0.5
    max_block_words: int = 250_000


#: Automata that a task holds at once, and the texts that it passes through them while they are loaded in turn.
LOADED_BYTES = 256 << 20
TEXT_BYTES = 64 << 20


class _Builder:
    """Builds a generalised suffix automaton over sequences of words."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: The names of the items that have each of the different sequences.
        self.names: dict[tuple[int, ...], list[str]] = {}
        for item, words in items:
            if words:
                sequence = tuple(self.ids.setdefault(w, len(self.ids)) for w in words)
                if sequence not in self.names:
                    self._add(sequence)
                    self.names[sequence] = []
                self.names[sequence].append(item)

    def _add(self, sequence: Iterable[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def arrays(self) -> dict[str, np.ndarray]:
        """What :class:`SuffixAutomaton` reads."""
        many = len(self.ids)
        key = np.array([s * many + c for s, row in enumerate(self.next) for c in row], np.int64)
        target = np.array([t for row in self.next for t in row.values()], np.int32)
        order = np.argsort(key)
        link, length = np.array(self.link, np.int32), np.array(self.length, np.int32)
        # from short to long, so that a state's link is done before it
        window, short = self.window, {}
        at_window, near = np.zeros(len(link), np.int32), np.zeros(len(link), np.int32)
        by_length = np.argsort(length, kind="stable").tolist()
        for s in by_length[1:]:
            at_window[s] = s if self.length[self.link[s]] < window else at_window[self.link[s]]
        ends: list[tuple[int, int, int]] = []  # state, length and sequence of windows (of length ``window``) and short items
        for i, sequence in enumerate(self.names):
            state = 0
            for n, c in enumerate(sequence, 1):
                state = self.next[state][c]
                if n >= window:
                    ends.append((int(at_window[state]), window, i))
            if len(sequence) < window:
                short.setdefault(state, []).append(i)
                ends.append((state, len(sequence), i))
        for s in by_length[1:]:
            near[s] = s if s in short else near[self.link[s]]
        ends = sorted(set(ends))
        pairs = np.array(sorted({(a, b) for s in self.names for a, b in zip(s, s[1:])}), np.int32).reshape(-1, 2)
        names = [n for own in self.names.values() for n in own]
        return {
            "key": key[order], "target": target[order], "link": link, "length": length, "at_window": at_window, "near": near,
            "end_state": np.array([e[0] for e in ends], np.int32), "end_length": np.array([e[1] for e in ends], np.int32), "end_item": np.array([e[2] for e in ends], np.int32),
            "pairs": pairs, "words": np.frombuffer(b" ".join(self.ids), np.uint8), "names": np.frombuffer(json.dumps(names).encode(), np.uint8),
            "named": np.cumsum([0, *map(len, self.names.values())]), "shortest": np.array(min([window, *map(len, self.names)])), "window": np.array(window),
        }


class SuffixAutomaton:
    """Reads the arrays of a built automaton; about 70 bytes for each word of the items."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.window, self.shortest = int(arrays["window"]), int(arrays["shortest"])
        self.key, self.target = memoryview(arrays["key"]), memoryview(arrays["target"])
        self.link, self.length = memoryview(arrays["link"]), memoryview(arrays["length"])
        self.at_window, self.near = memoryview(arrays["at_window"]), memoryview(arrays["near"])
        self.end_state, self.end_length, self.end_item = (arrays[k] for k in ("end_state", "end_length", "end_item"))
        joined = arrays["words"]
        self.ids = {w: i for i, w in enumerate(joined.tobytes().split(b" "))}
        self.many = len(self.ids)
        names, named = json.loads(arrays["names"].tobytes()), arrays["named"].tolist()
        self.names = [names[a:b] for a, b in zip(named[:-1], named[1:])]
        word_hash = find_words(joined, np.array([0, len(joined)])).hash
        pairs = arrays["pairs"]
        bits = max(16, min(26, int(8 * max(len(pairs), self.many, 1)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.word_table = np.zeros(1 << bits, bool)
        self.word_table[word_hash >> self.shift] = True
        self.pair_table = np.zeros(1 << bits, bool)
        self.pair_table[self._pair(word_hash[pairs[:, 0]], word_hash[pairs[:, 1]])] = True

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix(left * np.uint64(3) + right) >> self.shift

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """After one more word: the state and the length of the longest match that ends there."""
        while True:
            wanted = state * self.many + c
            at = bisect_left(self.key, wanted)
            if at < len(self.key) and self.key[at] == wanted:
                return self.target[at], length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]

    def items_of(self, ends: Iterable[tuple[int, int]]) -> set[str]:
        """The names of the items with a window, or as wholes, at these states and lengths."""
        out: set[str] = set()
        for state, length in ends:
            a, b = np.searchsorted(self.end_state, [state, state + 1])
            for i in self.end_item[a:b][self.end_length[a:b] == length].tolist():
                out.update(self.names[i])
        return out

    def runs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Stretches [from, to) of words in which a match of ``shortest`` words may lie."""
        known = self.word_table[w.hash >> self.shift]
        # joined[i]: words i and i + 1 are of one document and may be adjacent in an item
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        joined[at] = self.pair_table[self._pair(w.hash[at], w.hash[at + 1])]
        cuts = w.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(w.hash))]
        joined[cuts - 1] = False
        starts = known.copy()
        starts[1:] &= ~joined
        ends = known.copy()
        ends[:-1] &= ~joined
        a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        long = b - a >= self.shortest
        return a[long], b[long]

    def hits(self, w: Words) -> dict[int, tuple[list[list[int]], set[str]]]:
        """By document of ``w``: disjoint stretches of hit words (indices in ``w``), and names of items."""
        out: dict[int, tuple[list[list[int]], set[tuple[int, int]]]] = {}
        if not len(w.hash):
            return {}
        begin, stop = self.runs(w)
        of = np.searchsorted(w.bounds, begin, side="right") - 1
        for a, b, d in zip(begin.tolist(), stop.tolist(), of.tolist()):
            state = length = 0
            for i in range(a, b):
                c = self.ids.get(w.word(i))
                state, length = (0, 0) if c is None else self.step(state, length, c)
                reach, found = 0, []
                if length >= self.window:
                    reach = self.window
                    found.append((self.at_window[state], self.window))
                s = self.near[state]
                while s > 0:  # at most one state for each length below the window
                    low, high = np.searchsorted(self.end_state, [s, s + 1])
                    for m in set(self.end_length[low:high].tolist()):
                        if m <= length and m < self.window:
                            reach = max(reach, m)
                            found.append((s, m))
                    s = self.near[self.link[s]]
                if reach:
                    spans, ends = out.setdefault(d, ([], set()))
                    ends.update(found)
                    first = i + 1 - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, i + 1])
        return {d: (spans, self.items_of(ends)) for d, (spans, ends) in out.items()}


def normalised_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = find_words(data, np.array([0, len(data)]))
    return [w.word(i) for i in range(len(w.hash))]


def _build(limits: Limits):
    """Rows (item, text) to automata: block, bytes, data."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[str, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = io.BytesIO()
            np.savez(out, **_Builder(held, limits.window).arrays())
            data = out.getvalue()
            return pa.record_batch([pa.array([block]), pa.array([len(data)]), pa.array([data], pa.binary())], ["block", "bytes", "data"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = normalised_words(text)
                most = max(limits.max_block_words, limits.window)
                for a in range(0, max(1, len(words) - limits.window + 1), most - limits.window + 1):
                    piece = words[a : a + most]
                    if held and size + len(piece) > limits.max_block_words:
                        yield flush()
                        held, size, block = [], 0, block + 1
                    if piece:
                        held.append((item, piece))
                        size += len(piece)
        if held:
            yield flush()

    return run


def build_automata(benchmark: DataFrame, item_id: str, item_text: str, limits: Limits) -> tuple[Lookup, list[list[int]]]:
    """The automata of all items, and their blocks in groups that are loaded together.

    The driver sees one number for each ``max_block_words`` words.
    """
    items = benchmark.select(F.coalesce(col(item_id).cast("string"), F.lit("null")).alias("item"), col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-int(size) // (2 * limits.max_block_words)))  # a word takes two bytes at least
    built = items.coalesce(tasks).mapInArrow(_build(limits), "block long, bytes long, data binary")
    built = written(built, "automata")
    groups: list[list[int]] = [[]]
    held = 0
    for block, n in sorted((r.block, r.bytes) for r in built.select("block", "bytes").collect()):
        if held and held + n > LOADED_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(block)
        held += n
    return deal(built.select("block", "data"), "block", "automata-by-block"), groups


_loaded: dict[str, list[SuffixAutomaton]] = {}


def _load(automata: Lookup, blocks: list[int], keep: bool) -> list[SuffixAutomaton]:
    """The automata of these blocks; a worker process keeps those of one benchmark."""
    if automata.path in _loaded:
        return _loaded[automata.path]
    out = []
    for block in blocks:
        (data,) = automata.rows(block).column("data").to_pylist()
        with np.load(io.BytesIO(data)) as arrays:
            out.append(SuffixAutomaton({k: np.ascontiguousarray(arrays[k]) for k in arrays.files}))
    if keep:
        _loaded.clear()
        _loaded[automata.path] = out
    return out


_HITS = "struct<n_words:bigint,spans:array<array<bigint>>,items:array<string>>"
_OUT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _stream(automata: Lookup, groups: list[list[int]], text: int):
    """Adds what is found in the column at the place ``text``; spans are of word numbers and of bytes: [word, word, byte, byte]."""

    def found(batch: pa.RecordBatch, loaded: list[SuffixAutomaton], result: list[dict]) -> None:
        for w in words_of(batch.column(text)):
            n = np.diff(w.bounds)
            for d in range(w.n_docs):
                result[w.first + d]["n_words"] = int(n[d])
            for automaton in loaded:
                for d, (spans, items) in automaton.hits(w).items():
                    zero, byte, own = int(w.bounds[d]), int(w.base[d]), result[w.first + d]
                    own["spans"] += [[a - zero, b - zero, int(w.start[a]) - byte, int(w.end[b - 1]) - byte] for a, b in spans]
                    own["items"] += items

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            results = [[{"n_words": 0, "spans": [], "items": []} for _ in range(b.num_rows)] for b in held]
            for blocks in groups:
                loaded = _load(automata, blocks, len(groups) == 1)
                for batch, result in zip(held, results):
                    found(batch, loaded, result)
            for batch, result in zip(held, results):
                yield pa.record_batch([*batch.columns, pa.array(result, _OUT)], [*batch.schema.names, "added"])

        for batch in batches:
            held.append(batch)
            if len(groups) == 1 or sum(b.nbytes for b in held) > TEXT_BYTES:
                yield from flush()
                held = []
        yield from flush()

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with one more column, the last: struct(n_words, spans, items).

    It is called ``_hits``, with more underscores where ``docs`` has such a
    column.  spans: [first word, end word, first byte, end byte] of stretches of
    hit words; those of different blocks of items may overlap.  items: ids as
    strings of the items with an occurring window, of different blocks perhaps
    more than once.  A null or empty text has no words; items without words match
    nothing; items with a null id are named "null"; with no items at all nothing
    is hit.
    """
    automata, groups = build_automata(benchmark, item_id, item_text, limits)
    return map_rows(docs, _stream(automata, groups, at(docs, text)), free_name(docs, "_hits"), _HITS)


def hit_words(spans) -> "F.Column":
    """How many words the union of the spans holds."""
    order = F.array_sort(spans)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], acc["to"]))).alias("n"), F.greatest(acc["to"], s[1]).alias("to"))
    return F.aggregate(order, zero, step)["n"]


def contamination_report(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, coverage; one row per row of ``docs``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, limits=limits)
    items = F.array_sort(F.array_distinct("_hits.items"))
    return found.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        hit_words(F.col("_hits.spans")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
    ).select("*", (F.col("n_hit") > 0).alias("contaminated"), F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0)).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with hit stretches cut out of the text; documents hit beyond ``coverage`` go.

    All columns stay as they are otherwise, whatever their names; a text without
    hits is unchanged.
    """
    found = find_contamination(docs, benchmark, text=text, limits=limits)
    hits = found.columns[-1]
    spans, n_words, said = F.col(f"{hits}.spans"), F.col(f"{hits}.n_words"), col(text)
    n_hit = hit_words(spans)
    found = found.where((n_hit == 0) | (n_hit <= F.lit(limits.coverage) * n_words))
    raw = F.encode(said, "UTF-8")
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<string>").alias("parts"))
    cut = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    step = lambda acc, s: F.struct(F.greatest(acc["to"], s[3]).alias("to"), F.when(s[2] > acc["to"], F.concat(acc["parts"], F.array(cut(acc["to"], s[2])))).otherwise(acc["parts"]).alias("parts"))
    done = F.aggregate(F.array_sort(spans), zero, step)
    rest = F.concat(F.array_join(done["parts"], ""), cut(done["to"], F.octet_length(said).cast("long")))
    return found.withColumn(text, F.when(F.size(spans) > 0, rest).otherwise(said)).select(*columns_of(docs))
