"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. Every document becomes a weighted set of shingles of five words.  A
   shingle's weight is ``(1 + ln count) * idf`` with
   ``idf = 1 + ln((1 + N) / (1 + df))``: N documents, df of them hold it.
2. The rows are laid out once in blocks of about ``unit`` shingles.  A block
   sends its different shingles, packed and dealt by ranges of their hashes, to
   be counted; what comes back, dealt by block, are the counts of those that two
   documents or more hold (all others have df = 1).  So neither texts nor single
   shingles are shuffled, and a block's counts fit in a task's memory.
3. Improved consistent weighted sampling draws ``bands * rows`` samples per
   document; two documents agree in a sample with the probability of their
   weighted Jaccard similarity.  ``flat_bands * rows`` more are drawn by the
   weights without idf, for step 4's second measure.
4. Documents that agree in all samples of a band share a bucket.  The exact
   weighted Jaccard similarity is computed in two steps.  First every member is
   compared with the bucket's ``pivots``.  Only buckets whose members are not in
   one class by then go on: there, the members outside the largest class are
   compared with all others, in bounded groups.  No link between different
   classes is lost, and a bucket of m copies costs m comparisons.
   In a large group of near copies df is the group's own size, so that what they
   share weighs little beside every edit.  In a bucket of ``crowd`` texts or more
   two texts are therefore also linked if their similarity without idf reaches
   the threshold, unless what they share is mostly held elsewhere: its mean df
   (geometric) may be ``apart`` times the bucket's texts.
5. Classes are the connected components of the links.

Rows whose words are the same in the same order count as one document from step
3 on, so large groups of copies cost nothing there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .batches import small_batches
from .components import connected_components
from .lookup import Lookup, deal
from .names import col
from .skew import dealt_join
from .textvec import SHINGLE_BITS, Words, mix, shingle_counts, words_of


@dataclass(frozen=True)
class NearDup:
    """Parameters.  14 bands of 4 samples find a pair of similarity 0.8 with probability 0.9993."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 14
    rows: int = 4
    pivots: int = 4
    block: int = 256
    seed: int = 20
    #: Buckets of so many texts are judged without idf too, where no more than so many rows for each of them hold what two texts share.
    crowd: int = 8
    apart: int = 64
    #: Bands of samples without idf; 8 find a pair of such similarity 0.8 with probability 0.985.
    flat_bands: int = 8
    #: Shingles of a block of rows, and of a range of hashes that is counted at once.
    unit: int = 1_000_000


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return 1 + np.log((1 + n) / (1 + df))


def weight(count: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """(1 + ln count) * idf."""
    out = idf_of(df, n)
    many = count > 1
    out[many] *= 1 + np.log(count[many])
    return out


def flat_weight(count: np.ndarray) -> np.ndarray:
    """1 + ln count."""
    return 1 + np.log(count)


# --------------------------------------------------------------------------- layout


def _identity(w: Words) -> np.ndarray:
    """128 bits of each document's word sequence, as two integers."""
    out = np.zeros((w.n_docs, 2), np.uint64)
    n = np.diff(w.bounds)
    if not len(w.hash):
        return out.view(np.int64)
    at = (np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], n)).astype(np.uint64)
    some = n > 0
    for j, k in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        out[some, j] = mix(np.add.reduceat(mix(w.hash * np.uint64(k) + mix(at + np.uint64(j + 1))), w.bounds[:-1][some]) + n[some].astype(np.uint64))
    return out.view(np.int64)


_LAID = "doc_id {}, th long, k1 long, k2 long, block long, copies long, size long, text string"
_LAID_NAMES = [x.split()[0] for x in _LAID.split(", ")]


def _lay(p: NearDup):
    """Rows (doc_id, th, text) in blocks; a block holds each word sequence's text once, with its ``copies``."""

    def flush(held: list[tuple], block: int) -> pa.RecordBatch:
        ids, th, text = (pa.concat_arrays([h[i] for h in held]) for i in range(3))
        keys, n = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        null = text.is_null().to_numpy(zero_copy_only=False)
        copies = np.zeros(len(n), np.int64)
        some = np.flatnonzero(n > 0)
        if len(some):
            _, first, times = np.unique(keys[some].view([("a", np.int64), ("b", np.int64)]).ravel(), return_index=True, return_counts=True)
            copies[some[first]] = times
        text = pc.if_else(pa.array(copies > 0), text, pa.scalar(None, pa.string()))
        size = np.where(copies > 0, n, 0)
        columns = [ids, th, pa.array(keys[:, 0], mask=null), pa.array(keys[:, 1], mask=null), pa.array(np.full(len(n), block)), pa.array(copies), pa.array(size), text]
        return pa.record_batch(columns, _LAID_NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size, rows = [], 0, 0
        for batch in batches:
            column = batch.column(2).cast(pa.string())
            for w in words_of(column):
                keys, n = _identity(w), np.diff(w.bounds)
                for d in np.flatnonzero(n == 0):  # a text without words is known by itself
                    value = column[w.first + int(d)]
                    if value.is_valid:
                        keys[d] = np.frombuffer(hashlib.md5(value.as_py().encode()).digest(), np.int64)
                held.append((batch.column(0).slice(w.first, w.n_docs), batch.column(1).slice(w.first, w.n_docs), column.slice(w.first, w.n_docs), keys, n))
                size, rows = size + len(w.hash), rows + w.n_docs
                if size >= p.unit or rows >= 1 << 16:
                    yield flush(held, block)
                    held, size, rows, block = [], 0, 0, block + 1
        if held:
            yield flush(held, block)

    return run


def _runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The stretches of rows that agree on ``key``, each as a table without gaps between its chunks."""
    current, held = None, []
    for batch in batches:
        g = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and g[a] != current:
                yield current, pa.Table.from_batches(held).combine_chunks()
                held = []
            current = int(g[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


# --------------------------------------------------------------------------- document frequencies


def _planes(values: np.ndarray) -> bytes:
    """The bytes of integers, by significance: what compresses lies together."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def _pack(values: np.ndarray) -> bytes:
    """Sorted integers by their differences."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def _send(p: NearDup, parts: int):
    """Of each block: its different shingles and how many of its rows hold them, by ranges of hashes."""
    cuts = np.array([(k << SHINGLE_BITS) // parts for k in range(1, parts)], np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _runs(batches, "block"):
            copies = _one(table, "copies").to_numpy()
            values, times = [], []
            for w in words_of(_one(table, "text")):
                doc, shingle, _ = shingle_counts(w, p.words)
                values.append(shingle)
                times.append(copies[doc + w.first])
            if not values:
                continue
            value, n = np.concatenate(values), np.concatenate(times)
            if not len(value):
                continue
            order = np.argsort(value)
            value = value[order]
            first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            n = np.add.reduceat(n[order], first)
            value = value[first]
            bounds = [0, *np.searchsorted(value, cuts).tolist(), len(value)]
            rows = [(k, block, _pack(value[a:b]), _planes(n[a:b].astype(np.uint32))) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "shingles", "n"])

    return run


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions sorted by part: to each block the shingles of its own that two rows or more hold, and how many do."""
    for _, table in _runs(batches, "part"):
        sent = [_unpack(x) for x in _one(table, "shingles").to_pylist()]
        value = np.concatenate(sent)
        n = np.concatenate([_unplanes(x, np.uint32) for x in _one(table, "n").to_pylist()]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(value[order]) != 0)))
        df = np.empty(len(value), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(value))))
        end = np.cumsum([len(x) for x in sent])
        rows = []
        for block, own, z in zip(_one(table, "block").to_pylist(), sent, end.tolist()):
            found = df[z - len(own) : z]
            some = found > 1
            if some.any():
                rows.append((block, _pack(own[some]), _planes(found[some])))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["block", "shingles", "df"])


def document_frequencies(laid: DataFrame, p: NearDup) -> Lookup:
    """By block: its shingles that two documents or more hold, and how many do."""
    spark = laid.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = laid.agg(F.sum("size")).first()[0] or 0
    parts = max(ways, -(-int(total) // p.unit))
    sent = laid.where("copies > 0").select("block", "copies", "text").mapInArrow(_send(p, parts), "part int, block long, shingles binary, n binary")
    counted = sent.repartitionById(ways, F.col("part") % ways).sortWithinPartitions("part").mapInArrow(_count, "block long, shingles binary, df binary")
    return deal(counted, "block", "frequencies")


class _Frequencies:
    """The document frequency of a block's shingles."""

    def __init__(self, lookup: Lookup) -> None:
        self.lookup, self.block = lookup, None

    def of(self, block: int, shingle: np.ndarray) -> np.ndarray:
        if block != self.block:
            rows = self.lookup.rows(block)
            known = np.concatenate([np.zeros(0, np.uint64), *(_unpack(x) for x in rows.column("shingles").to_pylist())])
            df = np.concatenate([np.zeros(0, np.int64), *(_unplanes(x, np.int64) for x in rows.column("df").to_pylist())])
            self.known, first = np.unique(known, return_index=True)  # a block that was read in parts has equal answers
            self.df, self.block = df[first], block
        out = np.ones(len(shingle), np.int64)
        if len(self.known) and len(shingle):
            at = np.searchsorted(self.known, shingle)
            at[at == len(self.known)] = 0
            hit = self.known[at] == shingle
            out[hit] = self.df[at[hit]]
        return out


# --------------------------------------------------------------------------- samples


def _gamma_quantiles(size: int) -> np.ndarray:
    """The inverse of the distribution function 1 - (1 + x) exp(-x) of Gamma(2, 1), at the middles of ``size`` steps."""
    u = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted sampling.

    A 64-bit hash of shingle and sample gives the draws: 16 bits each for r and c
    ~ Gamma(2, 1), by its inverse distribution function, and 32 for beta ~ U(0, 1).
    """

    def __init__(self, p: NearDup) -> None:
        rng = np.random.default_rng(p.seed)
        self.n = p.bands * p.rows
        self.p = p
        gamma = _gamma_quantiles(1 << 16)
        self.r = gamma.astype(np.float32)
        self.lnc = np.log(gamma).astype(np.float32)
        self.factor = rng.integers(0, 2**63, self.n + p.flat_bands * p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, shingle: np.ndarray, d: int, ln_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t of every shingle in sample d."""
        h = shingle * self.factor[d]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        short = h.view(np.uint16).reshape(-1, 4)
        r = self.r[short[:, 3]]
        beta = h.view(np.uint32)[::2].astype(np.float32)
        beta *= np.float32(2.0**-32)
        t = ln_s / r
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        beta += self.lnc[short[:, 2]]  # ln c - r (t - beta + 1)
        return beta, t

    def bands(self, doc: np.ndarray, shingle: np.ndarray, s: np.ndarray, n_docs: int, flat: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have shingles, and their hash for each band, or for each of the ``flat`` ones."""
        many = self.p.flat_bands if flat else self.p.bands
        if not len(doc):
            return np.zeros(0, np.int64), np.zeros((0, many), np.int64)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        place = np.arange(len(doc), dtype=np.int64)
        ln_s = np.log(s).astype(np.float32)
        out = np.zeros((len(first), many), np.uint64)
        from_ = self.n if flat else 0
        for d in range(from_, from_ + many * self.p.rows):
            ln_a, t = self.draw(shingle, d, ln_s)
            i = ln_a.view(np.int32)
            i ^= (i >> 31) & np.int32(0x7FFFFFFF)  # integers in the order of ln a
            key = i.astype(np.int64)
            key <<= 32
            key |= place
            best = np.minimum.reduceat(key, first) & 0xFFFFFFFF
            got = mix(shingle[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(d << 56))
            b = (d - from_) // self.p.rows
            out[:, b] = mix(out[:, b] + got)
        return doc[first], out.view(np.int64)


def _sign(frequencies: Lookup, n: int, p: NearDup):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, known = Sampler(p), _Frequencies(frequencies)
        for block, table in _runs(batches, "block"):
            for w in words_of(_one(table, "text")):
                doc, shingle, count = shingle_counts(w, p.words)
                have, bands = sampler.bands(doc, shingle, weight(count, known.of(block, shingle), n), w.n_docs)
                bands = np.hstack([bands, sampler.bands(doc, shingle, flat_weight(count), w.n_docs, flat=True)[1]])
                many = bands.shape[1]
                size = np.bincount(doc, minlength=w.n_docs)[have]
                at = np.repeat(have, many) + w.first
                k1, k2 = (_one(table, k).to_numpy()[at] for k in ("k1", "k2"))
                columns = [k1, k2, np.repeat(size, many), np.tile(np.arange(many, dtype=np.int32), len(have)), bands.ravel()]
                yield pa.record_batch([pa.array(c) for c in columns], ["k1", "k2", "size", "band", "value"])

    return run


# --------------------------------------------------------------------------- verification

_SETS = "k1 long, k2 long, total double, flat double, shingles binary, counts binary, df binary"


def _sets(frequencies: Lookup, wanted: Lookup, n: int, p: NearDup):
    """The wanted documents' total weight, with and without idf, and those shingles that other rows hold too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Frequencies(frequencies)
        for block, table in _runs(batches, "block"):
            rows = wanted.rows(block)
            if not rows.num_rows:
                continue
            want = set(zip(rows.column("k1").to_pylist(), rows.column("k2").to_pylist()))
            keys = list(zip(_one(table, "k1").to_pylist(), _one(table, "k2").to_pylist()))
            keep = [i for i, k in enumerate(keys) if k in want]
            for w in words_of(_one(table, "text").take(pa.array(keep, pa.int64()))):
                doc, shingle, count = shingle_counts(w, p.words)
                df = known.of(block, shingle)
                total = np.bincount(doc, weight(count, df, n), w.n_docs)
                flat = np.bincount(doc, flat_weight(count), w.n_docs)
                shared = df > 1
                doc, shingle, count, df = doc[shared], shingle[shared], count[shared].astype(np.uint32), df[shared]
                cuts = np.searchsorted(doc, np.arange(w.n_docs + 1)).tolist()
                out = [(*keys[keep[w.first + d]], total[d], flat[d], shingle[a:b].tobytes(), count[a:b].tobytes(), df[a:b].tobytes()) for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in _SETS.split(", ")])

    return run


def _views(column: pa.Array, kind: type) -> list[np.ndarray]:
    """The integers of every row of a binary column without nulls, in the column's own memory."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    wide, places = np.dtype(kind).itemsize, np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, places)[column.offset : column.offset + len(column) + 1] // wide
    values = np.frombuffer(data or b"", kind, (data.size if data else 0) // wide)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _read(table: pa.Table) -> list[tuple]:
    """(shingles, counts, df) of every row; they keep the table's memory."""
    return list(zip(*(_views(_one(table, k), kind) for k, kind in (("shingles", np.uint64), ("counts", np.uint32), ("df", np.int64)))))


def _shared(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Of the shingles that two documents share the smaller count, and df."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return a[1], a[2]
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = np.flatnonzero(b[0][at] == a[0])
    return np.minimum(a[1][hit], b[1][at[hit]]), a[2][hit]


def common_weight(a: tuple, b: tuple, n: int) -> float:
    """Weight of what two documents share: the smaller of each shingle's weights."""
    return float(weight(*_shared(a, b), n).sum())


def _similar(common, total, n_total, p: NearDup):
    union = total + n_total - common
    return (common >= (p.threshold - 1e-9) * union) & (union > 0)


def _crowded(common, log_df, flat, n_flat, texts: int, p: NearDup):
    """Similar without idf, in a bucket of so many texts; ``log_df`` is the sum of weight times ln df of what is shared."""
    return _similar(common, flat, n_flat, p) & (log_df <= np.log(p.apart * texts) * common)


def _star(n: int, p: NearDup):
    """Over partitions sorted by group, pivots first: links of the members to the first pivot that they resemble."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivots, found = None, [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            columns = [_one(table, k).to_pylist() for k in ("g", "pivot", "texts", "k1", "k2", "total", "flat")]
            for g, pivot, texts, k1, k2, total, flat, own in zip(*columns, _read(table)):
                if g != current:
                    current, pivots = g, []
                for a1, a2, other, n_flat, theirs in pivots:
                    if (a1, a2) == (k1, k2):
                        continue
                    count, df = _shared(own, theirs)
                    near = _similar(float(weight(count, df, n).sum()), total, other, p)
                    if not near and texts >= p.crowd:
                        w = flat_weight(count)
                        near = _crowded(float(w.sum()), float((w * np.log(df)).sum()), flat, n_flat, texts, p)
                    if near:
                        found.append((a1, a2, k1, k2))
                        break
                if pivot:  # without its batch
                    pivots.append((k1, k2, total, flat, tuple(x.copy() for x in own)))
            if len(found) > 50_000:
                yield _links(found)
                found = []
        yield _links(found)

    return run


def _links(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[]] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a1", "a2", "b1", "b2"])


def _across(n: int, p: NearDup):
    """Over partitions sorted by group: links between members of different classes, as links of the classes.

    A group is two blocks of members.  A shingle that occurs c times is c
    elements of weights ``g(1) - g(0)``, ``g(2) - g(1)`` ... times its idf, with
    g(c) = 1 + ln c and g(0) = 0, so that the sum of minima is a matrix product.
    """

    def similar(total: np.ndarray, flat: np.ndarray, sets: list[tuple], texts: int) -> np.ndarray:
        many = len(sets)
        doc = np.repeat(np.arange(many), [len(s[0]) for s in sets])
        shingle, count, df = (np.concatenate([s[i] for s in sets]) for i in range(3))
        count = count.astype(np.int64)
        level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        element = mix(np.repeat(shingle, count) * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64))
        step = np.ones(len(level))
        more = level > 1
        step[more] = np.log(level[more]) - np.log(level[more] - 1)
        doc = np.repeat(doc, count)
        order = np.argsort(element, kind="stable")
        element, doc, step = element[order], doc[order], step[order]
        # with idf; in a crowd also without, and times ln df
        steps = [np.sqrt(step * np.repeat(x, count)[order]) for x in (idf_of(df, n), *([np.ones(len(df)), np.log(df)] if texts >= p.crowd else []))]
        common = [np.zeros((many, many)) for _ in steps]
        run = np.cumsum(np.concatenate(([False], element[1:] != element[:-1]))) if len(element) else element
        for a in range(0, int(run[-1]) + 1 if len(run) else 0, 4096):
            lo, hi = np.searchsorted(run, [a, a + 4096])
            m = np.zeros((many, 4096))
            for own, s in zip(common, steps):
                m[doc[lo:hi], (run[lo:hi] - a).astype(np.int64)] = s[lo:hi]
                own += m @ m.T
        near = _similar(common[0], total[:, None], total[None, :], p)
        return near | _crowded(*common[1:], flat[:, None], flat[None, :], texts, p) if len(common) > 1 else near

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _runs(batches, "g"):
            classes = list(zip(_one(table, "c1").to_pylist(), _one(table, "c2").to_pylist()))
            if len(set(classes)) < 2:
                continue
            near = similar(_one(table, "total").to_numpy(), _one(table, "flat").to_numpy(), _read(table), _one(table, "texts")[0].as_py())
            found = {tuple(sorted((classes[x], classes[y]))) for x, y in zip(*np.nonzero(np.triu(near, 1))) if classes[x] != classes[y]}
            yield _links([(*a, *b) for a, b in sorted(found)])

    return run


# --------------------------------------------------------------------------- the operator


def _pair(a: str, b: str, name: str):
    return F.struct(F.col(a).alias("k1"), F.col(b).alias("k2")).alias(name)


def _components(links: DataFrame) -> DataFrame:
    """k1, k2 and their root."""
    roots = connected_components(links.select(_pair("a1", "a2", "a"), _pair("b1", "b2", "b")))
    return roots.select("node.k1", "node.k2", "root")


def _classes(docs: DataFrame, doc_id: str, text: str, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, th (hash of its text), k1 and k2 (its words), and of words that are not alone their root and class_id."""
    with small_batches(docs.sparkSession):  # all that runs Python is written in here
        return _classed(docs, doc_id, text, p)


def _classed(docs: DataFrame, doc_id: str, text: str, p: NearDup) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("th"), col(text).cast("string").alias("text"))
    laid = written(rows.mapInArrow(_lay(p), _LAID.format(rows.schema["doc_id"].dataType.simpleString())), "laid", "zstd")
    n = laid.count()
    signed = laid.select("doc_id", "th", "k1", "k2")
    copies = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))

    texts = laid.where("copies > 0").select("block", "k1", "k2", "text")
    frequencies = document_frequencies(laid, p)
    banded = texts.mapInArrow(_sign(frequencies, n, p), "k1 long, k2 long, size long, band int, value long").distinct()
    banded = written(banded, "banded")
    total = banded.count()
    member = F.xxhash64("k1", "k2")
    bucket = banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum((member % 1_000_000_007)).alias("s1"), F.bit_xor(member).alias("s2")).where("n > 1")
    # buckets of the same members are one
    bucket = bucket.groupBy("n", "size", "s1", "s2").agg(F.min(F.struct("band", "value")).alias("one"))
    bucket = bucket.select("n", F.col("size").alias("sizes"), "one.band", "one.value")
    members = dealt_join(banded, bucket, ["band", "value"], "n", ["k1", "k2"], total)
    members = written(members.select(F.xxhash64("band", "value").alias("bucket"), "n", "sizes", "k1", "k2"), "members")

    # the shared shingles of all members, once
    places = members.select("k1", "k2").distinct().join(laid.where("copies > 0").groupBy("k1", "k2").agg(F.min("block").alias("block")), ["k1", "k2"])
    wanted = deal(places.select("block", "k1", "k2"), "block", "wanted", max(1, ways // 16))  # two numbers for a text
    sets = written(texts.mapInArrow(_sets(frequencies, wanted, n, p), _SETS), "sets")

    # every member against the bucket's pivots
    cells = F.greatest(F.ceil(F.col("n") / max(1, p.block // 4)), F.ceil(F.col("sizes") / p.unit)).cast("int")
    share = F.pmod(F.xxhash64("k2", "k1"), F.lit(p.pivots))
    least_of = F.array(*[F.min(F.when(share == j, F.struct("k1", "k2"))) for j in range(p.pivots)])
    pivots = members.groupBy("bucket").agg(F.filter(least_of, lambda k: k.isNotNull()).alias("pivots"), F.max(cells).alias("cells"), F.max("n").alias("texts"))
    every = members.select("bucket", F.col("n").alias("texts"), F.lit(False).alias("pivot"), F.pmod(F.xxhash64("k2", "k1"), cells).cast("int").alias("cell"), "k1", "k2")
    first = pivots.select("bucket", "texts", F.explode("pivots").alias("k"), "cells").select("bucket", "texts", F.lit(True).alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "k.k1", "k.k2")
    grouped = every.unionByName(first).join(sets, ["k1", "k2"]).withColumn("g", F.xxhash64("bucket", "cell"))
    grouped = grouped.select("g", "pivot", "texts", "k1", "k2", "total", "flat", "shingles", "counts", "df").repartition(ways, "g").sortWithinPartitions("g", F.desc("pivot"), "k1", "k2")
    links = grouped.mapInArrow(_star(n, p), "a1 long, a2 long, b1 long, b2 long")
    within = written(_components(links), "roots")

    # buckets of several classes: what is outside the largest class against all members
    classed = members.join(within, ["k1", "k2"], "left").select("bucket", "k1", "k2", F.coalesce("root", F.struct("k1", "k2")).alias("class"))
    sizes = classed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    split = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
    half = max(1, p.block // 2)
    split = split.select("bucket", F.col("top.class").alias("largest"), "all", F.ceil(F.col("all") / half).cast("int").alias("columns"), F.ceil((F.col("all") - F.col("top.n")) / half).cast("int").alias("lines"))
    split = dealt_join(classed, split, ["bucket"], "all", ["k1", "k2"], total)
    place = F.xxhash64("k2", "k1")
    column = split.select("bucket", F.col("all").alias("texts"), "k1", "k2", "class", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"), F.pmod(place, "columns").cast("int").alias("column"))
    line = split.where(F.col("class") != F.col("largest")).select("bucket", F.col("all").alias("texts"), "k1", "k2", "class", F.pmod(place, "lines").cast("int").alias("line"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    # a member that stands in the line and in the column of a group is there once
    both = column.unionByName(line).select(F.xxhash64("bucket", "line", "column").alias("g"), "texts", "k1", "k2", "class").distinct()
    grouped = both.join(sets, ["k1", "k2"]).select("g", "texts", F.col("class.k1").alias("c1"), F.col("class.k2").alias("c2"), "total", "flat", "shingles", "counts", "df")
    grouped = grouped.repartition(ways, "g").sortWithinPartitions("g")
    more = grouped.mapInArrow(_across(n, p), "a1 long, a2 long, b1 long, b2 long")
    merged = _components(more)

    # the classes' own nodes and roots, then those of single documents that were linked in the second step
    nodes = within.groupBy("root").agg(F.count("*").alias("n"))
    whole = merged.select(F.struct("k1", "k2").alias("root"), F.col("root").alias("whole"))
    nodes = nodes.join(whole, "root", "left").select("root", "n", F.coalesce("whole", "root").alias("whole"))
    roots = dealt_join(within, nodes, ["root"], "n", ["k1", "k2"], within.count()).select("k1", "k2", F.col("whole").alias("root"))
    alone = merged.join(within, ["k1", "k2"], "left_anti").select("k1", "k2", "root")
    roots = written(roots.unionByName(alone), "roots")
    classes = copies.join(roots, ["k1", "k2"], "left").select("k1", "k2", "least", "n", "root")
    linked = classes.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("nodes"))
    linked = dealt_join(linked, least, ["root"], "nodes", ["k1", "k2"], roots.count()).select("k1", "k2", "n", "root", "class_id")
    alone = classes.where("root is null and n > 1").select("k1", "k2", "n", F.struct("k1", "k2").alias("root"), F.col("least").alias("class_id"))
    classes = written(linked.unionByName(alone), "classes")
    discard(spark, frequencies.path, wanted.path, banded, members, sets, within, roots)
    return signed, classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least doc_id of its class), kept (whether it is that one).

    * A null text is a class of its own; so is one without words unless an
      equal text exists.  A document of one to four words is one shingle.
    * Rows of equal doc_id and words share a class and their ``kept``.  Null ids
      take part; a class that holds nothing else has the class_id null.
    * Ids may be of any type that can be ordered.  Other columns are not read; an
      empty table gives an empty result.
    """
    signed, classes = _classes(docs, doc_id, text, p)
    out = dealt_join(signed, classes, ["k1", "k2"], "n", ["doc_id", "th"], signed.count(), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """Exactly one row of each class: that of the least doc_id (null last), of these that of the least hash of its text.

    Of rows with equal doc_id and text one stays, by a hash of the other columns.
    Rows of null text are classes of their own and all stay.  Columns are those of
    ``docs``.
    """
    signed, classes = _classes(docs, doc_id, text, p)
    rows = dealt_join(signed, classes, ["k1", "k2"], "n", ["doc_id", "th"], signed.count()).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    rows = written(rows, "class-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"), F.count("*").alias("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    rows = dealt_join(rows, first, ["root"], "rows", ["doc_id", "th"], rows.count()).where(~stays | (F.col("n") > 1))
    rows = written(rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), stays.alias("_stays")), "gone")

    given = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(given))])
    id_, said = (docs[f"c{[c.lower() for c in given].index(x.lower())}"] for x in (doc_id, text))
    same = id_.eqNullSafe(rows["_id"]) & said.isNotNull() & (F.xxhash64(said) == rows["_th"])
    left = docs.join(rows, same, "left_anti")
    if rows.where("_stays").isEmpty():
        return left.toDF(*given)
    repeated = docs.join(rows.where("_stays"), same)
    hashed = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = repeated.groupBy("_id", "_th").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("_row"))
    return left.unionByName(one.select("_row.*")).toDF(*given)
