"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths, as attention is masked to each piece).  Pieces are
placed longest first.  Of the open sequences in which a piece fits in every
dimension, that with the least residual norm after placing it (or the largest
weighted dot product of piece and residual) takes it.

Packing is done in blocks of pieces.  A piece's block is a hash of its place,
so every block has the same mix of lengths and wastes part of one sequence only.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .names import col
from .textvec import LOWER, doc_ranges, run_hashes, utf8


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence; the weights are those of the dimensions in a score."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"  # or "dot"
    block: int = 20_000


# --------------------------------------------------------------------------- tokens

#: Beyond U+017F, and for U+0130, composition and lower case take more than single characters; U+001C to U+001F are
#: white space to Python only.
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")
# Fixed value: how the vocabulary's tokenizer takes a lower-case text apart, for characters up to U+017F.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\s\w]|_)+")

#: Classes of bytes: white space, letters and digits, punctuation but the apostrophe, all others.
_SPACE, _ALNUM, _PUNCT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _ALNUM
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = _PUNCT

_SLOT_BITS = 20
_POOL = 6_000_000


def segments(part: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (in lower case) of stretches that tokenise independently.

    Texts are cut at ASCII white space, and around runs of punctuation that have
    ASCII letters, digits, white space or nothing on both sides.
    """
    n = len(part)
    kind = _CLASS[part]
    fresh = np.zeros(n + 1, bool)  # a document starts here
    fresh[base] = True
    inside = kind != _SPACE
    punct = kind == _PUNCT
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero(punct)
    if len(at):
        first = np.concatenate(([True], (np.diff(at) > 1) | fresh[at[1:]]))
        begin = at[first]
        stop = at[np.concatenate((first[1:], [True]))] + 1
        before = np.where(fresh[begin], _SPACE, kind[begin - 1])
        after = np.where(fresh[stop], _SPACE, kind[np.minimum(stop, n - 1)])
        safe = (before <= _ALNUM) & (after <= _ALNUM)
        cut[begin[safe]] = True
        cut[stop[safe]] = True
    cut |= fresh
    previous = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~previous | cut[:-1]))
    following = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~following | cut[1:])) + 1
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    return start, end, run_hashes(LOWER[part[inside]], end - start)


class VectorTokenizer:
    """Token ids of whole columns of texts.

    For the word vocabulary: its tokenizer drops white space, lower-cases, takes
    the text apart into words, and merges within words only.  Segments are found
    and hashed (64 bits) on the bytes; each new one is worked out once and then
    looked up in a table of bounded size.  Segments with characters beyond U+017F
    are left to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        #: The printable character that stands for each byte in a byte-level vocabulary.
        self.characters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.place = np.zeros(1 << _SLOT_BITS, np.int64)
        self.size = np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool = np.zeros(_POOL + (1 << 20), np.uint32)
        self.used = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def segment(self, data: bytes) -> list[int]:
        text = data.decode()
        if _NOT_LATIN.search(text):
            return self.whole(text)
        text = text.lower()
        words = (text,) if text.isalpha() else _WORDS.findall(text)
        tokenize, characters = self.model.tokenize, self.characters
        return [t.id for w in words for t in tokenize((w if w.isascii() else w.encode().decode("latin-1")).translate(characters))]

    def _ids(self, part: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts and where each text's begin."""
        start, end, h = segments(part, base)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(base), np.int64)
        if self.used > _POOL:
            self._clear()
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        place, size = self.place[slot], self.size[slot]
        missing = np.flatnonzero(self.keys[slot] != h)
        if len(missing):
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            data = part.tobytes()
            made = [self.segment(data[start[i] : end[i]]) for i in missing[first].tolist()]
            sizes = np.fromiter(map(len, made), np.int32, len(made))
            flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(sizes.sum()))
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.used], np.zeros(len(flat) + (1 << 20), np.uint32)))
            self.pool[self.used : self.used + len(flat)] = flat
            places = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            place[missing], size[missing] = places[which], sizes[which]
            at = (new >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            self.keys[at], self.place[at], self.size[at] = new, places, sizes
        upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        ids = self.pool[np.repeat(place - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, base)]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first text, ids of it and the following ones); null counts as empty."""
        data, offsets = utf8(texts)
        for a, b in doc_ranges(offsets, 4096):
            part = data[offsets[a] : offsets[b]]
            base = offsets[a : b + 1] - offsets[a]
            ids, bounds = self._ids(part, base)
            out = [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            raw = part.tobytes()
            if any(s in raw for s in self.special):
                for d in range(b - a):
                    if any(s in raw[base[d] : base[d + 1]] for s in self.special):
                        out[d] = np.array(self.whole(raw[base[d] : base[d + 1]].decode()), np.uint32)
            yield a, out


_tokenizers: dict[str, VectorTokenizer] = {}


def worker_tokenizer(path: str) -> VectorTokenizer:
    """One for all tasks of a worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = VectorTokenizer(path)
    return _tokenizers[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, row, piece, start, length, ids_crc32[, ids]).

    A document's ids are those of its text and ``end_id``.  Documents longer
    than ``size`` are cut into pieces of ``size``.  A null text counts as empty
    and so gives one piece of one id.  ``row`` tells rows of one doc_id apart.
    Ids may be of any type, null and repeated; other columns are not read.
    """
    path = tokenizer or tokenizer_path()
    docs = docs.select(col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), col(text).alias("text"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        end = np.array([end_id], np.uint32)
        names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = batch.column(1)
            for a, found in tokenizer.column(batch.column(2)):
                out, of = [], []
                for k, tokens in enumerate(found):
                    data = np.concatenate((tokens, end)).astype("<u4").tobytes()
                    for n, at in enumerate(range(0, len(data), 4 * size)):
                        piece = data[at : at + 4 * size]
                        of.append(a + k)
                        out.append((rows[a + k].as_py(), n, at // 4, len(piece) // 4, zlib.crc32(piece), *[piece] * with_ids))
                yield pa.record_batch([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names)

    return docs.mapInArrow(run, kinds)


# --------------------------------------------------------------------------- packing


def best_fit(length: np.ndarray, c: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece.

    Only sequences that still have room are looked at.  Pieces longer than
    ``tokens``, or alone beyond a limit, are refused.
    """
    size = np.array([c.tokens, c.documents, c.attention], float)
    weights = np.array(c.weights)
    n = len(length)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and (length.max() > c.tokens or c.documents < 1 or float(length.max()) ** 2 > c.attention):
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(-length, kind="stable")
    full = (length[order] == c.tokens).sum()
    bins[order[:full]] = np.arange(full)
    count = int(full)
    order = order[full:]
    # the residual capacities of open sequences
    left = np.zeros((3, max(1, len(order))))
    name = np.zeros(max(1, len(order)), np.int64)
    opened = 0
    smallest = int(length.min()) if n else 0
    for i in order.tolist():
        item = np.array([length[i], 1, float(length[i]) ** 2])
        now = left[:, :opened]
        fits = np.flatnonzero((now[0] >= item[0]) & (now[1] >= 1) & (now[2] >= item[2]))
        if len(fits):
            if c.score == "dot":
                value = -(((item / size) * weights) @ (now[:, fits] / size[:, None]))
            else:
                value = weights @ ((now[:, fits] - item[:, None]) / size[:, None]) ** 2
            at = int(fits[np.argmin(value)])
        else:
            at = opened
            left[:, at], name[at] = size, count
            opened, count = opened + 1, count + 1
        bins[i], offsets[i] = name[at], c.tokens - left[0, at]
        left[:, at] -= item
        if left[0, at] < smallest or left[1, at] < 1:  # closed: the last open one takes its place
            opened -= 1
            left[:, at], name[at] = left[:, opened], name[opened]
    return bins, offsets


def pack(pieces: DataFrame, c: Capacity = Capacity()) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0).

    ``pieces`` has ``row``, ``piece`` and ``length`` and must be a written table,
    as it is read twice.  The number of blocks follows from the number of rows.
    """
    total = pieces.count()
    blocks = max(1, round(total / c.block))
    width = 1 << 32
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"]).reset_index(drop=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), c)
        block = int(pdf["_block"].iloc[0])
        return pdf.drop(columns="_block").assign(sequence_id=bins + block * width, offset=offsets)

    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    return dealt.groupBy("_block").applyInPandas(run, schema)


def packed(docs: DataFrame, c: Capacity = Capacity(), doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """All documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    An empty table gives an empty result, repeated rows are packed each.  Token ids stay out of the shuffle unless ``with_ids`` asks for them.
    """
    pieces = written(token_pieces(docs, doc_id, text, c.tokens, tokenizer=tokenizer, with_ids=with_ids), "pieces")
    return pack(pieces, c).drop("row")
