"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one binary logistic regression over
hashed byte n-grams predicts each bit.  A document's language is that of the
codeword with the least summed logistic loss (loss-weighted decoding), so a few
wrong bits are corrected.  A document whose nearest two codewords lie within
``ambiguous`` of each other in loss per bit is flagged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import at, col, columns_of, free_name, map_rows
from .textvec import LOWER, doc_ranges, mix, utf8


@dataclass(frozen=True)
class LangId:
    """``sample``: bound on the labelled documents that training takes, dealt evenly to the languages.

    ``languages``: bound on the labels that are learned, the most frequent ones.
    """

    sample: int = 4000
    languages: int = 1000
    dims: int = 2048
    max_bits: int = 63
    steps: int = 300
    ambiguous: float = 0.02
    seed: int = 7


UNKNOWN = "und"
_CHUNK_DOCS = 512


def codewords(n: int, p: LangId = LangId()) -> np.ndarray:
    """n rows of +1 and -1.

    Up to seven languages: the exhaustive code, whose words differ in more than
    half of their 2 ** (n - 1) - 1 bits.  Beyond: of many random codes that with
    the largest least distance.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return _exhaustive(n)
    bits = min(p.max_bits, 10 * int(np.ceil(np.log2(n))))
    rng = np.random.default_rng(p.seed)
    best, reached = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        distance = (bits - code @ code.T) / 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > reached:
            best, reached = code, least
    return best


def _exhaustive(n: int) -> np.ndarray:
    """All dichotomies in which the first language is +1 and not all are."""
    columns = [[1, *(1 - 2 * ((k >> i) & 1) for i in range(n - 1))] for k in range(1, 1 << (n - 1))]
    return np.array(columns, dtype=float).T


def ngram_features(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, features) by ranges of documents: hashed counts of 2- and 3-grams of bytes, square-rooted and of unit length.

    A-Z and the letters of U+00C0 to U+00DE are taken in lower case; every
    ASCII character that is no letter counts as one and the same separator.
    """
    data, offsets = utf8(column)
    for a, b in doc_ranges(offsets, _CHUNK_DOCS):
        part = LOWER[data[offsets[a] : offsets[b]]]
        if len(part) > 1:
            after_c3 = np.flatnonzero(part[:-1] == 0xC3) + 1
            upper = after_c3[(part[after_c3] >= 0x80) & (part[after_c3] <= 0x9E) & (part[after_c3] != 0x97)]
            part[upper] += 32
        part[(part < 97) | ((part > 122) & (part < 128))] = 32
        n = b - a
        out = np.zeros(n * dims)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets[a : b + 1])) * dims
        wide = part.astype(np.uint64)
        for k in (2, 3):
            if len(part) < k:
                continue
            gram = np.full(len(part) - k + 1, k, np.uint64)
            for j in range(k):
                gram = (gram << np.uint64(8)) | wide[j : len(part) - k + 1 + j]
            same = doc[: len(gram)] == doc[k - 1 :]
            slot = (mix(gram) % np.uint64(dims)).astype(np.int64) + doc[: len(gram)]
            out += np.bincount(slot[same], minlength=n * dims)
        out = np.sqrt(out.reshape(n, dims))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        yield a, out / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    params: LangId
    #: Texts whose nearest codeword has a greater loss per bit are of no language.
    limit: float = np.inf

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss per bit of every document to every codeword."""
        margin = x @ self.weights + self.bias
        plus, minus = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        return (plus @ (self.code.T > 0) + minus @ (self.code.T < 0)) / self.code.shape[1]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], p: LangId) -> Model:
    """Full-batch gradient descent with momentum on all bits at once.

    ``x`` stays in single precision, and in one copy.
    """
    code = codewords(len(languages), p)
    target = code[y]
    w, b = np.zeros((p.dims, code.shape[1])), np.zeros(code.shape[1])
    count = np.bincount(y, minlength=len(languages)).astype(float)
    importance = (1 / count[y] / len(languages))[:, None]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(p.steps):
        z = -target / (1 + np.exp(np.clip(target * (x @ w.astype(np.float32) + b), -30, 30))) * importance
        vw = 0.9 * vw - 8.0 * (x.T @ z.astype(np.float32) + 1e-5 * w)
        vb = 0.9 * vb - 1.0 * z.sum(0)
        w, b = w + vw, b + vb
    # calibrated: as far as any labelled text is, half the loss of coin flips at least
    margin = x @ w.astype(np.float32) + b
    loss = (np.logaddexp(0, -margin) @ (code.T > 0) + np.logaddexp(0, margin) @ (code.T < 0)) / code.shape[1]
    return Model(languages, code, w, b, p, max(float(np.log(2)) / 2, float(loss.min(1).max())))


_PICKED = "lang string, place long, x binary"


def fit(labelled: DataFrame, p: LangId = LangId(), text: str = "text", lang: str = "lang", order: str = "doc_id") -> Model | None:
    """A model of the languages in ``labelled``; None if no row has both text and label.

    Training takes ``sample`` rows at most, evenly by language: those with the
    least hash of ``order`` and text (neither is a feature as such); rows that
    repeat both count once.  It runs in one task; only the weights reach the driver.
    """
    place = F.xxhash64(col(order).cast("string"), col(text), F.lit(p.seed))
    rows = labelled.where(col(lang).isNotNull() & col(text).isNotNull() & col(text).rlike(r"\p{L}")).select(col(lang).cast("string").alias("lang"), col(text).alias("text"), place.alias("place"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.languages).collect()}
    if not counts:
        return None
    each = max(1, p.sample // len(counts))
    # twice as many as are wanted lie below these hashes, give or take; the least of them are taken in the end
    below = {k: min(2**63 - 1, -(2**63) + (2 * each + 64) * 2**64 // n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(v) for pair in below.items() for v in pair])
    picked = rows.where(F.col("place") <= limit[F.col("lang")]).dropDuplicates(["lang", "place"]).select("lang", "place", "text")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in ngram_features(batch.column(2), p.dims):
                yield pa.record_batch([*(batch.column(i).slice(a, len(x)) for i in range(2)), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], ["lang", "place", "x"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        rows.sort()
        names = sorted({r[0] for r in rows})
        taken: dict[str, int] = {}
        kept = []
        for r in rows:
            taken[r[0]] = taken.get(r[0], 0) + 1
            if taken[r[0]] <= each:
                kept.append(r)
        del rows
        x = np.frombuffer(b"".join(r[2] for r in kept), np.float32).reshape(-1, p.dims)
        model = train(x, np.array([names.index(r[0]) for r in kept]), names, p)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learned = picked.mapInArrow(features, _PICKED).repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(learned.model)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with one more column, the last: struct(lang, score, margin, ambiguous, distance).

    It is called ``_lang``, with more underscores where ``docs`` has such a
    column.  ``distance`` is the loss per bit to the nearest codeword, infinite
    for ``und``.

    A null text, or one without a letter, is ``und`` with score 0, as is
    everything where no model could be learned.  Other columns pass through.
    """
    name, letter, place = free_name(docs, "_lang"), free_name(docs, "_letter"), at(docs, text)
    inner = docs.select(*columns_of(docs), F.coalesce(col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter))
    out_type = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("ambiguous", pa.bool_()), ("distance", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            result: list[dict] = []
            has_letter = batch.column(len(names) - 1).to_pylist()
            for a, x in ngram_features(batch.column(place), model.params.dims if model else 2):
                if model:
                    loss = model.losses(x)
                    order = np.argsort(loss, axis=1, kind="stable")
                    best = order[:, 0]
                    at = np.arange(len(x))
                    gap = loss[at, order[:, 1]] - loss[at, best] if loss.shape[1] > 1 else np.full(len(x), np.inf)
                    odds = np.exp(-model.code.shape[1] * (loss - loss[at, best][:, None]))
                    score = 1 / odds.sum(1)
                for d in range(len(x)):
                    if model and has_letter[a + d]:
                        result.append({"lang": model.languages[best[d]], "score": float(score[d]), "margin": float(gap[d]), "ambiguous": bool(gap[d] < model.params.ambiguous), "distance": float(loss[d, best[d]])})
                    else:
                        result.append({"lang": UNKNOWN, "score": 0.0, "margin": 0.0, "ambiguous": True, "distance": float("inf")})
            yield pa.record_batch([*batch.columns, pa.array(result, out_type)], [*names, "added"])

    found = map_rows(inner, run, name, "struct<lang:string,score:double,margin:double,ambiguous:boolean,distance:double>")
    return found.select(*columns_of(docs), col(name))


def held_out(doc_id: str = "doc_id"):
    """Rows that training must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
