from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import SMALL

from tarn.llm import neardup, queries
from tarn.llm.components import connected_components
from tests.llm.test_text_ops import plain_words


def bag(text, k=5):
    w = plain_words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute(rows):
    """Weighted Jaccard similarity of all pairs that share a shingle, by dictionaries: (1 + ln count) (1 + ln((1 + N) / (1 + df)))."""
    n = len(rows)
    bags = [bag(t) for _, t in rows]
    holders = {}
    for i, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, []).append(i)
    weights = [{s: (1 + math.log(c)) * (1 + math.log((1 + n) / (1 + len(holders[s])))) for s, c in b.items()} for b in bags]
    total = [sum(w.values()) for w in weights]
    shared = Counter()
    for s, docs in holders.items():
        for x, j in enumerate(docs):
            for i in docs[:x]:
                shared[i, j] += min(weights[i][s], weights[j][s])
    return {(i, j): low / (total[i] + total[j] - low) for (i, j), low in shared.items()}


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_copies(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        for edits in (0, 0, 1, 2, 4, 8):
            words = base[:]
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = near_copies()
    similar = brute(rows)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, class_id int, k1 int")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    want = closure(len(rows), [ij for ij, s in similar.items() if s >= 0.8])
    missed = [ij for ij, s in similar.items() if s >= 0.8 and got[ij[0]] != got[ij[1]]]
    assert len(missed) <= 1
    for i in range(len(rows)):
        for j in range(i):
            assert got[i] != got[j] or want[i] == want[j]


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    similar = brute([(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: r.class_id for r in queries.op9_minhash_near_dedup(spark, SMALL).collect()}
    want = closure(len(docs), [ij for ij, s in similar.items() if s >= 0.8])
    assert [docs[x].doc_id for x in want] == [got[d.doc_id] for d in docs]


@pytest.mark.parametrize("block", [256, 4])
def test_edges(spark, block):
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(5, base), (3, base.upper() + "!"), (9, base + " z"), (1, None), (2, None), (4, ""), (6, ""), (7, "?!"), (8, "?!"), (10, "one two"), (11, "One, two"), (None, base), (5, base), (12, "x"), (None, "y")]
    rows += [(100 + i, " ".join([*(f"a{k}" for k in range(59)), f"b{i}"])) for i in range(20)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, root string")
    out = neardup.near_duplicates(docs, p=neardup.NearDup(block=block)).collect()
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in out), key=str)
    assert len(out) == len(rows)
    by = {d: c for d, c, _ in got if d is not None}
    assert {by[i] for i in (5, 3, 9, *range(100, 120))} == {3}
    assert (by[1], by[2], by[4], by[6], by[7], by[8], by[10], by[11], by[12]) == (1, 2, 4, 4, 7, 7, 10, 10, 12)
    assert sorted((str(c) for d, c, _ in got if d is None)) == ["3", "None"]
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 10, 12]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_class(spark):
    """Ids that repeat with other texts, rows that repeat, and null ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "p"), (7, a, "p"), (7, b, "q"), (9, b + "!", "q"), (3, c, "x"), (3, c, "y"), (3, c, "y"), (None, c, "z"), (None, "n " + a[:20], "z"), (None, "n " + a[:20], "z"), (4, None, "w"), (4, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(1, a), (7, b), (3, c), (None, "n " + a[:20]), (4, None), (4, None)], key=str)
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_recall_on_a_table(spark):
    """Of all pairs of similarity 0.8 or more, 99 % share a class; no class holds what no chain of such pairs joins."""
    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    near = [ij for ij, s in brute([(d.doc_id, d.text) for d in docs]).items() if s >= 0.8]
    got = {r.doc_id: r.class_id for r in queries.op9_minhash_near_dedup(spark, sf).collect()}
    found = [got[docs[i].doc_id] == got[docs[j].doc_id] for i, j in near]
    assert near and sum(found) >= 0.99 * len(found)
    want = closure(len(docs), near)
    for i, d in enumerate(docs):
        assert want[i] == want[next(j for j, e in enumerate(docs) if e.doc_id == got[d.doc_id])]


@pytest.mark.parametrize("unit", [2_000_000, 700])
def test_document_frequencies(spark, unit):
    """Every block gets the counts of all rows, however the rows are dealt; repeated rows count each."""
    p = neardup.NearDup(unit=unit)
    rows = [(i, 0, f"all of us say this here and {i} {i} {i}" + (" half of us say that too" if i % 2 else "")) for i in range(300)] + [(7, 0, "one row that occurs twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, th long, text string").repartition(7)
    laid = neardup.written(docs.mapInArrow(neardup._lay(p), neardup._LAID.format("bigint")), "laid")
    assert laid.count() == len(rows) and laid.where("copies > 0").agg({"copies": "sum"}).first()[0] == len(rows)
    known = neardup._Frequencies(neardup.document_frequencies(laid, p))
    df = Counter(s for _, _, t in rows for s in bag(t))
    for r in laid.where("copies > 0").collect():
        (w,) = neardup.words_of(pa.array([r.text]))
        _, shingle, count = neardup.shingle_counts(w)
        assert sorted(known.of(r.block, shingle).tolist()) == sorted(df[s] for s in bag(r.text))


@pytest.mark.parametrize("block,pivots", [(256, 4), (4, 1)])
def test_large_buckets(spark, block, pivots):
    """Chains whose ends are unlike, and several classes in one bucket, against all pairs."""
    rng = random.Random(5)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{i}" for i in range(120)]
        for step in range(40):
            words = words[:]
            words[rng.randrange(120)] = f"x{chain}s{step}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    similar = brute(rows)
    # one sample a band: buckets hold what is hardly alike
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, p=neardup.NearDup(bands=40, rows=1, block=block, pivots=pivots)).collect()}
    assert closure(len(rows), [ij for ij, s in similar.items() if s >= 0.8]) == [got[i] for i in range(len(rows))]


def test_long_texts_among_short_ones(spark):
    long = " ".join(f"w{i % 9000}x{i // 7}" for i in range(40_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, None), (5, "a " * 30_000), (6, "a " * 30_001)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


def test_string_ids_and_odd_columns(spark):
    rows = [("b", "x " * 20, 1, "p"), ("a", "x " * 20, 2, "q"), (None, "other", 3, None), ("c", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `k1.x` int, _th string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {"a": "a", "b": "a", None: None, "c": "c"}
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted((r[0] or "", r[2] or 0) for r in left.collect()) == [("", 3), ("a", 2), ("c", 0)]


def test_common_weight_is_that_of_all_pairs():
    rows = near_copies(4)[:60]
    n = len(rows)
    (w,) = neardup.words_of(pa.array([t for _, t in rows]))
    doc, shingle, count = neardup.shingle_counts(w)
    held = Counter(shingle.tolist())
    sets = [(shingle[doc == d], count[doc == d].astype(np.uint32), np.array([held[x] for x in shingle[doc == d].tolist()])) for d in range(n)]
    for (i, j), s in brute(rows).items():
        total = [neardup.weight(sets[x][1], sets[x][2], n).sum() for x in (i, j)]
        low = neardup.common_weight(sets[i], sets[j], n)
        assert math.isclose(low / (sum(total) - low), s, rel_tol=1e-9)


def test_samples_estimate_similarity():
    rows = near_copies(3)[:80]
    p = neardup.NearDup(bands=64, rows=1)
    similar = brute(rows)
    (w,) = neardup.words_of(pa.array([t for _, t in rows]))
    doc, shingle, count = neardup.shingle_counts(w)
    held = Counter(shingle.tolist())
    df = np.array([held[x] for x in shingle.tolist()])
    _, bands = neardup.Sampler(p).bands(doc, shingle, neardup.weight(count, df, len(rows)), w.n_docs)
    error = [(bands[i] == bands[j]).mean() - s for (i, j), s in similar.items() if s > 0.3]
    assert abs(np.mean(error)) < 0.06 and np.std(error) < 0.12


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(7, 7), (100, 90), (90, 100), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {100: 90, 90: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowds(spark):
    """In a large group df is the group's own size; edits must not part its members, and what is mostly held elsewhere must not join them."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = [" ".join(base)]
    for i in range(300):  # two words of each copy changed
        words = base[:]
        for j in rng.sample(range(5, 115), 2):
            words[j] = f"e{i}x{j}"
        rows.append(" ".join(words))
    notice = [f"n{i}" for i in range(60)]
    rows += [" ".join([*notice, *(f"o{i}y{k}" for k in range(400))]) for i in range(3000)]  # a notice in long texts
    rows += [" ".join([*notice, *(f"s{i}z{k}" for k in range(4))]) for i in range(12)]  # and in short ones
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group = [i for i, t in rows if t.startswith("b0")]
    bags = {i: set(bag(t)) for i, t in rows if i in set(group)}
    near = [ij for x, j in enumerate(group) for i in group[:x] for ij in [(i, j)] if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])]
    want = closure(len(rows), near)
    assert len({want[i] for i in group}) == 1
    assert sum(got[i] == want[i] for i in group) >= 0.99 * len(group)
    assert all(got[i] == i for i, t in rows if t.startswith("n0"))
