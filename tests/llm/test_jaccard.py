import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard
from tidemark.llm.graph import components


def brute(rows):
    found = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = found[a], found[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: (len(found[d]), top(d)) for d in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One TWO"), (4, "one  two\nthree"), (5, "a b c d e"), (6, "a b c d e f")]
    while len(rows) < n:
        length = int(rng.choice([3, 6, 9, 14, 20, 35, 60, 120, 300]) * rng.uniform(0.8, 1.3))
        base = rng.choices(vocabulary, k=length)
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, length // 18))):
                spot = rng.randrange(len(own))
                own[spot : spot + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            rows.append((len(rows), " ".join(own)))
        if rng.random() < 0.3:
            rows.append((len(rows), passage + " " + " ".join(rng.choices(vocabulary, k=40))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute(rows)


def test_one_id_with_several_texts_keeps_the_links_of_each(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, None), (4, "one two three"), (5, "one two three"), (6, "")]
    rows += [(7, "k l m n o p q r s t"), (7, "k l m n o p q r s t"), (8, "k l m n o p q r s t z")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 4, 1), (2, 5, 1), (3, 5, 1), (4, 0, 4), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 6, 7), (8, 7, 7)}


def test_leaders_are_rows(spark):
    a, b = "a b c d e f g h i j k", "p q r s t u v w x y z"
    rows = [(1, a), (1, b), (2, a + " 1"), (3, b + " 2"), (None, a), (None, "own text of a row without id"), (4, None), (4, ""), (5, b), (5, b), (6, "lone text here"), (6, "lone text here")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, mark int")
    got = jaccard.leaders(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, "own text of a row without id"), (4, None), (4, ""), (6, "lone text here")], key=str)
    assert jaccard.leaders(df.limit(0)).count() == 0


def test_a_third_of_rows_are_copies_and_ids_are_null(spark):
    rows = corpus(4, 120)
    rows += [(1000 + i, "the same text that is copied over and over in this table") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == brute(rows)


def test_allocation_follows_the_counts():
    none, many = (jaccard.allocate(np.full(len(jaccard.limits()[0]), n)) for n in (0, 10**7))
    assert set(none) == {1}
    assert 2 in many[:12] and set(many[20:40]) == {1}


@pytest.mark.parametrize("units", [1, 2])
def test_pigeonhole_holds_for_each_allocation(units):
    rng = np.random.default_rng(3)
    allocated = tuple([units] * len(jaccard.limits()[0]))
    for _ in range(150):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, len(x) // 9 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 9 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and len(y):
            row, _, _, sig, _ = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), allocated)
            assert len(np.intersect1d(sig[row == 0], sig[row == 1]))


def test_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for spot in rng.sample(range(150), rng.randint(0, 3)):
            own[spot] = f"x{i}_{spot}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "x " * 30000), (None, "a b c d e f")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_pigeonhole_holds_for_random_pairs():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, len(x) // 9 + 1))
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 9 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or not len(y):
            continue
        row, band, seg, sig, filled = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        key, need, spare = jaccard.needs(np.array([len(x), len(y)]), row, band, seg, filled)
        shared = np.intersect1d(sig[row == 0], sig[row == 1])
        assert len(shared)
        common = set(band[np.isin(sig, shared)].tolist())
        assert any(all(len(np.unique(seg[(row == r) & (band == b) & np.isin(sig, shared)])) >= spare[key == r * 64 + b][0] for r in (0, 1)) for b in common)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0
