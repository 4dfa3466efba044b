import hashlib
import random
from collections import Counter

import numpy as np

from tidemark.llm import _merge, suffixes


def brute(rows):
    raw = [(d, (t or "").encode()) for d, t in rows]
    met = Counter(x[i : i + 200] for _, x in raw for i in range(len(x) - 199))
    out = []
    for d, x in raw:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - 199):
            if met[x[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(b for b, g in zip(x, gone[1:], strict=False) if not g)
        out.append((d, len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.choice([30, 60, 120]))) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "y" * 201), (4, "ab" * 300), (5, "z" * 200), (6, "z" * 200), (7, "same " * 60)]
    while len(rows) < 70:
        text = " ".join(rng.choices(words, k=rng.randint(5, 200)))
        for p in rng.sample(passages, rng.randint(0, 2)):
            spot = rng.randint(0, len(text))
            text = text[:spot] + p + text[spot:]
        rows.append((len(rows), text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            own = list(text)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice("QRSTU")
            rows.append((len(rows), "".join(own)))
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = suffixes.cut(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string").repartition(3)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)


def test_many_copies_and_repeated_rows(spark, monkeypatch):
    base = corpus(3)[20][1] * 2
    rows = [(i, base) for i in range(90)] + [(5, base), (None, "q" * 500), (None, base[:150]), (1000, base[10:400])]
    got = suffixes.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)
    assert suffixes.cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = corpus(5)[30][1] * 2, corpus(6)[31][1] * 2
    rows = [(1, a), (1, b), (1, "short"), (2, "head " + a), (3, b + " tail"), (1, None), (None, a[:260]), (None, b[-260:])]
    got = suffixes.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)


def test_a_core_with_many_stretches_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 3)
    monkeypatch.setattr(suffixes, "FEW", 50)
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=330))
    rows = []
    for i in range(60):
        head, tail = ("".join(rng.choices("ijklmnop ", k=60)) for _ in range(2))
        own = list(passage)
        if i % 3:
            own[rng.randrange(330)] = "#"
        rows.append((i, head + "".join(own) + tail))
    got = suffixes.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows)


def test_names_of_strings_tell_periodic_texts_apart():
    # strings on which plain polynomial hashes modulo 2**64 collide
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    x = np.array(thue, np.uint8)
    y = 1 - x
    whole = np.array([0]), np.array([2048])
    from tidemark.llm import _text

    assert _text.Strings(x).of(*whole)[0] != _text.Strings(y).of(*whole)[0]
    z = np.concatenate([y[:50], x, y])
    assert _text.Strings(z).of(np.array([50]), np.array([2098]))[0] == _text.Strings(x).of(*whole)[0]


def test_loser_tree_equals_sorting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        runs, every = [], []
        for _ in range(rng.integers(1, 7)):
            a = rng.integers(0, 2, (rng.integers(1, 30), 6)).astype(np.uint8)
            a = a[np.lexsort(a.T[::-1])]
            runs.append(a)
            every += [bytes(x) for x in a]
        out = list(_merge.merged([_merge.pack(a, np.arange(len(a)))[0] for a in runs], 6))
        order = [bytes(runs[r][i]) for r, i, _ in out]
        assert order == sorted(every)
        for a, b, (_, _, shared) in zip(order, order[1:], out[1:], strict=False):
            assert shared == next((i for i in range(6) if a[i] != b[i]), 6)


def test_spans_of_many_rows_are_united_at_once():
    rng = np.random.default_rng(4)
    row, start = rng.integers(0, 50, 900), rng.integers(0, 3000, 900)
    end = start + rng.integers(1, 60, 900)
    found = list(zip(*(x.tolist() for x in suffixes._union(row, start, end)), strict=True))
    expected = []
    for r in range(50):
        held = {i for a, b in zip(start[row == r].tolist(), end[row == r].tolist(), strict=True) for i in range(2 * a, 2 * b + 1)}  # touching spans are one
        edges = sorted(i for i in held if (i - 1 in held) != (i + 1 in held))
        expected += [(r, a // 2, b // 2) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    assert found == expected
    assert all(len(x) == 0 for x in suffixes._union(*[np.zeros(0, np.int64)] * 3))
