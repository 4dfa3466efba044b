import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from tidemark.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        sure = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in sure.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        found = []
        for p, a in sure.items():
            if 100 * around[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "é", "Éa", "c-d", "x" * 40, "の", "12", "q"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "   "]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    line = "the same passage of words goes here again and again without an end"
    return rows + [("en", line)] * 40 + [("en", "head " + line)] * 5 + [("fr", None), (None, ""), ("", "a b a b a b"), ("en", "a " * 3000)]


def made(spark, rows, least, top=2000, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(parts)
    return sorted(map(tuple, C.collocations(docs, least, top).collect()))


def test_equals_brute_force(spark):
    for seed, least in ((1, 3), (2, 12)):
        rows = corpus(seed)
        assert made(spark, rows, least) == brute(rows, least)
    assert made(spark, rows, 12, top=4, parts=1) == brute(rows, 12, top=4)


def test_small_chunks_and_a_full_filter(spark, monkeypatch):
    rows = corpus(3, 120)
    monkeypatch.setattr(C, "filters", lambda docs, least: (np.full(C.BITS // 64, 2**64 - 1, np.uint64),) * 2)  # nothing is cut
    assert made(spark, rows, 4) == brute(rows, 4)


def test_no_rows(spark):
    assert made(spark, [("en", "one two three")], 2) == []
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_compaction_keeps_all_edges():
    """The unrolled stretches of one chunk are what is read at each place, once, whatever is cut."""
    rng = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) + rng.choice(["", ".", ". a b c d e f"]) for _ in range(rng.randint(1, 12))]
        words = C.Words(pa.array(texts, pa.large_string()), ["en"] * len(texts))
        n = len(words.of)
        reads = C.reach(words.pairs() & np.array([rng.random() < 0.95 for _ in range(n)], bool), np.array([rng.random() < 0.9 for _ in range(n)], bool))
        got = Counter()
        for first, last, k, ended in C.stretches(words, reads, np.ones(n, bool)):
            for phrase, c in zip(words.phrases(first, last).to_pylist(), k.tolist(), strict=True):
                w = phrase.split()
                for i in range(1 if ended else len(w) - 3):
                    got[tuple(w if ended else w[i : i + 4])] += c
        w = words.phrases(np.arange(n), np.arange(n)).to_pylist()
        assert got == Counter(tuple(w[i : i + r]) for i, r in enumerate(reads.tolist()))
    twice = C.Words(pa.array(["one two three four five six seven"] * 2, pa.large_string()), ["en"] * 2)
    reads = C.reach(twice.pairs(), np.ones(14, bool))
    assert reads.tolist() == [4, 4, 4, 4, 3, 2, 1] * 2
    assert [(len(f), k.tolist()) for f, _, k, ended in C.stretches(twice, reads, np.ones(14, bool)) if not ended] == [(1, [2])]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.sql(C.SQL).fetchall())
    assert sorted(map(tuple, C.op12_collocations(spark, folder).collect())) == want and want
    assert brute(con.sql("SELECT lang, text FROM documents").fetchall(), 30) == want
