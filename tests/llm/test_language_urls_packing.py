import zlib
from itertools import product

import numpy as np
import pytest

from tidemark.llm import _tokens, language, packing, urls

TEXTS = [None, "", "Hello there, world. This is it!", "a  b\n c   d ", "Ärger über Öl. " * 400, "x" * 5000, "same", "same", "<|endoftext|> no"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")


def test_pieces_equal_the_library():
    path = _tokens.default_path()
    e = _tokens.Encoder(path)
    for text, got in zip(TEXTS, e.encode(TEXTS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*e.library.encode(text or "", add_special_tokens=False).ids, 0]


def test_cuts_are_of_least_cost():
    rng = np.random.default_rng(1)
    for _ in range(60):
        steps = rng.integers(1, 6, rng.integers(1, 9))
        at, cost = np.concatenate([[0], np.cumsum(steps)]), rng.integers(0, 4, len(steps) + 1).astype(float)
        got = packing.cuts(at, cost, 7)

        def total(chosen, at=at, cost=cost):
            return sum(7 - at[b] + at[a] + cost[b] if at[b] - at[a] <= 7 else 1e9 for a, b in zip(chosen, chosen[1:], strict=False))

        every = [[0, *[i for i, x in enumerate(pick, 1) if x], len(at) - 1] for pick in product((0, 1), repeat=len(at) - 2)] if len(at) > 1 else [[0]]
        assert total(got) == min(map(total, every))


def test_packing_covers_each_id_once(spark):
    path = _tokens.default_path()
    rows = packing.pack(frame(spark), path, window=64).toPandas()
    e = _tokens.Encoder(path)
    for i, raw in enumerate(e.encode(TEXTS)):
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() == len(raw) // 4 == own.doc_tokens.iloc[0]
        for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True):
            assert zlib.crc32(raw[4 * s : 4 * (s + n)]) == c
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() == seq.sequence_tokens.iloc[0] <= 64
    assert packing.pack(frame(spark, []), path).count() == 0


def test_language_of_odd_texts(spark):
    words = {"aa": "lorem banda kilo ", "bb": "über straße käse "}
    rows = [(i, words[k] * 20, k, "x") for i, k in enumerate(["aa", "bb"] * 60)]
    odd = [(1000, None, None, None), (1001, "", "aa", "y"), (1002, "12 34 !!", "aa", "y"), (1003, words["bb"] * 3000, None, None), (None, words["aa"] * 9, None, None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")).collect()}
    assert len(got) == 125
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "bb"
    assert all(r.lang_pred == ("aa", "bb")[i % 2] for i, r in got.items() if i is not None and i < 120)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        (None, "", "", None),
        ("no scheme", "", "", None),
        ("http://A.Example.COM/en/1?x=/fr/", "a.example.com", "/en/1", "example.com/en/"),
        ("http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/"),
        ("http://badexample.com/en/x", "badexample.com", "/en/x", "com/"),
        ("ftp://x.net/es/1#a", "x.net", "/es/1", "net/es/"),
        ("http://x.net?y", "x.net", "", None),
        ("http://x.com", "x.com", "", None),
    ],
)
def test_urls(spark, url, host, path, rule):
    got = urls.judge(spark.createDataFrame([(1, url, "z")], "page_id long, url string, rule string"), urls.RULES).first()
    assert (got.host, got.path, got.rule) == (host, path, rule)
    if rule:
        assert got.verdict == {r[1] + r[2]: r[0] for r in urls.RULES}[rule]


def test_url_models_agree_with_plain_counts():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, urls.CELLS, 500)
    counts = np.bincount(cells, minlength=urls.CELLS).astype(float)
    p = np.exp(urls.log_model(counts))
    assert np.allclose(p.reshape(-1, urls.CLASSES).sum(1), 1)
    data = np.frombuffer(b"ab/1ab", np.uint8)
    c = urls.codes(data, np.array([0, 4, 6]))
    t = [int(urls._TABLE[x]) for x in data]
    n = urls.CLASSES
    assert c.tolist() == [t[0], t[1] + n * t[0], t[2] + n * t[1] + n * n * t[0], t[3] + n * t[2] + n * n * t[1] + n**3 * t[0], t[4], t[5] + n * t[4]]


def test_unlisted_urls_follow_the_models(spark):
    rows = [(i, f"http://a{i}.com/good/{i}") for i in range(60)] + [(100 + i, f"http://b{i}.net/fr/bad/{i}") for i in range(60)]
    rows += [(1000, "http://z.org/good/7"), (1001, "http://z.org/fr/bad/7"), (1002, None)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()}
    assert got[1000] == "allow" and got[1001] == "block" and got[1002] == "allow"


def test_random_texts_equal_the_library():
    rng = np.random.default_rng(9)
    alphabet = list("abcXYZ019 .,'\n\t éß—日😀") + ["  ", " \n", "don't", "'s ", " ", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(800)]
    e = _tokens.Encoder(_tokens.default_path())
    for at in range(0, 800, 100):
        for text, got in zip(texts[at : at + 100], e.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*e.library.encode(text, add_special_tokens=False).ids, 0], repr(text)
