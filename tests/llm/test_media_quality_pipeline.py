import hashlib
import random
import zlib

import numpy as np

import corpus_pipeline
from tidemark.llm import _shared, media, quality

WORDS = [f"wort{i}" for i in range(500)]


def test_gear_equals_the_plain_sum():
    data = np.random.default_rng(1).integers(0, 256, 200).astype(np.uint8)
    got = media.gear(data)
    for i in range(200):
        assert int(got[i]) == sum(int(media._GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) % 2**32


def test_chunks_shift_with_their_content():
    rng = random.Random(2)
    body = " ".join(rng.choices(WORDS, k=6000)).encode()
    a, b = media.chunks(body), media.chunks(b"put before " * 30 + body)
    assert b"".join(x for _, x in a) == body
    assert all(len(x) <= media.MOST for _, x in a) and all(len(x) >= media.LEAST for _, x in a[:-1])
    assert len({d for d, _ in a} & {d for d, _ in b}) > 0.7 * len(a)


def test_media_round_trip(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices(WORDS, k=4000))
    rows = [(1, None), (2, ""), (3, "a" * 192), (4, "ß" * 97), (5, long), (6, "new head " + long), (7, long), (7, long), (8, "z" * 40000), (None, long), (9, "other"), (9, "texts")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, place int").repartition(3)
    path = _shared.shared_folder(spark, "m")
    media.store(df, path)
    got = media.features(media.load(spark, path)).collect()
    want = []
    for d, t in rows:
        p = media.payload_of((t or "").encode())
        want.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], key=str) == sorted(want, key=str)
    assert len({(r.media_bytes, r.media_sha256, r.feature) for r in got if r.doc_id in (5, 7, None)}) == 1
    body = spark.read.parquet(path).selectExpr("sum(aggregate(arrays_zip(sizes, owned), 0, (s, x) -> s + if(x.owned, x.sizes, 0)))").first()[0]
    assert body < 0.6 * sum(x[2] for x in want)
    media.store(df.limit(0), path + "e")
    assert media.load(spark, path + "e").count() == 0


def test_quality_of_planted_documents(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = rng.choices(WORDS, k=60)
        if bad:
            words[::9] = [f"junk{k % 4}" for k in range(len(words[::9]))]
        docs.append((i, " ".join(words), "en", "spam" if bad and i % 2 else "src", 0.1))
        if i < 400:
            labels.append((i, 0 if bad else 1))
    docs += [(9000, None, None, None, 0.0), (9001, "", "", "", 0.0), (None, "junk0 junk1", "en", "spam", 0.0), (5, docs[5][1], "en", "src", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, y int")
    got = quality.classify(df, marks).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    new = [(r.keep, r.doc_id % 3 != 0) for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean([a == b for a, b in new]) > 0.95
    assert {r.score for r in quality.classify(df, marks.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), marks).count() == 0


def test_pseudo_labels_are_counted_over_all_unlabelled_rows(spark):
    rng = random.Random(11)
    docs = [(i if i % 9 else None, " ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) if i % 13 else None, rng.choice(["en", None]), rng.choice("ab")) for i in range(300)] + [(7, "same text", "en", "a")] * 200
    drawn = np.arange(0, 300, 4)
    weights = [np.random.default_rng(i).normal(size=n) for i, n in enumerate(quality.CELLS)]
    edges = [(-0.5, 0.5), (-1.0, float("inf"))]
    got = quality._counted(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5), drawn, weights, edges)
    want = [np.zeros((2, n + 1), np.int64) for n in quality.CELLS]
    for d, text, lang, source in docs:
        if d is not None and d in drawn:
            continue
        data = np.frombuffer((text or "").encode(), np.uint8)
        at = np.array([0, len(data)])
        views = [quality.text_view(data, at), quality.page_view([source], [lang], data, at)]
        odds = [sum(w[c] * x for c, x in zip(v.cell, v.value, strict=True)) for v, w in zip(views, weights, strict=True)]
        for to in (0, 1):
            low, high = edges[1 - to]
            label = 1 if odds[1 - to] >= high else 0 if odds[1 - to] <= low else None
            if label is not None:
                want[to][label, -1] += 1
                for c in [int(c) for c, x in zip(views[to].cell, views[to].value, strict=True) if x > 0]:
                    want[to][label, c] += 1
    for a, b in zip(got, want, strict=True):
        assert b.sum() and not np.argwhere(a != b).tolist(), [(a[tuple(i)], b[tuple(i)]) for i in np.argwhere(a != b)[:5]]


def test_sure_bounds_equal_plain_search():
    rng = np.random.default_rng(12)
    for _ in range(50):
        z, y = rng.integers(-6, 7, 40).astype(float), rng.integers(0, 2, 40)
        low, high = quality.bounds(z, y, 0.4, 0.7)
        fits = [t for t in set(z) if (y[z >= t] == 1).mean() >= 0.7 and (z > t).sum() < max(1, 0.4 * y.sum())]
        assert high == min(fits, default=np.inf)
        fits = [t for t in set(z) if (y[z <= t] == 0).mean() >= 0.7 and (z < t).sum() < max(1, 0.4 * (1 - y).sum())]
        assert low == max(fits, default=-np.inf)


def test_a_view_teaches_the_other_words_that_no_label_shows(spark):
    rng = random.Random(13)
    docs = []
    for i in range(900):
        bad = i % 3 == 0
        words = rng.choices(WORDS, k=40)
        if bad:  # the page tells bad documents; unlabelled ones use a word of their own
            words[::6] = ["junk" if i < 400 else "fresh"] * len(words[::6])
        docs.append((i, " ".join(words), "en", "spam" if bad else "src"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    pair = quality.learn(df, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, y int"))
    assert pair.exchanged[0][0][0] > 100  # the page view marked bad documents for the text view
    text = "wort1 fresh wort2 fresh".encode(), "wort1 wort3 wort2 wort4".encode()
    odds = [quality.text_view(np.frombuffer(t, np.uint8), np.array([0, len(t)])).dot(pair.weights[0])[0] for t in text]
    assert odds[0] < odds[1]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    item = " ".join(rng.choices(WORDS, k=30))
    plain = [" ".join(rng.choices(WORDS, k=80)) for _ in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    held = " ".join(rng.choices(WORDS, k=60)) + " " + item
    docs += [(1, held, "en", "s", 1), (None, held + " more", "en", "s", 1), (None, plain[0] + " and", "en", "s", 1), (2, plain[2], "en", "s", 1), (3, None, None, None, None), (3, "", "en", "s", 0)]
    path = str(tmp_path)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    texts = [sorted((str(r.doc_id), r.text or "") for r in f(spark, df, path).collect()) for f in stages[:-1]]
    whole = sorted((str(d), t or "") for d, t, *_ in docs)
    assert texts[0] == [x for x in whole if x[1]]  # texts without letters go, all others stay
    assert len(texts[1]) == len(docs) - 3 and ("1", held) in texts[1] and ("1", plain[1]) in texts[1] and texts[1].count(("2", plain[2])) == 1 and ("3", "") in texts[1]
    assert ("1", plain[1]) in texts[2] and not any(t == "" for _, t in texts[2])
    assert texts[3] == [x for x in whole if item not in x[1]]
    for f in stages:
        assert f(spark, df.limit(0), path).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    item = " ".join(rng.choices(WORDS, k=30))
    passage = " ".join(rng.choices(WORDS, k=70))
    texts = {i: " ".join(rng.choices(WORDS, k=120)) for i in range(60)}
    texts |= {100: texts[3] + " neu", 101: texts[3], 102: None, 103: "123 456 !!", 104: texts[4] + " " + item, 105: " ".join(rng.choices(WORDS, k=90)) + " " + passage, 106: passage + " " + " ".join(rng.choices(WORDS, k=90))}
    docs = [(i, t, "de" if i % 2 else "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = _shared.read(spark, str(tmp_path), "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = _shared.written(stage(spark, step, str(tmp_path)), "s")
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in step.collect()})
    assert {102, 103} & kept[0].keys() == set() and {3, 100, 101} <= kept[0].keys()
    assert {100, 101} & kept[1].keys() == set() and 3 in kept[1]
    assert kept[2][105] in texts[105] and all(len(passage) - 10 <= len(texts[i]) - len(kept[2][i]) <= len(passage) + 2 for i in (105, 106)) and kept[2][7] == texts[7]
    assert 104 not in kept[3] and kept[3].keys() >= set(range(60)) - {4}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept[3].keys()
