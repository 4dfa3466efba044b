import zlib

import numpy as np
import pytest

from tidemark.llm import _shared, _tokens, coding, licenses


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 7000])
@pytest.mark.parametrize("kind", ["same", "random", "cycle"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"same": np.zeros(n), "random": rng.integers(0, 65536, n), "cycle": np.arange(n) % 37}[kind].astype(np.int32)
    head, blocks = coding.encode(ids)
    assert (coding.decode(head, blocks) == ids).all()
    assert sum(b["n_ids"] for b in blocks) == n
    if kind != "random" and n > 2000:
        assert sum(len(b["payload"]) for b in blocks) < n / 2


def test_a_damaged_block_is_found():
    head, blocks = coding.encode(np.arange(3000, dtype=np.int32) % 91)
    blocks[1]["crc32"] ^= 1
    with pytest.raises(ValueError):
        coding.decode(head, blocks)


def test_token_file(spark):
    texts = [None, "", "one two  three", "ß" * 3000, "same text here", "same text here"] + [f"row {i} of many, " * (i % 40) for i in range(300)]
    docs = spark.createDataFrame([(1000 - i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(5)
    path = _shared.shared_folder(spark, "t")
    coding.write(docs, _tokens.default_path(), path, 3)
    got = coding.read(spark, path).toPandas().sort_values("doc_id")
    raw = _tokens.Encoder(_tokens.default_path()).encode(texts[::-1])
    assert got.n_tokens.tolist() == [len(x) // 4 for x in raw]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x) for x in raw]
    empty = _shared.shared_folder(spark, "t")
    coding.write(docs.limit(0), _tokens.default_path(), empty, 3)
    assert coding.read(spark, empty).count() == 0


def test_license_cases(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "CC-BY cc by\ncc by"),
        (4, "x All Rights\nReserved. y"),
        (5, "Licensed under the Apache License, Version 2.0."),
        (6, "Licensed under the Apache License, Version 2.0."),
        (6, "Licensed under the Apache License, Version 2.0."),
        (7, "Éall rights reserved"),
        (8, "General Public License GENERAL public license " + "word " * 50000),
        (None, "released under MIT license"),
        (9, "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following\n// conditions are met:"),
        (10, "this wor\u212a is licensed under a creative commons attribution license " + "\u212a " * 3),
        (11, " ".join(w + " filler" * 40 for w in "this work is licensed under a creative commons attribution license".split())),
        (12, "word " * 500 + "released under\nthe mit\nlicense" + " word" * 45),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS label")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 14 and [r.doc_id for r in got].count(6) == 2
    assert (by[1].n_words, by[1].labels, by[1].score, by[1].first_word) == (0, "", 0.0, None)
    assert (by[3].n_words, by[3].n_base, by[3].first_word, by[3].last_word) == (6, 3, 0, 4)
    assert by[4].base_labels == "reserved" and by[4].first_word == 1
    assert by[5].labels == "apache" and by[5].base_labels == "" and by[5].score == 1.0
    assert by[7].base_labels == "" and by[8].n_base == 2 and by[8].last_word == 3
    assert by[9].labels == "bsd" and by[9].base_labels == "" and by[12].labels == "mit"
    assert by[10].score == 0.9 and by[11].labels == "" and by[11].score == 0.0
    assert by[None].labels == "mit" and by[None].score == 0.8
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
