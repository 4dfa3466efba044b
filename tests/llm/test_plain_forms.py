"""Language network and packing against plain forms of their definitions."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import _tokens, language, packing


def test_forward_pass_equals_a_plain_convolution():
    rng = np.random.default_rng(4)
    d, h = language.DIMS, language.HIDDEN
    filters = rng.normal(size=(4 * d, h)) * language._mask()
    net = language.Network(["a", "b", "c"], rng.normal(size=(256, d)), filters, rng.normal(size=h), rng.normal(size=(h, 3)), rng.normal(size=3))
    windows = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    want = []
    for w in windows:
        pooled = np.full(h, -np.inf)
        for i, width in enumerate(language.WIDTHS):
            for k in range(i * language.FILTERS, (i + 1) * language.FILTERS):
                for at in range(0, language.WINDOW - 3, 2):
                    pooled[k] = max(pooled[k], sum(net.embedding[w[at + j]] @ filters[j * d : (j + 1) * d, k] for j in range(width)))
        z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.probabilities(windows), want, atol=1e-5)


def test_packing_over_several_buffers(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, n)) + "." for n in rng.integers(1, 1500, 160)] + [None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = _tokens.default_path()
    rows = packing.pack(docs, path).collect()
    assert sum(r.length for r in rows) > 1.2 * packing.BUFFER  # more than one buffer is solved
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= 1024
        assert {r.padded_to for r in own} == {at if at & (at - 1) == 0 else 1024}
        padded += own[0].padded_to - at
    assert padded <= 0.02 * sum(r.length for r in rows)
