import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def same(codec, lib, text):
    want = lib.encode(text, add_special_tokens=False).ids
    raw = codec.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == want, text
    assert codec.decode(raw) == lib.decode(want, skip_special_tokens=False)


def test_equals_library():
    codec, lib, rng = bpe.Codec(PATH), library(), random.Random(5)
    signs = ["a", "B", "the", "tion", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'", "é", "ß", "1", "23", ".", "!?", " ", "　", " ", "\x1c", "\x85", "日本", "🙂", "é", "՘", "٣", "<|endoftext|>", "<|", "\x00"]
    for _ in range(3000):
        same(codec, lib, "".join(rng.choices(signs, k=rng.randint(0, 25))))
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|> ", "a   b", "\n \nb", "a\n\n b", " x", "x "):
        same(codec, lib, text)


def test_every_character():
    codec, lib = bpe.Codec(PATH), library()
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 4000):
        same(codec, lib, "".join(f"x{c}y 1{c}2 !{c}! {c} {c}{c}\n" for c in signs[at : at + 4000 : 7]))


def test_merge_equals_plain_search():
    codec, rng = bpe.Codec(PATH), random.Random(7)

    def plain(piece):
        ids = [codec.byte_ids[b] for b in piece.encode()]
        while True:
            ranked = [(codec.rank.get(a << 32 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            if not ranked or min(ranked)[0] == 1 << 40:
                return ids
            r, i = min(ranked)
            ids[i : i + 2] = [codec.made[r]]

    for _ in range(400):
        piece = "".join(rng.choices("aeinotrs" if rng.random() < 0.5 else "aéçßx1日", k=rng.randint(1, 60)))
        assert codec.merge(piece) == plain(piece)
    long = "".join(rng.choices("etaoin", k=30000))
    same(codec, library(), long)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    codec, lib = bpe.Codec(PATH), library()
    same(codec, lib, " ".join(f"word{i % 7} {'long' * 30}{i}" for i in range(50)))
    assert len(codec.known) <= 3


def test_any_ids_decode_as_the_library():
    codec, lib, rng = bpe.Codec(PATH), library(), np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(0, 12))
        assert codec.decode(ids.astype("<u4").tobytes()) == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_rows(spark):
    texts = [None, "", "Hello, wörld  again", "same text", "same text", "x" * 50000, "ends <|endoftext|>", "\n\n  a"]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "no id", "clash", 0), (3, "same text", "clash", 3), (3, "another", "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long").repartition(3)
    lib = library()
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = []
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, bytes(r.ids), r.text)) for r in got)
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_query_on_the_table(spark):
    import duckdb

    lib, folder = library(), "/root/testdata/sf0.001"
    want = {}
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, folder).collect()} == want
