"""Token-id files: the cost of the coder, carries, damage, ids it cannot hold; what the encoder remembers."""

import zlib

import numpy as np
import pytest

from tidemark.llm import _shared, _tokens, coding


def test_chances_are_set_a_few_times_a_block(monkeypatch):
    turns = []
    turn = coding.Models.turn
    monkeypatch.setattr(coding.Models, "turn", lambda self: (turns.append(1), turn(self)))
    ids = np.random.default_rng(1).integers(0, 50, 20 * coding.BLOCK)
    head, blocks = coding.encode(ids)
    once = len(turns)
    assert (coding.decode(head, blocks) == ids).all()
    assert 0 < once <= 8 and len(turns) == 2 * once


@pytest.mark.parametrize("seed", range(8))
def test_carries_reach_the_words_given_out(seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.1 + seed / 8, 60_000 + seed), 65_535)
    ids[rng.random(len(ids)) < 0.2] = 7
    head, blocks = coding.encode(ids)
    assert (coding.decode(head, blocks) == ids).all()


def test_damaged_payloads_are_found():
    ids = np.random.default_rng(2).integers(0, 900, 3 * coding.BLOCK)
    head, blocks = coding.encode(ids)
    for at in (0, 5, 400, 900):
        payload = bytearray(blocks[1]["payload"])
        payload[at] ^= 255
        with pytest.raises(ValueError):
            coding.decode(head, [blocks[0], blocks[1] | {"payload": bytes(payload)}, blocks[2]])


def test_ids_over_16_bits_are_refused():
    with pytest.raises(ValueError):
        coding.encode(np.array([3, 65_536]))


def test_words_and_tails_met_before_are_not_encoded_again(monkeypatch):
    encoder = _tokens.Encoder(_tokens.default_path())
    encoder.encode(["x alpha beta, gamma.\nThis"])
    asked, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda pieces: (asked.extend(pieces), learn(pieces)))
    texts = ["x alpha, beta.\nThis gamma, delta.\nThis gamma.\nThis alpha.\nThis", "x été, été ÿ, don't, don't. a,b, a.b.\n", "x œuvre, Ünder: a::b a: b:", "x a.\n\nb c,\td b, a é.́"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert not {"alpha,", "beta.\nThis", "gamma,", "gamma.\nThis"} & set(asked)
    assert {"delta", "été"} <= set(asked)
    assert got == [[*encoder.library.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_a_full_memory_keeps_what_was_met_first(monkeypatch):
    monkeypatch.setattr(_tokens, "MEMORY", 40)
    encoder = _tokens.Encoder(_tokens.default_path())
    rng = np.random.default_rng(4)
    for _ in range(30):
        texts = [" ".join(["of", "the,", *(f"w{k}x." for k in rng.integers(0, 500, 6)), "end"]) for _ in range(2)]
        want = [[*encoder.library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
        assert len(encoder.known) <= 60
    assert "the," in encoder.known and "end" in encoder.known


def test_ids_are_read_only_when_asked_for(spark):
    docs = spark.createDataFrame([(i, f"row {i} " * (700 * (i == 3) + i)) for i in range(9)], "doc_id long, text string")
    path = _shared.shared_folder(spark, "t")
    coding.write(docs, _tokens.default_path(), path, 2)
    whole, bare = (coding.read(spark, path, **x).toPandas().sort_values("doc_id") for x in ({}, {"with_ids": False}))
    assert [*bare] == ["doc_id", "start", "n_tokens", "ids_crc32"] and bare.values.tolist() == whole[[*bare]].values.tolist()
    assert [zlib.crc32(x) for x in whole.ids] == bare.ids_crc32.tolist()
