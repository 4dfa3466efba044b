"""Byte-level BPE in both directions: merge ranks in a priority queue over a linked list of symbols, ids back to text.

Encoding. A text is cut at added tokens, then by the usual pattern of byte-level tokenizers into pieces. The symbols of a
piece, at first its bytes, form a doubly linked list; every neighbouring pair that the vocabulary merges waits in a heap by
(rank, place). What comes off the heap is stale if the pair at its place has changed since, and is skipped; else the right
symbol goes into the left one and the two new pairs are queued. A piece of n bytes costs n log n, so a very long word
does no harm. Words recur, so a worker remembers the ids of up to MEMORY of them.

Decoding joins the vocabulary's byte strings of the ids and reads them as UTF-8; what is not UTF-8 becomes U+FFFD.

Rows are independent of each other: nothing is shuffled, and a row's result is the same at any layout. A null text counts
as empty and has no ids. Repeated rows, and rows without doc_id, are encoded as often as they come. Other columns of the
input are left out. An empty table gives no rows. A row's ids must fit the 2 GB of a binary value.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _tokens

#: Fixed value: the pattern by which byte-level tokenizers of this kind cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, and their longest length in characters; when it is full its memory starts anew.
MEMORY, LONGEST = 1_000_000, 64
_SHIFT = 32
_UNSAFE = re.compile(r"\s ")
ENCODED = "doc_id long, n_tokens long, ids binary"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class _Classes(dict):
    """Stand-ins by code point, for ``str.translate``: what a character is to the pattern, as the tokenizer's own library has it.

    Unicode versions differ between libraries, so each character beyond ASCII is looked up once: a letter becomes z, a number 0,
    white space a tab, anything else an exclamation mark.
    """

    def __init__(self, splitter):
        super().__init__((c, c) for c in range(128))
        self.splitter = splitter

    def __missing__(self, code: int) -> int:
        c = chr(code)
        for probe, stand in (("z", "z"), ("0", "0"), ("!", "!")):
            if len(self.splitter.pre_tokenize_str(probe + c)) == 1:
                break
        else:
            stand = "\t"
        self[code] = ord(stand)
        return self[code]


class _Known(dict):
    """Ids of words after a space; a new one is encoded when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """A byte-level BPE read from a tokenizer file; other kinds of tokenizers are refused."""

    def __init__(self, path: str):
        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        vocabulary: dict[str, int] = model["vocab"]
        characters = byte_characters()
        self.byte_ids = [vocabulary[c] for c in characters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocabulary[a] << _SHIFT | vocabulary[b], len(self.made))
            self.made.append(vocabulary[a + b])
        code = {c: b for b, c in enumerate(characters)}
        self.strings: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in added)]))
        for token, i in [*vocabulary.items(), *((t["content"], t["id"]) for t in added)]:
            self.strings[i] = bytes(map(code.__getitem__, token)) if all(c in code for c in token) else token.encode()
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(longest) + ")") if longest else None
        self.pattern = regex.compile(PIECES)
        self.classes = _Classes(pre_tokenizers.ByteLevel(add_prefix_space=False))
        self.known = _Known(self._pieces)

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.classes))]

    def merge(self, piece: str) -> list[int]:
        symbols = [self.byte_ids[b] for b in piece.encode()]
        n, rank, made = len(symbols), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << _SHIFT | i for i in range(n - 1) if (r := rank(symbols[i] << _SHIFT | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> _SHIFT, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or rank(symbols[i] << _SHIFT | symbols[j]) != r:  # stale: a symbol of the pair has gone or grown
                continue
            symbols[i], symbols[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] << _SHIFT | symbols[k])) is not None:
                    heapq.heappush(heap, r << _SHIFT | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << _SHIFT | symbols[i])) is not None:
                heapq.heappush(heap, r << _SHIFT | h)
        return [s for s in symbols if s >= 0]

    def _pieces(self, text: str) -> bytes:
        return b"".join([np.array(self.merge(p), "<u4").tobytes() for p in self.pieces(text)])

    def _plain(self, text: str) -> bytes:
        """Where no white space stands before a space, pieces never cross one, so that the words after spaces stand alone."""
        if _UNSAFE.search(text):
            known = self.known
            return b"".join([known[p[1:]] if p[0] == " " and len(p) > 1 else self._pieces(p) for p in self.pieces(text)])
        first, *words = text.split(" ")
        return self._pieces(first) + b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(self.added.get(x) or self._plain(x) for x in self.special.split(text) if x)

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def _mapped(rows: DataFrame, columns: list[str], schema: str, one) -> DataFrame:
    """``one`` on the values of each row; texts are in Python some at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = list(zip(*(one(*x) for x in zip(*(part.column(c).to_pylist() for c in columns), strict=True)), strict=True))
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(made, fields, strict=True)], schema=fields)

    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])
    return rows.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text of ``docs`` (doc_id, text); ids as little-endian unsigned 32-bit integers."""

    def one(doc_id, text):
        ids = codec(tokenizer).encode(text)
        return doc_id, len(ids) // 4, ids

    return _mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ["doc_id", "text"], ENCODED, one)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of ``encode`` with the text that their ids spell; null ids spell an empty one."""

    def one(doc_id, n_tokens, ids):
        return doc_id, n_tokens, ids, codec(tokenizer).decode(ids)

    return _mapped(encoded, ["doc_id", "n_tokens", "ids"], ENCODED + ", text string", one)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokens.default_path()
    both = decode(encode(_shared.read(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
