"""Token ids of whole texts from a public tokenizer file, with a bounded memory of pieces met before.

A byte-level BPE of the usual pre-tokenisation never joins a character that is not white space to a space after it,
so a text may be cut before each such space and the pieces encoded alone. Pieces recur, so most cost one dictionary
look-up. Nor does it join a letter to a mark or line break after it, so a new piece that is a word and such a tail, both met
before, is put together from their ids. A text in which a space follows white space is given to the library whole. The
result equals the library's.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from itertools import pairwise

import numpy as np

#: Pieces that a worker remembers; beyond that it forgets the half met last, as frequent ones are met early.
MEMORY = 1_500_000
#: Each white space before a space.
_UNSAFE = [c + " " for c in map(chr, range(0x110000)) if c.isspace()]
#: A word of letters that are letters in every version of Unicode, and what follows it.
_TAILED = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?\n].*)", re.DOTALL)


class _Known(dict):
    """Ids by piece; a piece that is not known stands for itself and is noted."""

    def __init__(self):
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> str:
        self.missed.append(piece)
        return piece


class Encoder:
    def __init__(self, path: str, end_id: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.known = _Known()  # by piece without the space before it
        self.tails: dict[str, bytes] = {}  # by what follows a word within its piece
        self.starts: dict[str, bytes] = {}  # by a text's first piece
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a byte-level token has a character for each byte

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text (null: empty) its ids and the end id, as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = []
        for text in texts:
            cut.append([] if not text else None if any(map(text.__contains__, _UNSAFE)) else text.split(" "))
        # in these texts only the last piece can be empty or end in white space
        loose = {pieces[-1] for pieces in cut if pieces and len(pieces) > 1 and (not pieces[-1] or pieces[-1][-1].isspace())}
        look = self.known.__getitem__
        found = [list(map(look, pieces[1:])) if pieces else [] for pieces in cut]
        new = set(self.known.missed)
        self.known.missed.clear()
        if new and len(self.known) + len(new) > MEMORY:
            while len(self.known) > MEMORY // 2:
                self.known.popitem()
            self.tails.clear()
            self.starts.clear()
        self._extend(new - loose)
        for x in new & loose:  # a space may not follow these
            self.known[x] = self._alone(" " + x)
        out = []
        for text, pieces, own in zip(texts, cut, found, strict=True):
            first = self._alone(text) if pieces is None else self._start(pieces[0]) if len(pieces) > 1 else self._alone(text) if text else b""
            out.append(first + b"".join([look(x) if type(x) is str else x for x in own]) + self.end)
        return out

    def _extend(self, new: set[str]) -> None:
        """Makes these pieces known, from their words and tails where it can."""
        whole, joint, first = set(), [], {}
        for x in new:
            if cut := _TAILED.fullmatch(x):
                word, tail = cut.groups()
                if word not in self.known:
                    whole.add(word)
                if tail in self.tails or tail in first:
                    joint.append((x, word, tail))
                    continue
                first[tail] = x, word
            whole.add(x)
        self._learn(list(whole))
        for tail, (x, word) in first.items():
            self.tails[tail] = self.known[x][len(self.known[word]) :]
        for x, word, tail in joint:
            self.known[x] = self.known[word] + self.tails[tail]

    def _start(self, piece: str) -> bytes:
        if piece not in self.starts:
            if len(self.starts) >= MEMORY // 8:
                self.starts.clear()
            self.starts[piece] = self._alone(piece)
        return self.starts[piece]

    def _alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces, many to a call: joined by the spaces before them they are cut where they were joined.

        Pieces hold no space, so each space of the joined bytes starts one; tokens are found by their count of bytes.
        """
        for at in range(0, len(pieces), 16384):
            groups = [pieces[i : i + 128] for i in range(at, min(at + 16384, len(pieces)), 128)]
            joined = [" " + " ".join(g) for g in groups]
            for group, text, got in zip(groups, joined, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.frombuffer(array("I", got.ids), np.uint32)
                data = np.frombuffer(text.encode(), np.uint8)
                starts = np.append(np.flatnonzero(data == 0x20), len(data))
                edge = (4 * np.searchsorted(np.cumsum(self.size[ids]), starts, "right")).tolist()
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[a:b] for a, b in pairwise(edge)], strict=True))


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int = 0) -> Encoder:
    """One for each worker process."""
    return Encoder(path, end_id)


def default_path() -> str:
    """The byte-level BPE of 50 thousand ids among the public tokenizer files of the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """Truth for each id whose characters end in a full stop, question mark, exclamation mark or line break."""
    vocabulary = encoder(path).library.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith((".", "!", "?", "Ċ"))]] = True
    return out
