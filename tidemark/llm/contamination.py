"""Benchmark passages in documents: latent semantic likeness, common subsequence and answer checks.

Terms are the words of the benchmark; other words of the corpus cannot match it. Document frequencies and a randomised
decomposition are taken over all documents, cut into passages of PASSAGE words: with A the TF-IDF matrix of passages and a
random matrix R, every task adds its share of A'(A R), a matrix of terms by RANK + spare columns; Spark sums the shares,
and the leading right singular vectors of A follow by the Nystrom formula. A term's weight falls with the passages that hold it, to FLOOR
at least: an item that many copies hold makes its own words frequent, and they still tell.

Where an item can be is bounded exactly: a document must have ``loose`` of the item's words, and so must a stretch of it at most
a quarter longer than the item. Each such stretch is compared: the longest common subsequence must reach ``near`` of the item's
words, or ``loose`` of them when the words of the item's answer (its last sentence) are found in order around it to the same
share as well. Of the latter, paraphrases, those are kept that the latent space retrieves: the largest cosine of the windows
around the stretch (SPANS words, one at every STEP words) with a part of the item must reach ``cosine``. Verbatim items are kept
whatever their cosine, as no gate on it keeps all of them. The best stretch that passes is reported with its cosine, and with the
``path`` that found it: ``cosine`` where the latent space retrieves it, else ``words``.

The benchmark is taken in blocks of BLOCK items, so what is sent to tasks is bounded. Null or empty documents and items
match nothing. Repeated rows are reported as often as they come. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text

PASSAGE, STEP, RANK, SPARE, FLOOR, BLOCK = 32, 8, 64, 16, 0.05, 4000
#: Least cosine at which the latent space retrieves an item.
COSINE = 0.5
FOUND = "item_id long, cosine double, common_share double, answer_share double, path string"
#: Words of the windows that are compared; the short ones are for short items.
SPANS = (16, PASSAGE)
#: Counts of a row's words by item that are held at once; lengths of vectors are at least TINY.
WORK, TINY = 2_000_000, 1e-30


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row) of lower-cased words."""
    data = _text.lower(data)
    starts, ends, first = _text.words(data, offsets, _text.WORDY)
    return _text.Hashes(data).of(starts, ends), first


def _terms(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words that are terms, their numbers)."""
    spot = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[spot] == words)
    return at, spot[at]


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows before each row, and of all."""
    out = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows, axis=0, dtype=float, out=out[1:])
    return out


def _passages(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """(passage of each word place, number of passages) when every row is cut into PASSAGE words."""
    count = np.diff(first)
    each = -(-count // PASSAGE)
    row = np.searchsorted(first, at, "right") - 1
    return (np.cumsum(each) - each)[row] + (at - first[row]) // PASSAGE, int(each.sum())


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(passages that hold each term, passages) over all documents."""

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in arrow:
            for _, _, part, own in _text.slices(*_text.buffers(batch.column("text"))):
                words, first = _hashed(part, own)
                at, term = _terms(words, vocabulary)
                passage, more = _passages(first, at)
                n += more
                once = np.unique(passage * len(vocabulary) + term)
                total += np.bincount(once % len(vocabulary), minlength=len(vocabulary))
        keep = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(keep, -1)), pa.array(np.append(total[keep], n))], names=["term", "n"])

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def latent(docs: DataFrame, vocabulary: np.ndarray, seed: int = 5) -> np.ndarray:
    """terms x RANK: a term's contribution to the latent vector of a text."""
    holding, passages = frequencies(docs, vocabulary)
    idf = np.maximum(np.log((1 + passages) / (1 + holding)), FLOOR)
    wide = RANK + SPARE
    random = np.random.default_rng(seed).normal(size=(len(vocabulary), wide)).astype(np.float32)
    weighted = (random * idf[:, None]).astype(np.float32)
    narrow = np.min_scalar_type(len(vocabulary))  # few bits sort by radix

    def share(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(vocabulary), wide))
        for batch in arrow:
            for _, _, part, own in _text.slices(*_text.buffers(batch.column("text"))):
                words, first = _hashed(part, own)
                at, term = _terms(words, vocabulary)
                if not len(at):
                    continue
                passage, _ = _passages(first, at)
                start = np.flatnonzero(np.diff(passage, prepend=-1))
                y = np.add.reduceat(weighted[term], start, axis=0)  # a row a passage
                of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
                order = np.argsort(term.astype(narrow), kind="stable")
                edge = np.flatnonzero(np.diff(term[order], prepend=-1))
                total[term[order][edge]] += np.add.reduceat(y[of[order]], edge, axis=0)
        for at in range(0, len(total), 64):
            if total[at : at + 64].any():
                yield pa.record_batch([pa.array([at // 64]), pa.array([total[at : at + 64].tobytes()])], names=["chunk", "share"])

    def add(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in table:
            total = total + sum(np.frombuffer(x.as_buffer()) for x in batch.column("share"))
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([np.asarray(total).tobytes()])], names=["chunk", "share"])

    g = np.zeros((len(vocabulary), wide))
    for r in docs.mapInArrow(share, "chunk long, share binary").groupBy("chunk").applyInArrow(add, "chunk long, share binary").collect():  # terms x wide numbers
        own = np.frombuffer(r["share"]).reshape(-1, wide)
        g[64 * r["chunk"] : 64 * r["chunk"] + len(own)] = own
    g *= idf[:, None]
    small = random.T @ g
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = values > values.max() * 1e-9 if values.max() > 0 else np.zeros(len(values), bool)
    if not keep.any():
        return np.zeros((len(vocabulary), RANK), np.float32)
    u, s, _ = np.linalg.svd(g @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    rank = min(RANK, len(s))
    out = np.zeros((len(vocabulary), RANK))
    out[:, :rank] = idf[:, None] * u[:, :rank] / np.sqrt(np.maximum(s[:rank], 1e-12))
    return out.astype(np.float32)


def common_length(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, by bit rows."""
    masks: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y.tolist():
        m = masks.get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def _parts(n: int) -> list[tuple[int, int]]:
    """Pieces of an item of n words that windows are compared with."""
    if n <= PASSAGE + PASSAGE // 2:
        return [(0, n)]
    return [(a, min(n, a + PASSAGE)) for a in range(0, n - PASSAGE // 2, PASSAGE // 2)]


class Holders:
    """The items that hold each term, with how often."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]], terms: int):
        term = np.concatenate([t for t, _ in counted])
        order = np.argsort(term, kind="stable")
        self.item = np.repeat(np.arange(len(counted)), [len(t) for t, _ in counted])[order]
        self.times = np.concatenate([c for _, c in counted])[order].astype(float)
        self.edge = np.searchsorted(term[order], np.arange(terms + 1))

    def rows(self, row: np.ndarray, term: np.ndarray, rows: int, least: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) wherever the row has at least ``least`` of the item's words, in any order."""
        terms, items = len(self.edge) - 1, len(least)
        once = np.unique(row * terms + term)
        row, term = once // terms, once % terms
        many = np.diff(self.edge)[term]
        work = np.cumsum(np.bincount(row, many, rows) + items)
        a = 0
        while a < rows:
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + WORK, "right")))
            x, y = np.searchsorted(row, [a, b])
            size = many[x:y]
            spot = np.repeat(self.edge[term[x:y]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            key = np.repeat((row[x:y] - a) * items, size) + self.item[spot]
            has = np.bincount(key, self.times[spot], (b - a) * items).reshape(b - a, items)
            for r, i in zip(*np.nonzero(has >= least), strict=True):
                yield a + int(r), int(i)
            a = b


def _stretches(places: np.ndarray, n: int, least: int) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches at most a quarter longer than n words that start and end at one of ``places`` and have ``least`` of them.

    A stretch that lies within another one is left out.
    """
    end = np.searchsorted(places, places + n + max(2, n // 4))
    good = (end - np.arange(len(places)) >= least) & (np.diff(end, prepend=0) > 0)
    for j in np.flatnonzero(good):
        yield int(places[j]), int(places[end[j] - 1]) + 1


def _likeness(places: np.ndarray, vectors: np.ndarray, pieces: np.ndarray, size: int) -> float:
    """Largest cosine of a window of SPANS words, one at every STEP of ``size`` words, with an item's pieces."""
    cells = -(-size // STEP)
    sums = _sums(vectors)[np.searchsorted(places, STEP * np.arange(cells + 1))]
    best = -1.0
    for span in SPANS:
        window = sums[np.minimum(np.arange(cells) + span // STEP, cells)] - sums[:-1]
        best = max(best, float((window @ pieces.T / np.maximum(np.linalg.norm(window, axis=1, keepdims=True), TINY)).max()))
    return best


def _block(docs: DataFrame, items: list[tuple[int, str]], cosine: float, near: float, loose: float) -> DataFrame | None:
    numbers, sequences, answers = [], [], []
    for number, text in items:
        body = (text or "").strip()
        cut = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", body)]
        words, first = _hashed(*_text.buffers(pa.array([body, body[cut[-1] :] if cut else body])))
        if first[1]:
            numbers.append(number)
            sequences.append(words[: first[1]])
            answers.append(words[first[1] :] if first[2] > first[1] else words[: first[1]])
    if not numbers:
        return None
    vocabulary = np.unique(np.concatenate(sequences))
    vectors = latent(docs, vocabulary)
    pieces = []
    for words in sequences:
        spot = np.searchsorted(vocabulary, words)
        own = np.stack([vectors[spot[a:b]].sum(0) for a, b in _parts(len(words))])
        pieces.append(own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), TINY))
    listed = [x.tolist() for x in sequences]
    least = np.array([max(1, math.ceil(min(near, loose) * len(x) - 1e-9)) for x in sequences])
    counted = [np.unique(np.searchsorted(vocabulary, x), return_counts=True) for x in sequences]
    held_by = Holders(counted, len(vocabulary))

    def search(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(len(vocabulary), bool)
        for batch in arrow:
            ids, out = batch.column("doc_id"), []
            for begin, _, part, own in _text.slices(*_text.buffers(batch.column("text"))):
                words, first = _hashed(part, own)
                at, term = _terms(words, vocabulary)
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                edge = np.searchsorted(row, np.arange(len(first)))
                for r, i in held_by.rows(row, term, len(first) - 1, least):
                    places, terms = at[edge[r] : edge[r + 1]], term[edge[r] : edge[r + 1]]
                    marked[counted[i][0]] = True
                    places = places[marked[terms]]
                    marked[counted[i][0]] = False
                    n, low, high = len(listed[i]), int(first[r]), int(first[r + 1])
                    found = None
                    for a, b in _stretches(places, n, int(least[i])):
                        held = set(words[a:b].tolist())
                        if sum(map(held.__contains__, listed[i])) < least[i]:
                            continue  # more words of the item cannot be in order than are there
                        share = common_length(sequences[i], words[a:b]) / n
                        if share < min(near, loose) or (found and share <= found[1] and found[2] == 1):
                            continue
                        begun, ended = max(low, b - PASSAGE - 2 * n), min(high, a + PASSAGE + 2 * n)
                        told = common_length(answers[i], words[begun:ended]) / len(answers[i])
                        if share >= near or (share >= loose and told >= loose):
                            x, y = edge[r] + np.searchsorted(at[edge[r] : edge[r + 1]], [begun, ended])
                            alike = _likeness(at[x:y] - begun, vectors[term[x:y]], pieces[i], ended - begun)
                            if alike >= cosine or share >= near:
                                found = max(found or (0.0, 0.0, 0.0), (alike, share, told), key=lambda f: f[1:])
                    if found:
                        out.append((begin + r, numbers[i], *found))
            if out:
                docs_, items_, cos, lcs, told = zip(*out, strict=True)
                path = ["cosine" if c >= cosine else "words" for c in cos]
                yield pa.record_batch([ids.take(pa.array(docs_)), pa.array(items_, pa.int64()), pa.array(np.clip(cos, -1, 1)), pa.array(lcs), pa.array(told), pa.array(path)], names=["doc_id", "item_id", "cosine", "common_share", "answer_share", "path"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(search, f"doc_id {kind}, {FOUND}")


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, near: float = 0.7, loose: float = 0.55) -> DataFrame:
    """doc_id, item_id, cosine, common_share, answer_share and path of every document that holds a benchmark item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    count = items.count()
    found = []
    for k in range(-(-count // BLOCK)):
        blocks = -(-count // BLOCK)
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        for at in range(0, len(rows), 2 * BLOCK):
            if (part := _block(docs, sorted({(r["item_id"], r["text"]) for r in rows[at : at + 2 * BLOCK]}), cosine, near, loose)) is not None:
                found.append(part)
    if not found:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, {FOUND}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_shared.read(spark, sf_dir, "documents"), _shared.read(spark, sf_dir, "benchmark"))
