"""Order-preserving packing of documents into token windows by dynamic programming.

Each scan task packs the documents it reads in their order. Cuts may stand at the end of a document (free), after a
sentence (a small penalty) or, in long stretches without either, at a fixed spacing (a larger one). The cuts chosen
minimise padding plus penalties: best[i] = window - at[i] + penalty[i] + min(best[j] + at[j]) over the j within a window
before i, a minimum that a monotone queue gives in constant time a step. A buffer of some windows is solved at a time;
its last window stays open for the next buffer, so that only the last window of a task may be short.

Null and empty texts are one end id. Repeated rows are packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"
#: Ids that are solved together.
BUFFER = 1 << 17


def cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indexes into ``at`` (increasing places, first 0, no gap over ``window``) of the cuts of least cost, both ends included."""
    place, step = at.tolist(), (penalty + window).tolist()
    back, key = [0] * len(place), [0.0] * len(place)  # key: best + at
    queue: deque[int] = deque([0])
    for i in range(1, len(place)):
        low = place[i] - window
        while place[queue[0]] < low:
            queue.popleft()
        j = back[i] = queue[0]
        k = key[i] = step[i] + key[j]
        while key[queue[-1]] >= k:  # ends at j at the latest, as penalties are not negative
            queue.pop()
        queue.append(i)
    out = [len(place) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def boundaries(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, spacing: int, sentence_cost: float, hard_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may stand, with penalties. ``ends``: where documents end."""
    free = np.zeros(len(ids) + 1, bool)
    free[ends] = free[0] = free[-1] = True
    soft = free.copy()
    soft[1:] |= sentence[ids]
    place = np.flatnonzero(soft)
    more = (np.diff(place) - 1) // spacing  # cuts between one soft place and the next
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    allowed = soft.copy()
    allowed[np.repeat(place[:-1], more) + spacing * (nth + 1)] = True
    at = np.flatnonzero(allowed)
    cost = np.where(free[at], 0.0, np.where(soft[at], sentence_cost, hard_cost))
    return at, cost


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, sentence_cost: float = 1.0, hard_cost: float = 8.0, spacing: int = 32) -> DataFrame:
    """One row per piece of a document: its ids' place in the document, checksum, sequence and offset there.

    ``docs`` has doc_id and text; other columns are ignored. ``padded_to``: the sequence's length when it is a power of
    two, else ``window``.
    """

    def solve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, sentence = _tokens.encoder(tokenizer), _tokens.sentence_ends(tokenizer)
        base = TaskContext.get().partitionId() << 36
        count = 0
        held: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        size = 0

        def emit(last: bool) -> pa.RecordBatch | None:
            nonlocal held, size, count
            ids = np.concatenate([x[3] for x in held])
            lengths = np.array([len(x[3]) for x in held])
            ends = np.cumsum(lengths)
            firsts = ends - lengths
            at, cost = boundaries(ids, ends, sentence, spacing, sentence_cost, hard_cost)
            chosen = at[cuts(at, cost, window)]
            stop = len(chosen) if last else len(chosen) - 1
            if stop < 2:
                return None
            chosen = chosen[:stop]
            edges = np.union1d(chosen, ends[ends <= chosen[-1]])
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, a, "right")
            seq = np.searchsorted(chosen, a, "right") - 1
            begin = chosen[seq]
            full = chosen[seq + 1] - begin
            raw = memoryview(ids.tobytes())
            rows = {
                "doc_id": [held[d][0] for d in doc.tolist()],
                "start": np.array([held[d][1] for d in doc.tolist()], np.int64) + a - firsts[doc],
                "length": b - a,
                "ids_crc32": [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                "doc_tokens": [held[d][2] for d in doc.tolist()],
                "sequence_id": base + count + seq,
                "offset": a - begin,
                "sequence_tokens": full,
                "padded_to": np.where(full & (full - 1) == 0, full, window),
            }
            count += len(chosen) - 1
            left, rest = int(chosen[-1]), []
            for (doc_id, start, total, own), f, e in zip(held, firsts.tolist(), ends.tolist(), strict=True):
                if e > left:
                    skip = max(0, left - f)
                    rest.append((doc_id, start + skip, total, own[skip:]))
            held, size = rest, sum(len(x[3]) for x in rest)
            return pa.record_batch([pa.array(x, pa.int64()) for x in rows.values()], names=list(rows))

        for batch in parts:
            names = batch.column("doc_id").to_pylist()
            for at in range(0, len(names), 256):
                texts = batch.column("text").slice(at, 256).to_pylist()
                for doc_id, raw in zip(names[at : at + 256], encoder.encode(texts), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    held.append((doc_id, 0, len(ids), ids))
                    size += len(ids)
                    if size >= BUFFER and (out := emit(False)) is not None:
                        yield out
        if held:
            yield emit(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(solve, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_shared.read(spark, sf_dir, "documents"), _tokens.default_path())
