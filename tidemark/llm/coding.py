"""Token-id files: blocks of ids under an adaptive context-mixing range coder.

A file part holds segments of whole documents. A segment's ids are cut into blocks of BLOCK ids that are coded
independently: every block starts from reset models, has its own bytes and its own crc32, and is coded side by side with
the others, one numpy lane a block, so that one step of the coder serves all blocks of the segment.

Each id is coded in one step. A table of the block, indexed by the last id (order 1), holds the id that followed last,
whether it had been right, and a tag of the id before (order 2). A step has two outcomes: the guess, or not. Its chance
mixes two adaptive estimates, one met under the mark of order 1, one under whether the tag of order 2 agrees and whether
the guess before was right, in the logistic domain with weights learnt online; all in integers, so that the decoder
repeats it exactly. The table learns from every id, chances and weights at the steps in TURNS, from the counts since the
last one. An id that is not the guess is coded within the second outcome by the order-0 model: the segment's id
frequencies, sent once in its head.

The range coder keeps 64 bits of low and range and gives out 32 bits once the range is below 2**32; a carry goes into the
words given out before. Null texts count as empty; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _tokens

BLOCK = 1024  # ids of a block
LANES = 2048  # blocks that are coded side by side
SLOTS = 512  # entries of each table
#: Steps after which chances and weights are set anew.
TURNS = frozenset([16, 64, 256, 512])
ROWS = 8  # steps whose codes the coder works out at once
_LOW = np.uint64(1 << 32)
_U32, _U28, _U16, _U12, _ALL = np.uint64(32), np.uint64(28), np.uint64(16), np.uint64(12), np.uint64(4096)
_WORDS = BLOCK + 2  # an id gives out a word at most, the end two


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """Integer tables: stretch of a 12-bit chance to -2047..2047 and squash back; built by rule from integers alone."""
    knots = [round(4096 / (1 + 2.718281828 ** (-x / 256))) for x in range(-2048, 2049)]
    squash = np.clip(np.array(knots), 1, 4095)
    stretch = np.clip(np.searchsorted(squash, np.arange(4096)) - 2048, -2047, 2047)
    return stretch, squash


_STRETCH, _SQUASH = _logistic()


class Models:
    """Guesses and chances of all lanes, advanced by the ids that were coded.

    An entry is 128 times the guessed id + 1, four times the tag, and a mark: 1, or 2 if the guess was right at last. A
    lane's context is one of 12: the mark (0: no guess), whether the tag agrees, whether the guess before was right.
    """

    def __init__(self, lanes: int):
        own = np.arange(lanes, dtype=np.int64)
        self.table = np.zeros(lanes * SLOTS, np.int64)
        self.base, self.lane = own * SLOTS, own * 12
        self.hash = self.tag = np.zeros(lanes, np.int64)
        self.right = np.zeros(lanes, bool)
        self.met: list[np.ndarray] = []  # contexts * 2 + whether the guess was right, since chances were set
        self.weight = [np.full((lanes, 1), 1 << 15, np.int64) for _ in (1, 2)]
        self.seen = [np.full((lanes, 3), 4, np.int64), np.full((lanes, 4), 4, np.int64)]
        self.hits = [np.full((lanes, 3), 1, np.int64), np.full((lanes, 4), 1, np.int64)]
        self.mix()

    def keep(self, lanes: int) -> None:
        """Only the first lanes go on; the others' blocks have ended."""
        self.base, self.lane, self.hash, self.tag, self.right = (x[:lanes] for x in (self.base, self.lane, self.hash, self.tag, self.right))

    def mix(self) -> None:
        """For each lane and context the chance of the guess, of 4096; 0 where there is none."""
        self.stretched = [_STRETCH[(hits << 12) // (seen + 1)] for hits, seen in zip(self.hits, self.seen, strict=True)]
        one, two = (w * t for w, t in zip(self.weight, self.stretched, strict=True))
        self.mixed = _SQUASH[np.clip((one[:, :, None] + two[:, None, :]) >> 16, -2047, 2047) + 2048]
        chance = np.minimum(self.mixed, 4000)
        chance[:, 0] = 0
        self.chance = chance.ravel().astype(np.uint64)

    def turn(self) -> None:
        """Chances and weights learn from what was met since the last time."""
        met = np.bincount(np.concatenate(self.met), minlength=24 * len(self.mixed)).reshape(-1, 3, 4, 2)
        self.met = []
        hits = met[..., 1]
        n = hits + met[..., 0]
        error = (hits << 12) - n * self.mixed
        error[:, 0] = 0
        for k, axis in ((0, 2), (1, 1)):
            weight = self.weight[k] + ((self.stretched[k] * error.sum(axis)).sum(1, keepdims=True) >> 12)
            self.weight[k] = np.clip(weight, -(1 << 18), 1 << 18)
            self.seen[k] += n.sum(axis)
            self.hits[k] += hits.sum(axis)
        self.mix()

    def look(self) -> np.ndarray:
        """The lanes' contexts; ``entry`` holds the guess."""
        self.at = ((self.hash >> 6) & (SLOTS - 1)) + self.base
        self.entry = self.table.take(self.at)
        agrees = ((self.entry ^ self.tag) & 124) == 0
        return ((((self.entry & 3) << 1) + agrees) << 1) + self.right + self.lane

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """Whether the guess was right."""
        new = ((ids + 1) << 7) + self.tag + 1
        self.right = (self.entry ^ new) < 128
        self.table[self.at] = new + self.right
        self.tag = (self.hash >> 14) & 124
        self.hash = ids * 40503
        return self.right


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their frequencies as 16-bit shares that sum to 65536)."""
    n = np.bincount(ids)
    known = np.flatnonzero(n)
    n = n[known]
    share = np.maximum(1, n * (65536 - len(known)) // n.sum())
    share[np.argmax(share)] += 65536 - share.sum()
    return known, share


def _spread(known: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By id: the ids' shares before it and its own."""
    before, own = np.zeros(65536, np.uint64), np.zeros(65536, np.uint64)
    before[known], own[known] = np.cumsum(share) - share, share
    return before, own


def _lanes(n: int) -> tuple[int, np.ndarray]:
    """Number of blocks of n ids and the ids of each, longest first."""
    size = np.full(-(-n // BLOCK), BLOCK)
    if n % BLOCK:
        size[-1] = n % BLOCK
    return len(size), size


def encode(ids: np.ndarray) -> tuple[bytes, list[dict]]:
    """(head with the order-0 model, blocks with n_ids, crc32 and payload) of at most LANES * BLOCK ids below 65536."""
    known, share = order0(ids)
    if known[-1] > 65535:
        raise ValueError(f"id {known[-1]} does not fit 16 bits")
    head = known.astype("<u2").tobytes() + (share - 1).astype("<u2").tobytes()
    before, share_of = _spread(known, share)
    lanes, size = _lanes(len(ids))
    grid = np.zeros(lanes * BLOCK, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    out = np.zeros(lanes * _WORDS, "<u4")
    first = np.arange(lanes) * _WORDS
    fill = first.copy()
    models, live, rows = Models(lanes), lanes, []

    def give() -> None:
        """Codes the steps met since the last time, under the chances of the models."""
        nonlocal low, span
        x, met = np.concatenate(rows), np.concatenate(models.met[-len(rows) :])
        chance, other = models.chance.take(met >> 1), met & 1 == 0
        rest, end = _ALL - chance, chance << _U16
        start = np.where(other, end + rest * before.take(x), np.uint64(0))
        width = np.where(other, rest * share_of.take(x), end)
        at = 0
        for row in rows:
            n = len(row)
            if n < len(low):
                ended.append((low[n:], fill[n:]))
                low, span = low[:n], span[:n]
            part = span >> _U28
            more = part * start[at : at + n]
            low = low + more
            span = part * width[at : at + n]
            at += n
            over = (low < more).nonzero()[0]
            back = fill[over] - 1
            while len(back):
                out[back] += np.uint32(1)
                back = back[out[back] == 0] - 1
            todo = (span < _LOW).nonzero()[0]
            a, place = low[todo], fill[todo]
            out[place] = a >> _U32
            fill[todo] = place + 1
            low[todo] = a << _U32
            span[todo] <<= _U32
        rows.clear()

    ended: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(size[0]):
        if step == size[live - 1]:
            live -= 1
            models.keep(live)
        if len(rows) == ROWS:
            give()
        if step in TURNS:
            models.turn()
        x = grid[step, :live]
        context = models.look()
        rows.append(x)
        models.met.append((context << 1) + models.learn(x))
    give()
    for rest, place in [(low, fill[: len(low)]), *ended]:
        out[place], out[place + 1] = rest >> _U32, rest & (_LOW - np.uint64(1))
        place += 2
    raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
    words = memoryview(out.view(np.uint8))
    ends = zip(size.tolist(), first.tolist(), fill.tolist(), strict=True)
    blocks = [{"n_ids": n, "crc32": zlib.crc32(raw[4 * BLOCK * i : 4 * (BLOCK * i + n)]), "payload": bytes(words[4 * a : 4 * b])} for i, (n, a, b) in enumerate(ends)]
    return head, blocks


def decode(head: bytes, blocks: list[dict]) -> np.ndarray:
    """The ids; a block whose checksum differs raises ValueError."""
    table = np.frombuffer(head, "<u2").astype(np.int64).reshape(2, -1)
    known, share = table[0], table[1] + 1
    before, own = _spread(known, share)
    id_at = np.repeat(known, share)
    size = np.array([b["n_ids"] for b in blocks])
    lanes = len(blocks)
    words = np.zeros((lanes, _WORDS + 1), "<u4")
    for i, b in enumerate(blocks):
        payload = np.frombuffer(b["payload"], "<u4")
        words[i, : len(payload)] = payload
    code = (words[:, 0].astype(np.uint64) << _U32) | words[:, 1]
    words = words.ravel()
    read = np.arange(lanes) * (_WORDS + 1) + 2
    span = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    grid = np.zeros((BLOCK, lanes), np.int32)
    models, live = Models(lanes), lanes
    for step in range(size[0]):
        if step == size[live - 1]:
            live -= 1
            models.keep(live)
            code, span = code[:live], span[:live]
        if step in TURNS:
            models.turn()
        if step == 0 or step in TURNS:
            upper = models.chance << _U16
        context = models.look()
        part = span >> _U28
        end = part * upper.take(context)
        hit = code < end
        unit = (part << _U12) - (end >> _U16)
        x = id_at.take(((code - end) // unit).view(np.int64), mode="clip")
        start, span = unit * before.take(x), unit * own.take(x)
        start += end
        np.copyto(start, np.uint64(0), where=hit)
        np.copyto(span, end, where=hit)
        np.copyto(x, (models.entry >> 7) - 1, where=hit)
        code = code - start
        grid[step, :live] = x
        models.learn(x)
        models.met.append((context << 1) + hit)
        todo = (span < _LOW).nonzero()[0]
        place = read[todo]
        code[todo] = (code[todo] << _U32) | words[place]
        read[todo] = place + 1
        span[todo] <<= _U32
    ids = np.ascontiguousarray(grid.T).ravel()[: (lanes - 1) * BLOCK + size[-1]].astype("<u4")
    raw, at = memoryview(ids.tobytes()), 0
    for i, b in enumerate(blocks):
        if zlib.crc32(raw[at : at + 4 * b["n_ids"]]) != b["crc32"]:
            raise ValueError(f"block {i} is damaged")
        at += 4 * b["n_ids"]
    return ids


FILE = (
    "part int, segment long, first_id long, n_ids long, doc_ids array<long>, doc_tokens array<int>,"
    " pieces array<struct<head: binary, blocks: array<struct<n_ids: int, crc32: long, payload: binary>>>>"
)


def write(docs: DataFrame, tokenizer: str, path: str, parts: int) -> None:
    """Writes the ids of all texts, each with its end id, in ascending doc_id order. ``first_id`` counts within a part.

    A segment holds whole documents of about LANES * BLOCK ids and is coded in pieces of that many. Parts hold ranges of
    doc_id, so a file is read in order by (part, segment). Rows with the same doc_id stay together, in order of text.
    """

    block = pa.struct([("n_ids", pa.int32()), ("crc32", pa.int64()), ("payload", pa.binary())])
    piece = pa.struct([("head", pa.binary()), ("blocks", pa.list_(block))])
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("pieces", pa.list_(piece))])

    def code(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _tokens.encoder(tokenizer)
        names: list[int] = []
        held: list[bytes] = []
        size, segment, first = 0, 0, 0
        most = LANES * BLOCK

        def emit() -> pa.RecordBatch:
            nonlocal names, held, size, segment, first
            counts = [len(x) // 4 for x in held]
            ids = np.frombuffer(b"".join(held), "<u4").astype(np.int32)
            pieces = []
            for at in range(0, len(ids), most):
                head, blocks = encode(ids[at : at + most])
                pieces.append({"head": head, "blocks": blocks})
            row = {"part": part, "segment": segment, "first_id": first, "n_ids": len(ids), "doc_ids": names, "doc_tokens": counts, "pieces": pieces}
            segment, first, names, held, size = segment + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in arrow:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(ids), 256):
                for doc_id, raw in zip(ids[at : at + 256], encoder.encode(batch.column("text").slice(at, 256).to_pylist()), strict=True):
                    if held and size + len(raw) // 4 > most:
                        yield emit()
                    names.append(doc_id)
                    held.append(raw)
                    size += len(raw) // 4
        if held:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(code, FILE).write.parquet(path)


def _pieces(row: pa.ListScalar) -> Iterator[tuple[bytes, list[dict]]]:
    """(head, blocks) of a segment's pieces, column by column: dictionaries made by Arrow cost many times as much."""
    heads, blocks = row.values.flatten()
    for k, head in enumerate(heads.to_pylist()):
        n_ids, crc32, payload = (x.to_pylist() for x in blocks[k].values.flatten())
        yield head, [{"n_ids": n, "crc32": c, "payload": p} for n, c, p in zip(n_ids, crc32, payload, strict=True)]


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Of each document: doc_id, start, n_tokens, ids_crc32, and (unless not asked for) ids as little-endian unsigned 32-bit integers."""
    file = spark.read.schema(FILE).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in file.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each file part
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def back(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            small, pieces = batch.select(["part", "first_id", "doc_ids", "doc_tokens"]), batch.column("pieces")
            for i in range(batch.num_rows):
                row = small.slice(i, 1).to_pylist()[0]
                raw = b"".join(decode(head, blocks).tobytes() for head, blocks in _pieces(pieces[i]))
                size = np.array(row["doc_tokens"], np.int64)
                end = np.cumsum(size)
                start = end - size
                view = memoryview(raw)
                own = [view[4 * a : 4 * b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                for k in range(0, len(own), 1024):
                    sub = own[k : k + 1024]
                    yield pa.record_batch(
                        [pa.array(row["doc_ids"][k : k + 1024], pa.int64()), pa.array(start[k : k + 1024] + row["first_id"] + base[row["part"]]), pa.array(size[k : k + 1024]), pa.array([zlib.crc32(x) for x in sub], pa.int64()), *([pa.array([bytes(x) for x in sub], pa.binary())] if with_ids else [])],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
                    )

    return file.mapInArrow(back, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.shared_folder(spark, "token-file")
    write(_shared.read(spark, sf_dir, "documents"), _tokens.default_path(), path, _shared.tasks(spark))
    return read(spark, path, with_ids=False)
