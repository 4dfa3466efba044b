"""Exact set-similarity self-join of documents by partitioning the universe of word shingles.

Two sets of sizes x and y link when 100 * intersection >= 80 * union, that is when they differ in at most (x + y) / 9
tokens. Sizes fall in bands; the scheme of a band serves all pairs whose smaller set is in it, so a set takes part in the
scheme of its own band and in those below whose sizes it may still meet. A scheme hashes tokens into m segments. Of any
m segments of which H + 1 differences would be needed to touch each, one at least is equal in both sets (pigeonhole).
Two allocations exist; the cheaper one is taken for each band by the number of sets counted in it (``allocate``):
  one unit a segment     m = H + 1 and some spare segments; a segment is indexed as a whole;
  two units a segment    m = (H + 1) / 2; a segment is indexed as a whole and with each one of its tokens deleted, so
                         that segments with one difference meet too. Signatures grow with the set's size, so this is
                         for small sets, whose segments would otherwise hold one or two tokens and meet by chance.
A set whose signatures leave H + 1 segments that no other set shares has no partner; most documents end here. Of the rest
each probes its H + 1 segments with the fewest sharers and finds all others through the index of all segments.

Of these, sets with more tokens of their own, in no other candidate, than a partner may differ in are dropped, and a pair
whose own tokens add up to more than it may differ in is not verified; nor is a pair whose parity sketches differ in more bits than that.

Sharers of one signature are not paired with each other: they are verified against one leader and joined with it if they
link. Sets that are still in different components after that meet once under each leader that they have in common. Equal
sets count as one class throughout.
Signatures are found with numpy in tasks that Spark deals out by hash; a signature that one batch of documents holds very
often travels as one entry.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text
from tidemark.llm.graph import components

WORDS = 5  # of a shingle
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Entries of one signature in one batch from which they travel as one.
OFTEN = 32
#: Bytes of text whose signatures a task holds at a time; numpy holds some 15 times as much.
DEALT = 4 << 20
#: Words of 64 bits of a set's parity sketch.
SKETCH = 8
_ODD = [f"odd{i}" for i in range(SKETCH)]
#: Turns of leaders before sets that still share signatures are held against each other.
STARS = 1


@functools.cache
def limits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, largest size, most differences of a pair) of each band, for sizes up to 2**40."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, -(-low[-1] * 8 // 5)))
    low = np.array(low, np.int64)
    high = np.append(low[1:] - 1, 1 << 41)
    return low, high, (high + high * 5 // 4) // 9


def _segments(units: np.ndarray) -> np.ndarray:
    most = limits()[2]
    return np.where(units == 2, -(-(most + 1) // 2), most + 1 + -(-most // 8))


def allocate(sets: np.ndarray) -> tuple[int, ...]:
    """Units a segment of each band, the cheaper ones where ``sets`` is how many sets each band has.

    The cost of a set is its signatures and the sets that it meets by chance: those with the same empty segment, which one
    unit a segment indexes only where filled segments are too few, or, with one-deletion neighbourhoods, with a segment of
    at most one token. The chances are those of tokens thrown at segments at random.
    """
    low, high, most = limits()
    size = (low + np.minimum(high, 1 << 40)) / 2
    meets = sets + np.append(sets[1:], 0)
    cost = []
    for unit in (1, 2):
        m = _segments(np.full(len(low), unit))
        load = size / m
        empty = np.exp(-np.minimum(load, 700))
        if unit == 1:
            few, term, spare = np.zeros(len(low)), np.exp(-np.minimum(m * empty, 700)), m - most - 1
            for k in range(int(spare[spare < 64].max()) + 1):
                few += np.where(k <= spare, term, 0)
                term = term * m * empty / (k + 1)
            short = np.where(spare < 64, np.clip(1 - few, 0, 1), spare < m * empty)
            alike = m * (short * np.maximum(empty, (spare + 1) / m)) ** 2
        else:
            alike = m * (empty * (1 + load)) ** 2
        cost.append(m + (unit == 2) * size + meets * alike)
    return tuple(np.where(cost[1] < cost[0], 2, 1).tolist())


@functools.cache
def bands(units: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least size, largest size, segments, units a segment) of each band."""
    low, high, _ = limits()
    return low, high, _segments(np.array(units)), np.array(units)


#: The allocation for some thousands of sets in each band.
USUAL = allocate(np.full(len(limits()[0]), 5000))


def schemes(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, band) of the schemes that sets of sizes n take part in: their own band's and those below that reach them."""
    low, high, _ = limits()
    own = np.searchsorted(low, n, "right") - 1
    out = [(np.flatnonzero(n > 0), own[n > 0])]
    for down in (1, 2):
        k = own - down
        ok = np.flatnonzero((n > 0) & (k >= 0) & (high[np.maximum(k, 0)] * 5 // 4 >= n))
        if len(ok):
            out.append((ok, k[ok]))
    return out


def allowed(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Most differences of a set of size n from a partner in a scheme."""
    high = limits()[1][band]
    return (n + np.minimum(n * 5 // 4, high * 5 // 4)) // 9


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each row, offsets of rows) of texts."""
    starts, ends, first = _text.words(data, offsets, _text.NOT_SPACE)
    h = _text.Hashes(_text.lower(data)).of(starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        if len(h) >= WORDS:
            total = np.zeros(len(h) - WORDS + 1, np.uint64)
            for i in range(WORDS):
                total = (total + h[i : len(h) - WORDS + 1 + i]) * _GOLD
                total ^= total >> np.uint64(29)
            whole = row[: len(total)] == row[WORDS - 1 :]
            shingle, own = _text.mix(total[whole]), row[: len(total)][whole]
        else:
            shingle, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            extra = np.array([functools.reduce(lambda a, b: (a + int(b)) * int(_GOLD) % (1 << 64), h[first[r] : first[r + 1]], int(count[r])) for r in short.tolist()], np.uint64)
            shingle, own = np.concatenate([shingle, _text.mix(extra ^ _GOLD)]), np.concatenate([own, short])
    order = np.lexsort((shingle, own))
    shingle, own = shingle[order], own[order]
    keep = np.ones(len(shingle), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])
    shingle, own = shingle[keep], own[keep]
    return shingle, np.searchsorted(own, np.arange(len(offsets)))


def set_keys(shingle: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(shingle ^ np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
        return tuple((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


def signatures(shingle: np.ndarray, at: np.ndarray, allocated: tuple[int, ...] = USUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, segment, signature, whether the segment has tokens) of sets.

    Empty segments are left out where the others are enough for the pigeonhole: then the set is found by its others, and a
    partner for which they are not enough is found by this set's.
    """
    n = np.diff(at)
    _, _, segments, units = bands(allocated)
    found = []
    for rows, band in schemes(n):
        size = n[rows]
        token = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(rows)), size)
        t, m = shingle[token], segments[band]
        seg = ((t >> np.uint64(20)) % m[own].astype(np.uint64)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(m)])
        cell = base[own] + seg
        with np.errstate(over="ignore"):
            value = _text.mix(t + _GOLD)
            order = np.argsort(cell, kind="stable")
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)])
            edge = np.searchsorted(cell[order], np.arange(base[-1] + 1))
            total = sums[edge[1:]] - sums[edge[:-1]]
            held = np.diff(edge)
            cell_row = np.repeat(np.arange(len(rows)), m)
            cell_seg = np.arange(base[-1]) - base[cell_row]
            salt = _text.mix((band[cell_row] * 1_000_003 + cell_seg).astype(np.uint64) * _GOLD + np.uint64(11))
            filled = np.bincount(cell_row, held > 0, len(rows))
            enough = (units[band] == 1) & (filled >= allowed(size, band) + 1)
            keep = (held > 0) | ~enough[cell_row]
            found.append((rows[cell_row[keep]], band[cell_row[keep]], cell_seg[keep], _text.mix(total[keep] ^ salt[keep]), held[keep] > 0))
            two = (units[band] == 2)[own[order]]
            c = cell[order][two]
            if len(c):
                found.append((rows[cell_row[c]], band[cell_row[c]], cell_seg[c], _text.mix((total[c] - value[order][two]) ^ salt[c]), np.ones(len(c), bool)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def needs(n: np.ndarray, row: np.ndarray, band: np.ndarray, seg: np.ndarray, filled: np.ndarray, allocated: tuple[int, ...] = USUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each (row, band), named row * 64 + band in order: the segments to probe, and the shared ones that a partner implies.

    With one unit a segment and H + 1 filled segments, H + 1 are probed and all but H are shared with any partner. Else all
    are probed and one is shared: with two units, or where a partner may meet only at what is empty in both.
    """
    cell, at = np.unique((row * 64 + band) * (1 << 36) + seg, return_index=True)
    key, start = np.unique(cell >> 36, return_index=True)
    held = np.add.reduceat(filled[at].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    most = allowed(n[key // 64], key % 64)
    enough = (bands(allocated)[3][key % 64] == 1) & (held >= most + 1)
    return key, np.where(enough, most + 1, 1 << 30), np.where(enough, held - most, 1)


def _each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = _text.buffers(batch.column("text"))
    ids = np.asarray(batch.column("doc_id"))
    for a, b, part, own in _text.slices(data, offsets, _text.NARROW):
        yield ids[a:b], *sets(part, own)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch by about DEALT bytes of text; a longer text comes alone."""
    for a, b, *_ in _text.slices(*_text.buffers(batch.column("text")), DEALT):
        yield batch.slice(a, b - a)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n, key_a, key_b: size and name of each row's set."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            marks, done = batch.column("mark"), 0
            for ids, shingle, at in _each(batch):
                a, b = set_keys(shingle, at)
                yield pa.record_batch([pa.array(ids), marks.slice(done, len(ids)), pa.array(np.diff(at)), pa.array(a), pa.array(b)], names=["doc_id", "mark", "n", "key_a", "key_b"])
                done += len(ids)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, n long, key_a long, key_b long")


def suspects(docs: DataFrame, parts: int, allocated: tuple[int, ...] = USUAL) -> DataFrame:
    """key_a, band of sets that may have a partner in that scheme: fewer than H + 1 segments are theirs alone."""
    parts *= 2

    def deal(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            met: set[tuple[int, int]] = set()  # copies within the batch: one stands for all
            for piece in _pieces(batch):
                yield from dealt_piece(piece, met)

    def dealt_piece(piece: pa.RecordBatch, met: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows, ids, spares = [], [], []
        for own_ids, shingle, at in _each(piece):
            a, b = set_keys(shingle, at)
            fresh = np.zeros(len(own_ids), bool)
            for i, k in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if k not in met:
                    met.add(k)
                    fresh[i] = True
            row, band, seg, sig, filled = signatures(shingle, at, allocated)
            keep = fresh[row]
            ahead = sum(map(len, ids))
            rows.append((row[keep] + ahead, band[keep], sig[keep]))
            key, need, spare = needs(np.diff(at), row, band, seg, filled, allocated)
            spares.append((spare, key + 64 * ahead))
            ids.append(a)
        row, band, sig = (np.concatenate(x) for x in zip(*rows, strict=True))
        doc = np.concatenate(ids)
        spare_of = [np.concatenate(x) for x in zip(*spares, strict=True)]
        rows.clear()
        order = np.argsort(sig, kind="stable")
        row, band, sig = row[order], band[order], sig[order]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(sig)))
        often = np.repeat(size >= OFTEN, size)
        first = np.zeros(len(sig), bool)
        first[start] = True
        bucket = ((sig >> np.uint64(48)) % np.uint64(parts)).astype(np.int32)
        # what is met often here is shared for certain; one entry of it tells the other pieces
        k, back = np.unique(row * 64 + band, return_inverse=True)
        if len(k):
            lines = np.stack([k % 64, np.bincount(back, often, len(k)).astype(np.int64), spare_of[0][np.searchsorted(spare_of[1], k)]])
            yield pa.record_batch([pa.array(np.full(1, -1, np.int32)), pa.array([doc[k // 64].tobytes()]), pa.array([lines.tobytes()]), pa.array([b""]), pa.array([b""])], names=["bucket", "docs", "band", "row", "sig"])
        out = np.flatnonzero(~often | first)
        out = out[np.argsort(bucket[out], kind="stable")]
        edge = np.searchsorted(bucket[out], np.arange(parts + 1))
        for p in range(parts):
            part = out[edge[p] : edge[p + 1]]
            if len(part):
                k, back = np.unique(row[part] * 64 + band[part], return_inverse=True)
                mark = np.where(often[part], 0x80000000, 0).astype(np.uint32) | back.astype(np.uint32)
                six = sig[part].view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.record_batch([pa.array(np.full(1, p, np.int32)), pa.array([doc[k // 64].tobytes()]), pa.array([(k % 64).astype(np.uint8).tobytes()]), pa.array([mark.tobytes()]), pa.array([np.ascontiguousarray(six.T).tobytes()])], names=["bucket", "docs", "band", "row", "sig"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        names = ["key_a", "band", "shared", "spare"]
        docs_, band_, mark_, sig_ = ([x.as_py() for x in table.column(c)] for c in ("docs", "band", "row", "sig"))
        d = np.concatenate([np.frombuffer(x, np.int64) for x in docs_])
        if key[0].as_py() < 0:
            lines = [np.frombuffer(x, np.int64).reshape(3, -1) for x in band_]
            band, n, spare = (np.concatenate([x[i] for x in lines]) for i in (0, 1, 2))
            return pa.table([pa.array(d), pa.array(band.astype(np.int32)), pa.array(n), pa.array(spare)], names=names)
        band = np.concatenate([np.frombuffer(x, np.uint8) for x in band_])
        base = np.concatenate([[0], np.cumsum([len(x) // 8 for x in docs_])])
        raw = [np.frombuffer(x, np.uint32) for x in mark_]
        often = np.concatenate([x >> 31 for x in raw]).astype(bool)
        owner = np.concatenate([(x & 0x7FFFFFFF).astype(np.int64) + base[i] for i, x in enumerate(raw)])
        wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
        at = 0
        for x, six in zip(raw, sig_, strict=True):
            wide[at : at + len(x), :6] = np.frombuffer(six, np.uint8).reshape(6, -1).T
            at += len(x)
        sig = wide.view(np.uint64).ravel()
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        shared = np.repeat(size > 1, size)
        shared &= ~often[order]  # counted where they were met
        n = np.bincount(owner[order][shared], minlength=len(d))
        keep = np.flatnonzero(n)
        return pa.table([pa.array(d[keep]), pa.array(band[keep].astype(np.int32)), pa.array(n[keep].astype(np.int64)), pa.array(np.zeros(len(keep), np.int64))], names=names)

    dealt = docs.mapInArrow(deal, "bucket int, docs binary, band binary, row binary, sig binary")
    # what was met often needs no meeting: each such row is a group of its own
    salted = dealt.withColumn("salt", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("docs"), F.lit(4 * parts)).cast("int")).otherwise(0))
    met = salted.groupBy("bucket", "salt").applyInArrow(meet, "key_a long, band int, shared long, spare long")
    return met.groupBy("key_a", "band").agg(F.sum("shared").alias("shared"), F.max("spare").alias("spare")).where("shared >= spare").select("key_a", "band")


def expand(docs: DataFrame, allocated: tuple[int, ...] = USUAL) -> DataFrame:
    """doc_id, band, need, n, set (sorted hashes), and the signatures with their segments of each (document, scheme)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("band", pa.int32()), ("need", pa.int64()), ("n", pa.int64()), ("seg", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])
        for batch in arrow:
            for ids, shingle, at in _each(batch):
                row, band, seg, sig, filled = signatures(shingle, at, allocated)
                _, need, _ = needs(np.diff(at), row, band, seg, filled, allocated)
                key = row * 64 + band
                order = np.argsort(key, kind="stable")
                seg, sig = seg[order], sig[order].view(np.int64)
                k, start = np.unique(key[order], return_index=True)
                edge = np.append(start, len(sig)).astype(np.int32)
                r, b = k // 64, k % 64
                n = np.diff(at)[r]
                columns = [pa.array(ids[r]), pa.array(b.astype(np.int32)), pa.array(need), pa.array(n), pa.ListArray.from_arrays(pa.array(edge), pa.array(seg)), pa.ListArray.from_arrays(pa.array(edge), pa.array(sig))]
                yield pa.record_batch(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id long, band int, need long, n long, seg array<long>, sig array<long>")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, n, the set as bytes of sorted 64-bit hashes, and its parity sketch.

    The sketch has a bit for each of 64 * SKETCH cells, set where the cell has an odd number of tokens. A token that only one
    of two sets has flips one bit, so the bits in which two sketches differ are never more than the tokens.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for ids, shingle, at in _each(batch):
                edge = (8 * at).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edge), pa.py_buffer(shingle.tobytes())])
                cell = (shingle >> np.uint64(9)) % np.uint64(64 * SKETCH)
                row = np.repeat(np.arange(len(ids)), np.diff(at))
                odd = np.zeros((len(ids), SKETCH), np.uint64)
                np.bitwise_xor.at(odd, (row, (cell // np.uint64(64)).astype(np.int64)), np.uint64(1) << (cell % np.uint64(64)))
                yield pa.record_batch([pa.array(ids), pa.array(np.diff(at)), held, *[pa.array(odd[:, i].copy().view(np.int64)) for i in range(SKETCH)]], names=["doc_id", "n", "set", *_ODD])

    return docs.mapInArrow(run, "doc_id long, n long, set binary, " + ", ".join(f"{c} long" for c in _ODD))


def _may_link(a: str, b: str) -> str:
    """SQL that is true of all pairs that link: of sizes, tokens of their own, and sketches, in columns with these suffixes."""
    odd = " + ".join(f"bit_count({c}{a} ^ {c}{b})" for c in _ODD)
    return f"least(n{a}, n{b}) * 100 >= greatest(n{a}, n{b}) * 80 AND (own{a} + own{b}) * 9 <= n{a} + n{b} AND ({odd}) * 9 <= n{a} + n{b}"


def _facts(held: DataFrame, name: str, suffix: str) -> DataFrame:
    return held.select(F.col("doc_id").alias(name), *[F.col(c).alias(c + suffix) for c in ("n", "own", *_ODD)])


def _alone(held: DataFrame) -> DataFrame:
    """``held`` and own: how many shingles of each set no other set of the table has; any partner differs in these."""

    def tokens(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            ids, sizes = np.asarray(batch.column("doc_id")), np.asarray(batch.column("n"))
            for at in range(0, len(ids), 256):
                raw = b"".join(x.as_py() for x in batch.column("set").slice(at, 256))
                yield pa.record_batch([pa.array(np.frombuffer(raw, np.int64)), pa.array(np.repeat(ids[at : at + 256], sizes[at : at + 256]))], names=["token", "doc_id"])

    single = held.mapInArrow(tokens, "token long, doc_id long").groupBy("token").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1")
    own = single.groupBy("doc_id").agg(F.count("*").alias("own"))
    return _shared.written(held.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0))), "held")


def _links(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the (a, b) pairs whose sets link. A leader's set travels once to each task that verifies it."""

    def verify(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            a, b = batch.column("a"), batch.column("b")
            xs, ys = batch.column("x"), batch.column("y")
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = np.frombuffer(xs[i].as_buffer(), np.int64), np.frombuffer(ys[i].as_buffer(), np.int64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[i] = 100 * both >= 80 * (len(x) + len(y) - both)
            keep = np.flatnonzero(ok)
            yield pa.record_batch([a.take(pa.array(keep)), b.take(pa.array(keep))], names=["a", "b"])

    sized = pairs.join(_facts(held, "a", "_a"), "a").join(_facts(held, "b", "_b"), "b")
    fit = sized.where(_may_link("_a", "_b")).select("a", "b")
    full = fit.join(held.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").join(held.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    A text without words, or null, has an empty set, links with nothing and is a component of its own. Rows with the same
    doc_id are one node whatever their texts are: each row links by its own text, and all of them share a component. Rows
    without doc_id have no component. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _components(docs.where(F.col("doc_id").isNotNull()), True).select("doc_id", "n_shingles", F.coalesce("component.doc_id", "doc_id").alias("component_id"))
    unnamed = docs.where(F.col("doc_id").isNull()).withColumn("doc_id", F.lit(0).cast("long"))
    none = describe(unnamed).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none)


#: Stands for a missing doc_id where rows are nodes; it comes last.
_NO_ID = (1 << 63) - 1


def leaders(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their components, whole: of linked rows the one with the smallest (doc_id, hash of text).

    Here a row is a node of its own, so that two texts under one doc_id, or without doc_id, do not stand for each other. Of
    rows that repeat doc_id and text one stays, where the text has words. Rows without words all stay.
    """
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("__mark", F.xxhash64(F.col("text").cast("string")))
    found = _components(keyed.select(F.col("__id").alias("doc_id"), F.col("text").cast("string").alias("text")), False)
    stay = found.where("n_shingles > 0 AND (component IS NULL OR (component.doc_id = doc_id AND component.mark = mark))").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    kept = keyed.join(stay, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    bare = found.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return kept.unionByName(keyed.join(bare, ["__id", "__mark"], "left_semi")).select(docs.columns)


def _components(known: DataFrame, ids: bool) -> DataFrame:
    """doc_id, mark, n_shingles, component (the least (doc_id, mark) of all that the row reaches; null: itself alone)."""
    spark, parts = known.sparkSession, _shared.tasks(known.sparkSession)
    info = _shared.written(describe(known), "sets")
    # equal sets are one class, named by a number; one row's text stands for it
    classes = info.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.count("*").alias("copies"))
    classes = _shared.written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    low = limits()[0]
    band = F.size(F.filter(F.array(*[F.lit(x) for x in low.tolist()]), lambda x: x <= F.col("n"))) - 1
    sizes = np.zeros(len(low))
    for r in classes.groupBy(band.alias("band")).count().collect():  # a row for each band of sizes at most
        sizes[r["band"]] = r["count"]
    allocated = allocate(sizes)
    # any batch's stand-in for copies speaks for the whole class
    wanted = _shared.written(suspects(known, parts, allocated).join(classes, "key_a").select(F.col("rep").alias("doc_id"), "band").distinct(), "suspects")
    chosen = wanted.select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id"), "one"), "doc_id").select(F.col("doc_id").alias("rep"), F.col("one.doc_id").alias("doc_id"), F.col("one.mark").alias("mark"))
    texts = known.withColumn("mark", F.xxhash64("text")).join(chosen, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    texts = _shared.written(texts.select(F.col("rep").alias("doc_id"), "text"), "texts")
    held = _alone(_shared.written(members(texts), "members"))
    alive = held.where("own * 9 <= n + n * 1.25").select("doc_id")
    open_ = expand(texts.join(alive, "doc_id", "left_semi"), allocated).join(wanted, ["doc_id", "band"])
    rows = open_.select("doc_id", "band", "need", F.explode(F.arrays_zip("seg", "sig")).alias("z")).select("doc_id", "band", "need", "z.seg", "z.sig")
    rows = _shared.written(rows, "signatures")
    counted = rows.groupBy("sig").agg(F.count("*").alias("sharers")).where("sharers > 1")
    shared = rows.join(counted, "sig")
    # the segments of a set alone cost nothing and lie first: of the shared ones, the cheapest up to need are probed
    mine = rows.groupBy("doc_id", "band").agg(F.count("*").alias("all"))
    packed = shared.groupBy("doc_id", "band", "need").agg(F.array_sort(F.collect_list(F.struct("sharers", "sig"))).alias("z"))
    probes = packed.join(mine, ["doc_id", "band"]).where(F.size("z") > F.greatest(F.lit(0), F.col("all") - F.col("need")))
    take = F.least(F.size("z"), F.greatest(F.lit(0), F.col("need") - (F.col("all") - F.size("z")))).cast("int")
    picked = probes.select("doc_id", F.explode(F.transform("z", lambda x, i: F.struct(x["sig"].alias("sig"), x["sharers"].alias("sharers"), (i < take).alias("probe")))).alias("p")).select("doc_id", "p.sig", "p.sharers", "p.probe")
    return _told(info, classes, _rounds(_shared.written(picked, "index"), held), parts, ids)


def _told(info: DataFrame, classes: DataFrame, edges: DataFrame, parts: int, ids: bool) -> DataFrame:
    """The result for each row of ``info``, from the links between classes; with ``ids``, rows of one doc_id are one node."""
    repeats = False
    if ids:
        name = F.struct("key_a", "key_b", "n")
        twice = _shared.written(info.groupBy("doc_id").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo != hi").select("doc_id"), "twice")
        repeats = not twice.isEmpty()  # an id with several texts joins their classes
    if repeats:
        own = info.where("n > 0").join(twice, "doc_id").join(classes.select("key_a", "key_b", "n", "rep"), ["key_a", "key_b", "n"]).select("doc_id", "rep").distinct()
        first = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
        edges = edges.unionByName(own.join(first, "doc_id").where("a != rep").select("a", F.col("rep").alias("b")))
    linked = classes.join(components(edges), F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    least = linked.groupBy("root").agg(F.min("one").alias("component"), F.sum("copies").alias("held"))
    # a set that one row has and nothing links needs no looking up; it is its own component
    known = _shared.written(linked.join(least.where("held > 1"), "root").select("key_a", "key_b", "n", "copies", "component"), "told")
    # a class with over 1 / (4 * parts) of all rows is one of at most 4 * parts classes, which every task can hold
    total = F.lit(classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    large = known.where(F.col("copies") * 4 * parts > total).select("key_a", "key_b", "n", F.col("component").alias("large"))
    rest = known.where(F.col("copies") * 4 * parts <= total).select("key_a", "key_b", "n", "component")
    rows = info.join(F.broadcast(large), ["key_a", "key_b", "n"], "left").withColumn("key_a", F.when(F.col("large").isNull(), F.col("key_a")).otherwise(F.xxhash64("doc_id", "mark")))
    rows = rows.withColumn("size", F.when(F.col("large").isNull(), F.col("n")).otherwise(-1))
    out = rows.join(rest.withColumnRenamed("n", "size"), ["key_a", "key_b", "size"], "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("large", "component").alias("component"))
    if repeats:
        whole = out.join(twice, "doc_id").groupBy("doc_id").agg(F.min("component").alias("whole"))
        out = out.join(whole, "doc_id", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    return out


def _rounds(index: DataFrame, held: DataFrame, stars: int = STARS) -> DataFrame:
    """Links of the sharers of each signature: with a leader first, then between those still in different components.

    A signature's leader is its sharer that shares most in all, the likely centre of a group of near copies; in the next
    turns the leader is chosen among those that are not yet in the first one's component. Every turn is linear in the index.
    Sets that still share a signature across components meet under that signature's leader: two sets may share a hundred
    signatures, but these have few leaders, and the sizes, own tokens and sketches are held against each other there.
    """
    weight = index.groupBy("doc_id").agg(F.sum("sharers").alias("weight"))
    rows = _shared.written(index.join(weight, "doc_id").select("sig", "doc_id", "probe", F.struct("weight", "doc_id").alias("rank")), "ranked")
    seen = edges = None
    for turn in range(stars + 1):
        now = rows.withColumn("root", F.col("doc_id"))
        if edges is not None:
            roots = components(edges).withColumnRenamed("node", "doc_id")
            now = _shared.written(rows.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "now")
        mixed = now.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("probe").alias("any"), F.max(F.struct("rank", "root")).alias("first")).where("any AND r0 != r1")
        left = now.join(mixed.select("sig", F.col("first.root").alias("head"), F.col("first.rank.doc_id").alias("leader")), "sig")
        if turn < stars:
            if turn:  # another leader, outside the first one's component
                other = left.where("root != head").groupBy("sig").agg(F.max(F.struct("rank", "root")).alias("first"))
                left = now.join(other.select("sig", F.col("first.root").alias("head"), F.col("first.rank.doc_id").alias("leader")), "sig")
            pairs = left.where("root != head").select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b"))
        else:
            met = left.groupBy("leader", "doc_id").agg(F.max("root").alias("root"), F.max("probe").alias("probe"))
            full = met.join(_facts(held, "doc_id", ""), "doc_id")
            side = lambda n: full.select("leader", *[F.col(c).alias(f"{c}_{n}") for c in ("doc_id", "root", "probe", "n", "own", *_ODD)])
            fit = _may_link("_a", "_b")
            pairs = side("a").join(side("b"), "leader").where(f"doc_id_a < doc_id_b AND root_a != root_b AND (probe_a OR probe_b) AND {fit}").select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        pairs = pairs.distinct() if seen is None else pairs.distinct().join(seen, ["a", "b"], "left_anti")
        pairs = _shared.written(pairs, "pairs")
        found = _links(pairs, held)
        edges = _shared.written(found if edges is None else edges.unionByName(found), "links")
        seen = pairs if seen is None else seen.unionByName(pairs)
    return edges


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(_shared.read(spark, sf_dir, "documents"))
