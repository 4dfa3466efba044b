"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a path: the 16-byte digests of its turns in a row, so that paths sort with equal beginnings together. Paths
are range-partitioned and sorted with their ids. Within a partition each two neighbours are an edge as deep as the turns they
share. The edges are taken in descending depth; each merges two components, and the merged component is a branching node of
that depth. What lies between a component's depth and that of the next merge is a chain of nodes with the same members.

Only prefixes of a partition's first or last path can also stand in other partitions. They stay open: the partition contracts
its forest to them, with what hangs closed below each. Open nodes of all partitions meet by their prefix digest, at most two
paths of nodes a partition, whatever the number of conversations, and are merged in descending depth once more. Identical
conversations are dealt out over partitions by their ids, so a very common one is no hot key; the ids that end in an open
node travel as joined pieces and are hashed as a stream.

Turns stand in the order of ``turn``, null first, ties in that of their digest, so repeated rows are turns of their own. A null
role or text is empty. Rows without conv_id belong to no conversation. An empty table has no nodes. Other columns are ignored.
A conversation is one row of digests and word counts, as a document's text is one row. Digests are md5, of 128 bits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared

CLOSED, OPEN, ENDS = 0, 1, 2
_RUN = pa.schema(
    [("kind", pa.int32()), ("run", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()), ("piece", pa.int64())]
)
RUN = "kind int, run long, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, piece long"
NODE = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
#: Ids in one piece of the list of an open node.
PIECE = 8192
NOTHING = hashlib.sha256(b"").hexdigest()


class _Component:
    """Neighbouring paths with ``depth`` turns in common. Sums are over what is closed below that depth."""

    __slots__ = ("below", "depth", "end", "hi", "kids", "leaves", "least", "lo", "n", "waiting")

    def __init__(self, at: int, depth: int, n: int, least: int):
        self.lo = self.hi = self.end = at
        self.depth, self.n, self.least = depth, n, least
        self.kids = self.leaves = self.below = 0
        self.waiting: list[int] = []  # rows whose parent is the node at this depth


class Run:
    """Sorted (path, id, words of each turn) rows of one partition and their forest."""

    def __init__(self, number: int):
        self.number = number
        self.ids, self.starts, self.depths, self.shared = array("q"), array("q"), array("q"), array("q")
        self.words: list[array] = []
        self.first: bytes | None = None
        self.last: bytes = b""
        self.rows: list[list] = []

    def add(self, path: bytes, conv_id: int, words: list[int]) -> None:
        if self.first is None or path != self.last:
            deep, most = 0, min(len(path), len(self.last)) if self.first is not None else 0
            while deep < most and path[deep : deep + 16] == self.last[deep : deep + 16]:
                deep += 16
            self.shared.append(deep // 16)
            self.starts.append(len(self.ids))
            self.depths.append(len(path) // 16)
            self.words.append(array("q", words))
            self.first = path if self.first is None else self.first
            self.last = path
        self.ids.append(conv_id)

    def _keys(self, path: bytes) -> list[bytes]:
        keys = [b""]
        for at in range(0, len(path), 16):
            keys.append(hashlib.md5(keys[-1] + path[at : at + 16]).digest())
        return keys

    def _lift(self, c: _Component, to: int) -> None:
        """The nodes of ``c`` from its depth to just under ``to``; from there on it is one child of what it meets."""
        words, is_open = self.words[c.lo], c.lo == 0 or c.hi == len(self.depths) - 1
        keys = self.left if c.lo == 0 else self.right
        for t in range(c.depth, to, -1):
            w = words[t - 1] if t else 0
            ended = self.ids[self.starts[c.end] : self.starts[c.end + 1]] if c.end >= 0 and t == c.depth else ()
            row = len(self.rows)
            if is_open:
                for x in c.waiting:
                    self.rows[x][6] = keys[t]
                self.rows.append([OPEN, self.number, c.least, t, None, keys[t], keys[t - 1] if t else None, c.n, c.kids, c.leaves, c.below, w, None, None])
                for piece, at in enumerate(range(0, len(ended), PIECE)):
                    self.rows.append([ENDS, self.number, None, None, None, keys[t], None, None, None, None, None, None, ",".join(map(str, ended[at : at + PIECE])), piece])
                c.kids = c.leaves = c.below = 0
                c.waiting = []
            else:
                for x in c.waiting:
                    self.rows[x][4] = c.least
                c.leaves, c.below = c.leaves or 1, c.below + (c.n - 1) * w
                digest = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if len(ended) else NOTHING
                self.rows.append([CLOSED, self.number, c.least, t, None, None, None, c.n, c.kids, c.leaves, c.below, None, digest, None])
                c.kids, c.waiting = 1, [row]
        if c.depth > to:
            c.depth, c.end = to, -1

    def forest(self) -> list[list]:
        """Rows of _RUN: all nodes, the open ones contracted, and the ids that end in these."""
        if self.first is None:
            return []
        m = len(self.depths)
        self.left, self.right = self._keys(self.first), self._keys(self.last)
        self.starts.append(len(self.ids))
        top = [_Component(k, self.depths[k], self.starts[k + 1] - self.starts[k], self.ids[self.starts[k]]) for k in range(m)]
        boss = list(range(m))

        def find(k: int) -> int:
            while boss[k] != k:
                boss[k] = boss[boss[k]]
                k = boss[k]
            return k

        for k in sorted(range(1, m), key=self.shared.__getitem__, reverse=True):
            a, b = find(k - 1), find(k)
            x, y = top[a], top[b]
            for c in (x, y):
                self._lift(c, self.shared[k])
            x.hi, x.n, x.least, x.end = y.hi, x.n + y.n, min(x.least, y.least), max(x.end, y.end)
            x.kids, x.leaves, x.below = x.kids + y.kids, x.leaves + y.leaves, x.below + y.below
            if len(x.waiting) < len(y.waiting):
                x.waiting, y.waiting = y.waiting, x.waiting
            x.waiting += y.waiting
            boss[b], top[b] = a, None
        self._lift(top[find(0)], -1)
        return self.rows


def _batches(rows: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 8192):
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 8192], strict=True), schema, strict=True)], schema=schema)


def _forests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    run = Run(TaskContext.get().partitionId())
    for batch in parts:
        for path, conv_id, words in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "words")), strict=True):
            run.add(path, conv_id, words)
    yield from _batches(run.forest(), _RUN)


def _hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha256 of its pieces in a row joined by commas); rows come sorted by key and place."""
    key, state, out = None, None, []
    for batch in parts:
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state is not None:
        out.append((key, state.hexdigest()))
    yield from _batches(out, pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))


def _merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open nodes' whole sums, deepest first; one row a distinct open prefix comes in."""
    nodes = {r["key"]: r for batch in parts for r in batch.to_pylist()}
    out = []
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        up = nodes.get(r["parent_key"]) if r["depth"] else None
        leaves, saved = r["n_leaves"] or 1, r["saved_tokens"] + (r["n_convs"] - 1) * r["words"]
        if up:
            up["n_children"] += 1
            up["n_leaves"] += leaves
            up["saved_tokens"] += saved
        out.append((r["key"], r["conv_id"], r["depth"], up and up["conv_id"], r["n_convs"], r["n_children"], leaves, saved))
    kinds = [pa.binary()] + [pa.int64()] * 7
    yield from _batches(out, pa.schema(list(zip((x.split()[0] for x in NODE.split(", ")), kinds, strict=True))))


def trie(paths: DataFrame) -> DataFrame:
    """One row per node of ``paths`` (conv_id unique, path binary, words array<long>): see the module and ``op13_conversation_trie``."""
    ordered = paths.select("path", "conv_id", "words").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    runs = _shared.written(ordered.mapInArrow(_forests, RUN), "trie-runs")
    opened = runs.where(F.col("kind") == OPEN)
    spine = opened.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    whole = _shared.written(spine.repartition(1).mapInArrow(_merged, NODE), "trie-open")
    ended = runs.where(F.col("kind") == ENDS).select("key", "run", "piece", "ends").repartition("key").sortWithinPartitions("key", "run", "piece")
    ended = ended.mapInArrow(_hashed, "key binary, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = whole.join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    closed = runs.where(F.col("kind") == CLOSED).withColumnRenamed("ends", "ends_sha256")
    # a run has its own copy of the open nodes, so that the many children of one open node do not meet in one task
    above = opened.select("run", "key").join(whole.select("key", F.col("conv_id").alias("above")), "key").withColumnRenamed("key", "parent_key")
    below = closed.where(F.col("parent_key").isNotNull()).join(above, ["run", "parent_key"], "left").withColumn("parent_conv_id", F.col("above"))
    return closed.where(F.col("parent_key").isNull()).select(columns).unionByName(below.select(columns)).unionByName(top.select(columns))


def digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, digest, words) in order) of the rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), digest(role, text).alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with the first h turns of the one at the last multiple of ``every`` in place of its own first h; h: crc32 of the id modulo ``most``."""
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.expr("slice(turns, 1, 0)")), F.lit(1), h)
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), "")).alias("path"), F.transform("turns", lambda t: t.words).alias("words"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    # written first, as sorting by range reads its input twice
    return trie(_shared.written(paths(rebuilt(conversations(_shared.read(spark, sf_dir, "conversations")))), "trie-paths"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, words) AS rn FROM (
  SELECT conv_id, turn, md5(length(role)::VARCHAR || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t)),
i AS (SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1)))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 4 AS h FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM t)),
r AS (SELECT i.conv_id, 0 AS part, o.rn, o.digest, o.words FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 20 AND o.rn <= i.h
  UNION ALL SELECT i.conv_id, 1, o.rn, o.digest, o.words FROM i JOIN o ON o.conv_id = i.conv_id AND o.rn > i.h),
p AS (SELECT i.conv_id, coalesce(list(r.digest ORDER BY part, rn) FILTER (rn IS NOT NULL), []) AS path, coalesce(list(r.words ORDER BY part, rn) FILTER (rn IS NOT NULL), []) AS words
  FROM i LEFT JOIN r ON r.conv_id = i.conv_id GROUP BY 1),
m AS (SELECT conv_id, d, array_to_string(path[1:d], '') AS key, array_to_string(path[1:d - 1], '') AS up, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS w, len(path) = d AS ends
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p)),
n AS (SELECT d, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT m.d, m.key, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN q.conv_id END AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key JOIN a ON a.d = n.d AND a.key = n.key LEFT JOIN n q ON q.d = n.d - 1 AND q.key = n.up
"""
