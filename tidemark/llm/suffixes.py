"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if some WINDOW-byte string that covers it starts anywhere else in the corpus, the same text included. Only the
first WINDOW bytes of a suffix matter, so a suffix is repeated if a neighbour in sorted order shares WINDOW bytes with it.

1. Anchors (``_anchors``) cut all windows into stretches. Equal windows have anchors with equal cores, so a stretch whose
   core occurs once has no repeated window. Cores meet in tasks dealt out by hash; most stretches end here.
2. Stretches equal as a whole (named by 64 bits of their core and 64 of all their 8-byte strings, by unlike hashes) are
   repeated as a whole. Where a core has several different stretches,
   one of each goes on, as only parts of them may be repeated.
3. Their suffixes are sorted. Every task sorts runs of its own, parted by the hash of the suffix's core, and front-codes
   them; equal suffixes have equal cores at equal distance, so they are in the same part, and neighbouring suffixes of one
   text are too, which lets a run be packed tightly. A core with over MANY stretches is dealt out further, by blocks of
   BLOCK distances and the bytes that all windows of such a block share, which equal windows have in common.
   Parts are exchanged, and a loser tree that carries common prefixes merges a part's runs. Neighbours that share WINDOW
   bytes mark their suffixes as repeated.
4. Marks return to all equal stretches, and texts are cut.

A core that one batch holds very often is known to be repeated there; its stretches go on directly and one entry tells the
other batches. A null text is empty. Every row is a document: rows that repeat a doc_id and text lose what they share and
get the same result each; rows with one doc_id and other texts, and rows without doc_id, are told apart by text. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _anchors, _merge, _shared, _text

WINDOW = _anchors.WINDOW
#: Stretches of one core in one batch from which they go on directly.
OFTEN = 32
#: Suffixes of one run.
RUN = 100_000
#: Different stretches of a core beyond which its suffixes are dealt out by blocks of distances too.
MANY, BLOCK = 500, 16
#: Suffixes of a part: at least, while there are fewer parts than tasks can take, and at most.
FEW, MOST = 20_000, 400_000


def mark(text: Column) -> Column:
    """32 bits of a text, null as empty, that tell texts under one doc_id apart."""
    return (F.crc32(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")) - F.lit(1 << 31)).cast("int")


def _named(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, row (``carried`` columns), text, and what tells rows apart: name (the doc_id; without one, 64 bits of the text) and mark (32 bits of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.struct("doc_id", *[c for c in carried if c != "doc_id"]).alias("row"), text.alias("text"))
    return rows.withColumn("name", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).withColumn("mark", mark(F.col("text")))


_STRETCH = "core long, whole long, name long, first long, windows int, mark int"


def stretches(named: DataFrame, parts: int) -> DataFrame:
    """core, whole, name, first, windows, mark of every stretch whose core occurs twice or more.

    windows is their number, and in the higher half the distance from the first window to the anchor.
    """
    parts *= 2
    fields = ("core", "whole", "name", "first", "windows", "mark")
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)

    def deal(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            data, offsets = _text.buffers(batch.column("text"))
            ids, marks = np.asarray(batch.column("name")), np.asarray(batch.column("mark"))
            found = []
            for a, b, part, own in _text.slices(data, offsets, _text.NARROW):
                h = _text.Hashes(part)
                row, x, z, s = _anchors.stretches(part, own, h)
                found.append((h.of(s, s + _anchors.CORE), _text.Strings(part).of(x, z + WINDOW), ids[a:b][row], x - own[row], (z - x + 1) + ((s - x) << 16), marks[a:b][row]))
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            order = np.argsort(columns[0], kind="stable")
            for i, c in enumerate(columns):  # one after another, so that few copies stand at a time
                columns[i] = c[order]
            core = columns[0]
            start = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]])) if len(core) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(core)))
            often = np.repeat(size >= OFTEN, size)
            bucket = ((core >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            lead = np.zeros(len(core), bool)
            lead[start] = True

            def row(p: int, pick: np.ndarray, flag: np.ndarray, columns=columns) -> pa.RecordBatch:
                blobs = [c[pick].astype(k if k != np.int64 or c.dtype != np.uint64 else np.uint64).tobytes() for c, k in zip(columns, kinds, strict=True)]
                return pa.record_batch([pa.array(np.full(1, p, np.int32)), *[pa.array([x]) for x in blobs], pa.array([np.packbits(flag).tobytes()])], names=["bucket", *fields, "often"])

            direct = np.flatnonzero(often)
            for at in range(0, len(direct), 50_000):
                pick = direct[at : at + 50_000]
                yield row(-1, pick, np.ones(len(pick), bool))
            out = np.flatnonzero(~often | lead)
            out = out[np.argsort(bucket[out], kind="stable")]
            edge = np.searchsorted(bucket[out], np.arange(parts + 1))
            for p in range(parts):
                pick = out[edge[p] : edge[p + 1]]
                if len(pick):
                    yield row(p, pick, often[pick])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table.column(f)]) for f, k in zip(fields, kinds, strict=True)]
        sizes = [len(x.as_buffer()) // 8 for x in table.column("core")]
        often = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[:n] for x, n in zip(table.column("often"), sizes, strict=True)]).astype(bool)
        if key[0].as_py() >= 0:
            order = np.argsort(columns[0], kind="stable")
            core = columns[0][order]
            start = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
            size = np.diff(np.append(start, len(core)))
            keep = order[np.repeat(size > 1, size) & ~often[order]]  # the others went on directly
            columns = [c[keep] for c in columns]
        return pa.table([pa.array(c) for c in columns], names=fields)

    dealt = named.mapInArrow(deal, "bucket int, core binary, whole binary, name binary, first binary, windows binary, mark binary, often binary")
    salted = dealt.withColumn("salt", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("name", "first"), F.lit(4 * parts)).cast("int")).otherwise(0))
    return salted.groupBy("bucket", "salt").applyInArrow(meet, _STRETCH)


def _suffixes(arrow: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows as an array of bytes, tags class * 256 + place, parts) of the stretches of documents, in runs sorted by part."""
    strings, tags, groups, size = [], [], [], 0

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, tag, group = np.concatenate(strings), np.concatenate(tags), np.concatenate(groups)
        order = np.argsort(rows.view(f"S{WINDOW}").ravel(), kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        return rows[order], tag[order], group[order]

    for batch in arrow:
        data, offsets = _text.buffers(batch.column("text"))
        asked = batch.column("asked")
        first, windows, own, core, many = (np.asarray(asked.flatten().field(f)) for f in ("first", "windows", "class", "core", "many"))
        count, ahead = windows & 0xFFFF, windows >> 16
        part = _text.mix(core.view(np.uint64)) % np.uint64(parts)
        edge = np.asarray(asked.offsets) - asked.offsets[0].as_py()
        for i, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            views = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
            while x < y:
                z = x + max(1, int(np.searchsorted(np.cumsum(count[x:y]), RUN)))  # a very long text takes several runs
                held = count[x:z]
                of = np.repeat(np.arange(x, z), held)
                place = np.arange(len(of)) - np.repeat(np.cumsum(held) - held, held)
                strings.append(views[first[of] + place])
                tags.append((own[of] << 8) + place)
                group = part[of]
                for j in np.flatnonzero(many[x:z]) + x:
                    mine = np.flatnonzero(of == j)
                    distance, anchor = ahead[j] - place[mine], first[j] + ahead[j]
                    for block in range(int(distance[-1]) // BLOCK, int(distance[0]) // BLOCK + 1):
                        begin = anchor - BLOCK * block
                        common = zlib.crc32(text[max(0, begin) : begin + WINDOW - BLOCK + 1])
                        key = (int(core[j]) + (block << 32) + common + 1) % (1 << 64)
                        group[mine[distance // BLOCK == block]] = _text.mix(np.array([key], np.uint64))[0] % np.uint64(parts)
                groups.append(group.astype(np.int32))
                size += len(of)
                if size >= RUN:
                    yield run()
                    strings, tags, groups, size = [], [], [], 0
                x = z
    if size:
        yield run()


def repeated(texts: DataFrame, tasks: int) -> DataFrame:
    """class, places: of each class (``asked``: array of class, core, many, first, windows beside text) its windows that occur twice.

    ``asked`` holds one stretch of each class. NUL bytes sort before all others, as in any byte string.
    """
    total = texts.select(F.sum(F.aggregate("asked", F.lit(0).cast("long"), lambda s, x: s + x["windows"].bitwiseAND(0xFFFF)))).first()[0] or 0
    parts = max(1, min(4 * tasks, total // FEW), total // MOST)

    def sort(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tag, group in _suffixes(arrow, parts):
            edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                run, tags = _merge.pack(rows[a:b], tag[a:b])
                yield pa.record_batch([pa.array([int(group[a])], pa.int32()), pa.array([run]), pa.array([tags])], names=["part", "run", "tags"])

    def merge(table: pa.Table) -> pa.Table:
        import zstandard

        z = zstandard.ZstdDecompressor()
        packed = [x.as_py() for x in table.column("run")]
        tags = [np.frombuffer(z.decompress(x.as_py()), np.int64) for x in table.column("tags")]
        marks = [bytearray(len(t)) for t in tags]
        run0 = at0 = 0
        for run, at, shared in _merge.merged(packed, WINDOW):
            if shared == WINDOW:
                marks[run][at] = marks[run0][at0] = 1
            run0, at0 = run, at
        tag = np.sort(np.concatenate([t[np.frombuffer(m, bool)] for t, m in zip(tags, marks, strict=True)]))
        own, start = np.unique(tag >> 8, return_index=True)
        edge = np.append(start, len(tag)).astype(np.int32)
        return pa.table([pa.array(own), pa.ListArray.from_arrays(pa.array(edge), pa.array((tag & 255).astype(np.int16)))], names=["class", "places"])

    runs = texts.mapInArrow(sort, "part int, run binary, tags binary")
    met = runs.groupBy("part").applyInArrow(merge, "class long, places array<short>")
    return met.groupBy("class").agg(F.flatten(F.collect_list("places")).alias("places"))


def covered(named: DataFrame) -> DataFrame:
    """name, mark, spans: for each text with repeated bytes, array of (start, end) that may touch or overlap."""
    parts = _shared.tasks(named.sparkSession)
    named = named.select("name", "mark", "text")
    held = _shared.written(stretches(named, parts), "stretches")
    kinds = held.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("name", "mark", "first", "windows")).alias("one"))
    kinds = _shared.written(kinds.withColumn("class", F.monotonically_increasing_id()), "kinds")
    several = kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core", (F.col("kinds") > MANY).alias("many"))
    asked = F.struct("class", "core", "many", F.col("one.first").alias("first"), F.col("one.windows").alias("windows"))
    open_ = kinds.join(several, "core").groupBy(F.col("one.name").alias("name"), F.col("one.mark").alias("mark")).agg(F.collect_list(asked).alias("asked"))
    texts = _shared.written(named.join(open_, ["name", "mark"]).dropDuplicates(["name", "mark"]).select("text", "asked"), "asked")
    found = repeated(texts, parts)
    places = F.lit(None).cast("array<short>").alias("places")
    single = kinds.where("n = 1").select("core", "whole", "class").join(found, "class").select("core", "whole", "places")
    # a stretch that is over 1 / (4 * parts) of all is one of at most 4 * parts, which every task can hold
    total = F.lit(kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    frequent = kinds.where((F.col("n") > 1) & (F.col("n") * 4 * parts > total)).select("core", "whole", F.lit(True).alias("frequent"))
    many = kinds.where((F.col("n") > 1) & (F.col("n") * 4 * parts <= total)).select("core", "whole", places)
    told = held.join(F.broadcast(frequent), ["core", "whole"], "left")
    windows = F.col("windows").bitwiseAND(0xFFFF)
    spans = F.when(F.col("places").isNull(), F.array(F.struct(F.col("first").alias("start"), (F.col("first") + windows + WINDOW - 1).alias("end")))).otherwise(
        F.transform("places", lambda p: F.struct((F.col("first") + p).cast("long").alias("start"), (F.col("first") + p + WINDOW).cast("long").alias("end")))
    )
    rest = told.where("frequent IS NULL").join(single.unionByName(many), ["core", "whole"]).select("name", "mark", "first", "windows", "places")
    marked = rest.unionByName(told.where("frequent").select("name", "mark", "first", "windows", places)).select("name", "mark", spans.alias("spans"))
    return marked.groupBy("name", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _union(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows in order, those of a row that touch or overlap as one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    far = np.int64(1 + end.max())  # rows lie apart by more than any span reaches
    reach = np.maximum.accumulate(end + row * far) - row * far
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])]))
    return row[new], start[new], reach[np.append(new[1:], len(row)) - 1]


def cut(docs: DataFrame, *carried: str) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept (the remaining bytes; may split a character), and the removed spans of each row.

    Beside them row, a struct of doc_id and the ``carried`` columns, and doc_id.
    """
    named = _named(docs, *carried)
    joined = named.select("row", "name", "mark", "text").join(covered(named), ["name", "mark"], "left").select("row", "text", "spans")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            data, offsets = _text.buffers(batch.column("text"))
            column, n = batch.column("spans"), len(offsets) - 1
            count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            asked = column.flatten()
            row, start, end = _union(np.repeat(np.arange(n), count), np.asarray(asked.field("start")), np.asarray(asked.field("end")))
            edge = np.zeros(len(data) + 1, np.int8)
            edge[offsets[row] + start] += 1
            edge[offsets[row] + end] -= 1  # a span may end where another row's begins
            stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
            removed = np.bincount(row, end - start, n).astype(np.int64)
            held = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(held.astype(np.int64)), pa.py_buffer(data[stays])]).cast(pa.binary())
            first = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
            yield pa.record_batch([batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(first).astype(np.int64)), kept, spans], names=["row", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    kind = named.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")
    return out.select("row.doc_id", *out.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_shared.read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
