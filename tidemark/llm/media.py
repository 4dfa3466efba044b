"""Media payloads in a chunk store: content-defined chunks, digests deduplicated by joins, ordered chunk lists.

A document's payload is its UTF-8 bytes and spaces up to a positive multiple of 192. A rolling gear hash of the last 32
bytes cuts it: after at least LEAST bytes wherever the hash's low bits are zero, and after MOST at the latest. Chunk
digests meet in Spark; of equal chunks the first by (name, place) owns the bytes, and only owners store them. A stored row
is a document's ordered list of digests and sizes and the bytes it owns. Reading back, rows that refer to chunks of others
fetch these by a join on the digest; every chunk is checked against its digest before the payload is put together. The
stored form whose size and sha256 are reported is the chunk list as it lies in the store, read back: the chunks' sizes and
digests in order, the same for equal texts.

A null text is empty (a payload of 192 spaces). Rows that repeat a document get the same result each; documents with the
same id and other texts are kept apart. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text

UNIT = 192
LEAST, MASK, MOST = 512, (1 << 11) - 1, 8192
LEVEL = 10  # of compression of what is shuffled and stored
_GEAR = (_text.byte_values(7) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum over the last 32 bytes of the byte's value shifted left by its distance, modulo 2**32."""
    h = _GEAR[data]
    width = 1
    while width < 32:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(payload)
    spots = (np.flatnonzero(gear(np.frombuffer(payload, np.uint8)) & np.uint32(MASK) == 0) + 1).tolist() if n > LEAST else []
    ends, at, k = [], 0, 0
    while n - at > LEAST:
        while k < len(spots) and spots[k] < at + LEAST:
            k += 1
        end = min(spots[k] if k < len(spots) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    out, at = [], 0
    for end in cuts(payload):
        piece = payload[at:end]
        out.append((hashlib.blake2b(piece, digest_size=16).digest(), piece))
        at = end
    return out


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")))
    return docs.select(name.alias("name"), "doc_id", text.alias("text"))


def store(docs: DataFrame, path: str) -> None:
    """Writes doc_id, name, n_bytes, digests, sizes, owned (truth for each chunk), shared (likewise), bytes of owned chunks."""
    named = _named(docs)

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            names, place, digest = [], [], []
            data, offsets = _text.buffers(batch.column("text"))
            for i, name in enumerate(batch.column("name").to_pylist()):
                for k, (d, _) in enumerate(chunks(payload_of(data[offsets[i] : offsets[i + 1]].tobytes()))):
                    names.append(name)
                    place.append(k)
                    digest.append(d)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(place, pa.int32()), pa.array(digest, pa.binary())], names=["name", "place", "digest"])

    # cut again wherever it is needed: that is cheaper than a table of all chunks
    listed = named.mapInArrow(cut, "name string, place int, digest binary")
    owners = listed.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("name", "place")).alias("owner")).where("n > 1").select("digest", "owner")
    marks = listed.join(owners, "digest").select("name", "place", (F.col("owner") == F.struct("name", "place")).alias("own"))
    marks = marks.groupBy("name").agg(F.collect_set(F.struct("place", "own")).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def squeeze(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch in arrow:
            data, offsets = _text.buffers(batch.column("text"))
            packed = [z.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("name"), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["name", "doc_id", "packed"])

    def save(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, back = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in arrow:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "digests", "sizes", "owned", "shared", "body")}
            for packed, marked in zip(batch.column("packed"), batch.column("marks"), strict=True):
                text = back.decompress(packed.as_py())
                listed = chunks(payload_of(text))
                told = {m["place"]: m["own"] for m in marked.as_py()} if marked.is_valid else {}
                out["n_bytes"].append(len(text))
                out["digests"].append(b"".join(d for d, _ in listed))
                out["sizes"].append([len(p) for _, p in listed])
                out["owned"].append([told.get(i, True) for i in range(len(listed))])
                out["shared"].append([i in told for i in range(len(listed))])
                out["body"].append(z.compress(b"".join(p for i, (_, p) in enumerate(listed) if told.get(i, True))))
            types = {"n_bytes": pa.int64(), "digests": pa.binary(), "sizes": pa.list_(pa.int32()), "owned": pa.list_(pa.bool_()), "shared": pa.list_(pa.bool_()), "body": pa.binary()}
            yield pa.record_batch([batch.column("name"), batch.column("doc_id"), *[pa.array(out[k], t) for k, t in types.items()]], names=["name", "doc_id", *types])

    packed = named.mapInArrow(squeeze, f"name string, doc_id {kind}, packed binary")
    saved = packed.join(marks, "name", "left").mapInArrow(save, f"name string, doc_id {kind}, n_bytes long, digests binary, sizes array<int>, owned array<boolean>, shared array<boolean>, body binary")
    saved.write.option("compression", "uncompressed").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes, payload and stored form's size and sha256 of each stored row, put together from the chunk store."""
    saved = spark.read.parquet(path)
    foreign = F.exists("owned", lambda x: ~x)

    def given(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for batch in arrow:
            digest, piece = [], []
            for row in batch.to_pylist():
                at, body = 0, back.decompress(row["body"])
                for i, (size, own, shared) in enumerate(zip(row["sizes"], row["owned"], row["shared"], strict=True)):
                    if own:
                        if shared:
                            digest.append(row["digests"][16 * i : 16 * i + 16])
                            piece.append(body[at : at + size])
                        at += size
            yield pa.record_batch([pa.array(digest, pa.binary()), pa.array(piece, pa.binary())], names=["digest", "piece"])

    offered = saved.where(F.exists("shared", lambda x: x)).select("digests", "sizes", "owned", "shared", "body").mapInArrow(given, "digest binary, piece binary").groupBy("digest").agg(F.first("piece").alias("piece"))
    place = F.posexplode("owned").alias("place", "own")
    asked = saved.where(foreign).select("name", "digests", place).where("NOT own").select("name", "place", F.expr("substring(digests, 16 * place + 1, 16)").alias("digest")).distinct()
    fetched = asked.join(offered, "digest").groupBy("name").agg(F.collect_list(F.struct("place", "piece")).alias("fetched"))
    whole = saved.where(~foreign).withColumn("fetched", F.lit(None).cast("array<struct<place: int, piece: binary>>"))
    mixed = saved.where(foreign).join(fetched, "name", "left")
    kind = saved.schema["doc_id"].dataType.simpleString()

    def build(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for batch in arrow:
            ids, out = batch.column("doc_id"), {k: [] for k in ("payload", "media_bytes", "media_sha256", "n_chunks")}
            for row in batch.select(["digests", "sizes", "owned", "body", "fetched"]).to_pylist():
                other = {x["place"]: x["piece"] for x in row["fetched"] or ()}
                at, body, pieces = 0, back.decompress(row["body"]), []
                for i, (size, own) in enumerate(zip(row["sizes"], row["owned"], strict=True)):
                    if own:
                        piece, at = body[at : at + size], at + size
                    else:
                        piece = other[i]
                    if hashlib.blake2b(piece, digest_size=16).digest() != row["digests"][16 * i : 16 * i + 16]:
                        raise ValueError(f"chunk {i} of a stored payload is damaged")
                    pieces.append(piece)
                stored = np.array(row["sizes"], "<u4").tobytes() + row["digests"]
                payload = b"".join(pieces)
                out["payload"].append(payload)
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["n_chunks"].append(len(pieces))
            yield pa.record_batch([ids, batch.column("n_bytes"), pa.array(out["payload"], pa.binary()), pa.array(out["media_bytes"], pa.int64()), pa.array(out["media_sha256"], pa.string()), pa.array(out["n_chunks"], pa.int64())], names=["doc_id", "n_bytes", *out])

    columns = ["doc_id", "n_bytes", "digests", "sizes", "owned", "body", "fetched"]
    return whole.select(columns).unionByName(mixed.select(columns)).mapInArrow(build, f"doc_id {kind}, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_chunks long")


def features(loaded: DataFrame) -> DataFrame:
    """The digest columns of payloads read back. The feature names the chunks, the byte entropy and the commonest byte."""
    kind = loaded.schema["doc_id"].dataType.simpleString()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            sha, tail, feature, size = [], [], [], []
            for payload, n in zip(batch.column("payload"), batch.column("n_chunks").to_pylist(), strict=True):
                raw = payload.as_py()
                often = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                p = often[often > 0] / len(raw)
                size.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                tail.append(zlib.crc32(raw[-16:]))
                feature.append(f"chunks={n};entropy={-(p * np.log2(p)).sum():.4f};byte={int(often.argmax())}")
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array(feature, pa.string())], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return loaded.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.shared_folder(spark, "chunk-store")
    store(_shared.read(spark, sf_dir, "documents"), path)
    return features(load(spark, path))
