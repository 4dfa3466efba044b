"""Language identification by a small convolutional network over bytes, trained with numpy.

The network looks at windows of 256 bytes: an embedding of each byte, filters of widths 2, 3 and 4 at every second byte,
the largest value of each filter over the window, one softmax layer. It is fitted on a bounded sample: windows at places
drawn by hash from at most ``per_language`` labelled documents of each language. Every text is scored whole, as all its
windows in a row; a language's score is the mean of its probability over them, weighted by their bytes.

A null text or one without any letter is ``und`` with score 0. Where no label exists every row is ``und``. Labels are
assumed to be at most a few hundred languages. Repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text

WINDOW, DIMS, FILTERS, WIDTHS = 256, 6, 16, (2, 3, 4)
HIDDEN = FILTERS * len(WIDTHS)

def held_out() -> Column:
    """Fixed value of the task: labelled rows of this remainder are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256, DIMS
    filters: np.ndarray  # 4 * DIMS, HIDDEN; narrow filters have zeros in their last bytes
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def rows(self, windows: np.ndarray) -> np.ndarray:
        e = self.embedding[windows].reshape(len(windows), WINDOW // 2, 2 * DIMS)
        return np.concatenate([e[:, :-1], e[:, 1:]], axis=2)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes to a probability of each language."""
        found = []
        for at in range(0, len(windows), 128):
            pooled = (self.rows(windows[at : at + 128]) @ self.filters).max(1)
            z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            found.append(z / z.sum(1, keepdims=True))
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)), np.float32)


def _mask() -> np.ndarray:
    mask = np.zeros((4 * DIMS, HIDDEN), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * DIMS, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 7) -> Network:
    """Adam on the cross-entropy, classes weighted evenly."""
    rng, mask = np.random.default_rng(seed), _mask()
    f32 = np.float32
    p = [rng.normal(0, 0.5, (256, DIMS)).astype(f32), rng.normal(0, 0.25, mask.shape).astype(f32) * mask, np.zeros(HIDDEN, f32), rng.normal(0, 0.2, (HIDDEN, len(languages))).astype(f32), np.zeros(len(languages), f32)]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    share = np.bincount(label, minlength=len(languages)) / max(1, len(label))
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            net = Network(languages, *p)
            w, x = windows[pick], net.rows(windows[pick])
            z = x @ p[1]
            top = z.argmax(1)
            pooled = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + p[2]
            active = np.maximum(pooled, 0)
            s = active @ p[3] + p[4]
            s = np.exp(s - s.max(1, keepdims=True))
            s /= s.sum(1, keepdims=True)
            s[np.arange(len(pick)), label[pick]] -= 1
            s *= (1 / (len(languages) * np.maximum(share[label[pick]], 1e-6)))[:, None] / len(pick)
            d_pool = (s @ p[3].T) * (pooled > 0)
            at_top = np.take_along_axis(x, np.repeat(top[:, :, None], 4 * DIMS, 2), 1)  # batch, HIDDEN, 4 * DIMS
            d_filter = np.einsum("bh,bhd->dh", d_pool, at_top) * mask
            d_x = (d_pool[:, :, None] * (p[1] * mask).T[None]).reshape(len(pick), HIDDEN, 4, DIMS)
            place = 2 * top[:, :, None] + np.arange(4)
            d_embed = np.zeros_like(p[0])
            np.add.at(d_embed, np.take_along_axis(w, place.reshape(len(pick), -1), 1).ravel(), d_x.reshape(-1, DIMS))
            step += 1
            for i, g in enumerate((d_embed, d_filter, d_pool.sum(0), active.T @ s, s.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = (p[i] - 0.004 * 0.7**epoch * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-7)).astype(f32)
    return Network(languages, *p)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each, bytes of each) of whole texts; the last window of a text is filled with spaces."""
    size = np.diff(offsets)
    each = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    own = np.minimum(WINDOW, size[row] - nth * WINDOW)
    out = np.full((len(row), WINDOW), 32, np.uint8)
    to = np.repeat((np.cumsum(each) - each) * WINDOW - offsets[:-1], size) + np.arange(len(data))
    out.ravel()[to] = data
    return out, row, own


def fit(labelled: DataFrame, per_language: int = 700, windows_each: int = 4) -> Network | None:
    """``labelled``: doc_id, text, lang without nulls. At most per_language * windows_each windows of each language."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))])[F.col("lang")]
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < share * 1_000_000)
    spread = F.explode(F.sequence(F.lit(0), F.lit(windows_each - 1))).alias("nth")
    place = 1 + F.pmod(F.xxhash64("doc_id", "nth"), F.greatest(F.lit(1), F.length("text") - WINDOW // 2))
    pieces = drawn.select("doc_id", "lang", "text", spread).select("doc_id", "nth", "lang", F.substring("text", place.cast("int"), F.lit(WINDOW)).alias("piece")).toPandas()
    pieces = pieces.sort_values(["doc_id", "nth", "piece"]).reset_index(drop=True)
    data, offsets = _text.buffers(pa.array(pieces["piece"], pa.string()))
    windows, row, own = cut(data, offsets)
    keep = (np.diff(row, prepend=-1) > 0) & (own >= 16)
    label = np.searchsorted(languages, pieces["lang"].to_numpy(str)[row[keep]])
    return train(windows[keep], label, languages) if keep.any() else None


def predict(docs: DataFrame, net: Network | None, row: str = "doc_id") -> DataFrame:
    """``row``, lang_pred, score of each row of ``docs``; the column named by ``row`` is only carried along."""
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(row, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def score(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, "und"], object)
        for batch in arrow:
            data, offsets = _text.buffers(batch.column("text"))
            told, sure = np.full(len(offsets) - 1, len(names) - 1), np.zeros(len(offsets) - 1)
            for a, b, part, own in _text.slices(data, offsets):
                windows, row, size = cut(part, own)
                if not len(windows):
                    continue
                p = net.probabilities(windows) * size[:, None]
                total = np.stack([np.bincount(row, p[:, k], b - a) for k in range(p.shape[1])], 1) / np.maximum(1, np.diff(own))[:, None]
                told[a:b], sure[a:b] = total.argmax(1), np.clip(total.max(1), 0, 1)
            lettered = np.asarray(batch.column("lettered"))
            told[~lettered], sure[~lettered] = len(names) - 1, 0
            yield pa.record_batch([batch.column("row"), pa.array(names[told], pa.string()), pa.array(sure)], names=["row", "lang_pred", "score"])

    kind = docs.schema[row].dataType.simpleString()
    return docs.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"), letters.alias("lettered")).mapInArrow(score, f"row {kind}, lang_pred string, score double").withColumnRenamed("row", row)


def learned(docs: DataFrame) -> Network | None:
    """The network fitted on the labelled rows that are not held out."""
    lettered = F.col("text").rlike(r"\p{L}")
    return fit(docs.where(~held_out() & F.col("lang").isNotNull() & lettered).select("doc_id", "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learns from the labelled rows that are not held out."""
    return predict(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_shared.read(spark, sf_dir, "documents"))
