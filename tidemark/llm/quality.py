"""Quality classification by co-training of two views.

The text view holds hashed words and shares of kinds of characters; the page view holds what describes a document without
its words: source, language label, length, and line counts. Each view has a logistic regression over features scaled by
their naive Bayes log-ratio.

The two are fitted on labelled documents. In each round every unlabelled document is scored by both views, and those that a
view is sure of become pseudo-labels of the other view: Spark counts, over all of them, how many of each class hold each
feature, and these counts go into the other view's log-ratios, labelled and pseudo-labelled shares mixed 2 to 1 whatever the
corpus's size. A view is sure above the log-odds that a growing share of held-out labelled rows reach in each class, moved
on until ``sure`` of those rows are of that class; where no such place exists it gives no labels of that class. At the end
both views are calibrated on the held-out labelled rows, and a document's score is the mean of their log-odds weighted by how
well each did there, as a probability.

Labelled rows are drawn by hash of doc_id, about ``labelled`` at most; nothing else is bounded: a label that is not drawn is
not used, and its document counts as unlabelled. All documents are scored whole. Null texts are empty. Without labels of both
classes every score is 0.5. Repeated rows score alike; a doc_id with several labels counts with each. Rows without doc_id are
unlabelled. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text

TEXT_CELLS, PAGE_CELLS = 1 << 14, 1 << 10
CELLS = [TEXT_CELLS, PAGE_CELLS]
_KINDS = [np.isin(np.arange(256), list(b)) for b in (b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b" ", b"\n", b".,;", b"!?", b"#$%&*|<>{}[]=+~^_@")]


@dataclass
class Sparse:
    """Rows of (cell, value) features."""

    row: np.ndarray
    cell: np.ndarray
    value: np.ndarray
    rows: int

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weight[self.cell], self.rows)

    def pick(self, rows: np.ndarray) -> Sparse:
        new = np.full(self.rows, -1)
        new[rows] = np.arange(len(rows))
        keep = new[self.row] >= 0
        return Sparse(new[self.row[keep]], self.cell[keep], self.value[keep], len(rows))


def _join(parts: list[Sparse]) -> Sparse:
    at = np.cumsum([0, *[p.rows for p in parts]])
    return Sparse(*(np.concatenate(x) if parts else np.zeros(0, int) for x in ([p.row + a for p, a in zip(parts, at[:-1], strict=True)], [p.cell for p in parts], [p.value for p in parts])), int(at[-1]))


def text_view(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Hashed words present, in vectors of length 1, and shares of kinds of bytes and of distinct words."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    flat = _text.lower(data)
    starts, ends, first = _text.words(flat, offsets, _text.WORDY)
    cells = TEXT_CELLS - 16
    word = (_text.Hashes(flat).of(starts, ends) % np.uint64(cells)).astype(np.int64)
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    key = np.unique(row * cells + word)
    r, c = key // cells, key % cells
    value = 1 / np.sqrt(np.maximum(1, np.bincount(r, minlength=rows)))[r]
    shares = np.stack([np.diff(np.concatenate([[0], np.cumsum(k[data])])[offsets]) / np.maximum(1, size) for k in _KINDS], 1)
    distinct = np.bincount(r, minlength=rows) / np.maximum(1, np.sqrt(count * 30.0))
    dense = np.column_stack([2 * np.sqrt(shares), np.minimum(3, distinct), np.ones(rows)])
    k = dense.shape[1]
    return Sparse(np.concatenate([r, np.repeat(np.arange(rows), k)]), np.concatenate([c, np.tile(np.arange(k) + cells, rows)]), np.concatenate([value, dense.ravel()]), rows)


def page_view(source: list, lang: list, data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Source, language, and the logarithms of length and lines as bands; no words."""
    rows = len(source)
    size = np.diff(offsets)
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets])
    import zlib

    cells = PAGE_CELLS - 1
    each = [
        [zlib.crc32(f"source={x}".encode()) % cells for x in source],
        [zlib.crc32(f"lang={x}".encode()) % cells for x in lang],
        [zlib.crc32(f"size={x}".encode()) % cells for x in (2 * np.log2(1 + size)).astype(int)],
        [zlib.crc32(f"lines={x}".encode()) % cells for x in (2 * np.log2(1 + lines)).astype(int)],
        [zlib.crc32(f"mean={x}".encode()) % cells for x in (2 * np.log2(1 + size / (1 + lines))).astype(int)],
        [cells] * rows,
    ]
    cell = np.array(each).T.ravel() if rows else np.zeros(0, int)
    return Sparse(np.repeat(np.arange(rows), len(each)), cell, np.ones(len(cell)), rows)


def holding(x: Sparse, of: np.ndarray, cells: int) -> np.ndarray:
    """Per class 0 and 1, how many rows hold each feature, and in the last place how many rows there are. ``of``: 0, 1, else left out."""
    has = x.value > 0
    return np.stack([np.append(np.bincount(x.cell[has], (of == k)[x.row[has]], cells), (of == k).sum()) for k in (0, 1)]).astype(np.int64)


def ratios(known: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratio of the classes' shares of rows that hold each feature, and whether nearly all rows of both hold it.

    Pseudo-labelled rows ``told`` weigh half as much as the labelled ones ``known``, however many there are. Both classes get
    the same strength, so that a feature which no row holds has no ratio.
    """
    strength = max(1, known[:, -1].min())
    shares = []
    for own, other in zip(known, told, strict=True):
        share = own[:-1] / max(1, own[-1])
        if other[-1]:
            share = (2 * share + other[:-1] / other[-1]) / 3
        shares.append((strength * share + 1) / (strength + 2))
    return np.log(shares[1] / shares[0]), np.minimum(*shares) > 0.5


def fit(x: Sparse, y: np.ndarray, told: np.ndarray, cells: int, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam on labelled rows, classes weighted alike, each feature scaled by the size of its log-ratio.

    A feature that only pseudo-labelled rows hold gets its log-ratio times the mean that labelled features' ratios have got.
    """
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    known = holding(x, y, cells)
    ratio, always = ratios(known, told)
    scale = np.where(always, 1.0, np.abs(ratio))  # what nearly all rows have says nothing by being there
    value = x.value * scale[x.cell]
    w, m, v = np.zeros(cells), np.zeros(cells), np.zeros(cells)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(x.row, value * w[x.cell], x.rows), -30, 30)))
        g = np.bincount(x.cell, value * ((p - y) * weight)[x.row], cells) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    met = known[:, :-1].any(0)
    usual = np.mean((w * np.sign(ratio))[met & ~always]) if (met & ~always).any() else 0.0
    return np.where(met | always, w * scale, max(0.0, usual) * ratio)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and worth (log-loss gained over the base rate) of log-odds z on held-out labels."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        grad = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    p = np.clip(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), 1e-6, 1 - 1e-6)
    base = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    gain = (y * np.log(p) + (1 - y) * np.log(1 - p)).mean() - (base * np.log(base) + (1 - base) * np.log(1 - base))
    return float(a), float(b), float(max(gain, 1e-3))


@dataclass
class Pair:
    """Both views' weights and calibrations, and how many pseudo-labels each round gave: [to view][class]."""

    weights: list[np.ndarray]
    calibrations: list[tuple[float, float, float]]
    exchanged: list[list[list[int]]] = field(default_factory=list)

    def score(self, views: list[Sparse]) -> list[np.ndarray]:
        """[combined probability, text view's, page view's]."""
        odds = [a * v.dot(w) + b for v, w, (a, b, _) in zip(views, self.weights, self.calibrations, strict=True)]
        worth = np.array([c[2] for c in self.calibrations])
        both = (odds[0] * worth[0] + odds[1] * worth[1]) / worth.sum()
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (both, *odds)]


def bounds(z: np.ndarray, y: np.ndarray, share: float, sure: float) -> tuple[float, float]:
    """Log-odds of held-out rows at and below which a row is surely 0, and at and above which it is surely 1.

    Either class takes ``share`` of its rows' number and those that tie with the last, or fewer until ``sure`` of those taken
    are of the class, or none.
    """
    out = []
    for label, sign in ((0, -1.0), (1, 1.0)):
        order = np.argsort(-sign * z, kind="stable")
        size, value, right = np.arange(1, len(z) + 1), sign * z[order], np.cumsum(y[order] == label)
        last = np.append(value[1:] < value[:-1], True)  # rows of one value are taken together
        above = np.searchsorted(-value, -value)
        good = np.flatnonzero(last & (right >= sure * size) & (above < max(1, share * (y == label).sum())))
        out.append(sign * value[good[-1]] if len(good) else sign * np.inf)
    return out[0], out[1]


def surely(views: list[Sparse], weights: list[np.ndarray], edges: list[tuple[float, float]]) -> list[np.ndarray]:
    """For each view the class 0 or 1 that the other view is sure of, else -1."""
    said = []
    for v, w, (low, high) in zip(views, weights, edges, strict=True):
        z = v.dot(w)
        said.append(np.where(z >= high, 1, np.where(z <= low, 0, -1)))
    return said[::-1]


def cotrain(views: list[Sparse], y: np.ndarray, count: Callable[[list[np.ndarray], list[tuple[float, float]]], list[np.ndarray]], rounds: int = 3, share: float = 0.15, sure: float = 0.9) -> Pair | None:
    """``views`` and ``y`` (1 or 0) of labelled rows, of which every fourth calibrates; ``count`` gives the features that the
    unlabelled rows, which views of these weights and bounds are sure of, hold for each view (``holding``)."""
    hold, train = np.arange(len(y))[::4], np.flatnonzero(np.arange(len(y)) % 4)
    if len(np.unique(y[train])) < 2 or len(np.unique(y[hold])) < 2:
        return None
    told = [np.zeros((2, n + 1), np.int64) for n in CELLS]
    exchanged = []
    for turn in range(rounds + 1):
        weights = [fit(v.pick(train), y[train], t, n) for v, t, n in zip(views, told, CELLS, strict=True)]
        if turn == rounds:
            break
        edges = [bounds(v.pick(hold).dot(w), y[hold], share * (turn + 1), sure) for v, w in zip(views, weights, strict=True)]
        told = count(weights, edges)
        exchanged.append([t[:, -1].tolist() for t in told])
    return Pair(weights, [_calibrate(v.pick(hold).dot(w), y[hold]) for v, w in zip(views, weights, strict=True)], exchanged)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[Sparse]]]:
    source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    for a, b, part, own in _text.slices(*_text.buffers(batch.column("text"))):
        yield a, b, [text_view(part, own), page_view(source[a:b], lang[a:b], part, own)]


def _features(rows: DataFrame) -> pa.Table:
    """Features of a bounded number of labelled rows; a text has at most TEXT_CELLS of them."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            ids, y = batch.column("doc_id"), batch.column("y")
            for a, b, views in _views(batch):
                out = {}
                for name, v in zip("tp", views, strict=True):
                    order = np.argsort(v.row, kind="stable")
                    edge = pa.array(np.searchsorted(v.row[order], np.arange(b - a + 1)).astype(np.int32))
                    out[name + "c"] = pa.ListArray.from_arrays(edge, pa.array(v.cell[order].astype(np.int32)))
                    out[name + "v"] = pa.ListArray.from_arrays(edge, pa.array(v.value[order].astype(np.float32)))
                yield pa.record_batch([ids.slice(a, b - a), y.slice(a, b - a), *out.values()], names=["doc_id", "y", *out])

    return rows.mapInArrow(run, "doc_id long, y int, tc array<int>, tv array<float>, pc array<int>, pv array<float>").toArrow()


def _counted(rows: DataFrame, drawn: np.ndarray, weights: list[np.ndarray], edges: list[tuple[float, float]]) -> list[np.ndarray]:
    """``holding`` of both views over all rows but the drawn ones: a task adds up its own, Spark adds up the tasks'."""
    sent = rows.sparkSession.sparkContext.broadcast((drawn, weights, edges))  # ids of labelled rows and the cells' weights

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, weights, edges = sent.value
        sums = [np.zeros((2, n + 1), np.int64) for n in CELLS]
        for batch in arrow:
            free = ~np.isin(batch.column("doc_id").fill_null(-1).to_numpy(), drawn) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for a, b, views in _views(batch):
                for i, of in enumerate(surely(views, weights, edges)):
                    sums[i] += holding(views[i], np.where(free[a:b], of, -1), CELLS[i])
        for i, table in enumerate(sums):
            label, cell = np.nonzero(table)
            yield pa.record_batch([pa.array(np.full(len(cell), i), pa.int32()), pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(table[label, cell])], names=["view", "label", "cell", "n"])

    found = rows.mapInArrow(run, "view int, label int, cell int, n long").groupBy("view", "label", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * (TEXT_CELLS + PAGE_CELLS + 2) rows
    sent.destroy()
    view, label, cell, n = (found[c].to_numpy() for c in ("view", "label", "cell", "n"))
    out = [np.zeros((2, size + 1), np.int64) for size in CELLS]
    for i in (0, 1):
        at = view == i
        out[i][label[at], cell[at]] = n[at]
    return out


def learn(docs: DataFrame, labels: DataFrame, labelled: int = 6000) -> Pair | None:
    """``labels``: doc_id and y (1 or 0)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").distinct()
    chance = min(1.0, labelled / max(1, marks.count()))
    few = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < chance * 1_000_000)
    table = _features(own.join(F.broadcast(few), "doc_id"))  # about ``labelled`` rows of 12 bytes
    ids, y = table["doc_id"].to_numpy(), table["y"].to_numpy()
    order = np.lexsort((y, ids))
    views = []
    for c, v in (("tc", "tv"), ("pc", "pv")):
        cell, value = table[c].combine_chunks(), table[v].combine_chunks()
        size = np.diff(np.asarray(cell.offsets))
        views.append(Sparse(np.repeat(np.arange(len(y)), size), np.asarray(cell.flatten()).astype(np.int64), np.asarray(value.flatten()).astype(float), len(y)))
    drawn = np.unique(ids)
    return cotrain([v.pick(order) for v in views], y[order], lambda weights, edges: _counted(own, drawn, weights, edges))


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, score, text_score, page_score, keep for every document. ``docs``: doc_id, text, source, lang."""
    pair = learn(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    if pair is None:
        return rows.select("doc_id", *[F.lit(0.5).alias(c) for c in ("score", "text_score", "page_score")], F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(pair)  # TEXT_CELLS + PAGE_CELLS weights

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            ids = batch.column("doc_id")
            for a, b, views in _views(batch):
                both, text, page = sent.value.score(views)
                yield pa.record_batch([ids.slice(a, b - a), pa.array(both), pa.array(text), pa.array(page), pa.array(both >= keep_at)], names=["doc_id", "score", "text_score", "page_score", "keep"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, text_score double, page_score double, keep boolean")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good is a label of quality 1 that is not toxic."""
    labels = _shared.read(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0).alias("y"))
    return classify(_shared.read(spark, sf_dir, "documents"), labels)
