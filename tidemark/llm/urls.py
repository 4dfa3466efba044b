"""URL filter: listed rules first, then the ratio of two character language models.

Urls that a rule decides are the training text of the accepted and the rejected model. A model is a variable-order
Markov chain over an alphabet of 38 character classes: three characters of context, falling back to shorter contexts by
interpolation with weight n / (n + smoothing) for a context met n times. Its counts cover every decided url; their number
is bounded by 38**4 whatever the input, which is the proof for collecting them. A url's score is the difference of the
two log-likelihoods divided by its length; a logistic curve fitted on the decided urls held out of the counts calibrates it.

A null or empty url, and any url when a class has no training text, is allowed unless a rule decides. Repeated rows are
judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text

#: (verdict, host, path): fixed values of the task.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
CLASSES, ORDER = 38, 3
CELLS = CLASSES ** (ORDER + 1)
#: One in so many decided urls calibrates and is left out of the counts.
HELD = 5


def _class_table() -> np.ndarray:
    """Letters 1 to 26 without case, digits 27, nine marks 28 to 36, other bytes 37; 0 stands before a url's start."""
    out = np.full(256, 37, np.int64)
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    out[48:58] = 27
    for i, mark in enumerate("/.-_?=&#:"):
        out[ord(mark)] = 28 + i
    return out


_TABLE = _class_table()


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The cell of each byte: its class after those of the three bytes before it in its url."""
    c = _TABLE[data]
    out = c.copy()
    place = np.arange(len(c)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        before = np.zeros_like(c)
        before[back:] = c[:-back] if back < len(c) else c[:0]
        out += np.where(place >= back, before, 0) * CLASSES**back
    return out


def log_model(counts: np.ndarray, smoothing: float = 4.0) -> np.ndarray:
    """Log-probability of the last class of each cell given the classes before it."""
    p = np.full(CLASSES, 1 / CLASSES)
    for order in range(ORDER + 1):
        own = counts.reshape(-1, CLASSES ** (order + 1)).sum(0).reshape(-1, CLASSES)
        total = own.sum(1, keepdims=True)
        shorter = np.tile(p.reshape(-1, CLASSES), (len(own) // max(1, p.size // CLASSES), 1))
        p = (own + smoothing * shorter) / (total + smoothing)
    return np.log(p).ravel()


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; nulls if none does. The rule list is configuration."""
    rule = verdict = F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _platt(score: np.ndarray, block: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by damped Newton steps."""
    w, x = np.zeros(2), np.stack([score, np.ones_like(score)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - block)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(w[0]), float(w[1])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of rejection; null without models). Needs page_id and url."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string")).select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("listed"))
    held = F.crc32("url") % HELD == 0
    decided = rows.where(F.col("listed").isNotNull() & (F.length("url") > 0)).select("url", (F.col("listed") == "block").cast("int").alias("block"), held.alias("held"))

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, CELLS), np.int64)
        for batch in arrow:
            data, offsets = _text.buffers(batch.column("url"))
            side = np.repeat(np.asarray(batch.column("block")), np.diff(offsets))
            for s in (0, 1):
                totals[s] += np.bincount(codes(data, offsets)[side == s], minlength=CELLS)
        s, cell = np.nonzero(totals)
        schema = pa.schema([("block", pa.int32()), ("cell", pa.int64()), ("n", pa.int64())])
        yield from _text.batches({"block": s.astype(np.int32), "cell": cell, "n": totals[s, cell]}, schema)

    counted = decided.where(~F.col("held")).mapInArrow(count, "block int, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).toPandas()
    if counted["block"].nunique() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    tables = []
    for s in (0, 1):
        own = counted[counted["block"] == s]
        dense = np.zeros(CELLS)
        dense[own["cell"]] = own["n"]
        tables.append(log_model(dense))
    ratio = (tables[1] - tables[0]).astype(np.float32)
    shared = pages.sparkSession.sparkContext.broadcast(ratio)  # CELLS numbers of four bytes, whatever the input

    @F.pandas_udf("double")
    def score(url):
        data, offsets = _text.buffers(pa.Array.from_pandas(url, type=pa.string()))
        total = np.concatenate([[0.0], np.cumsum(shared.value[codes(data, offsets)], dtype=np.float64)])
        import pandas as pd

        return pd.Series((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets)))

    bins = decided.where("held").select("block", F.round(score("url"), 2).alias("bin")).groupBy("block", "bin").count().toPandas()
    if bins["block"].nunique() == 2:
        weight = bins["count"] / bins.groupby("block")["count"].transform("sum") / 2 * bins["count"].sum()
        slope, shift = _platt(bins["bin"].to_numpy(float), bins["block"].to_numpy(float), weight.to_numpy(float))
    else:
        slope, shift = 1.0, 0.0
    p = 1 / (1 + F.exp(-(F.lit(slope) * score("url") + F.lit(shift))))
    own = F.when(F.length("url") > 0, p)
    return rows.withColumn("score", own).select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_shared.read(spark, sf_dir, "pages"), RULES)
