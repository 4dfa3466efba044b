"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are phrases of WIDTH - 1 words, an edge between two overlapping nodes is a phrase of WIDTH words with its count. Only
edges are counted, and what a piece ends with: a node's count is the flow out of it plus the ends of pieces at it, and so on
down to single words, so every shorter count follows from the edges and a correction for the ends.

The graph is cut before it is built. A phrase that stands fewer than ``least`` times lies inside no candidate and inside no
part of one, so what is read at a word may end before it, an end that is corrected for like that of a piece. Pairs, and then
triples of frequent pairs, are counted by 64-bit hashes, and the frequent ones are kept in Bloom filters of a fixed size,
BITS, with the words of frequent pairs: a hash or a bit that two of them share only leaves an edge that could have been cut,
and where a filter fills up on a very large corpus more edges are counted. No result depends on it. All counting after it is
by the words themselves.

Each task builds the graph of some megabytes of text at a time and compacts its unary paths: an edge whose end has one edge
in, one out and no end or start of a piece is drawn together with the next. A compacted path is a stretch of text with one
count. Stretches are written to the shared folder, and unrolled into edges where these are added up over all tasks.

A null text is empty, a null lang ``und``. Repeated rows count as often as they come. An empty table, or one without
candidates, gives no rows. Only lang and text are read. Ties in score and count stand in byte order of the phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _shared, _text

#: Words of an edge.
WIDTH = 4
#: Bits of the Bloom filter of frequent pairs (8 MB), a fixed bound of what is sent to every task.
BITS = 1 << 26
#: Bytes of text whose graph a task builds at a time; a longer text is taken alone. Numpy holds some 40 times as much.
CHUNK = 1 << 20
#: The same where phrases are only counted.
COUNTED = 1 << 19
#: Distinct pairs that a task holds before it hands their counts on.
HELD = 500_000
#: Parts of a language in which the best are found before they meet.
SHARES = 16
STRETCH = "lang string, words string, n long, ended boolean"
_BREAK = _text.table([*b".,;:!?", *range(0x0A, 0x0E)])
_INSIDE = ~(_BREAK | _text.table([0x20, 0x09]))
_FIELDS = pa.schema([("lang", pa.string()), ("words", pa.large_string()), ("n", pa.int64()), ("ended", pa.bool_())])


class Words:
    """The words of some texts: numbers that tell words of one language apart, and which follow each other in a piece."""

    def __init__(self, texts: pa.Array, langs: list[str | None]):
        data, offsets = _text.buffers(texts)
        data = _text.lower(data)
        inside = _INSIDE[data]
        starts, ends, first = _text.words(data, offsets, _INSIDE)
        size = ends - starts
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.letters = data[inside]  # the words without what stands between them
        coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.letters))).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = sorted({x or "und" if x is None else x for x in langs})
        place = {x: i for i, x in enumerate(self.names)}
        lang = np.repeat(np.array([place["und" if x is None else x] for x in langs], np.int64), np.diff(first))
        self.lang = lang
        # a word of a language; dense, so that two fit into 64 bits
        self.word, which = np.unique(word * len(self.names) + lang, return_inverse=True)
        self.of = which.astype(np.int64)
        breaks = np.cumsum(_BREAK[data])
        row = np.searchsorted(first, np.arange(len(size)), "right")
        self.joined = np.zeros(len(size), bool)  # to the word before
        if len(size) > 1:
            self.joined[1:] = (breaks[starts[1:]] == breaks[starts[:-1]]) & (row[1:] == row[:-1])
        self.dictionary = coded.dictionary

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the word at each place, and of the two and the three words from it on, by their letters and language; 0 past the end."""
        letters, offsets = _text.buffers(self.dictionary)
        own = _text.Hashes(letters).of(offsets[:-1], offsets[1:]) if len(letters) else np.zeros(0, np.uint64)
        seeds = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in self.names] or [0], np.uint64)
        k = len(self.names) or 1
        h = _text.mix(own[self.word // k] ^ seeds[self.word % k]) if len(self.word) else np.zeros(0, np.uint64)
        h = h[self.of]
        two, three = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        with np.errstate(over="ignore"):
            two[:-1] = _text.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
            three[:-2] = _text.mix(two[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        return h, two, three

    def pairs(self) -> np.ndarray:
        """Whether the next word follows in the same piece."""
        return np.append(self.joined[1:], False)[: len(self.of)]

    def phrases(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """Words first to last (included) with single spaces between them."""
        size = self.at[last + 1] - self.at[first] + (last - first)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        out = np.full(offsets[-1], 0x20, np.uint8)
        count = last - first + 1
        which = np.repeat(np.arange(len(first)), count)  # of each word its phrase
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        word = first[which] + nth
        to = offsets[which] + (self.at[word] - self.at[first[which]]) + nth
        length = self.at[word + 1] - self.at[word]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + step] = self.letters[np.repeat(self.at[word], length) + step]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))


def _counted(key: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, how often it stands) of the keys at the places ``where``."""
    _, first, n = np.unique(key[where], return_index=True, return_counts=True)
    return where[first], n


def reach(pair: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """How many words are read at each place, 1 to WIDTH, by which pairs and triples that begin there are kept."""
    triple = triple & pair & np.append(pair[1:], False)[: len(pair)]
    edge = triple & np.append(triple[1:], False)[: len(pair)]
    return 1 + pair.astype(np.int8) + triple + edge


def stretches(words: Words, reads: np.ndarray, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(first word, last word, count, whether it is an end) of the compacted paths, and of what is read at each place where no edge begins.

    ``reads``: see ``reach``. ``wanted``: places whose word is asked for where it is read alone.
    """
    of, n = words.of, len(words.of)
    out = []
    p, k = _counted(of, np.flatnonzero((reads == 1) & wanted))
    out.append((p, p, k, True))
    pairs = np.flatnonzero(reads >= 2)
    pair = np.full(n, -1, np.int64)
    pair[pairs] = np.unique(of[pairs] << 32 | of[pairs + 1], return_inverse=True)[1]
    p, k = _counted(pair, np.flatnonzero(reads == 2))
    out.append((p, p + 1, k, True))
    nodes = np.flatnonzero(reads >= 3)
    node = np.full(n, -1, np.int64)
    node[nodes] = np.unique(pair[nodes] << 32 | of[nodes + 2], return_inverse=True)[1]
    p, k = _counted(node, np.flatnonzero(reads == 3))
    out.append((p, p + 2, k, True))
    places = np.flatnonzero(reads == WIDTH)
    if len(places):
        edge, k = _counted(pair << 32 | np.append(pair[2:], [-1, -1]), places)  # two pairs make four words
        m = node.max() + 1
        outward, inward = np.bincount(node[edge], minlength=m), np.bincount(node[edge + 1], minlength=m)
        bare = np.ones(m, bool)  # of nodes at which nothing ends and nothing begins
        bare[node[reads == 3]] = False
        entered = np.append(False, reads[:-1] == WIDTH)
        bare[node[nodes[~entered[nodes]]]] = False
        unary = bare & (outward == 1) & (inward == 1)
        through = np.zeros(n + 1, bool)
        through[nodes] = unary[node[nodes]]
        stops = np.flatnonzero(~through)
        head = ~through[edge]
        first, k = edge[head], k[head]
        last = stops[np.searchsorted(stops, first + 1)] + 2  # the path goes on through unary nodes
        out.append((first, last, k, False))
    return out


def _chunks(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[Words]:
    """The words of about ``most`` bytes of text at a time. Who asks for the next ones holds the last ones no more."""
    held, size = [], 0

    def words() -> Words:
        texts, langs = pa.concat_arrays([x for x, _ in held]), [y for _, ys in held for y in ys]
        held.clear()
        return Words(texts, langs)

    for batch in parts:
        lang, text = batch.column("lang").to_pylist(), batch.column("text")
        _, offsets = _text.buffers(text)
        at = 0
        while at < len(lang):  # rows until the chunk is full, one at least
            end = min(len(lang), max(at + 1, int(np.searchsorted(offsets, offsets[at] + most - size, "right")) - 1))
            held.append((text.slice(at, end - at).cast(pa.large_string()), lang[at:end]))
            size += int(offsets[end] - offsets[at])
            at = end
            if size >= most:
                yield words()
                size = 0
    if held:
        yield words()


def _bloom(docs: DataFrame, least: int, found) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of the hashes that ``found`` gives for a chunk's words, with counts, ``least`` times or oftener; BITS / 64 words, whatever the input."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            return _text.batches({"h": h.view(np.int64), "n": n}, pa.schema([("h", pa.int64()), ("n", pa.int64())]), 1 << 16)

        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for words in _chunks(parts, COUNTED):
            for more, k in found(words):
                h, at = np.unique(np.concatenate([h, more]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, k]), len(h)).astype(np.int64)
            words = more = k = at = None  # before the next ones are read
            if len(h) >= HELD:
                yield from out()
                h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from out()

    often = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bit = F.explode(F.array(*[F.shiftrightunsigned("h", 26 * i).bitwiseAND(BITS - 1) for i in (0, 1)]))
    filled = often.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[filled["at"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(np.uint64)


def filters(docs: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of the frequent pairs, and of the frequent triples of these with the words of frequent pairs."""

    def all_pairs(words: Words):
        yield np.unique(words.hashes()[1][words.pairs()], return_counts=True)

    pairs = _bloom(docs, least, all_pairs)
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def triples(words: Words):
        one, two, three = words.hashes()
        kept = words.pairs() & holds(sent.value, two)
        yield np.unique(three[kept & np.append(kept[1:], False)[: len(kept)]], return_counts=True)
        known = np.unique(one[kept | np.append(False, kept[:-1])[: len(kept)]])
        yield known, np.full(len(known), least)

    return pairs, _bloom(docs, least, triples)


def holds(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for i in (0, 1):
        bit = (h >> np.uint64(26 * i)) & np.uint64(BITS - 1)
        out &= ((bloom[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def paths(docs: DataFrame, least: int) -> DataFrame:
    """(lang, words, n, ended): compacted paths and ends, with their counts in one task's chunk; words that are not asked for as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(filters(docs, least))

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, rest = sent.value
        for words in _chunks(parts, CHUNK):
            one, two, three = words.hashes()
            reads, wanted = reach(words.pairs() & holds(pairs, two), holds(rest, three)), holds(rest, one)
            for first, last, n, ended in stretches(words, reads, wanted):
                for at in range(0, len(first), 1 << 14):
                    a, b = first[at : at + (1 << 14)], last[at : at + (1 << 14)]
                    lang = pa.DictionaryArray.from_arrays(pa.array(words.lang[a], pa.int32()), pa.array(words.names, pa.string())).cast(pa.string())
                    yield pa.record_batch([lang, words.phrases(a, b), pa.array(n[at : at + (1 << 14)], pa.int64()), pa.array(np.full(len(a), ended))], schema=_FIELDS)
            left = np.bincount(words.lang[(reads == 1) & ~wanted], minlength=len(words.names))  # only their number counts
            yield pa.record_batch([pa.array(words.names, pa.string()), pa.array([""] * len(left), pa.large_string()), pa.array(left, pa.int64()), pa.array([True] * len(left))], schema=_FIELDS)
            words = one = two = three = reads = wanted = first = last = n = ended = a = b = lang = None  # before the next ones are read

    return docs.mapInArrow(build, STRETCH)


def size(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


def part(words: Column | str, first: Column, many: Column | int) -> Column:
    return F.array_join(F.slice(words, first, many), " ")


def counts(stretch: DataFrame) -> DataFrame:
    """(lang, phrase, f): how often each phrase of up to WIDTH words stands, but for those that hold one that was cut.

    A path has an edge at each word that WIDTH - 1 others follow; an end is read once, as it is. What is read at all places
    where a phrase begins makes up its count.
    """
    w = F.split("words", " ")
    edge = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (WIDTH - 1)), lambda i: part("w", i, WIDTH)))
    edges = stretch.where(~F.col("ended")).withColumn("w", w).select("lang", edge.alias("words"), "n")
    longer = edges.unionByName(stretch.where(F.col("ended") & (F.instr("words", " ") > 0)).select("lang", "words", "n"))
    flow = F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: part("w", F.lit(1), k)))
    flows = longer.groupBy("lang", "words").agg(F.sum("n").alias("n")).withColumn("w", w).select("lang", flow.alias("phrase"), "n")
    single = stretch.where(F.col("ended") & (F.instr("words", " ") == 0) & (F.col("words") != "")).select("lang", F.col("words").alias("phrase"), "n")
    return flows.unionByName(single).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80) -> DataFrame:
    """The ``top`` phrases of each language by score: see ``op12_collocations`` and the module."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stretch = _shared.written(paths(docs, least), "phrase-paths")
    places = F.when(F.col("ended"), 1).otherwise(size(F.col("words")) - (WIDTH - 1))
    total = stretch.groupBy("lang").agg(F.sum(F.col("n") * places).alias("n"))
    known = _shared.written(counts(stretch).where(F.col("f") >= least), "phrase-counts")
    candidates = known.where(F.instr("phrase", " ") > 0).withColumn("size", size(F.col("phrase")))
    # each candidate and the shorter ones inside it: the largest count of a longer phrase around each
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: part(w, i, k))))
    around = candidates.where("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    free = candidates.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * covered))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "size", cut.alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(w, F.lit(1), F.col("k")).alias("head"), part(w, F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = best.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: rank, phrase, a = its count, l and r = those of its parts at the lowest-scoring cut, n = all words, score."""
    return collocations(_shared.read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc, lang, generate_subscripts(x, 1) AS piece, unnest(x) AS text FROM (SELECT doc, lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM d)),
w AS (SELECT doc, lang, piece, generate_subscripts(x, 1) AS place, unnest(x) AS word FROM (SELECT doc, lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS x FROM p)),
s AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY doc, piece ORDER BY place)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS k, w1 AS phrase FROM s UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM s WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM s WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM s WHERE w4 IS NOT NULL) GROUP BY 1, 2, 3),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 30),
i AS (SELECT lang, array_to_string(x[b:b + m - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, a, x, k, m, unnest(range(1, k - m + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
z AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.around IS NULL OR 100 * i.around < 80 * c.a),
e AS (SELECT z.lang, z.phrase, z.a, z.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * z.a) // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM z) z
  JOIN f l ON l.lang = z.lang AND l.phrase = array_to_string(z.x[1:z.cut], ' ') JOIN f r ON r.lang = z.lang AND r.phrase = array_to_string(z.x[z.cut + 1:], ' ')),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000
"""
