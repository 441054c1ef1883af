"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Training takes a bounded sample of labelled rows and all of its words.  A
word's weight is ``(1 + ln tf) * idf * (sqrt(chi2) + FLOOR)``: its document
frequency comes from all documents, and chi2 measures over the sample how far
the word goes with the label, so that a long text's topic doesn't drown the few
words that make it toxic.  No word is left out, however weak or rare.

Examples with equal vectors are one point, with their number and mean label.
Points stand in an inverted index cut into blocks of :data:`BLOCK`, which keeps
each word's largest weight in each block where it occurs.  The few words that
more than one point in :data:`COMMON` has are columns over all points, and one
matrix product takes them for many texts at once.  What these give a block at
best, and the largest weights of its other words, is the block's bound; the
k-th best so far only grows by more words, so blocks with a lower bound are
never opened and the nearest points are exact.  Of points equally near the
smaller doc_id counts.

The neighbours' votes, weighted by similarity and number, and the sample's base
rate make a raw score.  A logistic curve fitted to the raw scores that the
examples get from each other, each without itself, calibrates it.  The nearest
points are the evidence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches, crc_mod, small_batches, utf8

#: Labelled rows in the sample at most.
SAMPLE = 4_000
#: Added to each word's association with the label, whose expectation for an unrelated word is 1.
FLOOR = 0.1
NEAREST, BLOCK = 15, 32
#: A word that one point in so many has is a column.
COMMON = 24
#: Weight of the base rate among the votes.
PRIOR = 0.25
#: Maps a text's bytes so that all but word characters become blanks, A-Z lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> Counter:
    """The words of a whole text with their counts."""
    return Counter((text or b"").translate(FOLD).split())


def spans(first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The numbers of several ranges one after the other: ``held`` of them from each ``first`` on."""
    ends = np.cumsum(held)
    return np.repeat(first - ends + held, held) + np.arange(int(ends[-1]) if len(ends) else 0)


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


@dataclass
class Model:
    """What scoring needs: bounded by :data:`SAMPLE`.  It travels as words and counts; weights, blocks and bounds are made where it arrives."""

    words: list[bytes]
    scale: np.ndarray  # of each word: idf and association
    base: float
    ids: np.ndarray  # of each point: the smallest doc_id, the mean label and the number of its examples
    labels: np.ndarray
    sizes: np.ndarray
    held: np.ndarray  # of each word: in how many points it is
    point: np.ndarray  # of each posting, by word and point: the point and how often the word stands there
    times: np.ndarray

    def __post_init__(self) -> None:
        n, words = len(self.ids), len(self.words)
        term = np.repeat(np.arange(words), self.held)
        weight = (1 + np.log(self.times.astype(np.float64))) * self.scale[term]
        self.weight = weight / np.sqrt(np.bincount(self.point, weight * weight, n))[self.point]
        self.number = dict(zip(self.words, range(words), strict=True))
        column = self.held * COMMON > n
        self.column = np.where(column, np.cumsum(column) - 1, -1)  # of each word: its column, -1 if it has none
        self.columns = np.zeros((int(column.sum()), n))
        full = column[term]
        self.columns[self.column[term[full]], self.point[full]] = self.weight[full]
        term, self.place, self.weight = term[~full], self.point[~full], self.weight[~full]
        key = term * (n // BLOCK + 1) + self.place // BLOCK
        edges = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
        self.entries = np.searchsorted(term[edges], np.arange(words + 1))  # where the entries of each word begin
        self.block = narrow(self.place[edges] // BLOCK)  # of each entry of a word: the block and the largest weight there
        self.highest = np.maximum.reduceat(self.weight, edges) if len(edges) else np.zeros(0)
        self.postings = np.concatenate((edges, [len(term)]))  # where the postings of each entry begin

    def __reduce__(self) -> tuple:
        return Model, (self.words, self.scale, self.base, self.ids, self.labels, self.sizes, self.held, self.point, self.times)

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and normalised weights of a text's words; words that no example has only lengthen the text."""
        counts = terms(text)
        known = self.number
        number = np.array([known[t] for t in counts if t in known], np.int64)
        weight = (1 + np.log([n for t, n in counts.items() if t in known])) * self.scale[number] if len(number) else np.zeros(0)
        size = np.sqrt(weight @ weight)
        return number, weight / size if size else weight

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query positions and cosines of the k nearest points above 0, nearest first, then by doc_id."""
        n = len(self.ids)
        blocks = -(-n // BLOCK)
        for start in range(0, len(queries), 128):
            some = queries[start : start + 128]
            common = np.zeros((len(some), len(self.columns)))
            for row, (number, weight) in zip(common, some, strict=True):
                at = self.column[number]
                row[at[at >= 0]] = weight[at >= 0]
            for cosine, (number, weight) in zip(common @ self.columns, some, strict=True):
                if not n:
                    yield np.zeros(0, np.int64), np.zeros(0)
                    continue
                least = float(np.partition(cosine, n - k)[n - k]) if k < n else 0.0
                held = self.entries[number + 1] - self.entries[number]
                entry = spans(self.entries[number], held)
                times, block = np.repeat(weight, held), self.block[entry]
                bounds = np.maximum.reduceat(cosine, np.arange(0, n, BLOCK)) + np.bincount(block, times * self.highest[entry], blocks)
                order = np.argsort(-bounds, kind="stable")
                for visit in (order[:6], order[6:]):
                    visit = visit[bounds[visit] >= max(least - 1e-9, 1e-12)]
                    open_ = np.zeros(blocks, bool)
                    open_[visit] = True
                    inside = np.nonzero(open_[block])[0]
                    if len(inside):
                        first = self.postings[entry[inside]]
                        size = self.postings[entry[inside] + 1] - first
                        at = spans(first, size)
                        cosine = cosine + np.bincount(self.place[at], np.repeat(times[inside], size) * self.weight[at], n)
                        least = float(np.partition(cosine, n - k)[n - k]) if k < n else 0.0
                cosine = np.round(cosine, 9)
                found = np.nonzero(cosine >= max(round(least, 9), 1e-9))[0]
                order = np.lexsort((self.ids[found], -cosine[found]))[:k]
                yield found[order], cosine[found[order]]

    def vote(self, near: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> float:
        own = near * sizes
        return float((own @ labels + PRIOR * self.base) / (own.sum() + PRIOR))

    def without(self, at: np.ndarray, near: np.ndarray, toxic: int) -> float:
        """The vote for an example by all the others, given its nearest points, itself among them."""
        labels, sizes = self.labels[at], self.sizes[at].astype(np.float64)
        own = np.nonzero(near > 1 - 1e-6)[0][:1]  # the example's own point is the nearest
        if len(own):
            i = own[0]
            total = labels[i] * sizes[i] - toxic
            sizes[i] -= 1
            labels[i] = total / sizes[i] if sizes[i] else 0.0
        return self.vote(near, labels, sizes)


def sampled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Texts and labels (doc_id, text, toxic) of at most ``limit`` labelled rows, drawn by a hash of doc_id.

    A row's label is the largest of those its doc_id has; null ids and labels
    teach nothing.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.where(crc_mod("doc_id", 5) != 0)
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # bounded by limit


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model from the labelled rows whose crc32 of doc_id leaves a remainder by 5.

    The sample's words pass through the driver, as many as ``limit`` texts have.
    """
    sample = sampled(docs, labels, limit)

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = [terms(x) for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([list(x) for x in every], pa.list_(pa.binary())), pa.array([list(x.values()) for x in every], pa.list_(pa.int32()))], names=["doc_id", "toxic", "word", "n"])

    got = sample.select("doc_id", "text", "toxic").mapInArrow(counted, "doc_id long, toxic int, word array<binary>, n array<int>").toArrow().combine_chunks()
    sizes = np.diff(got["word"].combine_chunks().offsets.to_numpy()) if got.num_rows else np.zeros(0, np.int64)
    coded = (got["word"].combine_chunks().flatten() if got.num_rows else pa.array([], pa.binary())).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words: list[bytes] = coded.dictionary.to_pylist()
    term = coded.indices.to_numpy().astype(np.int64)
    n = got["n"].combine_chunks().flatten().to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    ids, toxic = (got[c].to_numpy().astype(np.int64) for c in ("doc_id", "toxic"))
    return index(ids, (toxic > 0).astype(np.int64), sizes, term, n, words, *frequencies(docs, words))


def frequencies(docs: DataFrame, words: list[bytes]) -> tuple[int, np.ndarray]:
    """The number of all documents, and how many of them have each word."""
    table = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the sample

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(table.value)}
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches(rows):
            total[-1] += batch.num_rows
            for text in utf8(batch.column(0)):
                total[[known[t] for t in set((text or b"").translate(FOLD).split()) if t in known]] += 1
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words) + 1, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()
    return int(df[-1]), df[:-1]


def index(ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, term: np.ndarray, n: np.ndarray, vocabulary: list[bytes], documents: int, df: np.ndarray) -> Model:
    """The block-max index over the examples (ids, toxic), whose ``sizes`` words ``term`` occur ``n`` times."""
    words, owner = len(vocabulary), np.repeat(np.arange(len(ids)), sizes)
    all1 = int(toxic.sum())
    all0 = len(ids) - all1
    a = np.bincount(term, toxic[owner], words)
    b = np.bincount(term, 1 - toxic[owner], words)
    below = (a + b) * (len(ids) - a - b) * all0 * all1
    chi = np.divide(len(ids) * (a * (all0 - b) - b * (all1 - a)) ** 2, below, out=np.zeros(words), where=below > 0)
    scale = (np.log((1 + documents) / (1 + df)) + 1) * (np.sqrt(chi) + FLOOR)
    points: dict[bytes, list] = {}
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(ids)):
        if sizes[i]:
            own = slice(starts[i], starts[i + 1])
            order = np.argsort(term[own])
            mine = term[own][order], n[own][order]
            point = points.setdefault(mine[0].tobytes() + mine[1].tobytes(), [int(ids[i]), 0, 0, mine])
            point[0], point[1], point[2] = min(point[0], int(ids[i])), point[1] + int(toxic[i]), point[2] + 1

    def leading(point: list) -> tuple:
        """Points whose weightiest words are the same share blocks, which makes the bounds tight."""
        t, times = point[3]
        return (*t[np.argsort(-(1 + np.log(times)) * scale[t], kind="stable")[:3]].tolist(), point[0])

    rows = sorted(points.values(), key=leading)
    every = [np.concatenate([x[3][k] for x in rows]) if rows else np.zeros(0, np.int64) for k in (0, 1)]
    at = np.repeat(np.arange(len(rows)), [len(x[3][0]) for x in rows]) if rows else np.zeros(0, np.int64)
    order = np.argsort(every[0] * max(1, len(rows)) + at)
    return Model(
        vocabulary,
        scale,
        (all1 + 0.5) / (len(ids) + 1),
        np.array([x[0] for x in rows], np.int64),
        np.array([x[1] / x[2] for x in rows], np.float64),
        np.array([x[2] for x in rows], np.int64),
        np.bincount(every[0], minlength=words),
        narrow(at[order]),
        narrow(every[1][order]),
    )


def calibrate(sample: DataFrame, shared: Broadcast[Model]) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the votes' log odds that fits the examples' votes for each other."""

    def voted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches(rows):
            near = m.nearest([m.vector(x) for x in utf8(batch.column(0))], NEAREST + 1)
            votes = [m.without(*x, int(toxic > 0)) for x, toxic in zip(near, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(1)], names=["vote", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(voted, "vote double, toxic int").toArrow()
    vote, toxic = got["vote"].to_numpy(), got["toxic"].to_numpy() > 0
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    x = np.log(vote / (1 - vote))
    y = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (len(toxic) - toxic.sum() + 2))  # no example is sure
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's steps with a little weight on the identity
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + (slope - 1), (p - y).sum() + offset])
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        move = np.linalg.solve(h, g)
        slope, offset = max(0.05, slope - move[0]), offset - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(slope), float(offset)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, score double, evidence), one for each row of ``docs``.

    ``evidence`` lists the nearest points, nearest first, as (doc_id of an
    example, cosine, share of toxic examples).  A text without a word of the
    sample, the empty and the null text too, has no evidence and the score of
    the sample's base rate; without labels all score 0.5.  Texts of any length
    are taken whole, repeated rows score alike, points equally near go by
    doc_id, other columns are ignored, and an empty table gives no rows.
    Only the text is scored.
    """
    model = small_batches(docs).sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    slope, offset = calibrate(sampled(docs, labels, limit), model)
    narrowed = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    name = narrowed.schema["doc_id"].dataType

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches(rows):
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                votes, ats, nears = [], [], []
                for at, near in m.nearest([m.vector(x) for x in utf8(part.column(1))]):
                    votes.append(m.vote(near, m.labels[at], m.sizes[at]))
                    ats.append(at)
                    nears.append(near)
                at, vote = np.concatenate(ats), np.array(votes)
                score = 1 / (1 + np.exp(-(slope * np.log(vote / (1 - vote)) + offset)))
                ends = np.cumsum([0, *map(len, ats)]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(m.ids[at]), pa.array(np.concatenate(nears)), pa.array(m.labels[at])], ["doc_id", "cosine", "toxic"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), items)], names=["doc_id", "score", "evidence"])

    return narrowed.mapInArrow(scored, f"doc_id {name.simpleString()}, score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:double>>")
