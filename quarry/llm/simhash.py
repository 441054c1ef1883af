"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits agree on whole
bands: with the bits cut into ``m`` bands, on at least ``m - radius`` of them.
Every choice of ``m - radius`` bands is a key, so each link is met under some
key and the search is exact for every ``m``.  ``m`` follows the number of
distinct fingerprints: more bands mean more rows but smaller buckets.

A bucket is compared in blocks of 64 fingerprints whose bits are stored
vertically, one word for each bit plane.  A query's distances to all 64 are
counted at once in bitwise counters fed by carry-save adders, three planes at
a time; a block is abandoned once all its distances exceed the radius.  A
bucket gives a spanning forest of its links, never all pairs.

A second fingerprint by another seed may confirm links: 64 bits alone can't
tell a similarity of 0.8 from chance in a large corpus, 128 can.

:func:`similar_documents` decides by the exact Jaccard similarity of shingle
sets: fingerprints only find candidates, with a radius far beyond what such
pairs differ by, among texts that share one of their smallest shingles, and
the sets' sizes and bits of 128 minima keep texts apart that only share a
passage: as candidates those would chain more and more of a growing corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import ROWS, batches, cut, partitions, small_batches, star_components, utf8, words

SEED = 42
#: Distinct fingerprints of a bucket that one task compares; larger buckets are dealt out in pairs of parts.
BUCKET = 8192
#: What a row costs against a comparison, from which the number of bands follows.
ROW = 3000
#: Bits of 128 within which documents count as similar to 0.8 by shingles: cosine 2 * 0.8 / 1.8 is an angle of about 19 bits.
SIMILAR = 20
#: Smallest shingles of a set that are candidate keys: a pair of similarity s shares none of them with a chance of about (1 - s) ** LOWEST.
LOWEST = 16
#: Candidate radii of the set's fingerprints, of 64 and of 128 bits; at a similarity of 0.8 pairs differ by 10 and 19 on average, 3 and 4 standard deviation.
WIDE, WIDE_BOTH = 28, 48
#: Minima of a set under as many orders, one bit of each; two sets' bits differ with a chance of (1 - s) / 2.
MINIMA = 128
#: Shingles of a candidate component that one task confirms; larger ones are dealt out in pairs of parts.
PART = 4_000_000
#: Planes are visited in this order, which spreads over all bands.
ORDER = [(p * 23) % 64 for p in range(64)]
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For each bit of a byte of the hash, whether each byte value has it.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 4, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """SimHashes of a whole text, one for each seed: bit i is set if more than half of the shingles' XXH64 have it."""
    found = words(text)
    if not found:
        return [0] * len(seeds)
    k = min(shingle, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - k + 1]
    joined = b" ".join(found)
    parts = [joined[a:b] for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]
    return [majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))) for seed in seeds]


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    eight = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 600:
        counts = np.unpackbits(eight, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(eight[:, b], minlength=256) @ BYTE_BITS for b in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text", seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """One row (doc_id, fp, fp2, ... long) for each row of ``docs``: the 64 bits of each seed as a signed number.

    A null or empty text and one without words have fingerprint zero.  Null
    keys and repeated rows are kept as they are.
    """
    narrow = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["fp", *(f"fp{i}" for i in range(2, len(seeds) + 1))]
    kind = pa.schema([("doc_id", to_arrow_type(narrow.schema["doc_id"].dataType)), *((n, pa.int64()) for n in names)])

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            every = np.array([fingerprint(x, shingle, seeds) for x in utf8(batch.column(1))], np.uint64)
            columns = [pa.array(np.ascontiguousarray(every[:, i]).view(np.int64)) for i in range(len(seeds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=kind)

    return narrow.mapInArrow(made, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def planes(block: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: (G, 64) values to (G, 64) words, word p with bit p of each."""
    bits = np.unpackbits(block.view(np.uint8).reshape(len(block), 64, 8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    return turned.view(np.uint64).reshape(len(block), 64)


def near(queries: np.ndarray, slices: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bit masks of the block members within ``radius`` of each query.

    queries (G, 64), slices (G, 64) planes, valid (G, 64) masks of the members
    that count for each query; the result has the shape of ``valid``.
    """
    out = np.zeros_like(valid)
    live = np.arange(len(queries))
    counters = [np.zeros_like(valid) for _ in range(max(2, radius.bit_length()))]  # of weight 1, 2, 4, ...
    over = np.zeros_like(valid)

    def beyond() -> np.ndarray:
        """Lanes whose count exceeds the radius: a comparison of the counters with a constant, bit by bit."""
        more, same = over.copy(), ~over
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                same &= counters[i]
            else:
                more |= same & counters[i]
                same &= ~counters[i]
        return more

    def differ(p: int) -> np.ndarray:
        return slices[:, p, None] ^ (np.uint64(0) - ((queries >> np.uint64(p)) & np.uint64(1)))

    for at in range(0, 64, 3):
        x = [differ(p) for p in ORDER[at : at + 3]]
        if len(x) == 3:
            half = x[0] ^ x[1]
            total, carry = half ^ x[2], (x[0] & x[1]) | (half & x[2])
        else:
            total, carry = x[0], np.zeros_like(x[0])
        spill = counters[0] & total
        counters[0] ^= total
        half = counters[1] ^ spill
        up = (counters[1] & spill) | (half & carry)
        counters[1] = half ^ carry
        for i in range(2, len(counters)):
            counters[i], up = counters[i] ^ up, counters[i] & up
        over |= up
        if at in (15, 24, 33, 45):
            keep = np.nonzero((valid & ~beyond()).any(axis=1))[0]
            if len(keep) < 0.7 * len(live):  # the other blocks are abandoned: all their distances exceed the radius
                live, queries, slices, valid = live[keep], queries[keep], slices[keep], valid[keep]
                counters, over = [c[keep] for c in counters], over[keep]
                if not len(live):
                    return out
    out[live] = valid & ~beyond()
    return out


def pairs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, queries and lanes of the bits set in masks (G, 64)."""
    g, q = np.nonzero(hits)
    lanes = np.unpackbits(hits[g, q].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(lanes)
    return g[k], q[k], lane


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels become the smallest label linked through the pairs (a, b)."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            to = label[label]
            if (to == label).all():
                break
            label[:] = to
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]


#: Lane masks for a block against itself: query q is held against the lanes after it.
AFTER = np.array([int(ALL) << (q + 1) & int(ALL) for q in range(64)], dtype=np.uint64)


class Compare:
    """When two of some fingerprints link: ``radius`` bits of the first at most, and ``both`` of both together.

    With ``sets``, which are sizes and bits of minima, sets that can't be
    similar to ``least`` by them don't link.
    """

    def __init__(self, fp: np.ndarray, radius: int, second: np.ndarray | None = None, both: int = 128, sets: tuple[np.ndarray, ...] = (), least: float = 0.0):
        self.fp, self.radius, self.second, self.both, self.sets, self.least = fp, radius, second, both, sets, least

    def part(self, at: slice) -> Compare:
        return Compare(self.fp[at], self.radius, None if self.second is None else self.second[at], self.both, tuple(x[at] for x in self.sets), self.least)

    def confirmed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs within the radius that the second fingerprint confirms."""
        if self.second is None or not len(a):
            return a, b
        near_ = np.bitwise_count(self.fp[a] ^ self.fp[b]) + np.bitwise_count(self.second[a] ^ self.second[b]) <= self.both
        a, b = a[near_], b[near_]
        if self.sets:
            size, *bits = self.sets
            near_ = np.minimum(size[a], size[b]) >= (self.least - 1e-9) * np.maximum(size[a], size[b])
            near_ &= sum(np.bitwise_count(x[a] ^ x[b]) for x in bits) <= spread(self.least)
            a, b = a[near_], b[near_]
        return a, b

    def ball(self, seed: int) -> np.ndarray:
        found = np.nonzero(np.bitwise_count(self.fp ^ self.fp[seed]) <= self.radius)[0]
        return self.confirmed(found, np.full(len(found), seed))[0]


def forest(group: np.ndarray, compare: Compare) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to), as positions, of a spanning forest of each group; groups are runs of equal numbers."""
    fp, radius = compare.fp, compare.radius
    starts = np.nonzero(np.concatenate(([True], group[1:] != group[:-1])))[0]
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    label = np.arange(len(fp))
    small = np.nonzero((sizes > 1) & (sizes <= 64))[0]
    for at in range(0, len(small), 2048):
        part = small[at : at + 2048]
        lane = np.arange(64)[None, :]
        there = lane < sizes[part][:, None]
        block = np.where(there, fp[np.minimum(starts[part][:, None] + lane, len(fp) - 1)], np.uint64(0))
        valid = np.where(there, (np.uint64(1) << lane.astype(np.uint64)), np.uint64(0)).sum(axis=1, dtype=np.uint64)[:, None] & AFTER[None, :]
        valid = np.where(there, valid, np.uint64(0))
        g, q, k = pairs(near(block, planes(block), valid, radius))
        merge(label, *compare.confirmed(starts[part][g] + q, starts[part][g] + k))
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        label[s : s + n] = s + large(compare.part(slice(s, s + n)))
    off = np.nonzero(label != np.arange(len(fp)))[0]
    return off, label[off]


def large(compare: Compare) -> np.ndarray:
    """Labels of one large group: its dense balls are gathered first, then blocks of different labels are compared."""
    fp, n = compare.fp, len(compare.fp)
    label, free = np.arange(n), np.ones(n, bool)
    for _ in range(8):
        if not free.any():
            break
        seed = int(np.argmax(free))
        ball = compare.ball(seed)
        free[ball] = free[seed] = False
        if len(ball) < 2:
            continue
        merge(label, np.full(len(ball), seed), ball)
    order = np.argsort(label, kind="stable")
    pad = -n % 64
    member = np.concatenate((order, np.repeat(order[-1:], pad))).reshape(-1, 64)
    there = (np.arange(n + pad) < n).reshape(-1, 64)
    block = fp[member]
    slices = planes(block)
    full = np.where(there, np.uint64(1) << np.arange(64, dtype=np.uint64)[None, :], np.uint64(0)).sum(axis=1, dtype=np.uint64)
    first, second = np.triu_indices(len(block))
    for at in range(0, len(first), 256):
        a, b = first[at : at + 256], second[at : at + 256]
        low, high = label[member].min(axis=1), label[member].max(axis=1)
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))  # one label on both sides: nothing to learn
        a, b = a[open_], b[open_]
        if len(a):
            valid = np.where((a == b)[:, None], full[b][:, None] & AFTER[None, :], full[b][:, None])
            valid = np.where(there[a], valid, np.uint64(0))
            g, q, k = pairs(near(block[a], slices[b], valid, compare.radius))
            merge(label, *compare.confirmed(member[a[g], q], member[b[g], k]))
    return label


def band_keys(radius: int, m: int) -> list[int]:
    """Masks of all choices of ``m - radius`` of ``m`` bands of 64 bits."""
    edges = [64 * i // m for i in range(m + 1)]
    bands = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(c) for c in combinations(bands, m - radius)]


def bands_for(distinct: int, radius: int) -> int:
    """The number of bands for which the rows and comparisons of evenly spread fingerprints cost least; every number is exact."""

    def cost(m: int) -> float:
        return comb(m, radius) * (ROW + distinct / 2 ** (64 * (m - radius) / m))

    return min(range(radius + 1, min(64, 2 * radius + 2) + 1), key=cost)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int, bands: int | None = None, bucket: int = BUCKET, both: int | None = None) -> DataFrame:
    """Links (a, b) that connect exactly the nodes connected at ``radius``; ``distinct`` has each ``node`` once with its ``fp``.

    With ``both`` links need that many bits of ``fp`` and ``fp2`` together at
    most, too.  Each bucket yields at most one link for each member.  Buckets
    of more than ``bucket`` members are split into parts and every two parts
    meet in a task of their own, so no bucket is gathered whole.
    """
    m = bands or bands_for(distinct.count(), radius)
    masks = band_keys(radius, m)
    own_columns = ["node", "fp", *(["fp2"] if both else [])]
    keys = [F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key")) for i, x in enumerate(masks)]
    rows = distinct.select(*own_columns, F.explode(F.array(*keys)).alias("k")).select(*own_columns, "k.band", "k.key")
    return met(rows, radius, bucket, both)


def met(rows: DataFrame, radius: int, bucket: int = BUCKET, both: int | None = None, counts: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """A spanning forest (a, b) of the links of each bucket; ``rows`` has ``band``, ``key``, ``node`` and the fingerprints.

    ``counts`` are the buckets' (band, key, count), if they are computed already.  With ``both``
    and ``least`` rows have ``size``, ``bits`` and ``bits2`` too, and only
    links stay that these allow.
    """
    own_columns = ["node", "fp", *(["fp2"] if both else []), *(["size", "bits", "bits2"] if both and least else [])]
    heavy = rows.groupBy("band", "key").count() if counts is None else counts
    heavy = heavy.where(F.col("count") > bucket).select("band", "key", F.ceil(F.col("count") / bucket).cast("int").alias("parts"))
    if counts is not None and heavy.count() <= ROWS:  # else the rows would travel once more for a few large buckets
        heavy = F.broadcast(heavy)
    rows = rows.join(heavy, ["band", "key"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(others))
    rows = rows.select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *own_columns)
    rows = rows.repartition(partitions(rows.sparkSession), "band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")

    def compared(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for part in batches(batch):
            now = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            now = [np.concatenate(x) for x in zip(kept, now, strict=True)] if kept else now
            change = np.zeros(len(now[0]), bool)
            for c in now[:4]:
                change[1:] |= c[1:] != c[:-1]
            last = int(np.nonzero(change)[0][-1]) if change.any() else 0  # the last group may go on in the next batch
            if last:
                yield linked(np.cumsum(change)[:last], [c[:last] for c in now[4:]])
            kept = [c[last:] for c in now]
        if kept:
            yield linked(np.zeros(len(kept[0]), int), kept[4:])

    def linked(group: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        node, *prints = columns
        prints = [np.ascontiguousarray(x).view(np.uint64) for x in prints]
        a, b = forest(group, Compare(prints[0], radius, *([prints[1], both, tuple(prints[2:]), least or 0.0] if both else [])))
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, key: str = "doc_id", text: str = "text", both: int | None = None) -> DataFrame:
    """One row (doc_id, fp long, component_id) for each row of ``docs``.

    ``component_id`` is the smallest key among the documents reached through
    links of at most ``radius`` differing bits, the document itself included;
    null only where no document of the component has a key.  With ``both``
    links also need at most that many differing bits of two fingerprints
    together.  Texts without words share fingerprint zero and are linked like
    any others.  Repeated rows and ties belong to one component.  An empty
    table gives no rows.
    """
    found = fingerprints(docs, shingle, key, text, (SEED, SEED + 1) if both else (SEED,))
    node = F.xxhash64("fp", "fp2") if both else F.col("fp")
    found = cut(found.withColumn("node", node))
    prints = [F.first(c).alias(c) for c in ("fp", "fp2") if c in found.columns]
    distinct = cut(found.groupBy("node").agg(F.min("doc_id").alias("least"), *prints))
    roots = star_components(links(distinct, radius, both=both))
    nodes = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id")
    return found.join(named, "node").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes; none of a text without words."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - k + 1]
    joined = b" ".join(found)
    parts = {joined[a:b] for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, by the finaliser of SplitMix64."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The orders: the hashes times each of these odd numbers.
ORDERS = remixed(np.arange(MINIMA, dtype=np.uint64)) | np.uint64(1)


def minima_bits(hashes: np.ndarray) -> list[int]:
    """One bit of a set's smallest element in each of :data:`MINIMA` orders, 64 to a number."""
    low = np.full(MINIMA, ALL)
    for at in range(0, len(hashes), 256):
        low = np.minimum(low, (hashes[at : at + 256, None] * ORDERS).min(axis=0))
    return np.packbits(np.bitwise_count(low) & 1, bitorder="little").view(np.uint64).tolist()


def spread(least: float) -> float:
    """Bits of the minima by which sets of that similarity differ at most: 8 standard deviations beyond the mean (at 0.8, 40 bits and a chance of 1e-11 of more)."""
    p = (1 - least) / 2
    return MINIMA * p + 8 * sqrt(MINIMA * p * (1 - p)) + 0.5


def set_node(found: np.ndarray) -> int:
    """The 64-bit name of a shingle set."""
    return signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, of a spanning forest of the sets whose Jaccard similarity is at least ``least``."""
    label, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(sets) - 1):
        if not sizes[i]:
            continue
        ratio = np.minimum(sizes, sizes[i]) / np.maximum(sizes, sizes[i])
        others = np.nonzero((np.arange(len(sets)) > i) & (label != label[i]) & (ratio >= least - 1e-9))[0]
        if not len(others):
            continue
        pieces = every if len(others) == len(sets) else np.concatenate([every[edges[j] : edges[j + 1]] for j in others])
        at = np.minimum(np.searchsorted(sets[i], pieces), sizes[i] - 1)
        cuts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        common = np.add.reduceat((sets[i][at] == pieces).astype(np.int64), cuts)
        near_ = others[common >= (least - 1e-9) * (sizes[i] + sizes[others] - common)]
        merge(label, np.full(len(near_), i), near_)
    off = np.nonzero(label != np.arange(len(sets)))[0]
    return off, label[off]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """One row for each row (doc_id, text) of ``docs``: doc_id, the text's hash ``digest``, and of its shingle set the name ``node``, size, SimHashes, bits of minima and smallest hashes."""
    names = ["node", "size", "fp", "fp2", "bits", "bits2"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out, low = [], []
            for text in utf8(batch.column(1)):
                found = shingle_set(text, shingle)
                prints = (majority(found), majority(remixed(found))) if len(found) else (0, 0)
                out.append((set_node(found), len(found), *map(signed, (*prints, *minima_bits(found)))))
                low.append(found[:LOWEST].view(np.int64))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "digest", *names, "low"])

    return docs.mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, " + ", ".join(f"{n} long" for n in names) + ", low array<long>")


def candidate_links(distinct: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect the sets that may be similar to ``least``; ``distinct`` has each set's sketch once.

    Most sets' smallest shingles are theirs alone, so only keys travel until it's known which are shared.
    """
    keys = distinct.select("node", F.explode("low").alias("key"))
    shared = cut(keys.groupBy("key").count().where("count > 1").withColumn("band", F.lit(0)))
    rows = keys.join(shared.select("key", "band"), "key").join(distinct.select("node", "fp", "fp2", "size", "bits", "bits2"), "node")
    return met(rows, WIDE, both=WIDE_BOTH, counts=shared, least=least)


def confirmed_links(docs: DataFrame, distinct: DataFrame, roots: DataFrame, least: float, shingle: int, part: int = PART) -> DataFrame:
    """Links (a, b) that connect exactly the sets that similarities of at least ``least`` connect within each candidate component.

    Of each set one text (doc_id ``least``, hash ``digest``) travels, as a text
    takes less than half of its set's space: once, and once for each part where
    its component has more than ``part`` shingles: then every two parts meet in
    a task of their own.
    """
    wanted = cut(distinct.join(roots, "node").select("node", "root", "size", "least", "digest"))
    heavy = wanted.groupBy("root").agg(F.ceil(F.sum("size") / part).cast("int").alias("parts")).where("parts > 1")
    wanted = wanted.join(heavy, "root", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0)))
    same = docs["doc_id"].eqNullSafe(wanted["least"]) & (F.xxhash64(docs["text"]) == wanted["digest"])
    texts = docs.join(wanted, same).select("root", "own", "parts", "node", "text")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = texts.withColumn("other", F.explode(others)).select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "text")
    rows = rows.repartition(partitions(docs.sparkSession), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")

    def compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches(rows):
            found: list[tuple[int, int]] = []
            for root, lo, hi, node, text in zip(*(c.to_pylist() for c in batch.columns[:4]), utf8(batch.column(4)), strict=True):
                if at != (root, lo, hi):
                    found += linked(held)
                    at, held = (root, lo, hi), {}
                if node not in held:  # of repeated rows, one
                    held[node] = shingle_set(text, shingle)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])
        found = linked(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    def linked(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        nodes = list(held)
        a, b = similar([held[x] for x in nodes], least)
        return [(nodes[i], nodes[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]

    return rows.mapInArrow(compared, "a long, b long")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fp long, component_id) for each row of ``docs``, as :func:`near_duplicates`.

    Links are the pairs whose sets of shingles have a Jaccard similarity of at
    least ``similarity`` over the whole texts, up to collisions of 64-bit
    hashes.  Candidates share one of their :data:`LOWEST` smallest shingles, lie
    within :data:`WIDE` and :data:`WIDE_BOTH` bits and have sizes and minima
    that allow it; all sets of a candidate component are then held against
    each other.  Texts without words are alike.
    """
    narrow = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = cut(sketches(narrow, shingle))
    text_of = F.struct("doc_id", "digest")
    text_of = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), text_of)), F.min(text_of))  # a null key only where there is no other
    distinct = found.groupBy("node").agg(text_of.alias("text_of"), *(F.first(c).alias(c) for c in ("size", "fp", "fp2", "bits", "bits2", "low")))
    distinct = cut(distinct.withColumns({"least": F.col("text_of.doc_id"), "digest": F.col("text_of.digest")}).drop("text_of"))
    candidates = star_components(candidate_links(distinct, similarity))
    candidates = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())  # the smallest nodes, too
    roots = star_components(confirmed_links(narrow, distinct, candidates, similarity, shingle))
    nodes = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id")
    return found.join(named, "node").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = 10, shingle: int = 5, both: int | None = SIMILAR, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest ``doc_id``.

    By default documents are near that share five-word shingles to a similarity
    of about 0.8: 10 of 64 bits of the fingerprint that finds candidates, and
    :data:`SIMILAR` of 128 bits of both.  With ``similarity`` the exact Jaccard
    similarity of the shingles decides instead, see :func:`similar_documents`.

    Of rows that share that doc_id, the one with the smallest text stays.  Rows
    without a doc_id all stay, as no decision can name them.  Null and empty
    texts are alike, texts of any length are taken whole, other columns pass
    through, and an empty table gives no rows.
    """
    found = cut(near_duplicates(docs, radius, shingle, both=both) if similarity is None else similar_documents(docs, similarity, shingle))
    keep = cut(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count())
    out = docs.join(keep.where("count = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    if not keep.where("count > 1").isEmpty():
        again = docs.join(keep.where("count > 1").select("doc_id"), "doc_id", "left_semi")
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        again = again.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
        out = out.unionByName(again.select(docs.columns))
    return out.unionByName(docs.where(F.col("doc_id").isNull()))
