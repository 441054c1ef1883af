"""Line dedup through two Bloom filters.

A line's key is the stripped line with A-Z in lower case; keys of at least
``least`` code points found in at least three documents lose all their lines
except in the document with the largest ``doc_id`` that holds it.

1. Each batch of documents reduces its keys to 128-bit digests and sends at
   most two packed records of a key: the holder with the largest doc_id, and
   the second holder where there are just two.  Three holders in one batch
   settle the key: the others lose the line there and then, so a line that
   half of the corpus shares travels once for each batch, not for each document.
2. Records meet by digest.  The first Bloom filter holds the digests seen once,
   the second those seen again; digests the second filter doesn't hold are
   unique for certain and end there.
3. Only suspected repeats go on as rows: they shuffle by digest, their holders
   are counted exactly, and the largest doc_id is chosen to keep the line.
4. Documents take up their list of dropped digests and are cut anew.

The filters belong to one part of the digests each, so their size follows the
part, not the corpus, and none is broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, batches, partitions, runs_of, small_batches, utf8

STRIP = BLANKS.encode()
#: Stands for a null doc_id, and so is smaller than any other.
NO_ID = -(1 << 63)
#: Bits for each record, and hash functions, of the Bloom filters: about 1 false suspect in 400.
BITS, HASHES = 16, 4


def key_of(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it's too short to count."""
    key = line.strip(STRIP).lower()
    return key if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least) else None


class Bloom:
    """A Bloom filter over pairs of 64-bit words."""

    def __init__(self, records: int):
        self.size = np.uint64(max(64, records * BITS))
        self.bits = np.zeros(int(self.size) // 8 + 1, np.uint8)

    def places(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        step = hi | np.uint64(1)
        return [(lo + np.uint64(k) * step) % self.size for k in range(HASHES)]

    def add(self, lo: np.ndarray, hi: np.ndarray) -> None:
        for at in self.places(lo, hi):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.ones(len(lo), bool)
        for at in self.places(lo, hi):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def suspects(lo: list[np.ndarray], hi: list[np.ndarray], weight: list[np.ndarray]) -> list[np.ndarray]:
    """For each batch's records, which of them are suspected repeats.

    Records of weight 3 are settled repeats: they count as seen again at once.
    """
    total = sum(map(len, lo))
    once, again = Bloom(total), Bloom(total)
    for a, b, w in zip(lo, hi, weight, strict=True):
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        twice = np.zeros(len(a), bool)
        twice[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        seen = twice | (w >= 3) | once.holds(a, b)
        again.add(a[seen], b[seen])
        once.add(a[~seen], b[~seen])
    return [again.holds(a, b) for a, b in zip(lo, hi, strict=True)]


def dropped_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """Rows (doc_id long, lo long, hi long): the digests of the lines each document loses."""
    shards = partitions(docs.sparkSession)
    narrow = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs_of(rows):
            held: dict[bytes, int | set[int]] = {}
            for batch in some:
                for at in range(0, batch.num_rows, 256):  # a few texts at a time lie in memory as lines
                    part = batch.slice(at, 256)
                    for doc, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                        for key in {key_of(x, least) for x in (text or b"").split(b"\n")}:
                            if key is not None:
                                digest = xxhash.xxh3_128_digest(key)
                                if (others := held.get(digest)) is None:
                                    held[digest] = doc  # most lines have one holder, which needs no set
                                elif type(others) is set:
                                    others.add(doc)
                                elif others != doc:
                                    held[digest] = {others, doc}
            digests, ids, weights = [], [], []
            for digest, holders in held.items():
                if type(holders) is int:
                    digests.append(digest)
                    ids.append(holders)
                    weights.append(1)
                    continue
                top = max(holders)
                few = len(holders) < 3
                for doc in holders:
                    digests.append(digest)
                    ids.append(doc)
                    weights.append(1 if few else 3 if doc == top else 0)
            both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            doc, weight = np.array(ids, np.int64), np.array(weights, np.uint8)
            shard = np.where(weight > 0, both[:, 0] % np.uint64(shards), doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            out = [(s, *(x[order[a:b]].tobytes() for x in (both[:, 0], both[:, 1], doc, weight))) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 5))], names=["shard", "lo", "hi", "doc", "weight"])

    def filtered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, doc, weight = parts = [], [], [], []
        for batch in batches(rows):
            for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.uint8)):
                parts[k].extend(np.frombuffer(x, kind) for x in batch.column(k + 1).to_pylist())
        sure = [w == 0 for w in weight]
        open_ = [~x for x in sure]
        found = suspects([a[m] for a, m in zip(lo, open_, strict=True)], [b[m] for b, m in zip(hi, open_, strict=True)], [w[m] for w, m in zip(weight, open_, strict=True)])
        for a, b, d, w, m, s in zip(lo, hi, doc, weight, open_, found, strict=True):
            keep = ~m
            keep[np.nonzero(m)[0][s]] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (a, b, d)] + [pa.array(w[keep].astype(np.int32))], names=["lo", "hi", "doc_id", "weight"])

    sent = narrow.mapInArrow(packed, "shard int, lo binary, hi binary, doc binary, weight binary").repartition(shards, "shard")
    rows = sent.mapInArrow(filtered, "lo long, hi long, doc_id long, weight int")  # two readers, which share the shuffle before it
    sure, open_ = rows.where("weight = 0"), rows.where("weight > 0")
    # a key has two records a run of batches at most, however many documents hold it
    by = Window.partitionBy("lo", "hi")
    counted = open_.distinct().withColumns({"keeper": F.max("doc_id").over(by), "n": F.count_if(F.col("weight") < 3).over(by), "w": F.max("weight").over(by)})
    lost = counted.where("(w = 3 or n >= 3) and doc_id < keeper")
    return lost.select("doc_id", "lo", "hi").unionByName(sure.select("doc_id", "lo", "hi")).distinct()


def dedup_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """``docs`` with its lines deduplicated in ``text``, and n_lines, n_dropped (long) after its columns.

    Documents are rows' doc_ids: rows with the same doc_id are one document,
    and rows without one together are a document that is smaller than all
    others (a doc_id of -2**63 counts as none).  A null or empty text is one
    empty line and comes out empty; a text of any length is taken whole.  Ties
    can't occur: of the documents that hold a line the largest doc_id keeps
    it.  Existing columns n_lines and n_dropped are replaced, other columns of
    any name pass through; an empty table gives no rows.

    Only texts that lose a line go through Python, the others stay as they are.
    """
    lost = dropped_lines(docs, least).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("lost"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rest = F.struct(*(F.col(f"`{c}`") for c in names if c != "text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    plain = docs.select(rest.alias("row"), key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = plain.join(lost.select(F.col("doc_id").alias("key"), "lost"), "key", "left")

    @F.arrow_udf("text string, n_dropped long")
    def kept(text: pa.Array, lost: pa.Array) -> pa.Array:
        texts, drops = [], []
        for at in range(0, len(text), 256):  # a few texts at a time lie in memory as lines
            for body, gone in zip(utf8(text.slice(at, 256)), lost.slice(at, 256), strict=True):
                if body is None:
                    texts.append(None)
                    drops.append(0)
                    continue
                own = gone.values
                digests = set(map(bytes, np.array([own.field(0).to_numpy(), own.field(1).to_numpy()], np.int64).T.copy().view(np.uint8)))
                every = body.split(b"\n")
                stay = [x for x in every if (key := key_of(x, least)) is None or xxhash.xxh3_128_digest(key) not in digests]
                drops.append(len(every) - len(stay))
                texts.append(b"\n".join(stay))
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(drops, pa.int64())], ["text", "n_dropped"])

    hit = F.col("lost").isNotNull()
    done = joined.withColumn("cut", kept(F.when(hit, F.col("text")), "lost"))
    put = F.when(hit, F.col("cut.text")).otherwise(F.col("text"))
    columns = [put.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return done.select(*columns, n_lines.cast("long").alias("n_lines"), F.when(hit, F.col("cut.n_dropped")).otherwise(0).alias("n_dropped"))
