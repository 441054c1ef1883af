"""Document fingerprints as homomorphic multiset hashes.

A text is the multiset of its passages.  Each passage hashes to a wide vector;
a fingerprint is the sum of its passages' vectors, every lane modulo a power
of two.  The order of passages doesn't matter, and a passage is inserted or
deleted by adding or subtracting its vector, without the rest of the text.

Two groups of lanes share the sum: 32 lanes of even 16-bit values, which tell
different multisets apart, and 512 lanes of +1 or -1 kept modulo 2**16.  For
the latter each occurrence of a passage is an element of its own, numbered
from 1, so the mean square of their difference estimates how many occurrences
two texts don't share, hence the likeness.  To insert or delete a passage one
has to know how often the rest of the text holds it.

Paragraphs end at a line break.  Long ones are cut further into passages after
words chosen by their own hash (one in eight), so that an edit disturbs only
the passages it touches.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches, partitions, small_batches

#: Lanes of 16-bit values and of signs, in bytes of a passage's hash.
VALUES, SIGNS = 32, 512
WIDTH = 2 * VALUES + SIGNS // 8
NO_ID = -(1 << 63)


def passages(text: str) -> list[bytes]:
    """The passages of a text; joined they give the text back."""
    out = []
    lines = text.split("\n")
    for paragraph in [*(x + "\n" for x in lines[:-1]), lines[-1]]:
        if not paragraph:
            continue
        words = paragraph.encode("utf-8", "surrogatepass").split(b" ")
        at = 0
        for k in range(len(words) - 1):
            if not zlib.crc32(words[k]) & 7:
                out.append(b" ".join(words[at : k + 1]) + b" ")
                at = k + 1
        out.append(b" ".join(words[at:]))
    return out


def occurrence(passage: bytes, j: int) -> bytes:
    """The hash whose bits are the signs of the j-th occurrence of a passage, from the second on."""
    return hashlib.shake_256(j.to_bytes(8, "little") + passage).digest(SIGNS // 8)


class Fingerprint:
    """The sum of the vectors of some passages, and their number.

    ``rest`` says how often each passage stands in the text that these are
    added to or taken from, so their occurrences are numbered after those.
    """

    __slots__ = ("number", "signs", "values")

    def __init__(self, parts: list[bytes] = (), rest: Counter | None = None):
        self.number = len(parts)
        if parts:
            raw = np.frombuffer(b"".join([hashlib.shake_128(x).digest(WIDTH) for x in parts]), np.uint8).reshape(-1, WIDTH)
            self.values = np.ascontiguousarray(raw[:, : 2 * VALUES]).view(np.uint16).sum(axis=0, dtype=np.uint16)
            signs = raw[:, 2 * VALUES :]
            seen: dict[bytes, int] = dict(rest or ())
            again = []
            for i, x in enumerate(parts):
                seen[x] = j = seen.get(x, 0) + 1
                if j > 1:
                    again.append((i, occurrence(x, j)))
            if again:
                signs = signs.copy()
                signs[[i for i, _ in again]] = np.frombuffer(b"".join([x for _, x in again]), np.uint8).reshape(-1, SIGNS // 8)
            ones = np.unpackbits(signs, axis=1).sum(axis=0, dtype=np.int64)
            self.signs = (2 * ones - len(parts)).astype(np.uint16)
        else:
            self.values, self.signs = np.zeros(VALUES, np.uint16), np.zeros(SIGNS, np.uint16)

    def _with(self, other: Fingerprint, sign: int) -> Fingerprint:
        out = Fingerprint()
        out.number = self.number + sign * other.number
        out.values = self.values + other.values if sign > 0 else self.values - other.values
        out.signs = self.signs + other.signs if sign > 0 else self.signs - other.signs
        return out

    def __add__(self, other: Fingerprint) -> Fingerprint:
        """Insertion of the other's passages; those that self holds too must be counted in the other's ``rest``."""
        return self._with(other, 1)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        """Deletion of the other's passages; those that remain in self must be counted in the other's ``rest``."""
        return self._with(other, -1)

    def __str__(self) -> str:
        raw = np.array([self.number], np.uint32).tobytes() + self.values.tobytes()
        low_and_high = np.ascontiguousarray(self.signs.view(np.uint8).reshape(-1, 2).T)  # the high bytes are nearly alike
        return base64.b64encode(raw + zlib.compress(low_and_high.tobytes(), 1)).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw, out = base64.b64decode(text), cls()
        out.number = int(np.frombuffer(raw[:4], np.uint32)[0])
        out.values = np.frombuffer(raw[4 : 4 + 2 * VALUES], np.uint16)
        low_and_high = np.frombuffer(zlib.decompress(raw[4 + 2 * VALUES :]), np.uint8).reshape(2, -1)
        out.signs = np.ascontiguousarray(low_and_high.T).view(np.uint16).ravel()
        return out

    def likeness(self, other: Fingerprint) -> float:
        """About the share of passages in common, 0 to 1; 1 for equal fingerprints."""
        if self.number == other.number and (self.values == other.values).all() and (self.signs == other.signs).all():
            return 1.0
        apart = (self.signs - other.signs).view(np.int16).astype(np.float64)
        return float(min(1.0, max(0.0, 1.0 - (apart @ apart) / SIGNS / max(1, self.number + other.number))))


def with_tail(text: str, parts: list[bytes], own: Fingerprint, following: str) -> tuple[str, Fingerprint]:
    """The text with its last quarter replaced by the beginning of another, and its fingerprint.

    ``parts`` are the text's passages and ``own`` is their fingerprint.  Only
    from the paragraph of the cut on are passages taken out and put in.
    """
    quarter = len(text) // 4
    cut = len(text) - quarter
    edited = text[:cut] + following[:quarter]
    start = text.rfind("\n", 0, cut) + 1
    before, after = passages(text[start:]), passages(edited[start:])
    same = 0
    while same < min(len(before), len(after)) and before[same] == after[same]:
        same += 1
    changed = {*before[same:], *after[same:]}
    rest = Counter(filter(changed.__contains__, parts[: len(parts) - len(before) + same]))
    return edited, own - Fingerprint(before[same:], rest) + Fingerprint(after[same:], rest)


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (part, guest, doc_id, text), parts and rows within them in the order of doc_id.

    Parts hold ranges of doc_id.  The first document of each part is also the
    last row (``guest``) of the part before it, and that of the first part of
    the last, so whoever reads a part sees each document's successor.  Texts
    are shuffled once.  The range limits and the parts' smallest ids are as
    many as the parts, so they may pass through the driver.
    """
    spark = docs.sparkSession
    number = 2 * partitions(spark)
    narrow = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = narrow.agg(F.percentile_approx("doc_id", [i / number for i in range(1, number)], F.lit(10000))).first()[0]
    limits = sorted(set(found or []))
    bounds = np.array(limits, np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="left").astype(np.int32))

    firsts = sorted((int(i), int(p)) for p, i in narrow.select("doc_id").withColumn("part", part("doc_id")).groupBy("part").agg(F.min("doc_id")).collect())
    before = {i: firsts[k - 1][1] for k, (i, _) in enumerate(firsts)}

    @F.pandas_udf("array<struct<part:int,guest:boolean>>")
    def seats(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(np.int64), side="left")
        return pd.Series([[{"part": int(p), "guest": False}] + ([{"part": before[i], "guest": True}] if i in before else []) for i, p in zip(ids.tolist(), own.tolist(), strict=True)])

    dealt = narrow.select(F.explode(seats("doc_id")).alias("seat"), "doc_id", "text").select("seat.part", "seat.guest", "doc_id", "text")
    return dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "guest", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the beginning of the next document.

    Rows (doc_id long, n_chars long, edited_sha256, fingerprint,
    edited_fingerprint string, near_edited, near_next double), one for each
    row.  The next document is the one that follows in the order of doc_id,
    then of text; after the last comes the first; a table of one row follows
    itself.  Rows that share a doc_id follow each other by their text, equal
    rows in any order.  Null texts are empty and texts of any length are taken
    whole; a null doc_id comes before all others (-2**63 counts as null).
    Other columns are ignored, and an empty table gives no rows.
    """

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches(rows):
            out: list[tuple] = []
            for _, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None and guest:
                    continue  # a further row with the successor's doc_id
                parts = passages(text)
                own = Fingerprint(parts)
                if held is not None:
                    last, said, pieces, mark = held
                    edited, other = with_tail(said, pieces, mark, text)
                    out.append((None if last == NO_ID else last, len(said), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(mark), str(other), mark.likeness(other), mark.likeness(own)))
                held = None if guest else (doc, text, parts, own)
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return neighbours(docs).mapInArrow(made, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
