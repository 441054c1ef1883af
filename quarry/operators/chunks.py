"""Chunking: fixed windows, the recursive splitter, pages and identities."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ids import draft_chunk_id
from quarry.functions.text import image_refs
from quarry.operators.frames import numbered

#: Separators, each tried before the next.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")


def windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, chunk_index, start_offset, end_offset, text): windows of ``size`` characters, the last one shorter."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
    each = docs.where(n > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return each.select(key, "chunk_index", start.alias("start_offset"), F.least(start + size, n).alias("end_offset"), F.substring(F.col(text), start + 1, F.lit(size)).alias("text"))


def split_recursively(text: str, size: int, overlap: int, length: Callable[[str], int] = len) -> list[tuple[int, int]]:
    """Spans (start, end) of chunks of at most ``size``, cut at the best separator, sharing up to ``overlap``.

    Separators stay at the end of the part before them.  Parts of a chunk too
    long are cut by the next separator; the last one cuts anywhere.
    """

    def parts(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if length(text[a:b]) <= size or level >= len(SEPARATORS):
            yield a, b
            return
        mark = SEPARATORS[level]
        if not mark:
            at = a
            while at < b:
                end = min(b, at + max(1, size))
                while end > at + 1 and length(text[at:end]) > size:
                    end -= 1
                yield at, end
                at = end
            return
        at = a
        while at < b:
            found = text.find(mark, at, b)
            end = b if found < 0 else found + len(mark)
            yield from parts(at, end, level + 1)
            at = end

    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for a, b in parts(0, len(text), 0):
        if held and length(text[held[0][0] : b]) > size:
            out.append((held[0][0], held[-1][1]))
            while held and (length(text[held[0][0] : held[-1][1]]) > overlap or length(text[held[0][0] : b]) > size):
                held.pop(0)
        held.append((a, b))
    if held:
        out.append((held[0][0], held[-1][1]))
    spans = []
    for a, b in out:
        body = text[a:b]
        a, b = a + len(body) - len(body.lstrip()), b - (len(body) - len(body.rstrip()))
        if a < b:
            spans.append((a, b))
    return spans


def recursive(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, chunk_index, start_offset, end_offset, text) by the recursive splitter; a chunk is the text at its offsets."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    kind = docs.schema[key].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(frame[key], frame[text], strict=True) if t for i, (a, b) in enumerate(split_recursively(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "start_offset", "end_offset", "text"])

    return docs.select(key, text).mapInPandas(cut, f"{key} {kind}, chunk_index int, start_offset int, end_offset int, text string")


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, page, text): parts between form feeds, a blank last one left out."""
    each = docs.select(key, F.split(text, "\f", -1).alias("p"))
    whole = F.when(F.trim(F.element_at("p", -1)) == "", F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p"))
    return each.select(key, F.posexplode(whole).alias("i", "text")).select(key, (F.col("i") + 1).alias("page"), "text")


def page_offsets(paged: DataFrame, key: str = "doc_id", joint: int = 2) -> DataFrame:
    """Rows (key, page, start_offset, end_offset) in the text that joins the pages by ``joint`` characters."""
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + joint).over(before), F.lit(0))
    return paged.select(key, "page", start.alias("start_offset"), (start + F.length("text")).alias("end_offset"))


def page_range(start: Column, end: Column, spans: Column) -> Column:
    """Struct (page_start, page_end, page_num) of the pages that a chunk's offsets touch; page_num if it's one."""
    hit = F.transform(F.filter(spans, lambda s: (start < s["end_offset"]) & (end > s["start_offset"])), lambda s: s["page"])
    low, high = F.array_min(hit), F.array_max(hit)
    return F.struct(low.alias("page_start"), high.alias("page_end"), F.when(low == high, low).alias("page_num"))


def located(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """Spans of pieces in a text, each found after the start of the one before: as it is, else with white space compared as single blanks.

    A piece that isn't there is a ``ValueError``.
    """
    flat, places = [], []
    for i, c in enumerate(text):
        if not c.isspace():
            flat.append(c)
            places.append(i)
        elif not flat or flat[-1] != " ":
            flat.append(" ")
            places.append(i)
    squeezed, out, before = "".join(flat), [], -1
    for piece in pieces:
        start = text.find(piece, before + 1)
        end = start + len(piece)
        if start < 0:
            wanted = " ".join(piece.split())
            at = squeezed.find(wanted, bisect_right(places, before)) if wanted else -1
            if at < 0:
                raise ValueError(f"a piece isn't in the text after character {before}: {piece[:60]!r}")
            start, end = places[at], places[at + len(wanted) - 1] + 1
        out.append((start, end))
        before = start
    return out


def locate(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, chunk_index, start_offset, end_offset) of documents' pieces (key, text, pieces array), in their order."""
    kind = docs.schema[key].dataType.simpleString()

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, a, b) for k, t, p in zip(frame[key], frame["text"], frame["pieces"], strict=True) for i, (a, b) in enumerate(located(t or "", list(p) if p is not None else []))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "start_offset", "end_offset"])

    return docs.select(key, "text", "pieces").mapInPandas(found, f"{key} {kind}, chunk_index int, start_offset int, end_offset int")


def materialised(cut: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks as records: ids, offsets, text and metadata, which a chunk inherits from its document.

    documents (key, metadata map, page_spans, images array of (id, path, page))
    has one row a document.  A chunk's images are those its placeholders name;
    its pages are those its offsets touch, else those of its images.
    """
    joined = cut.join(documents.select(key, "metadata", "page_spans", "images"), key)
    refs = image_refs(F.col("text"))
    named = F.filter(F.transform(refs, lambda r: F.get(F.filter("images", lambda x: x["id"] == r), 0)), lambda x: x.isNotNull())
    none = F.array().cast("array<int>")
    touched = F.coalesce(F.transform(F.filter("page_spans", lambda s: (F.col("start_offset") < s["end_offset"]) & (F.col("end_offset") > s["start_offset"])), lambda s: s["page"].cast("int")), none)
    pictured = F.coalesce(F.array_compact(F.transform(named, lambda x: x["page"].cast("int"))), none)
    pages = F.when(F.size(touched) > 0, touched).otherwise(pictured)
    low, high = F.array_min(pages), F.array_max(pages)
    own = F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ("chunk_index", "source_ref", "start_offset", "end_offset", "page_start", "page_end", "page_num"))),
            F.array(F.col("chunk_index").cast("string"), F.col(key).cast("string"), F.col("start_offset").cast("string"), F.col("end_offset").cast("string"), low.cast("string"), high.cast("string"), F.when(low == high, low).cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    inherited = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("images", "page_spans") & ~F.map_contains_key(own, k))
    chunk_id = draft_chunk_id(F.col(key).cast("string"), F.col("chunk_index"), F.col("text"))
    return joined.select(key, "chunk_index", chunk_id.alias("chunk_id"), "start_offset", "end_offset", "text", F.map_concat(inherited, own).alias("metadata"), refs.alias("image_refs"), named.alias("images"))


def batched(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with ``batch`` from 0: the number of the batch of ``size`` rows that each falls into, in an order."""
    if size < 1:
        raise ValueError("a batch has one row or more")
    return numbered(rows, *order).withColumn("batch", F.floor(F.col("position") / size).cast("long")).drop("position")


def batch_count(rows: Column, size: int) -> Column:
    return F.ceil(rows / size).cast("long")
