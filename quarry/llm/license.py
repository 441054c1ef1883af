"""License scans by an exact set-similarity join.

Text blocks are joined with license templates on containment: a block meets a
template if it holds at least ``threshold`` of the template's distinct words.
Blocks are the lines and, for notices wrapped over lines, all windows of
consecutive words of :data:`SLACK` times the template's length, at every place
of the text.  The join filters before it verifies:

* prefix: with the templates' words in the order of their frequency over all
  documents, a block that meets the threshold holds one of a template's first
  ``|T| - need + 1`` words, so only the blocks under those words are looked at;
* length: a block with fewer such words than needed can't meet it;
* position: with the rarest shared word at position p of the template and b of
  the block, both in that order, at most ``min(|T| - p, |B| - b)`` words can be
  common; words of no template count in neither.

The filters drop nothing that meets the threshold.  Besides, the places of
fixed phrases are counted over the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import batches, small_batches, utf8

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels and notices whose words a block must contain.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under the creative commons attribution sharealike license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
THRESHOLD = 0.8
#: Words of a window against those of the template.
SLACK = 1.5
#: Maps a text's bytes so that all but word characters become blanks, A-Z lower case; line breaks stay apart.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def need(size: int, threshold: float) -> int:
    """Words of a template of ``size`` distinct words that a block must hold."""
    return max(1, -(-round(threshold * size * 10**9) // 10**9))


class Scanner:
    """Prefix index over the templates, with their words in the order of frequency."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.templates = []
        self.windows: list[int] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        folded = {label: text.encode().translate(FOLD).split() for label, text in sorted(templates.items())}
        every = sorted({w for text in folded.values() for w in text}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        for label, text in folded.items():
            order = sorted(set(text), key=self.rank.__getitem__)
            least = need(len(order), threshold)
            self.templates.append((label, order, set(order), least))
            self.windows.append(math.ceil(SLACK * len(text)))
            for p, word in enumerate(order[: len(order) - least + 1]):
                self.prefix.setdefault(word, []).append((len(self.templates) - 1, p))

    def candidates(self, words: set[bytes]) -> list[int]:
        """The templates that the filters leave for a block's distinct words."""
        order = sorted(words & self.rank.keys(), key=self.rank.__getitem__)
        seen: set[int] = set()
        out = []
        for b, word in enumerate(order):
            for t, p in self.prefix.get(word, ()):
                if t not in seen:  # the rarest word that both have
                    seen.add(t)
                    size, least = len(self.templates[t][1]), self.templates[t][3]
                    if len(order) >= least and min(size - p, len(order) - b) >= least:
                        out.append(t)
        return out

    def block(self, words: set[bytes]) -> list[tuple[str, float]]:
        """Templates that a block's distinct words meet, with their containment."""
        out = []
        for t in self.candidates(words):
            label, order, every, least = self.templates[t]
            if (common := len(every & words)) >= least:
                out.append((label, common / len(order)))
        return out

    def across(self, words: list[bytes], line: list[int]) -> list[tuple[int, str, float]]:
        """Blocks over several lines (line of the first word, label, containment); ``line`` has each word's line.

        Overlapping windows of one template are one block, with the largest
        containment.  A window within a line holds no more than the line.
        """
        out = []
        own = set(words)
        for t in sorted(self.candidates(own)):
            label, order, every, least = self.templates[t]
            held: Counter = Counter()
            places_ = [i for i, word in enumerate(words) if word in every]
            left, end, best = 0, -1, None
            for i in places_:
                held[words[i]] += 1
                while places_[left] <= i - self.windows[t]:
                    held[words[places_[left]]] -= 1
                    if not held[words[places_[left]]]:
                        del held[words[places_[left]]]
                    left += 1
                first = places_[left]
                if len(held) < least or line[first] == line[i]:
                    continue
                if best and first > end:
                    out.append(best)
                    best = None
                if not best or len(held) / len(order) > best[2]:
                    best = (line[first], label, len(held) / len(order))
                end = i
            if best:
                out.append(best)
        return out


def places(folded: bytes, phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """Starts, as word numbers, of all places of the phrases, overlapping ones too."""
    line = b" " + b" ".join(folded.split()) + b" "
    out = []
    for phrase, label in phrases.items():
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(b" " + phrase + b" ", at + 1)
    return out


def word_frequency(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; as many rows as the templates have words."""
    wanted = sorted({w for t in templates.values() for w in t.encode().translate(FOLD).split()})

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        table = frozenset(wanted)
        for batch in batches(rows):
            for text in utf8(batch.column(0)):
                if text:
                    total.update(filter(table.__contains__, text.translate(FOLD).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(x["word"]): x["n"] for x in found}


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks), one for each row.

    ``blocks`` lists the blocks found as (number from 0 of the first line, label,
    containment), those over several lines last; ``score`` is the largest containment, 1 where a phrase
    occurs.  A null or empty text has no words, no labels and score 0; a text
    of any length is taken whole.  Of windows of one template that overlap, the
    first of those with the largest containment stands for all.
    ``first_word`` and ``last_word`` are null without a phrase.  Repeated rows
    and null keys come out as they went in, other columns are ignored, and an
    empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    table = {k.encode(): v for k, v in (PHRASES if phrases is None else phrases).items()}
    frequency = word_frequency(small_batches(docs), templates)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    name = narrow.schema["doc_id"].dataType
    block = pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))
    kind = pa.schema([("doc_id", to_arrow_type(name)), *((x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", block)])

    def scanned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, frequency, threshold)
        rare = scanner.prefix.keys()
        for batch in batches(rows):
            out = []
            for text in utf8(batch.column(1)):
                folded = (text or b"").translate(FOLD)
                words = folded.split()
                found, base = [], []
                if not rare.isdisjoint(words):
                    of: list[int] = []
                    for k, line in enumerate(folded.split(b"\n")):
                        own = line.split()
                        of += [k] * len(own)
                        if not rare.isdisjoint(own):
                            found += [(k, label, share) for label, share in scanner.block(set(own))]
                    found += scanner.across(words, of)
                if any(p.split(b" ", 1)[0] in folded for p in table):
                    base = places(folded, table)
                starts, own = [x for x, _ in base], {x for _, x in base}
                score = 1.0 if base else max((x[2] for x in found), default=0.0)
                out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[1] for x in found})), score, [dict(zip(("line", "label", "containment"), x, strict=True)) for x in found]))
            columns = [pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), list(kind)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=kind)

    return narrow.mapInArrow(scanned, f"doc_id {name.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:int,label:string,containment:double>>")
