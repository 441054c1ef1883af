"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

A word's symbols form a doubly linked list.  A priority queue holds the
possible merges as (rank, position); the lowest rank, leftmost first, is
applied and the pairs with the new neighbours are queued.  Entries whose pair
has changed since are stale and skipped when they surface.  Decoding
concatenates vocabulary strings.

The file's pipeline is read from its JSON: normalisation (NFC, white space
squeezed, lower case), the splitting pattern, the byte alphabet and the mark
that ends a word.  Only what such a file can ask for is supported; anything
else raises ``ValueError`` instead of giving other ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches, small_batches

#: Distinct stretches between blanks that a worker remembers in each of two generations; it bounds memory, not results.
REMEMBERED = 1 << 18
#: Below this character the two regex engines agree on letters and digits; others are split by the tokenizers library itself.
AGREED = "\u0530"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it's printable Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(plain))
    return table


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, spec: dict):
        self.content = json.dumps(spec)  # for the library, where it's needed
        model = spec["model"]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE model")
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
            raise ValueError("another normaliser or splitter than supported")
        if pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"] or spec["decoder"]:
            raise ValueError("another splitting or decoding than supported")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocabulary | self.special).items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocabulary
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.alphabet = byte_alphabet()
        self.symbol = [ids[self.alphabet[b]] for b in range(256)]
        self.final = [ids[self.alphabet[b] + (model["end_of_word_suffix"] or "")] for b in range(256)]
        squeeze = spec["normalizer"]["normalizers"][1]
        if squeeze["pattern"] != {"Regex": r"\s+"} or squeeze["content"] != " ":
            raise ValueError("another normaliser than supported")  # white space only parts pieces, so it needn't be squeezed
        self.pieces = regex.compile(pre[0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word, by the priority queue over the linked list of its symbols."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.symbol[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n, rank_of = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []  # rank << 32 | position: the lowest rank first, then the leftmost
        for i in range(n - 1):
            if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or rank_of(ids[i] << 32 | ids[j]) != entry >> 32:
                continue  # stale: a neighbour or the symbol itself has been merged since
            ids[i] = made = self.made[entry >> 32]
            ids[j] = -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (rank := rank_of(made << 32 | ids[k])) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] << 32 | made)) is not None:
                heappush(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def split(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch without blanks; pieces never cross white space, so stretches don't influence each other."""
        if max(stretch) < AGREED:
            plain = unicodedata.normalize("NFC", stretch)
            found = self.pieces.findall(plain.replace("Σ", "σ").lower())  # sigma has no final form here
        else:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.content)
                self.bytes = {c: b for b, c in self.alphabet.items()}
            plain = self.library.normalizer.normalize_str(stretch)
            found = [bytes(map(self.bytes.__getitem__, x)).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return tuple([i for x in found for i in self.merge(x)])

    def recall(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch, remembered."""
        found = self.old.get(stretch)
        if found is None:
            found = self.split(stretch)
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[stretch] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                ids.append(self.special[part])
                continue
            for stretch in part.replace("\n", " ").split(" "):
                if stretch:
                    found = self.young.get(stretch)
                    ids += self.recall(stretch) if found is None else found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after the other, with a blank between, as the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def load(content: str) -> WordBpe:
    return WordBpe(json.loads(content))


def bpe(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, ids array<int>, decoded string) for each row of ``docs``.

    ``path`` is the vocabulary file on the driver; its content (some MB, a
    property of the tokenizer, not of the data) travels as a broadcast.  A null
    or empty text has no ids and decodes to the empty text; a text of any length
    is encoded whole.  Rows don't influence each other: repeated rows and null
    keys come out as they went in.  Of equal ranks the leftmost pair merges
    first.  Stretches with characters from U+0530 on are normalised and split by
    the tokenizers library, whose regex engine knows other letters; merging and
    decoding are done here for all.  An empty table gives no rows.
    """
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    narrow = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.schema([("doc_id", _arrow(narrow)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(content.value)
        for batch in batches(rows):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                every = [model.encode(x or "") for x in part.column(1).to_pylist()]
                said = [model.decode(x) for x in every]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(every, pa.list_(pa.int32())), pa.array(said, pa.string())], schema=kind)
        model.young, model.old = {}, {}  # a worker waits for its next task without them

    name = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(encode, f"doc_id {name}, ids array<int>, decoded string").withColumnRenamed("doc_id", key)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)
