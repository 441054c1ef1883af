"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trigram model over words and one end token a text; two end
tokens stand before each text.  With counts c over the training texts, N tokens
in all and a vocabulary of their words and one unknown word::

    p(w | u v) = (c(u v w) + K c(v w) + K M p(w)) / (c(u v) + K c(v) + K M)
    p(w) = c(w) / (N + 1),   p(unknown) = 1 / (N + 1)

so each order is interpolated with the next lower one, and the masses of a
context sum to one.  The numerator needs only n-grams that end with w and the
denominator only those that end with v, so logarithms make a text's score a sum
of terms that different parts of the model know by themselves.

Parts are dealt out by the last word, and none is gathered or broadcast.  A
word that would fill a good share of a part is spread over ``FANOUT`` parts by
the residue of the word before it.  A first pass over all texts gives N and the
words to spread, a few for each part at most.

1. Batches of texts become blocks.  A block sends each n-gram it has once, with
   the documents that hold it, to the part of its last word, and how often it
   has each spread word to all parts of that word.
2. A part counts its n-grams and builds its trie, last word first: the level of
   words, of the words before them, and of the words before those.  A level is
   an Elias-Fano sequence of the ids of each node's children, with monotone
   pointers to the next level and smoothed log masses quantised to 16 bits, all
   in memory-mapped files.  A child is found by successor search among its
   parent's children only.  The part asks for each distinct n-gram once and
   adds the answers up for the documents.
3. Each block's sums meet in one place.

Only packed arrays travel.  A part's n-grams must fit the memory of a task, so
the shuffle partitions have to grow with the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches, crc_mod, cut, partitions, runs_of, small_batches, utf8, words
from quarry.llm.eliasfano import EliasFano, mapped

U = np.uint64
#: The end token; it has a blank, so it's no word.
END = b" end"
#: What a count of a pair and of a word weighs against one of a trigram: K, and K times M.
PAIR, WORD = 0.002, 2.0
#: Parts among which the n-grams that end with one frequent word are dealt.
FANOUT = 16
#: Width of the words' hashes, so that they fit an Elias-Fano sequence.
KEY = 63
#: Tokens of a block (a longer text is a block of its own), and documents of a block, so that 15 bits number them.
TOKENS, BLOCK = 1 << 22, 1 << 15
TRAIN = 0x8000
#: Bits of a number that says word, words before and document at once.
WIDTH = 64
#: Kinds of rows.
DOCS, GRAMS, WIDE, SUMS, TOTALS = range(5)
ROW = "kind int, dest int, block long, payload binary"


def hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


END_KEY = hashed(END)


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else U)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays in one string of bytes."""
    head = np.array([(ord(a.dtype.char), len(a)) for a in arrays], np.int64)
    return bytes([len(arrays)]) + head.tobytes() + b"".join(a.tobytes() for a in arrays)


def undump(raw: bytes) -> list[np.ndarray]:
    n = raw[0]
    head = np.frombuffer(raw, np.int64, 2 * n, 1).reshape(n, 2)
    out, at = [], 1 + 16 * n
    for code, size in head.tolist():
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def spread(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of a key, from all its bits."""
    mixed = key * U(0x9E3779B97F4A7C15)
    return (((mixed ^ (mixed >> U(29))) >> U(16)) % U(parts)).astype(np.int64)


def seats(parts: int) -> np.ndarray:
    """For each part a whole number that Spark's hash partitioning puts into the partition of that number.

    So each part has a task of its own instead of some tasks having several
    parts and others none.  The hash is the public Murmur3 of one 32-bit word
    with Spark's seed.
    """
    out, left, at = np.full(parts, -1, np.int64), parts, 0

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return (x << U(r) | x >> U(32 - r)) & U(0xFFFFFFFF)

    while left:
        tried = np.arange(at, at + 4 * parts + 64, dtype=U)
        k = turned(tried * U(0xCC9E2D51) & U(0xFFFFFFFF), 15) * U(0x1B873593) & U(0xFFFFFFFF)
        h = (turned(k ^ U(42), 13) * U(5) + U(0xE6546B64)) & U(0xFFFFFFFF)
        h ^= U(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> U(shift)) * U(factor) & U(0xFFFFFFFF)
        h ^= h >> U(16)
        part = h.astype(np.uint32).view(np.int32).astype(np.int64) % parts
        where, first = np.unique(part, return_index=True)
        new = out[where] < 0
        out[where[new]] = tried[first[new]].astype(np.int64)
        left, at = int((out < 0).sum()), at + len(tried)
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    for a in keys:
        change[1:] |= a[1:] != a[:-1]
    change[0] = True
    return np.append(np.nonzero(change)[0], n)


def grouped(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the positions it has, in their order."""
    order = np.argsort(part, kind="stable")
    at = runs(part[order])
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(part[order[a]]), order[a:b]


def pick(lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions of the items of the chosen groups, where groups of the given lengths follow each other."""
    ends = np.cumsum(lengths)
    sizes = lengths[chosen]
    first = ends[chosen] - sizes
    if not sizes.sum():
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


class Block:
    """The trigrams of some texts, by the ranks of the words' hashes, last word first."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {END: 0}
        self.texts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, found: list[bytes]) -> None:
        """One more text, as its words."""
        number = self.number
        take = number.setdefault
        self.texts.append(np.fromiter((take(w, len(number)) for w in found), np.uint32, len(found)))
        self.tokens += len(found) + 1

    def close(self) -> None:
        """Ranks instead of numbers, once all texts are there."""
        self.sizes = np.array([len(x) + 1 for x in self.texts], np.int64)
        hashes = np.fromiter(map(hashed, self.number), U, len(self.number))
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        end = rank[:1]
        self.w = np.concatenate([x for own in self.texts for x in (rank[own], end)])
        self.v = np.concatenate((end, self.w[:-1]))  # the end token of the text before stands before each first word
        self.u = np.concatenate((end, self.v[:-1]))
        self.u[np.cumsum(self.sizes) - self.sizes] = end[0]
        self.doc = np.repeat(np.arange(len(self.texts), dtype=np.uint16), self.sizes)
        self.number, self.texts = {}, []

    def grams(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct trigrams with their documents among chosen tokens: ranks used, then last words, words before, words before those (as positions in these ranks), documents and counts, sorted."""
        w, v, u, doc = (x[chosen] for x in (self.w, self.v, self.u, self.doc))
        if 12 * len(chosen) < len(self.hashes):
            used = np.unique(np.concatenate((w, v, u)))
            a, b, c = (np.searchsorted(used, x).astype(U) for x in (w, v, u))
        else:
            there = np.zeros(len(self.hashes), bool)
            there[w] = there[v] = there[u] = True
            used, new = np.nonzero(there)[0], np.cumsum(there, dtype=np.int64).astype(U) - U(1)
            a, b, c = new[w], new[v], new[u]
        bits, low = (len(used) - 1).bit_length(), (len(self.sizes) - 1).bit_length()
        mask, last = U((1 << bits) - 1), U((1 << low) - 1)
        if 3 * bits + low <= WIDTH:
            keys, count = np.unique(a << U(2 * bits + low) | b << U(bits + low) | c << U(low) | doc, return_counts=True)
            return used, keys >> U(2 * bits + low), keys >> U(bits + low) & mask, keys >> U(low) & mask, keys & last, count
        if 2 * bits > 64 or len(a).bit_length() + bits + low > 64:
            raise ValueError(f"{len(a)} tokens of a block can't be numbered")
        pairs, place = np.unique(a << U(bits) | b, return_inverse=True)  # very many words
        keys, count = np.unique(place.astype(U) << U(bits + low) | c << U(low) | doc, return_counts=True)
        pair = pairs[(keys >> U(bits + low)).astype(np.int64)]
        return used, pair >> U(bits), pair & mask, keys >> U(low) & mask, keys & last, count

    def rows(self, parts: int, wide: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Rows (kind, part, payload).

        GRAMS: hashes, and positions of them as last words, words before and
        words before those, each with how many children follow, then documents
        and counts.  WIDE: spread words and how often training texts have them.
        ``wide`` are the sorted hashes of the spread words, ``train`` says of
        each document whether it trains, which goes with its number.
        """
        part = spread(self.hashes, parts)[self.w]
        is_wide = np.isin(self.hashes, wide)
        some = np.nonzero(is_wide[self.w])[0]
        word, before = self.hashes[self.w[some]], self.hashes[self.v[some]]
        part[some] = spread(word * U(FANOUT) + before % U(FANOUT), parts)
        for p, chosen in grouped(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)):
            used, a, b, c, doc, count = self.grams(chosen)
            at = runs(a, b, c)
            starts = at[:-1]
            a, b, c = (narrow(x[starts]) for x in (a, b, c))
            first, second = runs(a), runs(a, b)
            doc = (doc.astype(np.int64) | np.where(train[doc.astype(np.int64)], TRAIN, 0)).astype(np.uint16)
            yield GRAMS, p, dump(self.hashes[used], a[first[:-1]], narrow(np.diff(np.searchsorted(second, first))), b[second[:-1]], narrow(np.diff(second)), c, narrow(np.diff(at)), doc, narrow(count))
        own = np.nonzero(is_wide)[0]
        count = np.bincount(self.w[some], train[self.doc[some]], len(self.hashes))[own].astype(np.int64)
        every = spread((self.hashes[own][:, None] * U(FANOUT) + np.arange(FANOUT, dtype=U)).ravel(), parts)
        for p, chosen in grouped(every):
            chosen = np.unique(chosen // FANOUT)  # two residues of a word may share a part
            yield WIDE, p, dump(self.hashes[own][chosen], count[chosen])


class Masses:
    """Logarithms quantised to 16 bits."""

    def __init__(self, values: np.ndarray):
        self.floor = float(values.min()) if len(values) else 0.0
        self.step = ((float(values.max()) - self.floor) / 65535 if len(values) else 0.0) or 1.0
        self.codes = mapped(np.rint((values - self.floor) / self.step).astype(np.uint16))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.floor + self.step * self.codes[at]


class Level:
    """A level of the trie: each parent's children, by their ids."""

    def __init__(self, parent: np.ndarray, child: np.ndarray, parents: int, size: int):
        """Sorted by parent, then child; ``size`` is the number of ids."""
        self.size = U(size)
        if max(1, parents) * size >= 1 << 63:
            raise ValueError("a part has too many n-grams; use more shuffle partitions")
        self.keys = EliasFano(parent.astype(U) * self.size + child.astype(U), max(1, parents) * size, mapped)
        self.pointers = EliasFano(np.searchsorted(parent, np.arange(parents + 1)).astype(U), len(child) + 1, mapped)

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Positions of children, -1 where there is none (or no parent)."""
        out = np.full(len(parent), -1, np.int64)
        ask = np.nonzero((parent >= 0) & (child >= 0))[0]
        if len(ask):
            place, exact = self.keys.successor(parent[ask].astype(U) * self.size + child[ask].astype(U))
            exact &= place < self.pointers[parent[ask] + 1].astype(np.int64)
            out[ask[exact]] = place[exact]
        return out


class Trie:
    """The model's part: words, the words before them and those before these, with their smoothed masses."""

    def __init__(self, hashes: np.ndarray, w: np.ndarray, c1: np.ndarray, first: np.ndarray, v: np.ndarray, c2: np.ndarray, second: np.ndarray, u: np.ndarray, c3: np.ndarray, tokens: int):
        """Sorted hashes of all words; words w, pairs (position of w, v) and trigrams (position of the pair, u) with their counts."""
        self.ids = EliasFano(hashes, 1 << KEY, mapped)
        self.words = Level(np.zeros(len(w), np.int64), w, 1, max(1, len(hashes)))
        self.pairs = Level(first, v, len(w), max(1, len(hashes)))
        self.trigrams = Level(second, u, len(v), max(1, len(hashes)))
        low = WORD * c1 / (tokens + 1)
        middle = PAIR * c2 + low[first]
        self.up = [Masses(np.log10(x)) for x in (low, middle, c3 + middle[second])]
        self.down = [Masses(np.log10(x)) for x in (PAIR * c1 + WORD, c2 + (PAIR * c1 + WORD)[first])]
        self.unknown = float(np.log10(WORD / (tokens + 1))), float(np.log10(WORD))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 where there is none."""
        at, there = self.ids.successor(hashes)
        return np.where(there, at, -1)

    def upper(self, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """Logarithms of the numerators for positions in the three levels."""
        out = np.full(len(one), self.unknown[0])
        for mass, at in zip(self.up, (one, two, three), strict=True):
            there = at >= 0
            out[there] = mass[at[there]]
        return out

    def lower(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Logarithms of the denominators of the contexts that end with a word and have another before it."""
        out = np.full(len(one), self.unknown[1])
        for mass, at in zip(self.down, (one, two), strict=True):
            there = at >= 0
            out[there] = mass[at[there]]
        return out


class Part:
    """The n-grams of one part, from the rows of all blocks."""

    def __init__(self, raws: list[bytes], wide: list[bytes], tokens: int):
        opened = [undump(x) for x in raws]
        spread_words = [undump(x)[0] for x in wide]
        hashes = np.unique(np.concatenate([x[0] for x in opened] + spread_words))
        pair_keys, owners, tails, trained = ([np.zeros(0, k)] for k in (U, np.int64, np.int64, np.int64))  # a part may have spread words only
        total = 0
        for dic, w, vs, v, us, u, held, doc, count in opened:
            ids = np.searchsorted(hashes, dic)
            pair_keys.append(np.repeat(ids[w], vs).astype(U) << U(32) | ids[v].astype(U))
            owners.append(np.repeat(np.arange(total, total + len(v)), us))
            total += len(v)
            tails.append(ids[u])
            starts = np.cumsum(held, dtype=np.int64) - held
            trained.append(np.add.reduceat(count.astype(np.int64) * (doc >= TRAIN), starts))
        pairs, place = np.unique(np.concatenate(pair_keys), return_inverse=True)
        grams, self.gram = np.unique(place[np.concatenate(owners)].astype(U) << U(32) | np.concatenate(tails).astype(U), return_inverse=True)
        c3 = np.bincount(self.gram, np.concatenate(trained), len(grams))
        del pair_keys, owners, tails, trained, place
        pair, u = (grams >> U(32)).astype(np.int64), (grams & U(0xFFFFFFFF)).astype(np.int64)
        c2 = np.bincount(pair, c3, len(pairs))
        w, v = (pairs >> U(32)).astype(np.int64), (pairs & U(0xFFFFFFFF)).astype(np.int64)
        c1 = np.bincount(w, c2, len(hashes))
        if wide:
            c1[np.searchsorted(hashes, np.unique(np.concatenate(spread_words)))] = 0  # counted over all their parts instead
        for raw in wide:
            keys, count = undump(raw)
            c1[np.searchsorted(hashes, keys)] += count
        trie = self.trie(hashes, c1, w, v, c2, pair, u, c3, tokens)
        ids = trie.find(hashes)
        one = trie.words.find(np.zeros(len(hashes), np.int64), ids)
        two = trie.pairs.find(one[w], ids[v])
        three = trie.trigrams.find(two[pair], ids[u])
        end = np.searchsorted(hashes, U(END_KEY))
        below = np.where(w == end, 0.0, trie.lower(one[w], two))  # a text's last token is no context
        self.lm = trie.upper(one[w][pair], two[pair], three) - below[pair]
        self.base = np.log10(c1 + 1)[w][pair]
        self.known = (c1 > 0)[w][pair]
        self.trained = hashes[c1 > 0]

    def owned(self, wide: np.ndarray, parts: int, part: int) -> int:
        """How many trained words this part counts, so that each is counted by one part."""
        return int((~np.isin(self.trained, wide) | (spread(self.trained * U(FANOUT), parts) == part)).sum())

    @staticmethod
    def trie(hashes: np.ndarray, c1: np.ndarray, w: np.ndarray, v: np.ndarray, c2: np.ndarray, pair: np.ndarray, u: np.ndarray, c3: np.ndarray, tokens: int) -> Trie:
        """The trie of what training texts hold."""
        keep1, keep2, keep3 = np.nonzero(c1 > 0)[0], np.nonzero(c2 > 0)[0], np.nonzero(c3 > 0)[0]
        used = np.unique(np.concatenate((keep1, v[keep2], u[keep3])))
        new = np.searchsorted(used, np.arange(len(hashes)))
        at1 = np.searchsorted(keep1, w[keep2])
        at2 = np.searchsorted(keep2, pair[keep3])
        return Trie(hashes[used], new[keep1], c1[keep1], at1, new[v[keep2]], c2[keep2], at2, new[u[keep3]], c3[keep3], tokens)

    def sums(self, raws: list[bytes]) -> Iterator[bytes]:
        """For each row that the part was made of, the documents it touches and their sums: lm, base, known."""
        at = 0
        for raw in raws:
            *_, u, held, doc, count = undump(raw)
            gram = np.repeat(self.gram[at : at + len(u)], held)
            at += len(u)
            doc = (doc & (TRAIN - 1)).astype(np.int64)
            touched = np.nonzero(np.bincount(doc))[0]
            each = [np.bincount(doc, x[gram] * count)[touched] for x in (self.lm, self.base, self.known)]
            yield dump(narrow(touched), each[0].astype(np.float32), each[1], narrow(np.rint(each[2]).astype(np.int64)))


def first_pass(rows: DataFrame, parts: int) -> tuple[int, int, list[int]]:
    """Tokens and texts in training, and the hashes of the words to spread.

    A run of batches names the words that make up one in ``4 * parts`` of its
    tokens, so no word with twice that share of all tokens is missed, and those
    that reach that share of all tokens by what runs name are spread.  Which words that
    are decides about places only.
    """

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in runs_of(rows):
            every: Counter = Counter()
            tokens = texts = 0
            for batch in some:
                for text, held in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    own = words(text)
                    every.update(own)
                    if not held:
                        tokens, texts = tokens + len(own) + 1, texts + 1
                every[END] += batch.num_rows
            whole = every.total()
            often = [(hashed(w), n) for w, n in every.items() if n * 4 * parts >= whole]
            columns = zip((None, whole, tokens, texts), *((w, n, 0, 0) for w, n in often), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["word", "n", "tokens", "texts"])

    found = cut(rows.mapInArrow(counted, "word long, n long, tokens long, texts long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "tokens", "texts"))))
    whole = found.where("word IS NULL").first()
    if not whole:
        return 0, 0, []
    often = found.where("word IS NOT NULL").where(F.col("n") * 4 * parts >= whole["n"])
    return whole["tokens"], whole["texts"], [x["word"] for x in often.select("word").collect()]  # 4 for each part at most


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of all texts by a model of those that ``held_out`` leaves for training.

    ``held_out`` is a condition on ``docs`` (null counts as false).  Rows
    (doc_id, held_out, n_tokens, n_known, train_tokens long, base_score, score
    double), one for each row.  A null or empty text is the end token alone;
    texts of any length are taken whole.  Without training texts every token is
    unknown and scores 0 by p = 1.  Repeated rows count as often as they stand
    there, and equal texts score alike; other columns are ignored.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    seat = seats(parts)
    part_of = {int(x): p for p, x in enumerate(seat)}
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    tokens, texts, often = first_pass(rows, parts)
    wide = np.array(sorted(often), U)

    def table(made: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        columns = list(zip(*made, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "dest", "block", "payload"])

    def written(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        """Rows in batches of some MB; the destination is a part."""
        held, size = [], 0
        for kind, part, block, raw in rows:
            held.append((kind, int(seat[part]), block, raw))
            size += len(raw)
            if size > 1 << 22 or len(held) >= 4096:
                yield table(held)
                held, size = [], 0
        yield table(held)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(block: Block, ids: list[int | None], held: list[bool]) -> Iterator[tuple[int, int, int, bytes]]:
            block.close()
            known = np.array([x is not None for x in ids], np.uint8)
            keys, out = np.array([x or 0 for x in ids], np.int64), np.array(held, bool)
            name = xxhash.xxh3_64_intdigest(dump(keys, known, out, block.sizes, block.hashes)) >> 1
            yield DOCS, name % parts, name, dump(keys, known, out.astype(np.uint8), block.sizes)
            yield from ((kind, p, name, raw) for kind, p, raw in block.rows(parts, wide, ~out))

        def each() -> Iterator[tuple[int, int, int, bytes]]:
            block, ids, held = Block(), [], []
            for batch in batches(rows):
                for i, text, out in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    own = words(text)
                    if ids and (block.tokens + len(own) + 1 > TOKENS or len(ids) == BLOCK):
                        yield from sent(block, ids, held)
                        block, ids, held = Block(), [], []
                    block.add(own)
                    ids.append(i)
                    held.append(out)
            if ids:
                yield from sent(block, ids, held)

        return written(each())

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, int, bytes]]:
            found: dict[int, tuple[list[int], list[bytes], list[bytes]]] = {}  # by seat: this task's parts
            for batch in batches(rows):
                for kind, dest, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == DOCS:
                        yield kind, block % parts, block, raw
                        continue
                    own = found.setdefault(dest, ([], [], []))
                    if kind == GRAMS:
                        own[0].append(block)
                        own[1].append(raw)
                    else:
                        own[2].append(raw)
            for dest in list(found):
                blocks, raws, spread_words = found.pop(dest)
                part = Part(raws, spread_words, tokens)
                yield TOTALS, 0, 0, dump(np.array([part.owned(wide, parts, part_of[dest])], np.int64))
                for block, sums in zip(blocks, part.sums(raws), strict=True):
                    yield SUMS, block % parts, block, sums

        return written(each())

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, list[bytes]] = {}
        totals: dict[int, np.ndarray] = {}
        vocabulary = 0
        for batch in batches(rows):
            for kind, _, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == DOCS:
                    heads.setdefault(block, []).append(raw)
                    continue
                if kind == TOTALS:
                    vocabulary += int(undump(raw)[0][0])
                    continue
                touched, *each = undump(raw)
                touched = touched.astype(np.int64)
                total = totals.get(block)
                if total is None or total.shape[1] <= touched[-1]:
                    wider = np.zeros((3, int(touched[-1]) + 1))
                    if total is not None:
                        wider[:, : total.shape[1]] = total
                    total = totals[block] = wider
                for row, value in zip(total, each, strict=True):
                    row[touched] += value
        for block, same in heads.items():
            ids, known, held, sizes = undump(same[0])
            lm, base, seen = totals.pop(block) / len(same)  # blocks of one name hold equal rows, so their sums are equal parts of the total
            for _ in same:
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(held.astype(bool)), pa.array(sizes), pa.array(np.rint(seen).astype(np.int64)), pa.array(base), pa.array(lm), pa.nulls(len(ids), pa.int64())], names=names)
        if vocabulary:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())] + [pa.array([vocabulary])], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "vocabulary"]
    sent = rows.mapInArrow(send, ROW).repartition(parts, "dest").mapInArrow(build, ROW)
    done = cut(sent.repartition(parts, "dest").mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, vocabulary long"))
    vocabulary = done.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0]
    opening = float(np.log10(texts + PAIR * texts + WORD))  # the denominator of the two end tokens before a text
    return done.where("vocabulary IS NULL").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + vocabulary + 1)))).alias("base_score"),
        (F.col("lm") - F.lit(opening)).alias("score"),
    )


def held_out_by(key: str = "doc_id", divisor: int = 7, remainder: int = 2):
    """The condition that a key's crc32 leaves a remainder."""
    return crc_mod(key, divisor) == remainder
