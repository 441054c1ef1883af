"""The operators against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quarry.llm import bpe, common, lines, mixing, multiset, ngrams, queries, rules, shards, simhash, toxicity
from quarry.llm import license as licenses

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [x for x in BLANK.split(lower(text or "")) if x]


def corpus():
    r = random.Random(7)
    vocabulary = ["the", "of", "and", "lake", "Straße", "naïve", "été", "x", "report", "data", "Moon", "a\x1cb", "wörter,", "99%"] + [f"w{i}" for i in range(150)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 120))) for _ in range(60)]
    shared = "This line is shared by several documents"
    texts += [f"{texts[i]}\n{shared if i % 2 else '  ' + shared.upper() + chr(9)}\n{texts[i + 1]}" for i in range(6)]
    near = texts[3].split()
    texts += [texts[0], texts[0], texts[0], " ".join([*near[:-1], "changed"]), " ".join(near[1:])]
    texts += ["", None, " \t\r", "one", "one two", "é" * 30, "Licensed under CC BY-NC 4.0 here.\nAll rights reserved. CC-BY cc by", "released under the MIT license.", "eight words stand here and they do repeat " * 5, "# * $ % & | < >" * 4, "long" * 5000, "a b " * 4000, "<|endoftext|> don't ΣΑΣ ok"]
    return [(i * 3, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null keys, repeated rows, nulls everywhere, and columns whose names the operators use inside."""
    rows = [(None, None, 1, "x"), (None, "some text of no key", 2, None), (5, "twice the same row", None, "y"), (5, "twice the same row", None, "y"), (6, "", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp long, lost string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {x[key]: x for x in df.collect()}


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    grams = [w[i : i + 4] for i in range(len(w) - 3)] or [w]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_simhash(docs):
    want = {d: brute_fingerprint(t) for d, t, *_ in corpus()}
    got = rows(simhash.near_duplicates(docs))
    assert {d: x["fp"] % (1 << 64) for d, x in got.items()} == want
    assert {d: x["component_id"] for d, x in got.items()} == brute_components(want, 4)


@pytest.mark.parametrize(("bands", "bucket"), [(None, 8192), (5, 7), (6, 8192), (7, 3)])
def test_simhash_links(spark, bands, bucket):
    r = random.Random(1)
    prints = {0: 0, 1: (1 << 64) - 1}
    for i in range(60):
        base = r.getrandbits(64)
        for k in range(r.choice([1, 2, 6, 40]) if i % 6 == 0 else 2):
            prints[len(prints)] = base ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) & (1 << 64) - 1
            base = prints[len(prints) - 1] if i % 2 else base
    dense = r.getrandbits(64)
    for i in range(200):
        prints[len(prints)] = dense ^ (1 << i % 64) ^ (1 << i * 7 % 64)
    want = brute_components(prints, 4)
    distinct = spark.createDataFrame([(simhash.signed(x),) * 2 for x in set(prints.values())], "node long, fp long")
    roots = {x["node"]: x["root"] for x in common.star_components(simhash.links(distinct, 4, bands, bucket)).collect()}
    label = {d: roots.get(simhash.signed(x), simhash.signed(x)) for d, x in prints.items()}
    groups = defaultdict(set)
    for d in prints:
        groups[label[d]].add(want[d])
    assert all(len(x) == 1 for x in groups.values())
    assert len(groups) == len(set(want.values()))


def brute_similar(prints, seconds):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            first = (prints[a] ^ prints[b]).bit_count()
            if first <= 10 and first + (seconds[a] ^ seconds[b]).bit_count() <= simhash.SIMILAR:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {find(d) for d in ids}


def test_simhash_one_of_each(spark, docs, awkward, empty):
    r = random.Random(5)
    words_ = [f"w{i}" for i in range(400)]
    base = [[r.choice(words_) for _ in range(300)] for _ in range(40)]
    table = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        copy = list(w)
        for _ in range(i % 4):  # up to three words of 300 changed: a similarity of 0.9 or more
            copy[r.randrange(300)] = "changed"
        table.append((100 + i, " ".join(copy)))
    many = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    both = {d: simhash.fingerprint(t.encode(), 5, (42, 43)) for d, t in table}
    want = brute_similar({d: x[0] for d, x in both.items()}, {d: x[1] for d, x in both.items()})
    got = simhash.one_of_each(many)
    assert got.columns == many.columns
    kept = sorted(x["doc_id"] for x in got.collect())
    assert kept == sorted(want)
    assert len([d for d in kept if d < 100]) == 40 and len(kept) <= 42
    assert sorted((x["doc_id"] or -1) for x in simhash.one_of_each(awkward).collect()) == [-1, -1, 5, 6]
    assert simhash.one_of_each(empty).count() == 0
    assert simhash.one_of_each(docs).count() < docs.count()


def test_simhash_exact_similarity(spark, docs, awkward, empty):
    """The pipeline's stage links exactly the pairs whose five-word shingles have a Jaccard similarity of 0.8."""
    r = random.Random(11)
    words_ = [f"w{i}" for i in range(3000)]
    table = []
    for i in range(60):
        own = [r.choice(words_) for _ in range(300)]
        table.append((i, " ".join(own)))
        for k, cut_ in enumerate((31, 35, 60)):  # words replaced at the end: similarities of 0.81, 0.79 and 0.66
            table.append((100 + 10 * i + k, " ".join([*own[:-cut_], *(f"n{i}x{k}x{j}" for j in range(cut_))])))
    table += [(9000 + i, " ".join(["one", "two", "three", "four", *(f"s{j}" for j in range(4 + i))])) for i in range(3)]
    sets = {d: {" ".join(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for d, t in table}
    parent = {d: d for d, _ in table}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    want = {d: find(d) for d in ids}
    assert 100 < len(set(want.values())) < len(ids) - 50
    many = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(many).collect()} == want
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, many, "").collect()} == set(want.values())
    narrow = many.select("doc_id", "text")
    distinct = simhash.sketches(narrow, 5).withColumnRenamed("doc_id", "least").cache()
    roots = distinct.select("node").selectExpr("node", "0L AS root")
    linked = common.star_components(simhash.confirmed_links(narrow, distinct, roots, 0.8, 5, part=9000))  # one component in several parts
    label = {x["node"]: x["root"] for x in linked.collect()}
    groups = defaultdict(set)
    for x in distinct.collect():
        groups[label.get(x["node"], x["node"])].add(want[x["least"]])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(want.values()))
    assert sorted((x["doc_id"] or -1) for x in simhash.one_of_each(awkward, similarity=0.8).collect()) == [-1, -1, 5, 6]
    assert simhash.one_of_each(empty, similarity=0.8).count() == 0


def test_simhash_candidates_do_not_chain(spark, monkeypatch):
    """Texts that only share a passage are no candidates: else most of a large corpus is one component, sent once for each of its parts."""
    r = random.Random(3)

    def drawn(n):
        return [f"w{r.randrange(10**6)}" for _ in range(n)]

    def changed(i, n):
        return " ".join([*table[i][1].split()[:-n], *drawn(n)])

    passage = drawn(40)
    table = [(i, " ".join([*drawn(100), *passage, *drawn(160)])) for i in range(240)]
    near = [(1000 + i, changed(i, 20)) for i in range(20)]
    near += [(5000, changed(30, 5)), (5000, changed(31, 5)), (None, changed(32, 5))]  # a repeated key and a null one
    alone = drawn(300)
    near += [(None, " ".join(alone)), (None, " ".join(alone[:-5])), (7000, changed(33, 70))]
    want = Counter([(i, i) for i in range(240)] + [(1000 + i, i) for i in range(20)] + [(5000, 30), (5000, 31), (None, 32), (None, None), (None, None), (7000, 7000)])
    seen = []
    confirmed = simhash.confirmed_links

    def watched(docs, distinct, roots, *rest):
        seen.extend(x["count"] for x in roots.groupBy("root").count().collect())
        return confirmed(docs, distinct, roots, *rest)

    monkeypatch.setattr(simhash, "confirmed_links", watched)
    many = spark.createDataFrame(table + near, "doc_id long, text string").repartition(3)
    assert Counter((x["doc_id"], x["component_id"]) for x in simhash.similar_documents(many).collect()) == want
    assert len(seen) >= 24 and max(seen) <= 4


def test_minima_bits():
    """Bits of the minima differ for half of what the sets don't share; similar sets stay within the spread."""
    g = np.random.default_rng(4)
    for n in (9, 90, 2000):
        for similarity in (0.8, 0.2):
            far = []
            for _ in range(300):
                x = g.integers(0, 2**64, n, np.uint64)
                own = round(n * (1 - similarity) / 2)  # of each of the two; all others are shared
                a, b = simhash.minima_bits(x[own:]), simhash.minima_bits(x[: n - own])
                far.append(sum((i ^ j).bit_count() for i, j in zip(a, b, strict=True)))
            assert abs(np.mean(far) - 128 * own / n) < 1.5
            assert similarity < 0.8 or max(far) <= simhash.spread(0.8)
    assert simhash.minima_bits(np.zeros(0, np.uint64)) == [0, 0]


def counted_trigrams(texts):
    """Counts of words, pairs and trigrams of tokenised training texts, whose contexts are padded with two end tokens."""
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        padded = [" end", " end", *t]
        one.update(t)
        two.update(zip(padded[1:], t, strict=False))
        three.update(zip(padded, padded[1:], t, strict=False))
    return one, two, three


def trigram_mass(one, two, three, u, v, w):
    """The model's probability by its formula, with plain dictionaries."""
    n, texts = sum(one.values()), one[" end"]
    pair = texts if (u, v) == (" end", " end") else two[u, v]
    p = (one[w] if one[w] else 1) / (n + 1)
    return (three[u, v, w] + ngrams.PAIR * two[v, w] + ngrams.WORD * p) / (pair + ngrams.PAIR * one[v] + ngrams.WORD)


def test_blocks_of_many_words():
    """A block whose n-grams don't fit one number holds the same."""
    block = ngrams.Block()
    for _, t, *_ in corpus():
        block.add([w.encode() for w in words(t)])
    block.close()
    for chosen in (np.arange(len(block.w)), np.arange(0, len(block.w), 40)):
        one = block.grams(chosen)
        try:
            ngrams.WIDTH = 8
            two = block.grams(chosen)
        finally:
            ngrams.WIDTH = 64
        assert all(np.array_equal(x, y) for x, y in zip(one, two, strict=True))
        used, w, v, u, doc, count = (x.astype(np.int64) for x in one)
        want = Counter(zip(block.w[chosen], block.v[chosen], block.u[chosen], block.doc[chosen], strict=True))
        assert want == dict(zip(zip(used[w], used[v], used[u], doc, strict=True), count, strict=True))


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_ngrams(docs, monkeypatch, size):
    monkeypatch.setattr(ngrams, "TOKENS", size)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in corpus()}
    text = {d: [*words(t), " end"] for d, t, *_ in corpus()}
    one, two, three = counted_trigrams(t for d, t in text.items() if not held[d])
    n, v = sum(one.values()), len(one)
    got = rows(ngrams.score(docs, ngrams.held_out_by()))
    assert set(got) == set(text)
    for d, t in text.items():
        padded = [" end", " end", *t]
        lm = sum(math.log10(trigram_mass(one, two, three, *x)) for x in zip(padded, padded[1:], t, strict=False))
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        x = got[d]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[d], len(t), sum(one[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(base, rel=1e-9)
        assert x["score"] == pytest.approx(lm, abs=2e-4 * len(t))
    assert sum(x["score"] for d, x in got.items() if held[d]) > sum(x["base_score"] for d, x in got.items() if held[d])


def test_ngrams_masses_sum_to_one(spark):
    """Scores of texts of one word more, over all words and an unknown one, add up to the mass of the text before."""
    train = ["a b a c", "b a b a", "c c a", "a b b"]
    one, two, three = counted_trigrams([*t.split(), " end"] for t in train)
    vocabulary = [*one, "unknown"]
    for u, v in [(" end", " end"), (" end", "a"), ("a", "b"), ("b", "a"), ("c", "b"), ("unknown", "a"), ("a", "unknown")]:
        assert sum(trigram_mass(one, two, three, u, v, w) for w in vocabulary) == pytest.approx(1)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][: len(train)]
    tried = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [f"{h} {w}".strip() for h in ("", "a", "a b", "b x") for w in ("a", "b", "c", "x", "")]
    table = [*zip(ids, train, strict=True), *zip(tried, texts, strict=False)]
    got = rows(ngrams.score(spark.createDataFrame(table, "doc_id long, text string"), ngrams.held_out_by()))
    said = {t: got[i]["score"] for i, t in zip(tried, texts, strict=False)}
    for h in ("", "a", "a b", "b x"):
        padded = [" end", " end", *h.split()]
        total = 0.0
        for w in ("a", "b", "c", "x", ""):  # each text's score without its own end, but that of the empty continuation
            t = f"{h} {w}".strip()
            own = [*padded, *([w] if w else [])]
            end = trigram_mass(one, two, three, own[-2], own[-1], " end") if w else 1.0
            total += 10 ** said[t] / end
        before = math.prod(trigram_mass(one, two, three, *padded[i : i + 3]) for i in range(len(padded) - 2))
        assert total == pytest.approx(before, rel=2e-3)


def test_seats_follow_sparks_partitioning(spark):
    seat = ngrams.seats(51)
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(seat)], "dest int, part int")
    assert rows.selectExpr("pmod(hash(dest), 51) = part AS same").where("not same").count() == 0


def test_ngrams_part_of_spread_words_only():
    raw = ngrams.dump(np.array([5, 9], np.uint64), np.array([3, 0], np.int64))
    part = ngrams.Part([], [raw, raw], 10)
    assert part.trained.tolist() == [5] and list(part.sums([])) == []


def test_ngrams_awkward(awkward, empty):
    got = ngrams.score(awkward, ngrams.held_out_by()).collect()
    assert sorted((x["doc_id"] or -1, x["n_tokens"]) for x in got) == [(-1, 1), (-1, 6), (5, 5), (5, 5), (6, 1)]
    assert ngrams.score(empty, ngrams.held_out_by()).count() == 0


def test_licenses(docs, awkward, empty):
    got = rows(licenses.license_scan(docs))
    for d, t, *_ in corpus():
        folded = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", " ", lower(t or ""))
        w = folded.split(" ")
        w = [x for x in w if x]
        base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels = {x for _, x in base}
        share = 0.0
        for line in lower(t or "").split("\n"):
            own = set(re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", " ", line).split(" ")) - {""}
            for label, template in licenses.TEMPLATES.items():
                s = len(own & set(template.split())) / len(set(template.split()))
                if s >= licenses.THRESHOLD:
                    labels.add(label)
                    share = max(share, s)
        starts = [i for i, _ in base]
        x = got[d]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(base), min(starts, default=None), max(starts, default=None)), d
        assert (x["base_labels"], x["labels"]) == (",".join(sorted({b for _, b in base})), ",".join(sorted(labels)))
        assert x["score"] == pytest.approx(1.0 if base else share)
    assert licenses.license_scan(awkward).count() == 5
    assert licenses.license_scan(empty).count() == 0


def test_licenses_wrapped(spark):
    """Notices wrapped over lines are found wherever the breaks are, and all windows by brute force."""
    fold = lambda t: re.sub(r"[^a-z0-9\n]", " ", lower(t))
    table = [
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy",
        "# Licensed under the Apache\n#\n# License, Version 2.0",
        "released\nat last\nunder other words than those of the\nlast license of mit and many more words",
    ]
    r = random.Random(2)
    for text in licenses.TEMPLATES.values():
        own = text.split()
        for _ in range(6):
            some = [*(f"w{r.randrange(50)}" for _ in range(r.randrange(20))), *own, *(f"w{r.randrange(50)}" for _ in range(9))]
            for _ in range(r.randrange(8)):
                some.insert(r.randrange(len(some)), r.choice(["the", "filler", *own]))
            table.append("".join(w + r.choice("    \n") for w in some))
    got = rows(licenses.license_scan(spark.createDataFrame(list(enumerate(table)), "doc_id long, text string"), phrases={}))
    for d, t in enumerate(table):
        labels, share = set(), 0.0
        for label, template in licenses.TEMPLATES.items():
            size, every, w = math.ceil(licenses.SLACK * len(template.split())), set(template.split()), fold(t).split()
            for block in [*(x.split() for x in fold(t).split("\n")), *(w[i : i + size] for i in range(len(w)))]:
                s = len(every & set(block)) / len(every)
                if s >= licenses.THRESHOLD:
                    labels.add(label)
                    share = max(share, s)
        assert (got[d]["labels"], got[d]["score"]) == (",".join(sorted(labels)), pytest.approx(share)), t
    assert [got[d]["labels"] for d in range(4)] == ["bsd", "mpl-2.0", "apache-2.0", ""]
    assert [(b["line"], b["label"], b["containment"]) for b in got[0]["blocks"]] == [(0, "bsd", 1.0)]


def test_license_filters():
    """The filters drop no template that meets the threshold, and the position alone drops some that the prefix leaves."""
    scanner = licenses.Scanner(licenses.TEMPLATES, {b"the": 900, b"license": 500, b"under": 70}, 0.8)
    vocabulary = sorted(scanner.rank, key=scanner.rank.get)
    r = random.Random(8)
    by_position = 0
    for _ in range(4000):
        own = set(r.sample(vocabulary, r.randrange(1, len(vocabulary)))) if r.random() < 0.5 else set(r.choice(scanner.templates)[1]) - set(r.sample(vocabulary, 8))
        met = {t for t, (_, order, every, least) in enumerate(scanner.templates) if len(every & own) >= least}
        left = set(scanner.candidates(own))
        assert met <= left
        under = {t for w in own for t, _ in scanner.prefix.get(w, ()) if len(own) >= scanner.templates[t][3]}
        by_position += len(under - left)
    assert by_position > 100


def brute_lines(table):
    def key(line):
        k = lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 20 else None

    held = defaultdict(set)
    for d, t, *_ in table:
        for x in (t or "").split("\n"):
            if key(x):
                held[key(x)].add(-1 if d is None else d)
    out = []
    for d, t, *_ in table:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) and len(held[key(x)]) >= 3 and (-1 if d is None else d) < max(held[key(x)]))]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark, docs, awkward, empty):
    got = lines.dedup_lines(docs)
    assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in got.collect()), key=str) == brute_lines(corpus())
    r = random.Random(3)
    pool = [f"a line long enough to count, number {i}" for i in range(40)]
    table = [(r.randrange(50), "\n".join(r.sample(pool, 5))) for _ in range(60)] + [(None, pool[0]), (None, None)]
    got = lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string").repartition(7))
    assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in got.collect()), key=str) == brute_lines(table)
    assert lines.dedup_lines(awkward).columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert lines.dedup_lines(awkward).count() == 5
    assert lines.dedup_lines(empty).count() == 0


def test_bloom_has_no_misses():
    r = np.random.default_rng(0)
    lo, hi = r.integers(0, 1 << 63, 500).astype(np.uint64), r.integers(0, 1 << 63, 500).astype(np.uint64)
    weight = np.ones(500, np.uint8)
    found = lines.suspects([lo, lo[:200]], [hi, hi[:200]], [weight, weight[:200]])
    assert found[0][:200].all()
    assert found[1].all()
    assert found[0][200:].mean() < 0.05


def brute_rules(t):
    w = [x for x in BLANK.split(t or "") if x]
    own = (t or "").split("\n")
    seen, dup = set(), 0
    for x in own:
        if BLANK.sub("", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


def test_rules(docs, awkward, empty):
    got = rows(rules.ledger(docs))
    for d, t, *_ in corpus():
        x = got[d]
        want = brute_rules(t)
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, d
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (x["failures"] & rules.mask("base-1") != 0) == failed
    led = rules.ledger(docs)
    table = led.select("failures").collect()
    for x in rules.ablation(led, "full-1").collect():
        bit = next(1 << r.bit for r in rules.RULES if r.name == x["rule"])
        assert x["n_failed"] == sum(y["failures"] & bit != 0 for y in table)
        assert x["n_alone"] == sum(y["failures"] == bit for y in table)
        assert x["n_kept_without"] == sum(y["failures"] & ~bit == 0 for y in table)
    assert rules.clean(docs).columns == docs.columns
    assert rules.clean(docs).count() == sum(x["failures"] == 0 for x in table)
    assert rules.ledger(awkward).count() == 5
    assert rules.ledger(empty).count() == 0


def test_fingerprints(docs, awkward, empty):
    table = [(d, t or "") for d, t, *_ in corpus()]
    got = rows(multiset.edited_fingerprints(docs))
    by_text = defaultdict(set)
    for (d, t), (_, following) in zip(table, table[1:] + table[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        x = got[d]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x["fingerprint"] == str(multiset.Fingerprint(multiset.passages(t)))
        assert x["edited_fingerprint"] == str(multiset.Fingerprint(multiset.passages(edited)))
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        by_text[t].add(x["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert multiset.edited_fingerprints(awkward).count() == 5
    assert multiset.edited_fingerprints(empty).count() == 0


def test_fingerprint_algebra():
    a, b = multiset.passages("one two\nthree\nfour"), multiset.passages("five\n")
    total = multiset.Fingerprint(a + b)
    assert str(multiset.Fingerprint(b + a)) == str(total)
    assert str(total - multiset.Fingerprint(b)) == str(multiset.Fingerprint(a))
    assert str(multiset.Fingerprint.parse(str(total))) == str(total)
    assert b"".join(a) == b"one two\nthree\nfour"


def test_fingerprint_likeness_of_equal_lines():
    """The likeness follows the exact multiset share where lines repeat, and edits stay incremental."""
    r = random.Random(6)
    for same, fewer, lines_ in ((100, 60, 60), (300, 150, 100), (40, 0, 50), (500, 450, 200)):
        own = [f"line {r.random()}" for _ in range(lines_)]
        a = "\n".join([*own, *["equal"] * same, *[""] * same])
        b = "\n".join([*own[: lines_ - 5], *["equal"] * fewer, *[""] * fewer])
        x, y = Counter(multiset.passages(a)), Counter(multiset.passages(b))
        share = 2 * (x & y).total() / (x.total() + y.total())
        got = multiset.Fingerprint(multiset.passages(a)).likeness(multiset.Fingerprint(multiset.passages(b)))
        assert abs(got - share) < 0.2 * (1 - share) + 0.01, (got, share)
        edited, mark = multiset.with_tail(a, multiset.passages(a), multiset.Fingerprint(multiset.passages(a)), b)
        assert str(mark) == str(multiset.Fingerprint(multiset.passages(edited)))


def test_fingerprint_likeness_of_texts():
    """The likeness against the exact multiset share of passages, for unrelated and related texts."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    off = []
    for k in range(200):
        a = [r.choice(vocabulary) for _ in range(200)]
        b = a[: 2 * k % 200] + [r.choice(vocabulary) for _ in range(200 - 2 * k % 200)] if k % 2 else [r.choice(vocabulary) for _ in range(200)]
        x, y = (multiset.passages(" ".join(t)) for t in (a, b))
        share = 2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y))
        got = multiset.Fingerprint(x).likeness(multiset.Fingerprint(y))
        off.append(abs(got - share))
        if not k % 2:
            assert got < share + 0.2
    assert sum(off) / len(off) < 0.05 and max(off) < 0.2


def test_shards(spark, docs, awkward, empty):
    got = rows(shards.sharded(docs))
    for d, t, *_ in corpus():
        raw = (t or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert got[d]["grown_shard"] in (40, got[d]["shard"])
    many = shards.sharded(spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")).collect()
    counts = Counter(x["shard"] for x in many)
    assert set(counts) == set(range(40)) and max(counts.values()) < 160
    slots = defaultdict(list)
    for x in many:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert 60 < sum(x["grown_shard"] == 40 for x in many) < 150
    assert sorted(x["slot"] for x in shards.sharded(spark.createDataFrame([(1, "a")] * 5, "doc_id long, text string")).collect()) == [0, 1, 2, 3, 4]
    assert shards.sharded(awkward).count() == 5
    assert shards.sharded(empty).count() == 0


def test_shard_weights_move_rows_only_into_what_grows(spark):
    keys = spark.range(3000)
    before, after = shards.layout(16, 16), shards.layout(16, 16, {5: 3.0})
    moved = keys.select(shards.winner(keys["id"].cast("string"), before).alias("a"), shards.winner(keys["id"].cast("string"), after).alias("b")).where("a <> b").collect()
    assert moved and all(x["b"] // 8 == 0 for x in moved)  # only into the region that holds shard 5


def test_bpe(spark, docs, awkward, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = rows(bpe.bpe(docs, path))
    for d, t, *_ in corpus():
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[d]["ids"] == want
        assert got[d]["decoded"] == library.decode(want, skip_special_tokens=False)
    model = bpe.WordBpe(json.load(open(path)))
    for at in range(0, 0x3000, 0x80):
        text = "x" + " a".join(map(chr, range(at, at + 0x80)))
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert bpe.bpe(awkward, path).count() == 5
    assert bpe.bpe(empty, path).count() == 0


def test_toxicity(spark, sf):
    """Neighbours by brute force over the raw texts: all words, all pairs of a query and an example."""
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = rows(toxicity.toxicity(d, labels))
    bag = {x["doc_id"]: Counter(re.findall(rb"[0-9a-z\x80-\xff]+", lower(x["text"] or "").encode())) for x in d.collect()}
    toxic = {x["doc_id"]: x["toxic"] for x in labels.collect() if x["doc_id"] in bag and zlib.crc32(str(x["doc_id"]).encode()) % 5}
    n, ones = len(toxic), sum(toxic.values())
    df = Counter(w for x in bag.values() for w in x)
    have, bad = Counter(w for i in toxic for w in bag[i]), Counter(w for i in toxic if toxic[i] for w in bag[i])

    def scale(w):
        a, b = bad[w], have[w] - bad[w]
        below = (a + b) * (n - a - b) * ones * (n - ones)
        chi = n * (a * (n - ones - b) - b * (ones - a)) ** 2 / below if below else 0.0
        return (math.log((1 + len(bag)) / (1 + df[w])) + 1) * (math.sqrt(chi) + toxicity.FLOOR)

    scales = {w: scale(w) for w in have}

    def vector(i):
        v = {w: (1 + math.log(k)) * scales[w] for w, k in bag[i].items() if w in scales}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = {}
    for i in sorted(toxic):
        if bag[i]:
            examples.setdefault(tuple(sorted(bag[i].items())), []).append(i)
    points = {same[0]: vector(same[0]) for same in examples.values()}
    for i in random.Random(0).sample(sorted(bag), 120):
        q = vector(i)
        near = sorted((-round(sum(x * v.get(w, 0.0) for w, x in q.items()), 9), e) for e, v in points.items())
        near = [(e, -c) for c, e in near if c < 0][: toxicity.NEAREST]
        assert [c for _, c in near] == pytest.approx([x["cosine"] for x in got[i]["evidence"]], abs=2e-9)
        last = near[-1][1] if near else 0
        assert {e for e, c in near if c > last + 1e-8} <= {x["doc_id"] for x in got[i]["evidence"]}


def test_toxicity_ties_and_blocks(spark):
    """Of 200 equally near examples those with the smallest doc_ids count, in whatever blocks they lie."""
    learnt = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:400]
    table = [(i, f"same word own{i}" if k % 2 else f"other own{i}", k % 2) for k, i in enumerate(learnt)] + [(5000, "same word", 0)]
    both = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    got = rows(toxicity.toxicity(both, both.where("doc_id < 5000").select("doc_id", "toxic")))
    assert [x["doc_id"] for x in got[5000]["evidence"]] == learnt[1::2][: toxicity.NEAREST]
    assert got[5000]["score"] > 0.9


def test_toxicity_held_out(spark):
    """On the larger table, where the held-out rows have about a hundred toxic ones."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {x["doc_id"]: x["toxic"] for x in labels.collect()}
    got = rows(toxicity.toxicity(d, labels))
    assert len(got) == d.count()
    held = [(got[i]["score"], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(s > t) + 0.5 * (s == t) for s, a in held for t, b in held if a > b]
    assert sum(right) / len(right) > 0.98
    assert sum((s - y) ** 2 for s, y in held) / len(held) < 0.02
    for low, high in ((0.0, 0.1), (0.1, 0.9), (0.9, 1.0)):  # calibrated: as many toxic rows as the scores say
        some = [(s, y) for s, y in held if low <= s <= high]
        assert abs(sum(s for s, _ in some) - sum(y for _, y in some)) / len(some) < (0.05 if len(some) > 60 else 0.2)


def test_toxicity_diverse_words(spark):
    """300 toxic words, each in five of 300 toxic examples among 3,000, all count."""
    r = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    learnt = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5][:3000]
    held = [i for i in range(6000, 8000) if zlib.crc32(str(i).encode()) % 5 == 0][:60]
    said = lambda k: [f"bad{(k + 60 * j) % 300}" for j in range(5)]
    text = lambda k, toxic: " ".join(r.choices(plain, k=20) + (said(k) if toxic else []))
    table = [(i, text(k, k < 300), int(k < 300)) for k, i in enumerate(learnt)] + [(i, text(7 * k, k < 30), int(k < 30)) for k, i in enumerate(held)]
    both = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    docs_, labels = both.select("doc_id", "text"), both.select("doc_id", "toxic")
    assert {f"bad{i}" for i in range(300)} <= {w.decode() for w in toxicity.fit(docs_, labels).number}
    got = rows(toxicity.toxicity(docs_, labels))
    assert min(got[i]["score"] for i in held[:30]) > 0.5 > max(got[i]["score"] for i in held[30:])


def test_toxicity_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward, none).collect()
    assert len(got) == 5 and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.toxicity(empty, none).count() == 0


CLASHING = ("__lo", "__w", "__f", "lost", "row", "key", "cut", "fp", "node", "rate", "tokens", "label", "part", "text_crc32", "shard", "word", "evidence", "n_words", "lo", "hi")


def test_long_texts_and_clashing_names(spark):
    """Texts of two megabytes in one line, in many lines and in one word, beside columns with the operators' inner names."""
    table = [(1, "word " * 400_000), (2, "a line that is long enough to count\n" * 60_000), (3, "x" * 2_000_000), (4, "a line that is long enough to count"), (5, "a line that is long enough to count")]
    plain = spark.createDataFrame(table, "doc_id long, text string").repartition(2)
    wide = plain.select(*(F.lit("z").alias(c) for c in CLASHING), "doc_id", "text")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    made = {
        "simhash": lambda d: simhash.near_duplicates(d),
        "similar": lambda d: simhash.similar_documents(d),
        "ngrams": lambda d: ngrams.score(d, ngrams.held_out_by()),
        "toxicity": lambda d: toxicity.toxicity(d, labels).select("doc_id", "score"),
        "license": lambda d: licenses.license_scan(d).drop("blocks"),
        "lines": lambda d: lines.dedup_lines(d).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("s"), "n_lines", "n_dropped"),
        "rules": lambda d: rules.ledger(d).select("doc_id", "failures", "n_words"),
        "mixing": lambda d: mixing.decided(d, labels).select("doc_id", "n_tokens", F.round("rate", 9).alias("rate")),
        "multiset": lambda d: multiset.edited_fingerprints(d).select("doc_id", "n_chars", "fingerprint"),
        "shards": lambda d: shards.sharded(d),
        "bpe": lambda d: bpe.bpe(d, queries.tokenizer_path()).select("doc_id", F.size("ids").alias("n"), F.sha2(F.col("decoded").cast("binary"), 256).alias("s")),
    }
    for name, of in made.items():
        want, got = rows(of(plain)), rows(of(wide))
        assert set(got) == {1, 2, 3, 4, 5}, name
        assert {k: x.asDict() for k, x in got.items()} == {k: {c: x.asDict().get(c) for c in got[k].asDict()} for k, x in want.items()}, name
    assert rows(ngrams.score(plain, ngrams.held_out_by()))[1]["n_tokens"] == 400_001
    assert lines.dedup_lines(wide).columns == [*CLASHING, "doc_id", "text", "n_lines", "n_dropped"]
    assert set(CLASHING) <= set(rules.clean(wide).columns) and set(CLASHING) <= set(mixing.resampled(wide, labels).columns)
    assert simhash.one_of_each(wide, similarity=0.8).columns == wide.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert key(got) == key(want)
    assert all(isinstance(x.dataType, (T.LongType, T.StringType, T.BooleanType, T.IntegerType, T.DoubleType)) for x in queries.QUERIES[name](spark, sf).schema)
