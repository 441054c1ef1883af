"""Mixing and the pipeline against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import lines, mixing, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def mixed(spark):
    got = queries.op7_mixing(spark, SF)
    return got.toPandas()


def test_one_row_each_and_native(spark, mixed):
    assert len(mixed) == spark.read.parquet(f"{SF}/documents.parquet").count()
    probabilities = mixed[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(probabilities.sum(axis=1), 1)
    assert (mixed["n_copies"] - mixed["rate"]).abs().max() < 1
    assert (mixed["rate"] >= 0).all()


def brute_rates(p, t, targets, rounds=200_000):
    """The nonnegative least squares problem solved another way: coordinate by coordinate, each to its exact minimum."""
    s, w = t.sum(), np.array(targets) / sum(targets)
    h = np.maximum(t @ p / s, 1e-9)
    r, e = np.ones(len(t)), t @ p / s
    for _ in range(rounds):
        before = r.copy()
        for i in range(len(t)):
            if t[i]:
                rest = e - r[i] * t[i] / s * p[i]
                # minimum of sum (rest + r t/s p - w)^2 / h + ridge t/s (r - 1)^2 over r >= 0
                up = ((w - rest) * p[i] / h).sum() + mixing.RIDGE
                now = max(0.0, up / ((p[i] ** 2 / h).sum() * t[i] / s + mixing.RIDGE))
                e, r[i] = rest + now * t[i] / s * p[i], now
        if np.abs(r - before).max() < 1e-10:
            break
    return r


def test_rates_by_brute_force(spark):
    """A small table whose targets are far from what it holds."""
    g = np.random.default_rng(2)
    targets = {"clean": 0.35, "low": 0.45, "toxic": 0.2}
    p = g.dirichlet([2.0, 1.0, 0.5], 30) ** 3
    p /= p.sum(axis=1, keepdims=True)
    t = g.integers(1, 900, 30).astype(float)
    rows = [(i, int(t[i]), *map(float, p[i])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens long, p_clean double, p_low double, p_toxic double").coalesce(1)
    got = {x["doc_id"]: x["rate"] for x in mixing.fitted(docs, targets, rounds=60, tolerance=1e-9).collect()}
    r, want = np.array([got[i] for i in range(30)]), brute_rates(p, t, list(targets.values()), 3000)
    s, w = t.sum(), np.array(list(targets.values()))
    h = np.maximum(t @ p / s, 1e-9)

    def cost(r):
        return (((r * t) @ p / s - w) ** 2 / h).sum() + mixing.RIDGE * (t / s * (r - 1) ** 2).sum()

    assert want.min() < 0.1
    assert cost(r) < cost(want) + 1e-4
    assert np.allclose((r * t) @ p / s, (want * t) @ p / s, atol=5e-3)


def test_totals_meet_targets(mixed):
    p = mixed[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    tokens = mixed["n_tokens"].to_numpy()
    total = (mixed["rate"].to_numpy() * tokens) @ p
    assert np.allclose(total / tokens.sum(), list(mixing.TARGETS.values()), atol=0.01)


def test_rates_are_the_least_squares_solution(mixed):
    """At the minimum the gradient is 0 where the rate is above 0, and not below 0 elsewhere."""
    p = mixed[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    t, r = mixed["n_tokens"].to_numpy(float), mixed["rate"].to_numpy()
    s = t.sum()
    mass = np.maximum(t @ p / s, 1e-9)
    off = ((r * t) @ p - np.array(list(mixing.TARGETS.values())) * s) / s / mass
    slope = p @ off + mixing.RIDGE * (r - 1)
    assert np.abs(slope[(r > 0) & (t > 0)]).max() < 0.02
    assert slope[(r == 0) & (t > 0)].min(initial=0) > -0.02


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {x["doc_id"]: x["domain"] for x in mixing.labelled(labels).collect()}
    held = {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 0}
    rest = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0)
    got = mixing.decided(docs.select("doc_id", "text"), rest).toPandas().set_index("doc_id")
    names = list(mixing.DOMAINS)
    best = got[[f"p_{d}" for d in names]].to_numpy().argmax(axis=1)
    guess = dict(zip(got.index, (names[i] for i in best), strict=True))
    right = sum(guess[d] == truth[d] for d in held) / len(held)
    common = Counter(truth[d] for d in held).most_common(1)[0][1] / len(held)
    assert right > common + 0.05


def test_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    copies = {x["doc_id"]: x["n_copies"] for x in mixing.decided(docs, labels).select("doc_id", "n_copies").collect()}
    got = mixing.resampled(docs, labels)
    assert got.columns == docs.columns
    assert Counter(x["doc_id"] for x in got.select("doc_id").collect()) == {d: n for d, n in copies.items() if n}


def test_awkward(spark):
    rows = [(None, None, 1.0, "x"), (5, "twice the same row", 2.0, "y"), (5, "twice the same row", 2.0, "y"), (6, "", 3.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate double, row string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(5, 1, None), (None, 1, 0), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = mixing.decided(docs, labels)
        assert got.count() == 4
        assert mixing.resampled(docs, labels).columns == docs.columns
    assert mixing.decided(docs.limit(0), none).count() == 0


def smallest_of_similar(texts):
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 of the five-word shingles, by all pairs."""
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {}
    for d, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets, key=lambda d: (len(sets[d]), d))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 4 * len(sets[b]) > 5 * len(sets[a]):
                break
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {find(d) for d in ids}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "SimHash near-dedup":
            texts = {x["doc_id"]: x["text"] for x in before.collect()}
            assert {x["doc_id"] for x in docs.collect()} == smallest_of_similar(texts)
        if name == "line dedup":
            held = defaultdict(set)
            for x in docs.collect():
                for line in (x["text"] or "").encode().split(b"\n"):
                    key = lines.key_of(line, 20)
                    if key:
                        held[key].add(x["doc_id"])
            assert max(map(len, held.values())) < 3
    assert docs.count() == seen["mixing to target weights"].count()
    assert corpus_pipeline.run(spark, SF.replace("0.01", "0.001")).count() > 0


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
