"""Known facts about text, query strings and ids."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import ids, query, replies, text
from quarry.operators import catalog, response
from quarry.operators.chunks import split_recursively


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a    b\n\n\n\nc   \n", "a b\n\nc"),
        ("body\n────────────────\nPage 3\n────────────────\nmore", "body\n\nmore"),
        ("x <!-- note\nmore --> y <b>z</b>", "x y z"),
        ("Text  here\n```python\na  =  1   \n\n\n\nb\n```\nend  now", "Text here\n```python\na  =  1   \n\n\n\nb\n```\nend now"),
        ("────────────\nonly a rule", "only a rule"),
        (" \n ", ""),
        ("plain", "plain"),
    ],
)
def test_refine(spark, raw, clean):
    assert one(spark, text.refine, raw) == clean


@pytest.mark.parametrize(
    ("raw", "title"),
    [("# Heading\nbody", "Heading"), ("Short line\nbody", "Short line"), ("A sentence here. Then more", "A sentence here. Then more"), ("Ends with a stop.\nMore", "Ends with a stop"), ("", "Untitled"), ("w" * 120 + " end. Next", ("w" * 120 + " end"))],
)
def test_title(spark, raw, title):
    assert one(spark, text.title, raw) == title


def test_summary(spark):
    assert one(spark, text.summary, "One. Two! Three? Four.") == "One. Two! Three?"
    assert len(one(spark, text.summary, "x" * 600)) == 500


def test_tags_are_sorted_and_few(spark):
    got = one(spark, text.keyword_tags, "The New York camelCase snake_case **bold term** text")
    assert got == sorted(got)
    assert {"camelCase", "snake_case", "bold term"} <= set(got)


@pytest.mark.parametrize(("raw", "name"), [("C:\\docs\\Annual Report.PDF", "annual report"), ("http://x/y/File.pdf?page=2#top", "file"), ('"Quoted.MD"', "quoted"), (None, "")])
def test_document_name(spark, raw, name):
    assert one(spark, text.document_name, raw) == name


def test_folded(spark):
    assert one(spark, lambda c: text.document_name(text.folded(c)), "\uff21\uff22.pdf") == "ab"


@pytest.mark.parametrize(("reference", "answer", "want"), [("$1,200", "USD 1,200", 1.0), ("25%", "0.25", 1.0), ("($1,200)", "-1200", 1.0), ("$1,200", "$1,250", 0.0), ("none", "5", None), ("$5", "none", 0.0), ("1.5 million", "1500000", 1.0)])
def test_numbers(spark, reference, answer, want):
    row = spark.createDataFrame([(reference, answer)], "r string, a string").select(text.numeric_accuracy(F.col("r"), F.col("a")).alias("y")).first()
    assert row["y"] == want


def test_query_strings(spark):
    assert one(spark, query.filters, "collection:api-docs how to c:last x:1") == {"collection": "last", "x": "1"}
    assert one(spark, query.tags, "tag:important,urgent tags:b q") == ["important", "urgent", "b"]
    assert one(spark, query.remainder, "type:pdf  find   this s:a") == "find this"
    assert one(spark, query.keywords, "Azure Azure azure AZURE") == ["Azure"]
    assert one(spark, query.keywords, "") == []
    assert one(spark, query.keywords, "how to use machine-learning gpt-4") == ["machine-learning", "gpt-4"]
    merged = spark.range(1).select(query.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"))).alias("m")).first()["m"]
    assert merged == {"a": "9", "b": "2"}


def test_tokens(spark):
    assert one(spark, text.index_terms, "C++ and C# programming @2024 x deep_learning") == ["and", "programming", "2024", "deep_learning"]


def test_ids(spark):
    sha = hashlib.sha256(b"text").hexdigest()
    assert one(spark, ids.document_id, "text") == f"doc_{sha[:16]}"
    assert one(spark, lambda c: ids.draft_chunk_id(F.lit("d"), F.lit(3), c), "text") == f"d_0003_{sha[:8]}"
    assert one(spark, lambda c: ids.fallback_document_id(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"), c), "k") == "doc_chunk_k"
    assert ids.settings_fingerprint({"model": "m", "api_key": "1"}) == ids.settings_fingerprint({"api_key": "2", "model": "m"})
    assert ids.settings_fingerprint({"model": "m"}) != ids.settings_fingerprint({"model": "n"})
    assert ids.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert ids.collection_name("a b", "f" * 20) == "a_b__" + "f" * 12


def test_replies(spark):
    reply = json.dumps([{"passage_id": "a", "score": 2}, {"passage_id": "b", "score": 0.5}])
    assert [tuple(x) for x in one(spark, replies.scores, f"```json\n{reply}\n```")] == [("a", 2.0), ("b", 0.5)]
    assert one(spark, replies.scores, "no") is None
    assert one(spark, replies.scores, '[{"score": 1}]') is None
    good = '{"evidence_matches": [{"evidence_index": 1, "first_matching_rank": 2}]}'
    assert one(spark, lambda c: replies.judgement(c, F.lit(1), F.lit(3)), good) == [2]
    assert one(spark, lambda c: replies.judgement(c, F.lit(2), F.lit(3)), good) is None
    assert one(spark, lambda c: replies.judgement(c, F.lit(1), F.lit(1)), good) is None
    assert one(spark, replies.redacted, "api_key=abc x") == "api_key=*** x"


@pytest.mark.parametrize(("raw", "want"), [('["a", " b "]', ["a", "b"]), ("a, b,,c", ["a", "b", "c"]), ("", [])])
def test_tag_lists(spark, raw, want):
    assert one(spark, catalog.normalised_tags, raw) == want


@given(st.text(alphabet="ab c.\n!?é,;", max_size=300), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_splitter_spans(body, size, overlap):
    spans = split_recursively(body, size, overlap)
    assert all(0 <= a < b <= len(body) and b - a <= size for a, b in spans)
    assert [a for a, _ in spans] == sorted(a for a, _ in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(body[i].isspace() for i in range(len(body)) if i not in covered)


def test_registry():
    r = plugins.Registry("thing")
    r.register(" Name ", len)
    assert r.create("NAME") is len
    with pytest.raises(ValueError, match="name"):
        r.create("other")
    with pytest.raises(TypeError):
        r.register("x", 3)


def test_fixed_prints_the_exact_value(spark):
    """By the exact binary value, which Java's shortest decimal rounds otherwise; true halves go to even."""
    values = [0.35, 0.45, 33.65, 278.25, 1.005, 2.675, 0.125, 0.375, -33.65, -0.04, 0.0, 9.95, 0.999, 12345.678]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", text.fixed(F.col("x"), 1).alias("one"), text.fixed(F.col("x"), 2).alias("two"), text.duration(F.col("x")).alias("shown")).collect()
    assert [(r["one"], r["two"]) for r in rows] == [(f"{r['x']:.1f}", f"{r['x']:.2f}") for r in rows]
    assert [r["shown"] for r in rows] == [f"{r['x'] / 1000:.2f} s" if r["x"] >= 1000 else f"{r['x']:.1f} ms" for r in rows]


def test_half_even_rounds_the_scaled_double(spark):
    """16.93305 times 10,000 is 169330.50000000003, no half; as a decimal it would go to the even 16.933."""
    values = [16.93305, 32.70175, 36.15485, 2.48085, 0.00005, -2.48085, 1e300]
    rows = spark.createDataFrame([(0, i, str(i), x, "t", {"source_path": "p"}) for i, x in enumerate(values)], "query_id long, rank int, chunk_id string, score double, text string, metadata map<string,string>")
    assert [x["v"] for x in rows.select(text.half_even(F.col("score"), 4).alias("v")).collect()] == [round(x * 1e4) / 1e4 if x < 1e15 else x for x in values]
    assert 'score="16.9331"' in response.rendered(rows.where("rank = 0")).first()["content"]
