"""Replies of language models read as columns; what doesn't fit becomes null, with no exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(reply: Column) -> Column:
    """The reply without a fence around it."""
    return F.regexp_replace(F.regexp_replace(reply, "^\\s*(```(json)?)?\\s*", ""), "\\s*(```)?\\s*$", "")


def scores(reply: Column) -> Column:
    """A rerank reply as array of (passage_id, score); null if it's no JSON array whose items have both."""
    found = F.from_json(unfenced(reply), "array<struct<passage_id:string,score:double>>")
    whole = F.forall(found, lambda x: x["passage_id"].isNotNull() & x["score"].isNotNull())
    return F.when(unfenced(reply).startswith("[") & whole, found)


def judgement(reply: Column, evidences: Column, results: Column) -> Column:
    """A judge's ranks by evidence; null unless each evidence has one entry and the ranks lie in the results."""
    body = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    found = F.from_json(body, "evidence_matches array<struct<evidence_index:int,first_matching_rank:int,reason:string>>")["evidence_matches"]
    order = F.array_sort(F.transform(found, lambda x: x["evidence_index"]))
    inside = F.forall(found, lambda x: x["first_matching_rank"].isNull() | x["first_matching_rank"].between(1, results))
    right = (F.size(found) == evidences) & (order == F.sequence(F.lit(1), F.greatest(evidences, F.lit(1)))) & inside
    ranks = F.array_sort(F.transform(found, lambda x: F.struct(x["evidence_index"].alias("evidence_index"), x["first_matching_rank"].alias("rank"))))
    return F.when(right, F.transform(ranks, lambda x: x["rank"]))


def enrichment(reply: Column) -> Column:
    """Struct (title, summary, tags) of a ``Title: / Summary: / Tags:`` reply; the raw reply, cut at 500 characters, for a missing summary."""
    title = F.trim(F.regexp_extract(reply, "(?i)Title:\\s*(.+?)(?:\\n|$)", 1))
    summary = F.trim(F.regexp_extract(reply, "(?is)Summary:\\s*(.+?)\\n(?:Tags:|$)", 1))
    tags = F.filter(F.transform(F.split(F.regexp_extract(reply, "(?i)Tags:\\s*(.+?)(?:\\n|$)", 1), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce(F.nullif(summary, F.lit("")), F.substring(reply, 1, 500)).alias("summary"), tags.alias("tags"))


def redacted(text: Column, secrets: list[str] = ()) -> Column:
    """Text without given secrets and without what stands behind a key, token or password."""
    for secret in secrets:
        text = F.replace(text, F.lit(secret), F.lit("***")) if secret else text
    return F.regexp_replace(text, "(?i)((?:api[_-]?key|token|secret|password|authorization)\\s*[\"']?\\s*[:=]\\s*[\"']?)[^\\s\"',}]+", "$1***")
