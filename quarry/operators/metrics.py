"""Retrieval and answer metrics, all cases at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import evidence_text, text_matches
from quarry.operators.frames import small


def hit_and_mrr(retrieved: DataFrame, truth: DataFrame, case: str = "case_id", item: str = "doc_id") -> DataFrame:
    """Rows (case, hit_rate, mrr) for every case of ``truth`` (case, item): first match of ``retrieved`` (case, rank, item)."""
    first = retrieved.join(truth, [case, item]).groupBy(case).agg(F.min("rank").alias("first"))
    cases = truth.select(case).distinct().join(first, case, "left")
    return cases.select(case, F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def document_metrics(retrieved: DataFrame, evidences: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows (case, document_hit_rate, document_mrr): evidences (case, evidence, document) count one by one; those without document don't."""
    named = evidences.where(F.coalesce("document", F.lit("")) != "")
    ranks = named.join(retrieved.select(case, "document", "rank"), [case, "document"], "left").groupBy(case, "evidence").agg(F.min("rank").alias("rank"))
    return ranks.groupBy(case).agg((F.count("rank") / F.count("*")).alias("document_hit_rate"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("document_mrr"))


def page_hit_rate(retrieved: DataFrame, evidences: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows (case, page_hit_rate): an evidence with a page is hit by a result of its document whose pages hold it, or, without pages, whose text does."""
    paged = evidences.where((F.coalesce("document", F.lit("")) != "") & F.col("page").isNotNull())
    paged = paged.withColumn("__wanted", evidence_text(F.col("evidence_text")))
    got = retrieved.withColumn("__body", F.when(F.col("page_start").isNull(), evidence_text(F.col("result_text"))))
    found = paged.join(got, [case, "document"], "left")
    text = text_matches(F.col("__wanted"), F.col("__body"))
    hit = F.when(F.col("page_start").isNotNull(), F.col("page").between(F.col("page_start"), F.col("page_end"))).otherwise(F.col("result_text").isNotNull() & text)
    each = found.groupBy(case, "evidence").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    return each.groupBy(case).agg((F.count_if("hit") / F.count("*")).alias("page_hit_rate"))


def counted(texts: DataFrame, key: list[str], text: str, name: str) -> DataFrame:
    """Rows (key, token, name): how often each token of the normalised text occurs."""
    words = F.filter(F.split(evidence_text(F.col(text)), " "), lambda t: t != "")
    return texts.select(*key, F.explode(words).alias("token")).groupBy(*key, "token").agg(F.count("*").alias(name))


#: Texts and characters of a block at most; counters that a meeting of two blocks handles at once.
TEXTS, CHARACTERS, AT_ONCE = 1024, 4 << 20, 2 << 20


def word_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (keys, bodies): normalised texts packed by some MB, those of one key in one."""
    body = F.array_join(F.collect_list("__body"), " ").alias("__body")
    whole = texts.select(key, evidence_text(F.col(text)).alias("__body")).groupBy(key).agg(body).where("__body <> ''")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.utf8_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                most = (ends[at - 1] if at else 0) + CHARACTERS
                end = min(at + TEXTS, max(at + 1, int(np.searchsorted(ends, most, "right"))))
                yield pa.RecordBatch.from_arrays([one_list(keys.slice(at, end - at)), one_list(bodies.slice(at, end - at))], names=["keys", "bodies"])
                at = end

    return whole.mapInArrow(pack, f"keys array<{whole.schema[key].dataType.simpleString()}>, bodies array<string>")


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def words_of(bodies: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The numbers of the texts, and their tokens."""
    parts = pc.split_pattern(bodies, " ")
    owner, words = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
    some = pc.not_equal(words, "")
    return owner[some.to_numpy(zero_copy_only=False)], words.filter(some)


def times(owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners and tokens in order, and how often the owner had the token before."""
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
    first = np.nonzero(new)[0]
    return owner, token, np.arange(len(owner)) - first[np.cumsum(new) - 1]


def common_counts(references: pa.Array, contexts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of tokens that each context shares with each reference, as multisets, and the references' own numbers.

    The n-th occurrence of a token is a feature of its own, so that sharing
    features is sharing tokens as multisets.
    """
    owner, words = words_of(references)
    coded = words.dictionary_encode()
    owner, token, before = times(owner, coded.indices.to_numpy())
    most = np.zeros(len(coded.dictionary), np.int64)
    np.maximum.at(most, token, before + 1)
    base = np.concatenate(([0], np.cumsum(most)))
    feature = base[token] + before
    order = np.argsort(feature, kind="stable")
    holders, start = owner[order], np.searchsorted(feature[order], np.arange(base[-1] + 1))
    c_owner, c_words = words_of(contexts)
    known = pc.index_in(c_words, value_set=coded.dictionary)
    there = pc.is_valid(known).to_numpy(zero_copy_only=False)
    c_owner, c_token, c_before = times(c_owner[there], known.drop_null().to_numpy())
    kept = c_before < most[c_token]
    c_owner, c_feature = c_owner[kept], base[c_token[kept]] + c_before[kept]
    lengths = start[c_feature + 1] - start[c_feature]
    ends = np.cumsum(lengths)
    n = len(references)
    common = np.zeros(len(contexts) * n, np.int64)
    at = 0
    while at < len(ends):  # features of contexts, as many as their holders fill a piece
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        some = lengths[at:end]
        where = np.arange(some.sum()) + np.repeat(start[c_feature[at:end]] - (ends[at:end] - some - done), some)
        pairs = np.repeat(c_owner[at:end] * n, some) + holders[where]
        low = int(c_owner[at]) * n  # contexts come in order
        high = (int(c_owner[end - 1]) + 1) * n
        common[low:high] += np.bincount(pairs - low, minlength=high - low)
        at = end
    return common.reshape(len(contexts), n), np.bincount(owner, minlength=n)


def coverage(references: DataFrame, contexts: DataFrame, reference: str, context: str, least: float = 0.5) -> DataFrame:
    """Rows (reference, context, coverage) of the pairs whose context has at least a share ``least`` of the reference's tokens, as multisets.

    Blocks of contexts meet blocks of references, which are broadcast if the
    optimizer knows that they are few.  A meeting counts the common tokens of
    its pairs in memory and gives back those that reach the threshold, so pairs
    that do not are neither shuffled nor written.
    """
    r = word_blocks(references.where(F.col(reference).isNotNull()), reference, "text").select(F.col("keys").alias("r_keys"), F.col("bodies").alias("r_bodies"))
    met = word_blocks(contexts, context, "text").crossJoin(F.broadcast(r) if small(references) else r)  # blocks, not rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, bodies, r_keys, r_bodies = (batch.column(c)[i].values for c in range(4))
                common, total = common_counts(r_bodies, bodies)
                row, column = np.nonzero((common > 0) & (common >= np.ceil(least * total - 1e-9)))
                yield pa.RecordBatch.from_arrays([r_keys.take(pa.array(column)), keys.take(pa.array(row)), pa.array(common[row, column] / total[column])], names=[reference, context, "coverage"])

    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for d, c in ((references, reference), (contexts, context)))
    return met.mapInArrow(count, f"{kinds}, coverage double")


def answer_scores(answers: DataFrame, key: str) -> DataFrame:
    """Rows (key, exact_match, token_f1) of answers (key, reference, answer)."""
    r = counted(answers, [key], "reference", "n1")
    a = counted(answers, [key], "answer", "n2")
    tokens = r.join(a, [key, "token"], "full").groupBy(key).agg(F.sum(F.coalesce(F.least(F.col("n1"), F.col("n2")).cast("long") * F.when(F.col("n1").isNull() | F.col("n2").isNull(), 0).otherwise(1), F.lit(0))).alias("common"), F.coalesce(F.sum("n1"), F.lit(0)).alias("nr"), F.coalesce(F.sum("n2"), F.lit(0)).alias("na"))
    f1 = F.when(F.coalesce("common", F.lit(0)) == 0, 0.0).otherwise(2.0 * F.col("common") / (F.col("nr") + F.col("na")))
    same = (evidence_text(F.col("reference")) == evidence_text(F.col("answer"))) & (evidence_text(F.col("reference")) != "")
    return answers.join(tokens, key, "left").select(key, F.when(same, 1.0).otherwise(0.0).alias("exact_match"), f1.alias("token_f1"))


def evidence_rank_metrics(judged: DataFrame, cutoff: int, case: str = "case_id") -> DataFrame:
    """Rows (case, evidence_hit_rate, evidence_mrr) of judged evidences (case, evidence, rank or null)."""
    inside = F.when(F.col("rank") <= cutoff, F.col("rank"))
    return judged.groupBy(case).agg((F.count(inside) / F.count("*")).alias("evidence_hit_rate"), F.coalesce(1.0 / F.min(inside), F.lit(0.0)).alias("evidence_mrr"))


def aggregate(metrics: DataFrame) -> DataFrame:
    """Rows (metric, mean, n) of (case, metric, value): only cases that have the metric count."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def latency(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """avg, p50, p95 and max of values not below zero, percentiles interpolated."""
    kept = rows.withColumn("__v", value).where(F.col("__v") >= 0)
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__v").alias("avg_ms"), F.percentile("__v", 0.5).alias("p50_ms"), F.percentile("__v", 0.95).alias("p95_ms"), F.max("__v").alias("max_ms"))
