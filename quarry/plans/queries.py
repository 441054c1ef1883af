"""One query for each operator, over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import ids, replies, text
from quarry.functions import query as qf
from quarry.operators import catalog, chunks, dense, experiments, fusion, metrics, rerank, response, sparse, traces
from quarry.operators import ingest as ingestion
from quarry.plans import search, tables
from quarry.plans.tables import read
from quarry.sources import files, sinks
from quarry.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; its whole numbers come out as long, arrays as strings joined by a bar."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = f(spark, sf)
        kinds = dict(df.dtypes)
        out = {c: F.col(c).cast("long") for c, k in kinds.items() if k in ("int", "smallint", "tinyint")}
        out |= {c: F.array_join(F.col(c).cast("array<string>"), "|") for c, k in kinds.items() if k.startswith("array<") and "struct" not in k}
        return df.withColumns(out)

    QUERIES[f.__name__] = run
    return f


def six(column: str, name: str | None = None):
    return F.round(column, 6).alias(name or column)


@query
def corpus_stats(spark, sf):
    return sparse.corpus_stats(sparse.tokenised(tables.corpus(spark, sf))).withColumn("avg_doc_length", six("avg_doc_length"))


@query
def term_frequency(spark, sf):
    return sparse.postings(sparse.tokenised(tables.corpus(spark, sf)))


@query
def document_frequency(spark, sf):
    posts = term_frequency(spark, sf)
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def _index(tokens):
    return sparse.term_table(sparse.postings(tokens), sparse.corpus_stats(tokens)).withColumn("idf", six("idf"))


@query
def bm25_index(spark, sf):
    return sparse.index_terms_table(tables.corpus(spark, sf)).withColumn("idf", six("idf"))


@query
def bm25_remove(spark, sf):
    docs = tables.corpus(spark, sf)
    return _index(sparse.remove_documents(sparse.tokenised(docs), docs.where("collection = 'src3'")))


@query
def bm25_add(spark, sf):
    docs = tables.corpus(spark, sf)
    new = docs.where("doc_type = 'en'").withColumn("text", F.concat(F.col("text"), F.lit(" added")))
    return _index(sparse.add_documents(sparse.tokenised(docs), sparse.tokenised(new)))


def _bm25(spark, sf, k=20):
    return sparse.bm25_topk(tables.item_terms(spark, sf), tables.corpus(spark, sf), k, "item_id")


@query
def bm25_topk(spark, sf):
    return _bm25(spark, sf, 5).withColumn("score", six("score"))


@query
def top_terms(spark, sf):
    return sparse.top_terms(term_frequency(spark, sf))


@query
def sparse_retrieve(spark, sf):
    hits = _bm25(spark, sf, 5)
    docs = tables.corpus(spark, sf).select("doc_id", "collection", F.length("text").alias("n_chars"))
    return hits.join(docs, "doc_id").withColumn("score", six("score"))


def _dense(spark, sf, k=20):
    return dense.dense_topk(tables.item_vectors(spark, sf), read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), k, query="item_id", key="doc_id")


def _vector_queries(spark, sf):
    return read(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("want"))


@query
def dense_topk(spark, sf):
    return dense.dense_topk(_vector_queries(spark, sf), read(spark, sf, "embeddings"), 10).withColumn("score", six("score"))


@query
def dense_filtered_topk(spark, sf):
    return dense.dense_topk(_vector_queries(spark, sf), read(spark, sf, "embeddings"), 10, ("label", "want")).withColumn("score", six("score"))


@query
def vector_dims(spark, sf):
    return dense.dimensions(read(spark, sf, "embeddings"))


@query
def rrf_fusion(spark, sf):
    return fusion.rrf([_dense(spark, sf), _bm25(spark, sf)], 10, query="item_id").withColumn("score", F.round("score", 9))


@query
def weighted_rrf(spark, sf):
    return fusion.rrf([_dense(spark, sf), _bm25(spark, sf)], 10, (0.7, 0.3), query="item_id").withColumn("score", F.round("score", 9))


@query
def interleave(spark, sf):
    return fusion.interleave([_dense(spark, sf), _bm25(spark, sf)], 10, query="item_id").withColumn("score", six("score"))


@query
def hybrid_search(spark, sf):
    return fusion.hybrid(_dense(spark, sf), _bm25(spark, sf), 10, query="item_id").withColumn("score", F.round("score", 9))


@query
def hybrid_single_list(spark, sf):
    """Only items whose vector has a label below 5 count as having one; of the others the sparse list passes as it is."""
    known = read(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("item_id"))
    return fusion.hybrid(_dense(spark, sf).join(known, "item_id", "left_semi"), _bm25(spark, sf), 10, query="item_id").withColumn("score", six("score"))


@query
def metadata_filter(spark, sf):
    docs = tables.corpus(spark, sf)
    found = _bm25(spark, sf).join(docs, "doc_id")
    test = fusion.matches(F.col("collection"), F.col("doc_type"), F.array("doc_type", "collection"), F.col("source_path"), {"doc_type": F.lit("en"), "source_path": F.lit("/src1"), "tags": F.array(F.lit("en"), F.lit("zz"))})
    return found.where(test).select("item_id", "doc_id", "rank", "source_path")


def _query_strings(spark, sf):
    head = F.concat(F.lit("col:"), F.col("role"), F.lit(" tag:a,"), F.col("turn").cast("string"), F.lit("  T:pdf x:1 x:2 tags:b "))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit(""))).alias("query"))


@query
def parse_filters(spark, sf):
    q = F.col("query")
    pick = lambda k: F.try_element_at(qf.filters(q), F.lit(k))
    return _query_strings(spark, sf).select("conv_id", "turn", pick("collection").alias("collection"), pick("doc_type").alias("doc_type"), pick("x").alias("x"), qf.tags(q).alias("tags"), qf.remainder(q).alias("rest"))


@query
def query_keywords(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", qf.keywords(F.col("text")).alias("keywords"))


@query
def window_chunks(spark, sf):
    return chunks.windows(tables.corpus(spark, sf), tables.SIZE, tables.OVERLAP)


@query
def chunk_ids(spark, sf):
    return tables.chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id", ids.draft_chunk_id(F.col("file_id"), F.col("chunk_index"), F.col("text")).alias("draft_id"), ids.fallback_document_id(F.lit(None).cast("string"), F.lit(" "), F.col("source_path"), F.col("chunk_id")).alias("fallback_id"))


def _lines_as_pages(spark, sf):
    return chunks.pages(tables.corpus(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f"))))


@query
def page_extract(spark, sf):
    return _lines_as_pages(spark, sf).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("md5"))


@query
def page_offsets(spark, sf):
    return chunks.page_offsets(_lines_as_pages(spark, sf))


@query
def page_ranges(spark, sf):
    spans = chunks.page_offsets(_lines_as_pages(spark, sf)).groupBy("doc_id").agg(F.collect_list(F.struct("page", "start_offset", "end_offset")).alias("spans"))
    cut = tables.chunks(spark, sf).join(spans, "doc_id")
    r = chunks.page_range(F.col("start_offset"), F.col("end_offset"), F.col("spans"))
    return cut.select("doc_id", "chunk_index", r["page_start"].alias("page_start"), r["page_end"].alias("page_end"), r["page_num"].alias("page_num"))


@query
def rule_refine(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(text.refine(F.col("html")).cast("binary")).alias("md5"))


@query
def extract_title(spark, sf):
    return tables.corpus(spark, sf).select("doc_id", text.title(F.col("text")).alias("title"))


@query
def extract_summary(spark, sf):
    return tables.corpus(spark, sf).select("doc_id", text.summary(F.col("text")).alias("summary"))


@query
def extract_tags(spark, sf):
    """Tags of the texts with other than ASCII letters taken out, of which SQL's word ends agree."""
    plain = F.regexp_replace(F.col("text"), "[^\\x00-\\x7F]", "")
    return tables.corpus(spark, sf).select("doc_id", text.keyword_tags(plain).alias("tags"))


@query
def preview(spark, sf):
    return tables.corpus(spark, sf).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query
def normalize_doc_name(spark, sf):
    made = F.concat(F.lit(' "C:\\Docs\\'), F.col("source"), F.lit("\\File "), F.col("doc_id").cast("string"), F.lit('.v1.PDF?x=1#p" '))
    return read(spark, sf, "documents").select("doc_id", text.document_name(made).alias("name"))


@query
def numeric_accuracy(spark, sf):
    made = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("total $"), F.format_number("o_totalprice", 2), F.lit(" in year 1995")).alias("r"), F.concat(F.lit("it was "), F.round(F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3 * 0.008), 2).cast("decimal(20,2)").cast("string"), F.lit(" in all")).alias("a"))
    return made.select("o_orderkey", text.numeric_accuracy(F.col("r"), F.col("a")).alias("accuracy"))


def _catalog_chunks(spark, sf):
    c = tables.chunks(spark, sf)
    return c.select("doc_id", "chunk_index", "chunk_id", "text", F.lit("").alias("title"), "source_path", "doc_type", F.array(F.col("doc_type"), F.concat(F.lit("p"), F.col("chunk_index").cast("string"))).alias("tags"), (F.floor(F.col("chunk_index") / 3) + 1).cast("int").alias("page"))


@query
def document_catalog(spark, sf):
    return catalog.document_catalog(_catalog_chunks(spark, sf))


@query
def collection_stats(spark, sf):
    docs, cut = tables.corpus(spark, sf), tables.chunks(spark, sf)
    return catalog.collection_stats(docs, cut, cut.where("chunk_index = 1"))


@query
def chunk_stats(spark, sf):
    return tables.chunks(spark, sf).groupBy("collection").agg(F.count("*").alias("n_chunks"), F.floor(F.sum(F.length("text")) / F.count("*")).alias("avg_size"))


def _history(spark, sf):
    status = F.when(F.col("doc_id") % 3 == 0, "success").when(F.col("doc_id") % 3 == 1, "failed").otherwise("success")
    return tables.corpus(spark, sf).select(ids.short_hash(F.col("source_path"), 32).alias("file_hash"), F.col("source_path").alias("file_path"), status.alias("status"), "collection", F.format_string("2024-01-%02d", F.col("doc_id") % 28 + 1).alias("processed_at"), F.format_string("2024-01-%02d", F.col("doc_id") % 28 + 1).alias("updated_at"))


@query
def incremental_ingest(spark, sf):
    return catalog.pending(_history(spark, sf).select("file_hash", "collection", "file_path"), _history(spark, sf))


@query
def history_merge(spark, sf):
    old = _history(spark, sf)
    changed = old.where("status = 'failed'").withColumns({"status": F.lit("success"), "updated_at": F.lit("2024-02-01"), "processed_at": F.lit("2024-02-01")})
    return catalog.merge_history(old, changed)


def _chunk_hashes(spark, sf):
    return tables.chunks(spark, sf).select(ids.short_hash(F.col("source_path"), 32).alias("file_hash"), "chunk_index", "chunk_id")


@query
def list_documents(spark, sf):
    cut = _chunk_hashes(spark, sf)
    return catalog.list_documents(_history(spark, sf), cut, cut.where("chunk_index = 2"))


@query
def document_detail(spark, sf):
    return catalog.document_detail(_history(spark, sf), _chunk_hashes(spark, sf), F.col("collection") == "src7").select("file_hash", "file_path", "chunk_ids")


@query
def vector_upsert(spark, sf):
    v = read(spark, sf, "embeddings").select("vec_id", "label")
    new = v.where("label = 3").select((F.col("vec_id") + 100).alias("vec_id"), F.lit(99).alias("label"))
    return catalog.upsert(v, new, "vec_id")


@query
def delete_document(spark, sf):
    return catalog.delete(tables.corpus(spark, sf), (F.col("collection") == "src2") | F.col("source_path").startswith("docs/src1/")).select("doc_id", "source_path")


@query
def index_gap(spark, sf):
    docs = tables.corpus(spark, sf)
    return catalog.index_gap(docs.where("doc_type in ('en', 'fr')"), docs.where("doc_type in ('fr', 'de')"), "source_path")


@query
def sanitize_metadata(spark, sf):
    meta = read(spark, sf, "documents").select("doc_id", F.array("lang", "source").alias("tags"), F.array(F.struct(F.col("source").alias("id"), F.col("n_chars").alias("page"))).alias("images"))
    return catalog.sanitised(meta, ["tags"], ["images"])


def _truth(spark, sf):
    """Documents that hold a benchmark item's first keyword sequence are judged by the term that they share most rarely."""
    return _bm25(spark, sf, 3).where("rank = 2").select("item_id", "doc_id")


@query
def hit_rate_mrr(spark, sf):
    return metrics.hit_and_mrr(_dense(spark, sf).union(_bm25(spark, sf)), _truth(spark, sf), "item_id").withColumn("mrr", six("mrr"))


@query
def document_hit_rate(spark, sf):
    got = _bm25(spark, sf, 10).join(tables.corpus(spark, sf), "doc_id").select("item_id", "rank", F.col("collection").alias("document"))
    wanted = read(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit("src1"), F.lit("src2"), F.lit(""))).alias("document")).withColumn("evidence", F.col("document"))
    return metrics.document_metrics(got, wanted, "item_id").withColumns({c: six(c) for c in ("document_hit_rate", "document_mrr")})


@query
def page_hit_rate(spark, sf):
    got = _bm25(spark, sf, 10).join(tables.corpus(spark, sf), "doc_id").select("item_id", "rank", F.col("collection").alias("document"), F.when(F.col("rank") % 2 == 0, F.col("rank")).alias("page_start"), F.when(F.col("rank") % 2 == 0, F.col("rank") + 2).alias("page_end"), F.col("text").alias("result_text"))
    wanted = read(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"))).alias("document"), F.lit(5).alias("page"), F.col("text").alias("evidence_text")).withColumn("evidence", F.col("document"))
    return metrics.page_hit_rate(got, wanted, "item_id").withColumn("page_hit_rate", six("page_hit_rate"))


@query
def evidence_coverage(spark, sf):
    got = metrics.coverage(read(spark, sf, "benchmark"), tables.corpus(spark, sf), "item_id", "doc_id")
    return got.where("coverage >= 0.5").withColumn("coverage", six("coverage"))


@query
def answer_f1(spark, sf):
    docs = read(spark, sf, "conversations")
    pairs = docs.where("turn = 0").select("conv_id", F.col("text").alias("reference")).join(docs.where("turn = 1").select("conv_id", F.col("text").alias("answer")), "conv_id")
    return metrics.answer_scores(pairs, "conv_id").withColumn("token_f1", six("token_f1"))


def _metric_rows(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_type").alias("metric"), F.concat(F.lit("e"), (F.col("user_id") % 7).cast("string")).alias("experiment"), F.col("event_id").alias("case_id"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"))


@query
def metric_aggregate(spark, sf):
    return metrics.aggregate(_metric_rows(spark, sf)).withColumn("mean", six("mean"))


@query
def experiment_comparison(spark, sf):
    return experiments.comparison(_metric_rows(spark, sf), ["click", "view"]).withColumns({c: six(c) for c in ("click", "view")})


@query
def latency_stats(spark, sf):
    return metrics.latency(tables.stages(spark, sf), F.col("elapsed_ms"), "stage").withColumns({c: six(c) for c in ("avg_ms", "p50_ms", "p95_ms", "max_ms")})


def _runs(spark, sf):
    o = read(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("config_id"), F.col("o_orderpriority").alias("experiment"), (F.col("o_orderkey") % 5 / 4.0).alias("hit_rate"), (F.col("o_orderkey") % 3 / 2.0).alias("mrr"), F.col("o_orderkey").alias("created_at"))


@query
def history_best_run(spark, sf):
    return experiments.best_runs(_runs(spark, sf))


@query
def index_reuse(spark, sf):
    plans = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 10).cast("string").alias("fingerprint"))
    return experiments.index_reuse(plans)


@query
def checkpoint_resume(spark, sf):
    c = read(spark, sf, "conversations")
    saved = c.where("role = 'assistant'").select(experiments.case_key(F.concat_ws("-", "conv_id", "turn"), F.col("turn")).alias("case_key"), F.col("turn").alias("line"), F.col("role").alias("query"))
    cases = c.select(experiments.case_key(F.concat_ws("-", "conv_id", "turn"), F.col("turn")).alias("case_key"), F.col("role").alias("query"))
    return experiments.resume(cases, saved)


@query
def stage_timings(spark, sf):
    return traces.stage_timings(tables.stages(spark, sf)).withColumns({c: F.round(c, 4) for c in ("total_ms", "avg_ms", "max_ms")})


@query
def trace_diagnostics(spark, sf):
    return traces.query_hints(tables.daily(spark, sf))


@query
def ingestion_diagnostics(spark, sf):
    names = F.array(*map(F.lit, traces.INGESTION))
    s = tables.daily(spark, sf).withColumn("stage", F.get(names, (F.col("event_id") % 5).cast("int")))
    return traces.ingestion_hints(s)


@query
def recent_traces(spark, sf):
    by = tables.stages(spark, sf).groupBy("trace_id").agg(F.max("started_at").cast("string").alias("started_at"), F.count("*").alias("n_stages"))
    return traces.recent(by, 100)


@query
def rerank_threshold(spark, sf):
    return rerank.threshold(_bm25(spark, sf, 10), 20.0, "item_id").withColumn("score", six("score"))


@query
def rerank_fallback(spark, sf):
    hits = _bm25(spark, sf, 10).join(tables.corpus(spark, sf).select("doc_id", "text"), "doc_id").join(read(spark, sf, "benchmark").select("item_id", F.col("text").alias("q")), "item_id")
    got = rerank.rerank(hits, rerank.overlap_score(F.col("q"), F.col("text")), 5, F.col("item_id") % 4 == 3, "item_id")
    return got.select("item_id", "doc_id", "rank", six("score"), six("original_score"), six("rerank_score"), "reranked", "rerank_fallback")


def _results(spark, sf):
    docs = tables.corpus(spark, sf)
    meta = F.create_map(F.lit("source_path"), F.col("source_path"), F.lit("doc_type"), F.col("doc_type"), F.lit("page"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise((F.col("doc_id") % 9).cast("string")), F.lit("text"), F.lit("t"))
    return _bm25(spark, sf, 5).join(docs, "doc_id").select(F.col("item_id").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("chunk_id"), "score", "text", meta.alias("metadata"))


@query
def citations(spark, sf):
    got = response.citations(_results(spark, sf))
    return got.withColumn("cited", F.array_join(F.transform(F.map_entries("cited"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query
def response_payload(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    got = response.payload(_results(spark, sf), queries)
    return got.select("query_id", "result_count", "is_empty", F.array_join(F.transform("results", lambda r: F.concat(r["rank"].cast("string"), F.lit(":"), r["chunk_id"], F.lit(":"), F.length(r["text"]).cast("string"))), ",").alias("results"))


@query
def format_contexts(spark, sf):
    return response.contexts(_results(spark, sf)).select("query_id", F.md5(F.col("context").cast("binary")).alias("md5"))


@query
def fallback_answer(spark, sf):
    return response.fallback_answer(_results(spark, sf)).select("query_id", F.md5(F.col("answer").cast("binary")).alias("md5"))


@query
def recursive_chunks(spark, sf):
    """What holds of the recursive splitter's chunks: by document their texts are the slices at their offsets, within the size, in order, without white space at their ends, and leave only white space out."""
    docs = tables.corpus(spark, sf).select("doc_id", F.col("text").alias("body"))
    cut = chunks.recursive(tables.corpus(spark, sf), tables.SIZE, tables.OVERLAP).join(docs, "doc_id")
    by = Window.partitionBy("doc_id").orderBy("chunk_index")
    before, end = F.lag("start_offset").over(by), F.coalesce(F.lag("end_offset").over(by), F.lit(0))
    gap = F.when(F.col("start_offset") > end, F.substring(F.col("body"), end + 1, F.col("start_offset") - end)).otherwise(F.lit(""))
    good = (
        (F.substring(F.col("body"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("text"))
        & (F.length("text") <= tables.SIZE)
        & F.coalesce(F.col("start_offset") > before, F.lit(True))
        & ~F.col("text").rlike("^\\s|\\s$")
        & ~gap.rlike("\\S")
    )
    last = F.substring(F.max_by("body", "chunk_index"), F.max("end_offset") + 1, F.lit(1 << 30))
    each = cut.withColumn("good", good).groupBy("doc_id").agg(F.min("good").alias("good"), (~last.rlike("\\S")).alias("whole"))
    return each


@query
def term_statistics(spark, sf):
    t = sparse.tokenised(tables.corpus(spark, sf))
    return t.select("doc_id", "doc_length", F.size(F.array_distinct("terms")).alias("unique_terms"))


@query
def benchmark_cases(spark, sf):
    b = read(spark, sf, "benchmark")
    evidence = F.array(F.struct(F.lit(None).cast("string").alias("doc_name"), F.col("item_id").cast("int").alias("page_num"), F.col("text").alias("text")))
    none = F.lit(None).cast("string")
    rows = b.select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.lit("yes").alias("answer"), F.lit("d").alias("doc_name"), none.alias("question_type"), F.lit("r").alias("question_reasoning"), none.alias("company"), none.alias("justification"), evidence.alias("evidence"))
    got = files.benchmark_cases(rows).select("case_id", "query", F.inline("evidences"), F.map_entries("metadata").alias("m"))
    return got.select("case_id", "query", "document_name", "page_number", F.md5(F.col("text").cast("binary")).alias("md5"), F.array_join(F.transform("m", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata"))


@query
def rerank_reply(spark, sf):
    """Replies as a model writes them: some fenced, some broken; scored passages join the hits, others drop out."""
    hits = _bm25(spark, sf, 3)
    one = F.concat(F.lit('{"passage_id": "'), F.col("doc_id").cast("string"), F.lit('", "score": '), (F.col("rank") / 2).cast("string"), F.lit("}"))
    listed = hits.where("rank > 1").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(one)), ", ").alias("x"))
    reply = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n["), "x", F.lit("]\n```"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("["), "x", F.lit("]"))).otherwise("no JSON")
    scored = listed.select("item_id", F.inline(replies.scores(reply)))
    return hits.join(scored.withColumn("doc_id", F.col("passage_id").cast("long")), ["item_id", "doc_id"]).select("item_id", "doc_id", "rank", scored["score"])


@query
def judge_reply(spark, sf):
    b = read(spark, sf, "benchmark")
    reply = F.format_string('Sure: {"evidence_matches": [{"evidence_index": 2, "first_matching_rank": null}, {"evidence_index": 1, "first_matching_rank": %d}]}', F.col("item_id") % 7 + 1)
    ranks = replies.judgement(reply, F.lit(2), F.lit(5))
    return b.select("item_id", ranks.isNotNull().alias("valid"), F.get(ranks, 0).alias("first"), F.get(ranks, 1).alias("second"))


@query
def enrich_reply(spark, sf):
    reply = F.concat(F.lit("Title: Item "), F.col("item_id").cast("string"), F.lit(" \nSummary: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nTags: a, b ,,c\n"))
    x = replies.enrichment(reply)
    return read(spark, sf, "benchmark").select("item_id", x["title"].alias("title"), x["summary"].alias("summary"), x["tags"].alias("tags"))


@query
def redaction(spark, sf):
    text_ = F.concat(F.lit("api_key: k"), F.col("s_suppkey").cast("string"), F.lit(" of "), F.col("s_name"), F.lit(" token=abc"))
    return read(spark, sf, "supplier").select("s_suppkey", replies.redacted(text_, ["Supplier"]).alias("safe"))


def _ingested(spark, sf):
    docs = tables.corpus(spark, sf)
    history = docs.where("collection = 'src1'").select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), "collection", F.lit("success").alias("status"))
    return ingestion.ingest(docs, history)


@query
def ingest_chunks(spark, sf):
    return _ingested(spark, sf).select("doc_id", "chunk_index", "chunk_id", "start_offset", "end_offset", "error")


@query
def ingest_summary(spark, sf):
    return ingestion.summary(_ingested(spark, sf))


@query
def caption_images(spark, sf):
    c = read(spark, sf, "conversations")
    body = F.concat(F.lit("see [IMAGE: i"), F.col("turn").cast("string"), F.lit("] and [IMAGE: none] in "), F.col("role"))
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), body.alias("text"))
    captions = c.select("turn").distinct().select(F.concat(F.lit("i"), F.col("turn").cast("string")).alias("image_id"), F.concat(F.lit("picture "), F.col("turn").cast("string")).alias("caption"))
    return ingestion.with_captions(rows, captions)


@query
def cascade_delete(spark, sf):
    docs, cut = tables.corpus(spark, sf), tables.chunks(spark, sf)
    stores = {"documents": docs.select("source_path"), "chunks": cut.select("source_path"), "history": _history(spark, sf).select(F.col("file_path").alias("source_path"))}
    return ingestion.delete_document(stores, "source_path", "docs/src5/5.md")[1]


@query
def parsed_cache(spark, sf):
    """The cache was filled from the even collections under one configuration and all under an older one."""
    docs = tables.corpus(spark, sf).select(ids.short_hash(F.col("source_path"), 32).alias("file_hash"), "source_path", "doc_type")
    cache = docs.where("doc_type in ('en', 'de')").withColumn("config_hash", F.lit("b")).unionByName(docs.withColumn("config_hash", F.lit("a"))).withColumn("source_path", F.lit("old"))
    hits, missing = sinks.cached(docs, cache, "b")
    return hits.select("file_hash", "source_path").withColumn("hit", F.lit(True)).unionByName(missing.select("file_hash", "source_path").withColumn("hit", F.lit(False)))


@query
def hashing_embedding(spark, sf):
    """Unit vectors of all benchmark texts by the offline embedder."""
    embed = plugins.embedders.create("hashing")(64)
    got = read(spark, sf, "benchmark").select("item_id", embed(F.col("text")).alias("v"))
    return got.select("item_id", F.size("v").alias("dims"), F.round(dense.norm(F.col("v")), 5).alias("norm"))


@query
def windowed_latency(spark, sf):
    """The batch form of the streaming windows."""
    return windows.windowed_latency(tables.stages(spark, sf).select("started_at", "stage", "elapsed_ms")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "stage", "n", six("avg_ms"), six("max_ms"))


@query
def end_to_end_search(spark, sf):
    """Benchmark items as query strings with an inline filter, searched by both paths."""
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.col("text"), F.lit(" type:en")).alias("query"))
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = tables.item_vectors(spark, sf).select(F.col("item_id").alias("query_id"), "vector")
    return search.search(queries, tables.corpus(spark, sf), vectors, asked).withColumn("score", F.round("score", 9))
