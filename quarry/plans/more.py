"""Queries over the tools, evaluation, images, stored index and record operators, and DuckDB SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import query as qf
from quarry.functions import text
from quarry.operators import catalog, chunks, evaluation, images, index, tools, traces
from quarry.operators import ingest as ingestion
from quarry.operators import response as responding
from quarry.plans import search, tables
from quarry.plans.oracle import _REFINED, _STOP, _TOKEN, _with
from quarry.plans.queries import _bm25, _history, _ingested, _results, query, six
from quarry.plans.tables import read
from quarry.sources import files

SQL: dict[str, str] = {}


def oracle(sql: str):
    """Registers the SQL of a query."""

    def add(f):
        SQL[f.__name__] = sql.replace(")\n, ", "),\n")  # a body that goes on with expressions of its own
        return query(f)

    return add


def shared_folder(spark) -> str:
    """A folder that driver and executors share, below the one for checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = "/tmp/quarry"
    return f"{named}/quarry-{uuid.uuid4().hex}"


@oracle(_with("SELECT item_id, doc_id, rank, round(score, 6) AS score FROM bmr WHERE rank <= 5", "bmr"))
def index_roundtrip(spark, sf):
    """An index is saved, loaded and asked for the benchmark's terms."""
    path = shared_folder(spark)
    index.save(tables.corpus(spark, sf), path)
    return index.search(tables.item_terms(spark, sf), path, 5, "item_id").withColumn("score", six("score"))


_ENGLISH = _with(
    """, kept AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS r FROM sp JOIN corpus USING (doc_id) WHERE doc_type = 'en'),
    top AS (SELECT * FROM kept WHERE r <= 5)
    SELECT b.item_id AS query_id, count(r)::BIGINT AS result_count, count(r) = 0 AS is_empty,
           coalesce(string_agg(r || ':' || doc_id || ':' || source_path || ':' || length(top.text), ',' ORDER BY r), '') AS results, NULL::VARCHAR AS error
    FROM benchmark b LEFT JOIN top USING (item_id) GROUP BY b.item_id
    UNION ALL SELECT -1, 0, true, '', 'query cannot be empty'""",
    "sp",
    "corpus",
)


@oracle(_ENGLISH)
def search_payload(spark, sf):
    """Benchmark items as query strings with an inline filter that an explicit one overrides, through the stored index; one query is blank."""
    path = shared_folder(spark)
    corpus = tables.corpus(spark, sf)
    index.save(corpus, path)
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.col("text"), F.lit(" type:fr")).alias("query"), F.create_map(F.lit("doc_type"), F.lit("en")).alias("own"))
    blank = spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("  ").alias("query"), F.create_map(F.lit("doc_type"), F.lit("en")).alias("own"))
    got = search.answered(asked.unionByName(blank), corpus, index_path=path, explicit=F.col("own"))
    kind = "results array<struct<rank:int,chunk_id:string,text:string,source:map<string,string>>>"
    found = F.from_json("content", kind)["results"]
    shown = F.array_join(F.transform(found, lambda r: F.concat_ws(":", r["rank"].cast("string"), r["chunk_id"], r["source"]["path"], F.length(r["text"]).cast("string"))), ",")
    return got.select("query_id", "result_count", "is_empty", shown.alias("results"), "error")


@oracle(
    _with(
        f""", q AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda t: lower(t)), lambda t: length(t) >= 2)) AS q FROM benchmark),
        s AS (SELECT sp.*, len(list_intersect(q, terms)) / len(q)::DOUBLE AS o FROM sp JOIN q USING (item_id) JOIN tk USING (doc_id) WHERE rank <= 8),
        r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(o, 9) DESC, rank) AS rank, o FROM s)
        SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id, rank, round(o, 6) AS final FROM r WHERE rank <= 4""",
        "sp",
        "tk",
    )
)
def search_rerank(spark, sf):
    """Keyword search with twice as many candidates, reranked by term overlap."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    got = search.answered(asked, tables.corpus(spark, sf), reranker="overlap", top_k=4)
    kind = "results array<struct<rank:int,chunk_id:string,scores:map<string,double>>>"
    each = got.select("query_id", F.inline(F.from_json("content", kind)["results"]))
    return each.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round(F.col("scores")["final"], 6).alias("final"))


def _records(spark, sf):
    """Chunks with metadata: odd documents by reference, others by their id only; some with titles, summaries and tags."""
    d = F.col("doc_id")
    some = lambda c, v: F.when(c, v)
    pairs = {
        "source_ref": some(d % 2 == 1, F.concat(F.lit("d"), d.cast("string"), F.lit("_"))),
        "title": some(d % 5 == 0, F.concat(F.lit("Title "), d.cast("string"))),
        "summary": some((d % 7 == 0) & (F.col("chunk_index") == 1), F.lit("said so")),
        "tags": some(d % 3 == 0, F.lit(" a, b ,,EN")),
        "doc_type": F.col("doc_type"),
        "source_path": some(d % 11 != 0, F.concat(F.lit("docs/my_file-"), d.cast("string"), F.lit(".v1.md"))),
        "_hidden": F.lit("x"),
        "lang": F.col("doc_type"),
    }
    meta = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda _, v: v.isNotNull())
    cut = tables.chunks(spark, sf)
    return cut.select("doc_id", F.concat(F.lit("d"), d.cast("string"), F.lit("_"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"), "chunk_index", F.when(d % 13 == 0, F.concat(F.lit("\n # Heading of "), d.cast("string"), F.lit(" \n"), "text")).otherwise(F.col("text")).alias("text"), meta.alias("metadata"))


def _asked(spark, sf):
    return read(spark, sf, "documents").where("doc_id % 4 < 2").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_")).alias("doc_id"))


_LINES = r"list_filter(list_transform(string_split(regexp_replace(t, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#'))"


@oracle(
    _with(
        rf""", c AS (SELECT doc_id, chunk_index, doc_type, CASE WHEN doc_id % 13 = 0 THEN chr(10) || ' # Heading of ' || doc_id || ' ' || chr(10) || text ELSE text END AS t FROM ch),
        n AS (SELECT doc_id, count(*) AS n, bool_or(chunk_index = 1) AS two FROM c GROUP BY doc_id),
        p AS (SELECT *, array_to_string({_LINES}, ' ') AS p FROM c WHERE chunk_index = 0 AND doc_id % 4 < 2)
        SELECT 'd' || doc_id || '_' AS doc_id,
               CASE WHEN doc_id % 5 = 0 THEN 'Title ' || doc_id WHEN doc_id % 13 = 0 THEN 'Heading of ' || doc_id
                    WHEN doc_id % 11 <> 0 THEN 'My File ' || doc_id || '.v1' ELSE 'Untitled Document' END AS title,
               CASE WHEN doc_id % 7 = 0 AND two THEN 'said so' WHEN t = '' THEN 'No summary available.' WHEN p = '' THEN 'No content preview available.'
                    WHEN length(p) > 500 THEN substring(p, 1, 497) || '...' ELSE p END AS summary,
               CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_type = 'en' THEN 'a|b|EN' ELSE 'a|b|EN|' || upper(doc_type) END ELSE upper(doc_type) END AS tags,
               CASE WHEN doc_id % 11 <> 0 THEN 'docs/my_file-' || doc_id || '.v1.md' END AS source_path, n AS chunk_count,
               'doc_type=' || doc_type || ',lang=' || doc_type AS metadata
        FROM p JOIN n USING (doc_id)""",
        "ch",
    )
)
def document_summaries(spark, sf):
    got = tools.document_summaries(_asked(spark, sf), _records(spark, sf).drop("doc_id"))
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return got.withColumn("metadata", meta)


@oracle(
    _with(
        """, d AS (SELECT doc_id, collection, doc_type, source_path, count(*) AS n, list_sort(list_distinct(list(chunk_index // 3 + 1))) AS pages FROM ch GROUP BY ALL)
        SELECT collection, md5('## Documents in `' || collection || '` (' || count(*) || ' total, ' || sum(n)::BIGINT || ' chunks)' || chr(10) || chr(10) ||
            string_agg(i || '. **' || 'T' || doc_id % 3 || '**' || chr(10) || '   - Document ID: `' || doc_id || '`' || chr(10) || '   - Source: `' || source_path || '`' || chr(10)
                || '   - Type: ' || upper(doc_type) || chr(10) || '   - Chunks: ' || n || chr(10) || '   - Pages: ' || array_to_string(pages, ', '), chr(10) || chr(10) ORDER BY i)) AS md5
        FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY doc_id % 3, doc_id) AS i FROM d) GROUP BY collection""",
        "ch",
    )
)
def documents_list(spark, sf):
    cut = tables.chunks(spark, sf)
    docs = cut.groupBy("doc_id", "collection", "doc_type", "source_path").agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_set((F.floor(F.col("chunk_index") / 3) + 1).cast("long"))).alias("pages"))
    docs = docs.select("*", F.concat(F.lit("T"), (F.col("doc_id") % 3).cast("string")).alias("title"), F.lit(None).cast("string").alias("summary"))
    return tools.documents_text(docs).select("collection", F.md5(F.col("text").cast("binary")).alias("md5"))


@oracle(
    _with(
        """SELECT '## Available Collections (' || count(*) || ' total)' || chr(10) || chr(10) ||
            string_agg(i || '. **' || collection || '** - ' || d || CASE WHEN d = 1 THEN ' document, ' ELSE ' documents, ' END || n || CASE WHEN n = 1 THEN ' chunk' ELSE ' chunks' END || ' (owner=' || collection || ')', chr(10) ORDER BY i) AS text
        FROM (SELECT collection, count(DISTINCT doc_id) AS d, count(*) AS n, row_number() OVER (ORDER BY collection) AS i FROM ch GROUP BY collection)""",
        "ch",
    )
)
def collections_list(spark, sf):
    by = tables.chunks(spark, sf).groupBy(F.col("collection").alias("name")).agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"))
    meta = F.create_map(F.lit("owner"), F.col("name"), F.lit("_id"), F.lit("1"), F.lit("hnsw:space"), F.lit("cosine"))
    return tools.collections_text(by.withColumn("metadata", meta))


@oracle(_with("SELECT doc_id, '# ' || doc_id AS first, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'H ' || doc_id END, line) AS title FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')), lambda x: x <> '')[1] AS line FROM corpus)", "corpus"))
def loader_titles(spark, sf):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit("\n\n  # H "), F.col("doc_id").cast("string"), F.lit("  "))).otherwise(F.col("text"))
    short = F.when(F.size(F.split("text", "\n")) <= 15, body).otherwise(F.concat(F.lit("  # H "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")))
    d = tables.corpus(spark, sf).withColumn("text", F.when(F.col("doc_id") % 2 == 0, short).otherwise(F.col("text")))
    return d.select("doc_id", F.concat(F.lit("# "), F.col("doc_id").cast("string")).alias("first"), text.loader_title(F.col("text")).alias("title"))


def _cases(spark, sf):
    """Benchmark items as cases: three evidences each, two with pages, the answer repeating the question or not."""
    b = read(spark, sf, "benchmark")
    one = lambda name, page, body: F.struct(F.lit(name).alias("document_name"), F.lit(page).cast("int").alias("page_number"), body.alias("text"))
    evidences = F.array(one("Docs/SRC1.pdf", 3, F.col("text")), one("src2", None, F.col("text")), one("src3?x=1", 5, F.col("text")))
    answer = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.lit("no such thing"))
    ranks = F.array(F.when(F.col("item_id") % 3 == 0, 2), F.when(F.col("item_id") % 3 == 1, 7), F.lit(None)).cast("array<int>")
    return b.select(F.col("item_id").alias("case_id"), F.col("text").alias("query"), F.col("text").alias("reference_answer"), answer.alias("answer"), evidences.alias("evidences"), ranks.alias("evidence_ranks"), F.array(F.col("item_id").cast("string")).alias("expected_ids"))


def _case_results(spark, sf):
    """Search results whose document is in metadata under one of three names, with pages on every second rank."""
    got = _bm25(spark, sf, 10).join(tables.corpus(spark, sf).select("doc_id", "collection", "text"), "doc_id")
    key = F.element_at(F.array(F.lit("source_path"), F.lit("file_name"), F.lit("doc_name")), (F.col("rank") % 3 + 1).cast("int"))
    meta = F.map_filter(F.map_from_arrays(F.array(key, F.lit("page")), F.array(F.concat(F.lit("X\\"), "collection", F.lit(".md")), F.when(F.col("rank") % 2 == 0, F.lit("3")))), lambda _, v: v.isNotNull())
    return got.select(F.col("item_id").alias("case_id"), "rank", F.col("doc_id").cast("string").alias("chunk_id"), "text", meta.alias("metadata"))


_EVAL = """, e AS (SELECT item_id, unnest(['src1', 'src2', 'src3']) AS d FROM benchmark),
    m AS (SELECT e.item_id, e.d, min(rank) AS rank FROM e JOIN sp USING (item_id) JOIN corpus c ON c.doc_id = sp.doc_id AND e.d = c.collection WHERE rank <= 10 GROUP BY ALL),
    s AS (SELECT b.item_id, count(m.rank) FILTER (WHERE m.rank <= 5) AS n5, min(m.rank) AS r10 FROM benchmark b LEFT JOIN m USING (item_id) GROUP BY ALL)
    SELECT item_id AS case_id, 'document_hit_rate@5' AS metric, round(n5 / 3.0::DOUBLE, 6) AS value FROM s
    UNION ALL SELECT item_id, 'mrr@10', round(coalesce(1.0::DOUBLE / r10, 0), 6) FROM s
    UNION ALL SELECT item_id, 'evidence_hit_rate@5', round(CASE WHEN item_id % 3 = 0 THEN 1 / 3.0::DOUBLE ELSE 0 END, 6) FROM s
    UNION ALL SELECT item_id, 'evidence_mrr@8', round(CASE item_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1 / 7.0::DOUBLE ELSE 0 END, 6) FROM s
    UNION ALL SELECT item_id, 'answer_exact_match', CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM s"""


@oracle(_with(_EVAL, "sp", "corpus"))
def evaluate_cases(spark, sf):
    """Metrics of all cases at once; names that can't be computed are left out."""
    names = ["document_hit_rate@5", "mrr@10", "evidence_hit_rate@5", "evidence_mrr@8", "answer_exact_match", "nonsense@2", "document_mrr"]
    return evaluation.evaluate_cases(_cases(spark, sf), _case_results(spark, sf), names).withColumn("value", six("value"))


_FIRST = "FROM benchmark b LEFT JOIN sp s ON s.item_id = b.item_id AND s.doc_id = b.item_id AND s.rank <= 10 GROUP BY b.item_id"


@oracle(_with(f"SELECT b.item_id AS case_id, 'hit_rate' AS metric, CASE WHEN min(s.rank) IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS value {_FIRST} UNION ALL SELECT b.item_id, 'mrr', round(coalesce(1.0::DOUBLE / min(s.rank), 0), 6) {_FIRST}", "sp"))
def composite_evaluation(spark, sf):
    """Two evaluators give hit_rate, of which the last counts; a third can't be planned and is left out."""
    doubled = lambda cases, results: evaluation.custom_evaluator(["hit_rate"])(cases, results).withColumn("value", F.col("value") * 2)
    broken = lambda cases, results: cases.select("no such column")
    parts = [evaluation.custom_evaluator(), broken, evaluation.no_evaluator, doubled]
    return evaluation.composite_evaluator(parts)(_cases(spark, sf), _case_results(spark, sf)).withColumn("value", six("value"))


@oracle("SELECT item_id AS case_id, text AS query, 'Docs/SRC1.pdf|src2|src3?x=1' AS expected_documents, '3|5' AS expected_pages, md5(text) AS evidence, md5(text) AS answer FROM benchmark")
def ground_truth(spark, sf):
    got = evaluation.ground_truth(_cases(spark, sf))
    return got.select("case_id", "query", "expected_documents", "expected_pages", F.md5(F.array_join("expected_evidence", "|").cast("binary")).alias("evidence"), F.md5(F.col("reference_answer").cast("binary")).alias("answer"))


@oracle(_with("SELECT item_id AS case_id, rank, doc_id::VARCHAR AS identifier, collection AS documents, CASE WHEN rank % 2 = 0 THEN '3-3' ELSE '' END AS pages, length(text) AS n_chars FROM sp JOIN corpus USING (doc_id) WHERE rank <= 10", "sp", "corpus"))
def extracted_fields(spark, sf):
    got = evaluation.extracted(_case_results(spark, sf))
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), ",")
    return got.select("case_id", "rank", "identifier", F.array_join("documents", "|").alias("documents"), pages.alias("pages"), F.length("body").alias("n_chars"))


@oracle("SELECT event_type AS metric FROM events WHERE event_id % 5 > 0 UNION SELECT 'planned' UNION SELECT 'summed'")
def metric_union(spark, sf):
    from quarry.plans.queries import _metric_rows

    one = lambda name: spark.range(1).select(F.array(F.lit(name), F.lit("planned")).alias("metrics"))
    return evaluation.metric_names(one("planned"), one("summed"), _metric_rows(spark, sf))


@oracle("SELECT count(*) AS n_queries, round(greatest(sum(value), 0.001), 4) AS total_elapsed_ms FROM events")
def report_total(spark, sf):
    got = evaluation.report_total(read(spark, sf, "events").select(F.col("value").alias("elapsed_ms")))
    return got.withColumn("total_elapsed_ms", F.round("total_elapsed_ms", 4))


@oracle("SELECT 'src1' AS document, NULL::VARCHAR AS path, (SELECT count(*) FROM (SELECT DISTINCT source FROM documents) WHERE lower(source) = 'src1') * 2 AS n_files UNION ALL SELECT 'src2', (SELECT 'b/' || max(source) || '.pdf' FROM documents WHERE source = 'src2'), (SELECT count(DISTINCT source) FROM documents WHERE source = 'src2') UNION ALL SELECT 'src3', NULL, 0")
def evidence_files(spark, sf):
    """Documents that evidences name, one with two files, one with one, one with none."""
    s = read(spark, sf, "documents").select("source").distinct()
    listed = s.where("source = 'src1'").select(F.explode(F.array(F.lit("a/src1.pdf"), F.lit("b/SRC1.md"))).alias("path")).unionByName(s.where("source = 'src2'").select(F.concat(F.lit("b/"), "source", F.lit(".pdf")).alias("path")))
    return evaluation.evidence_documents(_cases(spark, sf), listed)


def _settings(spark, sf):
    o = read(spark, sf, "orders")
    nested = F.to_json(F.struct(F.struct((F.col("o_custkey") % 5 * 100).alias("chunk_size"), F.struct(F.lit(True).alias("use_llm")).alias("chunk_refiner"), F.array().cast("array<string>").alias("metadata_enricher")).alias("ingestion"), F.struct(F.lit("hashing").alias("provider")).alias("embedding"), F.struct((F.col("o_custkey") % 2 == 0).alias("enable_dense"), F.lit(0.25).alias("dense_weight")).alias("retrieval")))
    return o.select((F.col("o_orderkey") % 20).cast("string").alias("run"), F.col("o_orderkey").cast("string").alias("name"), nested.alias("settings"), F.col("o_orderkey"), "o_custkey")


@oracle(
    """SELECT o_orderkey::VARCHAR AS name, 'characters' AS length_unit, (o_custkey % 5 * 100)::VARCHAR AS chunk_size, '{"use_llm":true}' AS chunk_refiner, '' AS metadata_enricher, 'hashing' AS embedding_provider,
       CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS dense_enabled, 'true' AS sparse_enabled, '0.25' AS dense_weight, '0.5' AS sparse_weight, 'false' AS rerank_enabled, '' AS llm_model FROM orders"""
)
def history_config_columns(spark, sf):
    shown = ("length_unit", "chunk_size", "chunk_refiner", "metadata_enricher", "embedding_provider", "dense_enabled", "sparse_enabled", "dense_weight", "sparse_weight", "rerank_enabled", "llm_model")
    return _settings(spark, sf).select("name", *evaluation.config_columns()).select("name", *shown)


@oracle("SELECT o_orderkey::VARCHAR AS experiment, '2024-' || (o_orderkey % 20) AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 99 ELSE o_orderkey % 7 END AS sample_size, (o_custkey % 5 * 100)::VARCHAR AS chunk_size FROM orders WHERE o_orderkey % 20 < 15")
def history_join(spark, sf):
    """Summaries with their run and plan; a quarter of the runs is unknown."""
    s = _settings(spark, sf)
    runs = s.select("run").distinct().where("cast(run AS int) < 15").select("run", F.concat(F.lit("2024-"), "run").alias("created_at"), F.lit(99).cast("long").alias("case_count"))
    summaries = s.select("run", F.col("name").alias("experiment"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 7).alias("query_count"), F.lit(1.0).alias("total_elapsed_ms"), F.lit(0.5).alias("hit_rate"), F.lit(0.5).alias("mrr"))
    return evaluation.history_rows(runs, s.select("run", "name", "settings"), summaries).select("experiment", "created_at", "sample_size", F.get_json_object("settings", "$.ingestion.chunk_size").alias("chunk_size"))


@oracle(_with("SELECT query_id AS case_id, rank, doc_id::VARCHAR AS id, md5(text) AS md5, round(score, 6) AS score FROM res", "res"))
def retrieved_items(spark, sf):
    r = _results(spark, sf).select(F.col("query_id").alias("case_id"), "rank", "chunk_id", F.col("text").alias("content"), F.col("score").cast("string").alias("relevance_score"))
    return evaluation.retrieved_items(r).select("case_id", "rank", "id", F.md5(F.col("text").cast("binary")).alias("md5"), six("score"))


@oracle(_with("SELECT query_id, rank, doc_id::VARCHAR AS chunk_id, round_even(score, 4) AS score, length(text) AS n_chars, source_path AS source FROM res", "res"))
def trace_snapshot(spark, sf):
    return traces.snapshot(_results(spark, sf)).select("query_id", "rank", "chunk_id", "score", F.length("text").alias("n_chars"), "source")


def _image_results(spark, sf):
    """Results with images as JSON, as a Python literal or as placeholders, and captions."""
    i = F.col("item_id")
    named = F.format_string('[{"id": "i%d", "path": "a/%d.png", "page": 2}, {"id": "j%d"}]', i, i, i)
    python = F.format_string("[{'id': 'i%d', 'path': None, 'page': 3}]", i)
    raw = F.when(i % 3 == 0, named).when(i % 3 == 1, python)
    captions = F.when(i % 2 == 0, F.format_string('{"i%d": "seen"}', i)).otherwise(F.format_string('[{"id": "i%d", "caption": "told"}]', i))
    meta = F.map_filter(F.map_from_arrays(F.array(F.lit("images"), F.lit("image_captions")), F.array(raw, captions)), lambda _, v: v.isNotNull())
    return read(spark, sf, "benchmark").select(i.alias("query_id"), F.lit(1).alias("rank"), F.format_string("see [IMAGE: i%d] and [IMAGE:k%d ] here", i, i).alias("text"), meta.alias("metadata"))


_REFS = """SELECT item_id AS query_id, 1 AS rank, p AS position, CASE WHEN p = 0 THEN 'i' WHEN item_id % 3 = 0 THEN 'j' ELSE 'k' END || item_id AS image_id,
    CASE WHEN p = 0 AND item_id % 3 = 0 THEN 'a/' || item_id || '.png' END AS path, CASE WHEN p = 0 THEN CASE item_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END END AS page,
    CASE WHEN p = 0 THEN CASE WHEN item_id % 2 = 0 THEN 'seen' ELSE 'told' END END AS caption
    FROM benchmark, (SELECT unnest([0, 1]) AS p) WHERE NOT (item_id % 3 = 1 AND p = 1)"""


@oracle(_REFS)
def image_references(spark, sf):
    return images.references(_image_results(spark, sf))


@oracle(f"SELECT query_id, count(*) AS n_images FROM ({_REFS}) GROUP BY query_id")
def image_counts(spark, sf):
    return images.counts(images.references(_image_results(spark, sf)))


@oracle("SELECT item_id AS query_id, 'i' || item_id AS image_id, CASE WHEN item_id % 3 = 0 THEN 'image/png' WHEN item_id % 2 = 0 THEN 'image/gif' ELSE 'image/jpeg' END AS mime_type, base64(encode(CASE WHEN item_id % 2 = 0 THEN 'GIF89a' ELSE 'xx' END || item_id)) AS data, CASE WHEN item_id % 2 = 0 THEN 'seen' ELSE 'told' END AS caption FROM benchmark WHERE item_id % 3 = 0 OR item_id % 2 = 0")
def image_blocks(spark, sf):
    """Images by their own path, else by the register; those of odd items that only the register knows have no file."""
    b = read(spark, sf, "benchmark")
    i = F.col("item_id")
    register = b.select(F.format_string("i%d", i).alias("image_id"), F.format_string("reg/%d", i).alias("file_path"))
    content = F.encode(F.concat(F.when(i % 2 == 0, "GIF89a").otherwise("xx"), i.cast("string")), "UTF-8")
    stored = b.where("item_id % 3 = 0").select(F.format_string("a/%d.png", i).alias("path"), content.alias("content")).unionByName(b.where("item_id % 2 = 0").select(F.format_string("reg/%d", i).alias("path"), content.alias("content"))).unionByName(b.select(F.format_string("none/%d", i).alias("path"), F.encode(F.lit(""), "UTF-8").alias("content")))
    return images.assembled(images.references(_image_results(spark, sf)), register, stored).select("query_id", "image_id", "mime_type", "data", "caption")


def _register(spark, sf):
    d = F.col("doc_id")
    return read(spark, sf, "documents").select(F.format_string("img%d", d).alias("image_id"), F.format_string("p/%d.png", d).alias("file_path"), F.col("source").alias("collection"), (d % 50).cast("string").alias("doc_hash"), (d % 9).cast("int").alias("page_num"), F.format_string("2024-01-%02d", d % 28 + 1).alias("created_at"))


@oracle("SELECT 'img' || doc_id AS image_id, CASE WHEN doc_id % 10 = 0 THEN 'new/' || doc_id ELSE 'p/' || doc_id || '.png' END AS file_path, source AS collection FROM documents WHERE source <> 'src4' AND doc_id % 50 <> 7 UNION ALL SELECT 'extra', 'late', 'src1'")
def image_register(spark, sf):
    """Images registered anew and once more, then those of a collection and of a document removed."""
    base = _register(spark, sf)
    new = base.where("cast(substring(image_id, 4) AS long) % 10 = 0").withColumn("file_path", F.concat(F.lit("new/"), F.substring("image_id", 4, 20)))
    extra = spark.range(2).select(F.lit("extra").alias("image_id"), F.when(F.col("id") == 1, "late").otherwise("early").alias("file_path"), F.lit("src1").alias("collection"), F.lit("h").alias("doc_hash"), F.lit(1).alias("page_num"), F.when(F.col("id") == 1, "2025").otherwise("2024").alias("created_at"))
    all_ = images.register(base, new.unionByName(extra))
    return images.unregister(images.unregister(all_, collection="src4"), doc_hash="7").select("image_id", "file_path", "collection")


@oracle("SELECT source AS collection, count(*) AS n_images, count(DISTINCT doc_id % 50) AS n_documents FROM documents GROUP BY source")
def image_stats(spark, sf):
    return images.stats(_register(spark, sf))


@oracle("SELECT 'img' || item_id AS image_id, CASE WHEN item_id IN (SELECT doc_id FROM documents) THEN 'p/' || item_id || '.png' END AS file_path FROM benchmark")
def image_paths(spark, sf):
    asked = read(spark, sf, "benchmark").select(F.format_string("img%d", "item_id").alias("image_id"))
    return images.paths(asked, _register(spark, sf))


_MATERIAL = r""", x AS (SELECT w.doc_id, chunk_index, start_offset, end_offset, w.text, source_path FROM win w JOIN corpus USING (doc_id))
    SELECT x.doc_id, x.chunk_index, x.doc_id || '_' || lpad(x.chunk_index::VARCHAR, 4, '0') || '_' || left(sha256(x.text), 8) AS chunk_id, x.source_path,
           x.doc_id::VARCHAR AS source_ref, x.start_offset::VARCHAR AS start_offset, min(p.page)::VARCHAR AS page_start, max(p.page)::VARCHAR AS page_end, CASE WHEN min(p.page) = max(p.page) THEN min(p.page)::VARCHAR END AS page_num, count(*) FILTER (WHERE FALSE) AS n_images
    FROM x LEFT JOIN (SELECT doc_id, page, start_offset, start_offset + n AS end_offset FROM po) p ON p.doc_id = x.doc_id AND x.start_offset < p.end_offset AND x.end_offset > p.start_offset
    GROUP BY ALL"""


@oracle(_with(_MATERIAL, "win", "corpus", "po"))
def chunk_records(spark, sf):
    """Windows as records that inherit their document's metadata and pages."""
    from quarry.plans.queries import _lines_as_pages

    spans = chunks.page_offsets(_lines_as_pages(spark, sf)).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "start_offset", "end_offset")).alias("page_spans"))
    none = F.array().cast("array<struct<id:string,path:string,page:int>>")
    docs = tables.corpus(spark, sf).join(spans, "doc_id", "left").select("doc_id", F.create_map(F.lit("source_path"), F.col("source_path"), F.lit("images"), F.lit("x"), F.lit("chunk_index"), F.lit("old")).alias("metadata"), "page_spans", none.alias("images"))
    got = chunks.materialised(chunks.windows(tables.corpus(spark, sf), tables.SIZE, tables.OVERLAP), docs)
    pick = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return got.select("doc_id", "chunk_index", "chunk_id", *map(pick, ("source_path", "source_ref", "start_offset", "page_start", "page_end", "page_num")), F.size("images").alias("n_images"))


@oracle(_with("SELECT doc_id, chunk_index, length(text) AS n_chars, true AS fits, true AS later FROM win", "win"))
def located_chunks(spark, sf):
    """Windows found again in their texts, each behind the start of the one before."""
    cut = chunks.windows(tables.corpus(spark, sf).where("text IS NOT NULL"), tables.SIZE, tables.OVERLAP)
    pieces = cut.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("pieces"))
    docs = tables.corpus(spark, sf).select("doc_id", "text").join(pieces, "doc_id")
    got = chunks.locate(docs).join(docs, "doc_id")
    piece = F.get("pieces", F.col("chunk_index"))
    before = F.lag("start_offset").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    fits = F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == piece
    return got.select("doc_id", "chunk_index", F.length(piece).alias("n_chars"), fits.alias("fits"), F.coalesce(F.col("start_offset") > before, F.lit(True)).alias("later"))


@oracle("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings")
def batches(spark, sf):
    return chunks.batched(read(spark, sf, "embeddings").select("vec_id"), 32, "vec_id")


@oracle(_with("SELECT doc_id, page, md5(text) AS md5 FROM (SELECT doc_id, page, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM pg) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, md5(replace(text, chr(10), chr(12))) FROM corpus WHERE doc_id % 2 = 1 AND text IS NOT NULL", "pg", "corpus"))
def page_strategies(spark, sf):
    """Form feeds count as page ends where their number fits the known page count; it is right for even documents."""
    d = tables.corpus(spark, sf).where("text IS NOT NULL").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f")))
    parts = F.split("text", "\f", -1)
    n = F.size(parts) - F.when(F.trim(F.element_at(parts, -1)) == "", 1).otherwise(0)
    got = files.paged(d.withColumn("page_count", F.when(F.col("doc_id") % 2 == 0, n).otherwise(n + 7)))
    return got.select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("md5"))


@oracle("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'doc_' || left(sha256(text), 16) END AS id, CASE doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' ELSE 'pdf' END AS doc_type, CASE WHEN doc_id % 3 = 2 THEN 'no parser for pdf' END AS error FROM documents WHERE trim(text) <> ''")
def load_documents(spark, sf):
    """Files of three kinds, one without a parser."""
    d = read(spark, sf, "documents").where("trim(text) <> ''")
    suffix = F.element_at(F.array(F.lit("txt"), F.lit("md"), F.lit("pdf")), (F.col("doc_id") % 3 + 1).cast("int"))
    stored = d.select(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"), F.encode("text", "UTF-8").alias("content"))
    got = files.load_documents(stored, {})
    return got.select(F.regexp_extract("source_path", "([0-9]+)", 1).cast("long").alias("doc_id"), F.when(F.col("error").isNull(), F.col("doc_id")).alias("id"), "doc_type", "error")


@oracle("SELECT p_partkey, p_partkey % 4 = 0 AS safe FROM part")
def archive_safety(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.format_string("a/b%d..txt", k)).when(k % 4 == 1, F.format_string("a/../../b%d", k)).when(k % 4 == 2, F.format_string("/b%d", k)).otherwise(F.format_string("C:\\b%d", k))
    return read(spark, sf, "part").select("p_partkey", files.safe_member(name).alias("safe"))


@oracle(_with("SELECT count(*) FILTER (WHERE doc_id % 2 = 0) AS pdf_count, (SELECT count(*) FROM benchmark) AS case_count, (SELECT min(item_id) FROM benchmark) AS first_case_id FROM corpus", "corpus"))
def preparation_summary(spark, sf):
    d = read(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".md")).alias("path"))
    return tools.preparation_summary(d, read(spark, sf, "benchmark").select(F.col("item_id").alias("case_id")))


@oracle("SELECT conv_id, turn, lower(role) AS role FROM conversations WHERE contains(lower(coalesce(text, '')), 'the') OR role = 'system'")
def trace_search(spark, sf):
    """Traces that mention a word in their metadata or stages."""
    c = read(spark, sf, "conversations")
    word = F.when(F.col("role") == "system", F.concat(F.lit("THE "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    t = c.select("conv_id", "turn", "role", F.create_map(F.lit("query"), word).alias("metadata"), F.array(F.struct(F.lit("dense").alias("stage"))).alias("stages"))
    return traces.matching(t, "The").select("conv_id", "turn", F.lower("role").alias("role"))


def _nested(spark, sf):
    """One trace for each user: stages in the order of events, every third in the older layout."""
    s = tables.stages(spark, sf)
    inner = F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("chunks"), F.concat(F.lit('[{"chunk_id": "c'), F.col("event_id").cast("string"), F.lit('", "score": 0.5, "source": "s"}]')))
    old = F.map_concat(inner, F.create_map(F.lit("stage"), F.col("stage"), F.lit("elapsed_ms"), F.lit("1")))
    legacy = F.col("event_id") % 3 == 0
    one = F.struct("event_id", "stage", F.when(F.col("event_id") % 4 > 0, F.col("elapsed_ms")).alias("elapsed_ms"), F.when(~legacy, inner).alias("data"), F.when(legacy, old).alias("legacy"))
    return s.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["event_id"] < b["event_id"], -1).otherwise(1)), lambda x: F.struct(x["stage"].alias("stage"), x["elapsed_ms"].alias("elapsed_ms"), x["data"].alias("data"), x["legacy"].alias("legacy"))).alias("stages"))


@oracle(_with("SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) - 1 AS position, stage, CASE WHEN event_id % 4 > 0 THEN elapsed_ms ELSE 0 END AS elapsed_ms, n::VARCHAR AS n, 2 AS n_fields FROM st", "st"))
def trace_stages(spark, sf):
    got = traces.flattened(_nested(spark, sf))
    return got.select("trace_id", "position", "stage", "elapsed_ms", F.try_element_at("data", F.lit("n")).alias("n"), F.size("data").alias("n_fields"))


@oracle(_with("SELECT trace_id, arg_max(n, event_id)::VARCHAR AS n FROM st WHERE stage = 'fusion' GROUP BY trace_id", "st"))
def trace_stage_data(spark, sf):
    """The data of each trace's last fusion stage."""
    got = traces.stage_data(traces.flattened(_nested(spark, sf)), "fusion")
    return got.select("trace_id", F.try_element_at("data", F.lit("n")).alias("n"))


@oracle(_with("SELECT trace_id, stage, 'c' || event_id AS chunk_id, 0.5::DOUBLE AS score FROM st UNION ALL SELECT DISTINCT trace_id, 'final', 'f' || trace_id, 1.0::DOUBLE FROM st WHERE trace_id % 2 = 0", "st"))
def trace_chunks(spark, sf):
    """The chunks that stages list, and final results of every second trace."""
    nested = _nested(spark, sf)
    t = F.col("trace_id")
    finals = nested.select(t, F.when(t % 2 == 0, F.concat(F.lit('[{"chunk_id": "f'), t.cast("string"), F.lit('", "score": 1.0}]'))).alias("results"))
    return traces.stage_chunks(traces.flattened(nested), finals).drop("source")


@oracle(_with("SELECT stage, CASE WHEN elapsed_ms >= 0.8 THEN 'high' WHEN elapsed_ms >= 0.5 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, sum(greatest(1, length(stage) // 3))::BIGINT AS tokens FROM st GROUP BY ALL", "st"))
def score_bands(spark, sf):
    s = tables.stages(spark, sf)
    return s.groupBy("stage", traces.score_band(F.col("elapsed_ms")).alias("band")).agg(F.count("*").alias("n"), F.sum(traces.estimated_tokens(F.col("stage"))).alias("tokens"))


@oracle("SELECT o_orderkey AS query_id, o_clerk || ' collection:' || c AS query, k AS top_k, 2 * k AS candidates FROM (SELECT o_orderkey, o_orderpriority AS o_clerk, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'default' END AS c, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 10 END AS k FROM orders WHERE o_orderstatus <> 'O')")
def trace_reevaluation(spark, sf):
    """Stored query traces as queries to run again; some lack their query, collection or top_k."""
    o = read(spark, sf, "orders")
    pairs = {"query": F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")), "collection": F.when(F.col("o_orderkey") % 2 == 0, "x"), "top_k": F.when(F.col("o_orderkey") % 3 == 0, "7")}
    meta = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda _, v: v.isNotNull())
    return evaluation.reevaluated(o.select(F.col("o_orderkey").alias("trace_id"), meta.alias("metadata")), reranking=True)


@oracle(_with("SELECT count(*) AS n_stale, 0 AS n_missing, count(*) = 0 AS complete FROM corpus WHERE doc_type = 'en'", "corpus"))
def index_completeness(spark, sf):
    docs = tables.corpus(spark, sf)
    return catalog.complete(docs, docs.where("doc_type <> 'en'"), "source_path")


@oracle("SELECT source AS collection, count(*) AS n FROM documents GROUP BY source")
def store_counts(spark, sf):
    return catalog.store_counts(tables.corpus(spark, sf))


@oracle(_with("SELECT file_hash, file_path, CASE WHEN status = 'failed' THEN 'success' ELSE status END AS status, processed_at, CASE WHEN status = 'failed' THEN '2024-03-01' ELSE updated_at END AS updated_at FROM hist WHERE collection <> 'src9'", "hist"))
def history_marks(spark, sf):
    """Failed files marked as done, which keeps the time of their first processing, then a collection's removed."""
    h = _history(spark, sf)
    failed = h.where("status = 'failed'").select("file_hash", "file_path", "collection")
    columns = h.withColumn("error_msg", F.lit(None).cast("string")).select("file_hash", "file_path", "status", "collection", "error_msg", "processed_at", "updated_at")
    done = catalog.marked(columns, failed, "success", "2024-03-01")
    return catalog.removed(done, done.where("collection = 'src9'")).select("file_hash", "file_path", "status", "processed_at", "updated_at")




@oracle("SELECT s_suppkey, round(s_acctbal, 4)::DOUBLE AS number, s_acctbal::BIGINT >= 0 OR TRUE AS known, CASE WHEN abs(s_acctbal) >= 1000 THEN printf('%.2f s', abs(s_acctbal) / 1000) ELSE printf('%.1f ms', abs(s_acctbal)) END AS shown FROM supplier")
def display_values(spark, sf):
    s = read(spark, sf, "supplier")
    number = text.display_number(F.col("s_acctbal").cast("string")).cast("double")
    return s.select("s_suppkey", number.alias("number"), (text.number_or_zero(F.lit("x")) == 0).alias("known"), text.duration(F.abs("s_acctbal")).alias("shown"))


@oracle("SELECT b.item_id, count(*) AS n_terms FROM (SELECT item_id, unnest(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM benchmark) b GROUP BY 1")
def plain_terms(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.size(qf.plain_terms(F.col("text"))).alias("n_terms")).where("n_terms > 0")


@oracle(_with("SELECT query_id, md5('T' || chr(10) || chr(10) || 'Query: q' || chr(10) || chr(10) || 'Passages:' || chr(10) || string_agg('Passage ID: ' || doc_id || chr(10) || 'Text: ' || coalesce(text, '') || chr(10), chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Output your response as a JSON array of objects, one per passage.') AS md5 FROM res GROUP BY query_id", "res"))
def rerank_prompts(spark, sf):
    listed = _results(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").alias("id"), "text"))).alias("p"))
    return listed.select("query_id", F.md5(tools.rerank_prompt("T", F.lit("q"), F.col("p")).cast("binary")).alias("md5"))


@oracle(_with("SELECT query_id, md5('<results>' || chr(10) || string_agg('<result rank=\"' || rank || '\" chunk_id=\"' || doc_id || '\" score=\"' || printf('%.4f', round_even(round_even(score, 6), 4)) || '\" source=\"' || source_path || '\"' || CASE WHEN doc_id % 3 = 0 THEN ' page=\"x\"' ELSE ' page=\"' || doc_id % 9 || '\"' END || '><![CDATA[' || text || ']]></result>', chr(10) ORDER BY rank) || chr(10) || '</results>') AS md5 FROM res GROUP BY query_id", "res"))
def render_xml(spark, sf):
    return responding.rendered(_results(spark, sf), "xml").select("query_id", F.md5(F.col("content").cast("binary")).alias("md5"))


@oracle(_with(f", r AS (SELECT *, {_REFINED} AS t FROM ch) SELECT count(*) FILTER (WHERE t <> '') AS n_chunks, floor(sum(length(t)) / count(*) FILTER (WHERE t <> ''))::BIGINT AS avg_size, count(*) FILTER (WHERE t <> '' AND length(t) < end_offset - start_offset) AS n_refined FROM r WHERE (collection, file_id) NOT IN (SELECT 'src1', 'doc_' || left(sha256(text), 16) FROM corpus WHERE collection = 'src1')", "ch", "corpus"))
def ingest_counts(spark, sf):
    return ingestion.stage_counts(_ingested(spark, sf)).select("n_chunks", "avg_size", "n_refined")




@oracle("SELECT item_id, k AS kept FROM (SELECT b.item_id, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(text, '{token}')) AS w FROM benchmark) b WHERE lower(w) NOT IN ({stop}) OR lower(w) = 'the' GROUP BY 1)".replace("{token}", _TOKEN).replace("{stop}", _STOP + ", 'of'"))
def stopword_changes(spark, sf):
    """Tokens left by stop-words of which one is taken out."""
    words = qf.stopwords(add=("of",), remove=("The",))
    kept = F.filter(text.tokens(F.col("text")), lambda t: ~F.lower(t).isin(words))
    return read(spark, sf, "benchmark").select("item_id", F.size(kept).alias("kept")).where("kept > 0")


@oracle("SELECT vec_id, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id % 100 = 0")
def dense_mixed_dimensions(spark, sf):
    """Vectors of two dimensions and one with a null: each query finds itself among those of its own dimension."""
    v = read(spark, sf, "embeddings")
    short = v.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.slice("embedding", 1, 8).alias("embedding"))
    broken = v.select((F.col("vec_id") + 2_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i != 3, x)).alias("embedding"))
    from quarry.operators import dense

    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = dense.dense_topk(asked, v.select("vec_id", "embedding").unionByName(short).unionByName(broken), 1)
    return got.select("vec_id", six("score"))


@oracle("SELECT item_id, md5(text) AS md5, 'hashing' AS embedder FROM benchmark")
def plugin_transform(spark, sf):
    """Texts through a registered transform that leaves them alone, with the names that are known."""
    keep = plugins.transforms.create("none")
    return read(spark, sf, "benchmark").select("item_id", F.md5(keep(F.col("text")).cast("binary")).alias("md5"), F.lit(next(iter(plugins.embedders.known))).alias("embedder"))




@query
def seeded_sample(spark, sf):
    """Ten cases drawn by a seed, the same as Python's generator draws from the sorted keys."""
    return files.seeded_sample(read(spark, sf, "benchmark").select(F.col("item_id").alias("case_id")), 10, 42)


