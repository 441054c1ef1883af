"""DuckDB SQL for the rows of each query of ``queries.py``."""

from __future__ import annotations

from quarry.functions.query import STOPWORDS
from quarry.plans.tables import OVERLAP, SIZE

_TOKEN = r"[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_STEP = SIZE - OVERLAP

#: Common table expressions by name, with those they need.
_CTES = {
    "corpus": ((), "SELECT doc_id, text, source AS collection, lang AS doc_type, 'docs/' || source || '/' || doc_id || '.md' AS source_path FROM documents"),
    "tk": (("corpus",), f"SELECT doc_id, collection, doc_type, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'), lambda t: lower(t)), lambda t: length(t) >= 2) AS terms FROM corpus"),
    "posts": (("tk",), "SELECT doc_id, term, count(*) AS tf, dl AS doc_length FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tk) GROUP BY doc_id, term, dl"),
    "stats": (("tk",), "SELECT count(*) AS num_docs, coalesce(avg(len(terms)), 0) AS avgdl FROM tk"),
    "dfs": (("posts",), "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM posts GROUP BY term"),
    "words": ((), f"SELECT item_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS w, generate_subscripts(regexp_extract_all(text, '{_TOKEN}'), 1) AS i FROM benchmark"),
    "qterms": (("words",), f"SELECT item_id, term FROM (SELECT item_id, lower(w) AS term, min(i) AS i FROM words GROUP BY ALL) WHERE length(term) >= 2 AND term NOT IN ({_STOP}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 20"),
    "bm": (("qterms", "posts", "stats", "dfs"), "SELECT item_id, doc_id, sum(ln((num_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / avgdl))) AS score FROM qterms JOIN posts USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY item_id, doc_id"),
    "bmr": (("bm",), "SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, score FROM bm"),
    "sp": (("bmr",), "SELECT * FROM bmr WHERE rank <= 20"),
    "dnall": ((), "SELECT b.item_id, v.vec_id AS doc_id, (1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2 AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v"),
    "dn": (("dnall",), "SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank, score FROM dnall QUALIFY rank <= 20"),
    "lists": (("dn", "sp"), "SELECT *, 0 AS l FROM dn UNION ALL SELECT *, 1 AS l FROM sp"),
    "chunks0": (("corpus",), f"SELECT doc_id, unnest(range(0, CASE WHEN length(text) <= {SIZE} THEN 1 ELSE (ceil((length(text) - {SIZE}) / {_STEP}::DOUBLE) + 1)::BIGINT END)) AS chunk_index, text AS body FROM corpus WHERE length(text) > 0"),
    "win": (("chunks0",), f"SELECT doc_id, chunk_index, chunk_index * {_STEP} AS start_offset, least(chunk_index * {_STEP} + {SIZE}, length(body)) AS end_offset, substring(body, (chunk_index * {_STEP} + 1)::BIGINT, {SIZE}) AS text FROM chunks0"),
    "ch": (("win",), "SELECT w.*, c.collection, c.doc_type, c.source_path, 'doc_' || left(sha256(c.text), 16) || '_' || left(sha256(c.source_path), 8) || '_' || lpad(w.chunk_index::VARCHAR, 4, '0') || '_' || left(sha256(w.text), 8) AS chunk_id, 'doc_' || left(sha256(c.text), 16) AS file_id FROM win w JOIN corpus c USING (doc_id)"),
    "pg0": (("corpus",), "SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS p FROM corpus WHERE text IS NOT NULL"),
    "pg": (("pg0",), "SELECT doc_id, unnest(q) AS text, generate_subscripts(q, 1) AS page FROM (SELECT doc_id, CASE WHEN trim(p[-1]) = '' THEN p[:-2] ELSE p END AS q FROM pg0)"),
    "po": (("pg",), "SELECT doc_id, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset, length(text) AS n FROM pg"),
    "hist": (("corpus",), "SELECT left(sha256(source_path), 32) AS file_hash, source_path AS file_path, CASE WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'success' END AS status, collection, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS processed_at, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS updated_at FROM corpus"),
    "chh": (("ch",), "SELECT left(sha256(source_path), 32) AS file_hash, chunk_index, chunk_id FROM ch"),
    "st": ((), "SELECT user_id AS trace_id, CASE event_type WHEN 'click' THEN 'dense_retrieval' WHEN 'view' THEN 'sparse_retrieval' WHEN 'purchase' THEN 'fusion' ELSE event_type END AS stage, ts AS started_at, value AS elapsed_ms, json_extract_string(props, '$.k')::BIGINT AS n, event_id FROM events"),
    "daily": (("st",), "SELECT trace_id || '-' || strftime(started_at, '%Y%m%d') AS trace_id, stage, CASE WHEN n > 3 THEN n ELSE 0 END AS n, CASE WHEN elapsed_ms < 0.5 THEN 'late' END AS error, event_id FROM st"),
    "mrows": ((), "SELECT event_type AS metric, 'e' || (user_id % 7) AS experiment, event_id AS case_id, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events"),
    "conv": ((), "SELECT conv_id, turn, trim(regexp_replace('col:' || role || ' tag:a,' || turn || '  T:pdf x:1 x:2 tags:b ' || coalesce(text, ''), '\\s+', ' ', 'g')) AS q FROM conversations"),
    "res": (("bmr", "corpus"), "SELECT item_id AS query_id, rank, doc_id, score, text, source_path, doc_type FROM bmr JOIN corpus USING (doc_id) WHERE rank <= 5"),
}


def _with(body: str, *names: str) -> str:
    """A statement with the common table expressions it names, each once and after those it needs."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return ("WITH " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" if order else "") + body


def _normal(text: str) -> str:
    """Evidence normalisation, for texts that lower case folds but for the sharp s; RE2 knows no \\s beyond ASCII, which the class covers with \\p{Z}."""
    return f"trim(regexp_replace(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '[\\p{{P}}\\p{{S}}\\p{{Z}}\\s\\x0B]+', ' ', 'g'))"


def _shared(reference: str, text: str) -> str:
    """Whether a text has half of a reference's tokens, as multisets."""
    a, b = (f"string_split({_normal(x)}, ' ')" for x in (reference, text))
    return f"2 * coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda y: y = t))))), 0) >= len({a})"


def _counts(table: str, key: str, text: str, name: str) -> str:
    return f"SELECT {key}, token, count(*) AS {name} FROM (SELECT {key}, unnest(string_split({_normal(text)}, ' ')) AS token FROM {table}) WHERE token <> '' GROUP BY ALL"


_INDEX = "SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf, sum(tf)::BIGINT AS total_tf FROM p CROSS JOIN (SELECT count(*) AS n FROM t) GROUP BY term, n"
_POSTS = "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY doc_id, term"
_RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY round(score, 9) DESC, {1})"
_VECTORS = "SELECT q.vec_id AS query_id, v.vec_id, (1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2 AS score FROM embeddings q JOIN embeddings v ON {0} WHERE q.vec_id % 100 = 0"
_HYBRID = "SELECT item_id, doc_id, rank, round(score, {1}) AS score, mode FROM (SELECT item_id, doc_id, mode, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, mode, sum(CASE WHEN mode = 'fused' THEN 0.5::DOUBLE / (60 + rank) ELSE score END) AS score FROM (SELECT *, CASE WHEN max(l) OVER w = 1 AND min(l) OVER w = 0 THEN 'fused' WHEN max(l) OVER w = 0 THEN 'dense' ELSE 'sparse' END AS mode FROM {0} WINDOW w AS (PARTITION BY item_id)) GROUP BY ALL)) WHERE rank <= 10"
_E2E = _HYBRID.format("lists", 9)
_RRF = "SELECT item_id, doc_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, sum({0} / (60 + rank)) AS score FROM lists GROUP BY ALL)) WHERE rank <= 10"
_REFINED = r"""CASE WHEN trim(text) = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t\x0B\f\r]+$', '', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') END"""
_SENTENCE = r"regexp_replace(trim(regexp_split_to_array(text, '[.!?][\s\x0B]+')[1], ' '), '[.!?]+$', '')"
_LINE = "trim(string_split(text, chr(10))[1], ' ')"

ORACLE_SQL: dict[str, str] = {
    "corpus_stats": _with("SELECT num_docs, round(avgdl, 6) AS avg_doc_length, (SELECT coalesce(sum(len(terms)), 0)::BIGINT FROM tk) AS total_tokens FROM stats", "stats"),
    "term_statistics": _with("SELECT doc_id, len(terms) AS doc_length, len(list_distinct(terms)) AS unique_terms FROM tk", "tk"),
    "term_frequency": _with("SELECT doc_id, term, tf, doc_length FROM posts", "posts"),
    "document_frequency": _with("SELECT term, df FROM dfs", "dfs"),
    "bm25_index": _with(f", t AS (SELECT doc_id, terms FROM tk), p AS ({_POSTS}) {_INDEX}", "tk"),
    "bm25_remove": _with(f", t AS (SELECT doc_id, terms FROM tk WHERE collection <> 'src3'), p AS ({_POSTS}) {_INDEX}", "tk"),
    "bm25_add": _with(f", t AS (SELECT doc_id, CASE WHEN doc_type = 'en' THEN list_append(terms, 'added') ELSE terms END AS terms FROM tk), p AS ({_POSTS}) {_INDEX}", "tk"),
    "bm25_topk": _with("SELECT item_id, doc_id, rank, round(score, 6) AS score FROM bmr WHERE rank <= 5", "bmr"),
    "top_terms": _with("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rank, term, tf FROM posts QUALIFY rank <= 10", "posts"),
    "sparse_retrieve": _with("SELECT item_id, doc_id, rank, round(score, 6) AS score, collection, length(text) AS n_chars FROM bmr JOIN corpus USING (doc_id) WHERE rank <= 5", "bmr", "corpus"),
    "dense_topk": f"SELECT query_id, vec_id, {_RANKED.format('query_id', 'vec_id')} AS rank, round(score, 6) AS score FROM ({_VECTORS.format('TRUE')}) QUALIFY rank <= 10",
    "dense_filtered_topk": f"SELECT query_id, vec_id, {_RANKED.format('query_id', 'vec_id')} AS rank, round(score, 6) AS score FROM ({_VECTORS.format('q.label = v.label')}) QUALIFY rank <= 10",
    "vector_dims": "SELECT count(*) AS n_vectors, count(DISTINCT len(embedding)) AS n_dims, max(len(embedding)) AS dim, count(DISTINCT len(embedding)) <= 1 AS consistent FROM embeddings",
    "rrf_fusion": _with(_RRF.format("1.0::DOUBLE"), "lists"),
    "weighted_rrf": _with(_RRF.format("CASE l WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END"), "lists"),
    "interleave": _with("SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY turn) AS rank, round(score, 6) AS score FROM (SELECT item_id, doc_id, min(2 * rank + l) AS turn, arg_min(score, 2 * rank + l) AS score FROM lists GROUP BY ALL) QUALIFY rank <= 10", "lists"),
    "hybrid_search": _with(_HYBRID.format("lists", 9), "lists"),
    "hybrid_single_list": _with(_HYBRID.format("(SELECT * FROM lists WHERE l = 1 OR item_id IN (SELECT vec_id FROM embeddings WHERE label < 5))", 6), "lists"),
    "metadata_filter": _with("SELECT item_id, doc_id, rank, source_path FROM sp JOIN corpus USING (doc_id) WHERE doc_type = 'en' AND contains(source_path, '/src1')", "sp", "corpus"),
    "parse_filters": _with(r"""SELECT conv_id, turn,
        list_filter(m, lambda x: lower(regexp_extract(x, '^[^:]*')) IN ('col', 'collection', 'c'))[-1].regexp_replace('^[^:]*:', '') AS collection,
        list_filter(m, lambda x: lower(regexp_extract(x, '^[^:]*')) IN ('type', 'doc_type', 't'))[-1].regexp_replace('^[^:]*:', '') AS doc_type,
        list_filter(m, lambda x: regexp_extract(x, '^[^:]*') = 'x')[-1].regexp_replace('^[^:]*:', '') AS x,
        array_to_string(list_transform(list_filter(m, lambda x: lower(regexp_extract(x, '^[^:]*')) IN ('tag', 'tags')), lambda x: replace(regexp_replace(x, '^[^:]*:', ''), ',', '|')), '|') AS tags,
        trim(regexp_replace(regexp_replace(q, '[\p{L}\p{N}_]+:[^\s]+', '', 'g'), '\s+', ' ', 'g')) AS rest
        FROM (SELECT *, regexp_extract_all(q, '[\p{L}\p{N}_]+:[^\s]+') AS m FROM conv)""", "conv"),
    "query_keywords": _with(f"SELECT b.item_id, coalesce(k, '') AS keywords FROM benchmark b LEFT JOIN (SELECT item_id, string_agg(w, '|' ORDER BY i) AS k FROM (SELECT item_id, arg_min(w, i) AS w, min(i) AS i FROM words GROUP BY item_id, lower(w) HAVING lower(w) NOT IN ({_STOP}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(i)) <= 20) GROUP BY item_id) USING (item_id)", "words"),
    "window_chunks": _with("SELECT * FROM win", "win"),
    "chunk_ids": _with("SELECT doc_id, chunk_index, chunk_id, file_id || '_' || lpad(chunk_index::VARCHAR, 4, '0') || '_' || left(sha256(text), 8) AS draft_id, 'doc_path_' || left(sha256(source_path), 16) AS fallback_id FROM ch", "ch"),
    "page_extract": _with("SELECT doc_id, page, md5(text) AS md5 FROM pg", "pg"),
    "page_offsets": _with("SELECT doc_id, page, start_offset, start_offset + n AS end_offset FROM po", "po"),
    "page_ranges": _with("SELECT c.doc_id, c.chunk_index, min(p.page) AS page_start, max(p.page) AS page_end, CASE WHEN min(p.page) = max(p.page) THEN min(p.page) END AS page_num FROM (SELECT * FROM ch WHERE doc_id IN (SELECT doc_id FROM po)) c LEFT JOIN po p ON p.doc_id = c.doc_id AND c.start_offset < p.start_offset + p.n AND c.end_offset > p.start_offset GROUP BY ALL", "ch", "po"),
    "rule_refine": r"""SELECT page_id, md5(CASE WHEN trim(html) = '' THEN '' ELSE regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t\x0B\f\r]+$', '', 'g'),
        '^[\s\x0B]+|[\s\x0B]+$', '', 'g') END) AS md5 FROM pages""",
    "extract_title": _with(rf"""SELECT doc_id, CASE
        WHEN coalesce(text, '') = '' THEN 'Untitled'
        WHEN trim(regexp_extract(text, '^#{{1,6}}[\s\x0B]+([^\n]+)', 1)) <> '' THEN trim(regexp_extract(text, '^#{{1,6}}[\s\x0B]+([^\n]+)', 1))
        WHEN {_LINE} <> '' AND length({_LINE}) <= 100 AND NOT regexp_matches({_LINE}, '[.,;]$') THEN {_LINE}
        WHEN {_SENTENCE} <> '' AND length({_SENTENCE}) <= 150 THEN {_SENTENCE}
        WHEN {_SENTENCE} <> '' THEN substring({_SENTENCE}, 1, 147) || '...'
        ELSE trim(substring(text, 1, 100)) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END END AS title FROM corpus""", "corpus"),
    "extract_summary": _with(r"""SELECT doc_id, CASE WHEN length(s) > 500 THEN substring(s, 1, 497) || '...' ELSE s END AS summary FROM (
        SELECT doc_id, regexp_replace(array_to_string(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1))[1:3], ' '), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS s FROM corpus)""", "corpus"),
    "extract_tags": _with(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
            regexp_extract_all(t, '\b[A-Z][a-z]+(?:[\s\x0B]+[A-Z][a-z]+)*\b')[1:5],
            regexp_extract_all(t, '\b[a-z]+(?:[A-Z][a-z]*)+\b|\b[a-z]+_[a-z_]+\b')[1:5],
            list_filter(list_transform(regexp_extract_all(t, '\*\*.+?\*\*|\*.+?\*|__.+?__|_.+?_')[1:5], lambda x: trim(regexp_replace(x, '^(\*\*|\*|__|_)|(\*\*|\*|__|_)$', '', 'g'))), lambda x: x <> ''))))[1:10], '|') AS tags
        FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM corpus)""", "corpus"),
    "recursive_chunks": _with("SELECT doc_id, true AS good, true AS whole FROM corpus WHERE regexp_matches(text, '\\S')", "corpus"),
    "preview": _with(r"SELECT doc_id, CASE WHEN length(p) > 240 THEN substring(p, 1, 237) || '...' ELSE nullif(p, '') END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B]+', ' ', 'g')) AS p FROM corpus)", "corpus"),
    "normalize_doc_name": "SELECT doc_id, 'file ' || doc_id || '.v1' AS name FROM documents",
    "numeric_accuracy": "SELECT o_orderkey, CASE WHEN abs(r - a) <= greatest(0.01 * greatest(abs(r), abs(a)), 1e-6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM (SELECT o_orderkey, round(o_totalprice, 2) AS r, round(o_totalprice * (1 + o_orderkey % 3 * 0.008::DOUBLE), 2) AS a FROM orders)",
    "document_catalog": _with(r"""SELECT doc_id, arg_min(regexp_replace(source_path, '^.*/|\.md$', '', 'g'), chunk_index) AS title, arg_min(source_path, chunk_index) AS source_path, arg_min(doc_type, chunk_index) AS doc_type,
        arg_min(coalesce(p, '<>'), chunk_index).nullif('<>') AS summary, string_agg(chunk_id, '|' ORDER BY chunk_index) AS chunk_ids,
        arg_min(doc_type, chunk_index) || '|' || string_agg('p' || chunk_index, '|' ORDER BY chunk_index) AS tags,
        array_to_string(list_sort(list_distinct(list(chunk_index // 3 + 1))), '|') AS pages
        FROM (SELECT *, CASE WHEN length(q) > 240 THEN substring(q, 1, 237) || '...' ELSE nullif(q, '') END AS p FROM (SELECT *, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) AS q FROM ch)) GROUP BY doc_id""", "ch"),
    "collection_stats": _with("SELECT collection, count(DISTINCT c.doc_id) AS n_documents, coalesce(any_value(x.n), 0) AS n_chunks, coalesce(any_value(x.i), 0) AS n_images FROM corpus c LEFT JOIN (SELECT collection, count(*) AS n, count(*) FILTER (WHERE chunk_index = 1) AS i FROM ch GROUP BY collection) x USING (collection) GROUP BY collection", "ch"),
    "chunk_stats": _with("SELECT collection, count(*) AS n_chunks, floor(sum(length(text)) / count(*))::BIGINT AS avg_size FROM ch GROUP BY collection", "ch"),
    "incremental_ingest": _with("SELECT file_hash, collection, file_path FROM hist h WHERE NOT EXISTS (SELECT 1 FROM hist s WHERE s.status = 'success' AND s.file_hash = h.file_hash AND s.collection = h.collection)", "hist"),
    "history_merge": _with("SELECT file_hash, file_path, 'success' AS status, collection, processed_at, CASE WHEN status = 'failed' THEN '2024-02-01' ELSE updated_at END AS updated_at FROM hist", "hist"),
    "list_documents": _with("SELECT h.*, coalesce(n, 0) AS n_chunks, coalesce(i, 0) AS n_images FROM hist h LEFT JOIN (SELECT file_hash, count(*) AS n, count(*) FILTER (WHERE chunk_index = 2) AS i FROM chh GROUP BY 1) USING (file_hash) WHERE status = 'success'", "hist", "chh"),
    "document_detail": _with("SELECT h.file_hash, h.file_path, coalesce(c, '') AS chunk_ids FROM hist h LEFT JOIN (SELECT file_hash, string_agg(chunk_id, '|' ORDER BY chunk_index) AS c FROM chh GROUP BY 1) USING (file_hash) WHERE collection = 'src7'", "hist", "chh"),
    "vector_upsert": "SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id + 100 FROM embeddings WHERE label = 3) UNION ALL SELECT vec_id + 100, 99 FROM embeddings WHERE label = 3",
    "delete_document": _with("SELECT doc_id, source_path FROM corpus WHERE collection NOT IN ('src1', 'src2')", "corpus"),
    "index_gap": _with("SELECT source_path, CASE doc_type WHEN 'en' THEN 'stale' ELSE 'missing' END AS state FROM corpus WHERE doc_type IN ('en', 'de')", "corpus"),
    "sanitize_metadata": """SELECT doc_id, lang || ',' || source AS tags, '[{"id":"' || source || '","page":' || n_chars || '}]' AS images FROM documents""",
    "hit_rate_mrr": _with("SELECT t.item_id, CASE WHEN min(r.rank) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit_rate, coalesce(round(1.0::DOUBLE / min(r.rank), 6), 0) AS mrr FROM (SELECT item_id, doc_id FROM sp WHERE rank = 2) t LEFT JOIN lists r ON r.item_id = t.item_id AND r.doc_id = t.doc_id GROUP BY t.item_id", "lists"),
    "document_hit_rate": _with("SELECT item_id, round(count(r) / count(*)::DOUBLE, 6) AS document_hit_rate, coalesce(round(1.0::DOUBLE / min(r), 6), 0) AS document_mrr FROM (SELECT b.item_id, e.d, min(x.rank) AS r FROM benchmark b CROSS JOIN (VALUES ('src1'), ('src2')) e(d) LEFT JOIN (SELECT item_id, rank, collection FROM bmr JOIN corpus USING (doc_id) WHERE rank <= 10) x ON x.item_id = b.item_id AND x.collection = e.d GROUP BY ALL) GROUP BY item_id", "bmr", "corpus"),
    "page_hit_rate": _with(f"SELECT item_id, round(count(*) FILTER (WHERE h) / count(*)::DOUBLE, 6) AS page_hit_rate FROM (SELECT b.item_id, e.d, max(coalesce(CASE WHEN x.rank % 2 = 0 THEN 5 BETWEEN x.rank AND x.rank + 2 ELSE x.text IS NOT NULL AND {_normal('b.text')} <> '' AND (contains({_normal('x.text')}, {_normal('b.text')}) OR {_shared('b.text', 'x.text')}) END, FALSE)) AS h FROM benchmark b CROSS JOIN (VALUES ('src1'), ('src2'), ('src3')) e(d) LEFT JOIN (SELECT item_id, rank, collection, text FROM bmr JOIN corpus USING (doc_id) WHERE rank <= 10) x ON x.item_id = b.item_id AND x.collection = e.d GROUP BY ALL) GROUP BY item_id", "bmr", "corpus"),
    "evidence_coverage": f"WITH r AS ({_counts('benchmark', 'item_id', 'text', 'n1')}), c AS ({_counts('documents', 'doc_id', 'text', 'n2')}), t AS (SELECT item_id, sum(n1) AS total FROM r GROUP BY 1) SELECT item_id, doc_id, round(sum(least(n1, n2)) / any_value(total)::DOUBLE, 6) AS coverage FROM r JOIN c USING (token) JOIN t USING (item_id) GROUP BY ALL HAVING sum(least(n1, n2)) / any_value(total)::DOUBLE >= 0.5",
    "answer_f1": f"""WITH p AS (SELECT a.conv_id, a.text AS r, b.text AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
        r AS ({_counts('p', 'conv_id', 'r', 'n1')}), a AS ({_counts('p', 'conv_id', 'a', 'n2')}),
        m AS (SELECT conv_id, sum(least(n1, n2)) AS c FROM r JOIN a USING (conv_id, token) GROUP BY 1)
        SELECT p.conv_id, CASE WHEN {_normal('p.r')} = {_normal('p.a')} AND {_normal('p.r')} <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
        coalesce(round(2.0::DOUBLE * c / ((SELECT sum(n1) FROM r WHERE r.conv_id = p.conv_id) + (SELECT sum(n2) FROM a WHERE a.conv_id = p.conv_id)), 6), 0) AS token_f1 FROM p LEFT JOIN m USING (conv_id)""",
    "metric_aggregate": _with("SELECT metric, round(avg(value), 6) AS mean, count(value) AS n FROM mrows GROUP BY metric", "mrows"),
    "experiment_comparison": _with("SELECT experiment, count(DISTINCT case_id) AS query_count, round(avg(value) FILTER (WHERE metric = 'click'), 6) AS click, round(avg(value) FILTER (WHERE metric = 'view'), 6) AS view FROM mrows GROUP BY experiment", "mrows"),
    "latency_stats": _with("SELECT stage, count(*) AS n, round(avg(elapsed_ms), 6) AS avg_ms, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50_ms, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95_ms, round(max(elapsed_ms), 6) AS max_ms FROM st WHERE elapsed_ms >= 0 GROUP BY stage", "st"),
    "history_best_run": "WITH r AS (SELECT (o_custkey % 50)::VARCHAR AS config_id, o_orderpriority AS experiment, (o_orderkey % 5 / 4.0::DOUBLE) AS hit_rate, (o_orderkey % 3 / 2.0::DOUBLE) AS mrr, o_orderkey AS created_at FROM orders) SELECT b.*, run_count, experiment_aliases FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY config_id ORDER BY coalesce(nullif(hit_rate, 0), -1) DESC, coalesce(nullif(mrr, 0), -1) DESC, created_at DESC, experiment) = 1) b JOIN (SELECT config_id, count(*) AS run_count, string_agg(DISTINCT experiment, '|' ORDER BY experiment) AS experiment_aliases FROM r GROUP BY 1) USING (config_id)",
    "index_reuse": "SELECT position, name, fingerprint, nullif(f, name) AS reuses_index_of FROM (SELECT s_suppkey AS position, s_name AS name, (s_nationkey % 10)::VARCHAR AS fingerprint, first_value(s_name) OVER (PARTITION BY s_nationkey % 10 ORDER BY s_suppkey) AS f FROM supplier)",
    "checkpoint_resume": "SELECT 'id:' || conv_id || '-' || turn AS case_key, role AS query, role = 'assistant' AS reused FROM conversations",
    "stage_timings": _with("SELECT stage, count(*) AS n, round(sum(elapsed_ms), 4) AS total_ms, round(avg(elapsed_ms), 4) AS avg_ms, round(max(elapsed_ms), 4) AS max_ms FROM st GROUP BY stage", "st"),
    "trace_diagnostics": _with("""SELECT trace_id, array_to_string(list_filter([
            CASE WHEN ed IS NOT NULL THEN 'dense_failed' WHEN nd = 0 AND hd THEN 'dense_empty' END,
            CASE WHEN es IS NOT NULL THEN 'sparse_failed' WHEN ns = 0 AND hs THEN 'sparse_empty' END,
            CASE WHEN NOT hf AND nd > 0 AND ns > 0 THEN 'fusion_missing' WHEN NOT hf THEN 'fusion_skipped' END,
            CASE WHEN nd > 0 OR ns > 0 THEN 'rerank_skipped' END,
            CASE WHEN nd = 0 AND ns = 0 THEN 'no_results' END], lambda x: x IS NOT NULL), '|') AS hints
        FROM (SELECT trace_id, bool_or(stage = 'dense_retrieval') AS hd, bool_or(stage = 'sparse_retrieval') AS hs, bool_or(stage = 'fusion') AS hf,
            coalesce(max(n) FILTER (WHERE stage = 'dense_retrieval'), 0) AS nd, coalesce(max(n) FILTER (WHERE stage = 'sparse_retrieval'), 0) AS ns,
            max(error) FILTER (WHERE stage = 'dense_retrieval') AS ed, max(error) FILTER (WHERE stage = 'sparse_retrieval') AS es FROM daily GROUP BY trace_id)""", "daily"),
    "ingestion_diagnostics": _with("""SELECT trace_id, array_to_string(list_filter(e, lambda x: NOT list_contains(seen, x)), '|') AS missing, array_to_string(list_filter(e, lambda x: list_contains(none, x)), '|') AS empty
        FROM (SELECT trace_id, ['load', 'split', 'transform', 'embed', 'upsert'] AS e, list(s) AS seen, coalesce(list(s) FILTER (WHERE n = 0), []) AS none FROM (SELECT *, ['load', 'split', 'transform', 'embed', 'upsert'][event_id % 5 + 1] AS s FROM daily) GROUP BY trace_id)""", "daily"),
    "recent_traces": _with("SELECT trace_id, max(started_at)::VARCHAR AS started_at, count(*) AS n_stages FROM st GROUP BY trace_id ORDER BY max(started_at) DESC, trace_id LIMIT 100", "st"),
    "rerank_threshold": _with("SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS b FROM bmr WHERE rank <= 10) WHERE score >= 20 OR (b < 20 AND rank = 1)", "bmr"),
    "rerank_fallback": _with(f""", h AS (SELECT item_id, doc_id, rank AS old, score, count(*) OVER (PARTITION BY item_id) AS n, item_id % 4 = 3 AS bad FROM bmr WHERE rank <= 10),
        qt AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda t: lower(t)), lambda t: length(t) >= 2)) AS q FROM benchmark),
        s AS (SELECT h.*, NOT bad AND n > 1 AS reranked, CASE WHEN NOT bad AND n > 1 THEN len(list_intersect(q, terms)) / len(q)::DOUBLE END AS rs FROM h JOIN qt USING (item_id) JOIN tk USING (doc_id))
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(rs, 9) DESC NULLS LAST, old) AS rank, round(coalesce(rs, score), 6) AS score, round(score, 6) AS original_score, round(rs, 6) AS rerank_score, reranked, bad AND n > 1 AS rerank_fallback FROM s QUALIFY rank <= 5""", "bmr", "tk"),
    "citations": _with("SELECT query_id, rank AS index, doc_id::VARCHAR AS chunk_id, source_path AS source, round_even(score, 4) AS score, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 9 END AS page, 'doc_type=' || doc_type AS cited FROM res", "res"),
    "response_payload": _with("SELECT item_id AS query_id, count(r.rank) AS result_count, count(r.rank) = 0 AS is_empty, coalesce(string_agg(r.rank || ':' || r.doc_id || ':' || length(r.text), ',' ORDER BY r.rank), '') AS results FROM benchmark b LEFT JOIN res r ON r.query_id = b.item_id GROUP BY item_id", "res"),
    "format_contexts": _with("SELECT query_id, md5(string_agg('[' || rank || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS md5 FROM res GROUP BY query_id", "res"),
    "fallback_answer": _with("SELECT query_id, md5(string_agg(text, ' ' ORDER BY rank)) AS md5 FROM res GROUP BY query_id", "res"),
    "benchmark_cases": "SELECT item_id::VARCHAR AS case_id, trim(text) AS query, 'd' AS document_name, item_id + 1 AS page_number, md5(trim(text)) AS md5, 'doc_name=d,reasoning=r' AS metadata FROM benchmark",
    "rerank_reply": _with("SELECT item_id, doc_id, rank, rank / 2.0::DOUBLE AS score FROM bmr WHERE rank IN (2, 3) AND item_id % 3 <> 2", "bmr"),
    "judge_reply": "SELECT item_id, item_id % 7 + 1 <= 5 AS valid, CASE WHEN item_id % 7 + 1 <= 5 THEN item_id % 7 + 1 END AS first, NULL::BIGINT AS second FROM benchmark",
    "enrich_reply": "SELECT item_id, 'Item ' || item_id AS title, trim(replace(text, chr(10), ' ')) AS summary, 'a|b|c' AS tags FROM benchmark",
    "redaction": "SELECT s_suppkey, 'api_key: *** of ' || replace(s_name, 'Supplier', '***') || ' token=***' AS safe FROM supplier",
    "ingest_chunks": _with(f", r AS (SELECT *, {_REFINED} AS t FROM ch WHERE (collection, file_id) NOT IN (SELECT 'src1', 'doc_' || left(sha256(text), 16) FROM corpus WHERE collection = 'src1')) SELECT doc_id, chunk_index, CASE WHEN t <> '' THEN file_id || '_' || left(sha256(source_path), 8) || '_' || lpad(chunk_index::VARCHAR, 4, '0') || '_' || left(sha256(t), 8) END AS chunk_id, start_offset, end_offset, CASE WHEN t = '' THEN 'the chunk is empty after refining' END AS error FROM r", "ch"),
    "ingest_summary": _with(f", r AS (SELECT *, {_REFINED} AS t FROM ch WHERE (collection, file_id) NOT IN (SELECT 'src1', 'doc_' || left(sha256(text), 16) FROM corpus WHERE collection = 'src1')) SELECT count(DISTINCT doc_id) AS n_documents, count(DISTINCT doc_id) FILTER (WHERE t = '') AS n_failed, count(*) FILTER (WHERE t <> '') AS n_chunks, CASE WHEN count(DISTINCT doc_id) FILTER (WHERE t = '') = 0 THEN 0::BIGINT WHEN count(*) FILTER (WHERE t <> '') = 0 THEN 2 ELSE 1 END AS exit_code FROM r", "ch"),
    "caption_images": "SELECT conv_id || '-' || turn AS chunk_id, 'see [IMAGE: i' || turn || ']' || chr(10) || '(Description: picture ' || turn || ') and [IMAGE: none] in ' || role AS text FROM conversations",
    "cascade_delete": _with("SELECT 'documents' AS store, count(*) AS n_deleted FROM corpus WHERE source_path = 'docs/src5/5.md' UNION ALL SELECT 'chunks', count(*) FROM ch WHERE source_path = 'docs/src5/5.md' UNION ALL SELECT 'history', count(*) FROM hist WHERE file_path = 'docs/src5/5.md'", "ch", "hist"),
    "parsed_cache": _with("SELECT left(sha256(source_path), 32) AS file_hash, source_path, doc_type IN ('en', 'de') AS hit FROM corpus", "corpus"),
    "hashing_embedding": "SELECT item_id, 64::BIGINT AS dims, 1.0::DOUBLE AS norm FROM benchmark",
    "windowed_latency": _with("SELECT strftime(started_at, '%Y-%m-%d') AS day, stage, count(*) AS n, round(avg(elapsed_ms), 6) AS avg_ms, round(max(elapsed_ms), 6) AS max_ms FROM st GROUP BY ALL", "st"),
    "end_to_end_search": _with(f", m AS ({_E2E}) SELECT item_id AS query_id, doc_id, rank, score FROM m JOIN corpus USING (doc_id) WHERE doc_type = 'en'", "lists", "corpus"),
}
# statements that go on with expressions of their own have a comma where the others have the body
ORACLE_SQL = {k: v.replace(")\n, ", "),\n") for k, v in ORACLE_SQL.items()}
