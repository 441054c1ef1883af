"""Known facts about the operators, their plans, sources, sinks and streams."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import catalog, chunks, dense, experiments, fusion, ingest, metrics, rerank, response, sparse
from quarry.plans import queries, search, tables
from quarry.sources import files, sinks
from quarry.streaming import ingest as stream_ingest
from quarry.streaming import windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_bm25_by_hand(spark):
    docs = frame(spark, [(1, "machine learning machine machine learning"), (2, "machine stuff here"), (3, "python code"), (4, "other words"), (5, "more words")], "doc_id long, text string")
    got = sparse.bm25_topk(frame(spark, [(0, ["machine", "learning"])], "query_id long, terms array<string>"), docs, 5).collect()
    assert [x["doc_id"] for x in got] == [1, 2]
    n, avg = 5, (5 + 3 + 2 + 2 + 2) / 5
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[0]["score"] == pytest.approx(part(3, 5, 2) + part(2, 5, 1))
    twice = sparse.bm25_topk(frame(spark, [(0, ["learning", "learning"])], "query_id long, terms array<string>"), docs, 1).first()
    assert twice["score"] == pytest.approx(2 * part(2, 5, 1))


def test_idf(spark):
    assert spark.range(1).select(sparse.idf(F.lit(3), F.lit(1)).alias("x")).first()["x"] == pytest.approx(math.log(2.5 / 1.5))


def lists(spark):
    a = frame(spark, [(0, "a", 1, 0.9), (0, "b", 2, 0.8)], "query_id long, doc_id string, rank int, score double")
    b = frame(spark, [(0, "b", 1, 7.0), (0, "c", 2, 6.0)], "query_id long, doc_id string, rank int, score double")
    return a, b


def test_fusion(spark):
    a, b = lists(spark)
    got = {x["doc_id"]: x["score"] for x in fusion.rrf([a, b], 10).collect()}
    assert got == pytest.approx({"b": 1 / 62 + 1 / 61, "a": 1 / 61, "c": 1 / 62})
    got = {x["doc_id"]: x["score"] for x in fusion.rrf([a, b], 10, (0.7, 0.3)).collect()}
    assert got == pytest.approx({"a": 0.7 / 61, "b": 0.7 / 62 + 0.3 / 61, "c": 0.3 / 62})
    assert [x["doc_id"] for x in fusion.interleave([a, b], 3).orderBy("rank").collect()] == ["a", "b", "c"]
    for bad in ((1.0,), (-1.0, 1.0), (0.0, 0.0)):
        with pytest.raises(ValueError):
            fusion.rrf([a, b], 3, bad)
    with pytest.raises(ValueError):
        fusion.rrf([a, b], 3, smoothing=0)
    assert "CartesianProduct" not in plan(fusion.rrf([a, b], 10))


def test_ties_go_by_key(spark):
    a = frame(spark, [(0, "z", 1, 1.0)], "query_id long, doc_id string, rank int, score double")
    b = frame(spark, [(0, "a", 1, 1.0)], "query_id long, doc_id string, rank int, score double")
    assert [x["doc_id"] for x in fusion.rrf([a, b], 2).orderBy("rank").collect()] == ["a", "z"]


def test_hybrid_passes_a_single_list(spark):
    a, _ = lists(spark)
    got = fusion.hybrid(a, a.limit(0), 5).orderBy("rank").collect()
    assert [(x["score"], x["mode"]) for x in got] == [(0.9, "dense"), (0.8, "dense")]


def test_top_k_is_pruned_before_the_sort(spark, sf):
    assert "WindowGroupLimit" in plan(queries.QUERIES["bm25_topk"](spark, sf))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>" in plan(queries.QUERIES["dense_topk"](spark, sf)) or "embedding" in plan(queries.QUERIES["dense_topk"](spark, sf))
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src7)]" in plan(tables.corpus(spark, sf).where("collection = 'src7'"))


def test_dense(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = dense.dense_topk(frame(spark, [(0, [2.0, 0.0])], "query_id long, vector array<float>"), v, 3).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(1, 1.0), (3, 0.5), (2, 0.0)]
    assert dense.dimensions(v).first()["consistent"]


def test_rerank(spark):
    rows = frame(spark, [(0, 1, 5.0, "a", "x"), (0, 2, 4.0, "b", "y z"), (1, 1, 3.0, "c", "y")], "query_id long, rank int, score double, doc_id string, text string")
    got = rerank.rerank(rows, rerank.overlap_score(F.lit("yy zz"), F.lit("yy")), 5).collect()
    assert sorted((x["doc_id"], x["reranked"]) for x in got) == [("a", True), ("b", True), ("c", False)]
    failed = rerank.rerank(rows, F.lit(1.0), 1, F.col("query_id") == 0).where("query_id = 0").first()
    assert (failed["doc_id"], failed["rerank_fallback"], failed["score"]) == ("a", True, 5.0)
    assert [x["doc_id"] for x in rerank.threshold(rows, 4.5).orderBy("doc_id").collect()] == ["a", "c"]


def test_chunks(spark):
    docs = frame(spark, [(1, "abcdefghij"), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    got = [(x["doc_id"], x["text"], x["start_offset"], x["end_offset"]) for x in chunks.windows(docs, 5, 2).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, "abcde", 0, 5), (1, "defgh", 3, 8), (1, "ghij", 6, 10), (4, "abc", 0, 3)]
    for size, overlap in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunks.windows(docs, size, overlap)
    rows = chunks.recursive(frame(spark, [(1, "One para.\n\nTwo para is longer than that. End")], "doc_id long, text string"), 20, 5).collect()
    body = "One para.\n\nTwo para is longer than that. End"
    assert all(body[x["start_offset"] : x["end_offset"]] == x["text"] for x in rows)
    paged = chunks.pages(frame(spark, [(1, "a\fbb\f ")], "doc_id long, text string"))
    assert [(x["page"], x["start_offset"], x["end_offset"]) for x in chunks.page_offsets(paged).orderBy("page").collect()] == [(1, 0, 1), (2, 3, 5)]


def test_history_keeps_the_first_time(spark):
    schema = schemas.HISTORY
    old = frame(spark, [("h", "p", "failed", "c", "e", "t1", "t1"), ("i", "q", "success", None, None, "t1", "t1")], schema)
    new = frame(spark, [("h", "p", "success", "c", None, "t2", "t2"), ("i", "q", "success", None, None, "t3", "t3")], schema)
    got = {x["file_hash"]: x for x in catalog.merge_history(old, new).collect()}
    assert (got["h"]["status"], got["h"]["processed_at"], got["h"]["updated_at"]) == ("success", "t1", "t2")
    assert got["i"]["processed_at"] == "t1" and len(got) == 2


def test_metrics(spark):
    answers = frame(spark, [(1, "alpha alpha beta", "alpha beta beta"), (2, "Same, text!", "same text"), (3, "", "x"), (4, "a", "b")], "k long, reference string, answer string")
    got = {x["k"]: x for x in metrics.answer_scores(answers, "k").collect()}
    assert got[1]["token_f1"] == pytest.approx(2 / 3)
    assert (got[2]["exact_match"], got[3]["exact_match"], got[3]["token_f1"], got[4]["token_f1"]) == (1.0, 0.0, 0.0, 0.0)
    rows = frame(spark, [("m", 1.0), ("m", None), ("m", 0.0), ("n", 0.5)], "metric string, value double")
    assert {x["metric"]: x["mean"] for x in metrics.aggregate(rows).collect()} == {"m": 0.5, "n": 0.5}
    judged = frame(spark, [(1, 1, 2), (1, 2, None), (1, 3, 9)], "case_id long, evidence long, rank int")
    x = metrics.evidence_rank_metrics(judged, 5).first()
    assert (x["evidence_hit_rate"], x["evidence_mrr"]) == (pytest.approx(1 / 3), 0.5)


def test_experiments(spark):
    runs = frame(spark, [("c", "e1", 0.0, 1.0, "t1"), ("c", "e2", None, 1.0, "t2")], "config_id string, experiment string, hit_rate double, mrr double, created_at string")
    x = experiments.best_runs(runs).first()
    assert (x["experiment"], x["run_count"], x["experiment_aliases"]) == ("e2", 2, "e1|e2")


def test_response(spark):
    rows = frame(spark, [(0, 1, "k", 0.123456789, "t", {"page": "x", "title": "T", "text": "t"})], schemas.RESULT)
    x = response.citations(rows).first()
    assert (x["source"], x["score"], x["page"], x["cited"]) == ("unknown", 0.1235, None, {"title": "T"})
    got = {x["query_id"]: x for x in response.payload(rows, frame(spark, [(0, "q"), (1, "r")], "query_id long, query string")).collect()}
    assert got[0]["result_count"] == 1 and got[1]["is_empty"] and got[1]["results"] == []


def test_ingest_marks_what_is_empty(spark):
    docs = frame(spark, [("d", "<b></b>", "p", "c"), ("e", "Good text.", "q", "c")], "doc_id string, text string, source_path string, collection string")
    history = spark.createDataFrame([], "file_hash string, collection string, status string")
    rows = ingest.ingest(docs, history)
    assert {x["doc_id"]: x["error"] is None for x in rows.collect()} == {"d": False, "e": True}
    assert ingest.summary(rows).first().asDict() == {"n_documents": 2, "n_failed": 1, "n_chunks": 1, "exit_code": 1}


def test_search(spark):
    docs = frame(spark, [(1, "solar panels on roofs", "a", "pdf", "x/1", ["t"]), (2, "solar wind", "b", "pdf", "x/2", ["u"]), (3, "cats", "a", "md", "y/3", []), (4, "dogs", "a", "md", "y/4", []), (5, "birds", "a", "md", "y/5", [])], "doc_id long, text string, collection string, doc_type string, source_path string, tags array<string>")
    asked = frame(spark, [(0, "solar"), (1, "c:b solar"), (2, "tag:t,zz solar"), (3, "the")], "query_id long, query string")
    got = {(x["query_id"], x["doc_id"]) for x in search.search(asked, docs).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (2, 1)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("in/a.pdf", "in/deep/b.PDF", "in/c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [x["path"].rsplit("/", 1)[1] for x in files.discover(spark, str(tmp_path / "in")).collect()] == ["a.pdf", "b.PDF"]
    (tmp_path / "golden.json").write_text(json.dumps({"test_cases": [{"query": "q", "expected_chunk_ids": ["a"]}]}))
    assert files.golden_set(spark, str(tmp_path / "golden.json")).first()["expected_chunk_ids"] == ["a"]
    row = {"case_id": "1", "question": "q", "answer": "a", "doc_name": "d", "evidence": [{"page_num": 0, "text": "t"}]}
    (tmp_path / "b.jsonl").write_text(json.dumps(row) + "\n")
    x = files.benchmark_file(spark, str(tmp_path / "b.jsonl")).first()
    assert (x["evidences"][0]["page_number"], x["evidences"][0]["document_name"]) == (1, "d")
    (tmp_path / "bad.jsonl").write_text(json.dumps(row | {"answer": " "}) + "\n")
    with pytest.raises(Exception, match="an answer is required"):
        files.benchmark_file(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text('{"case_key": "id:1", "result": {"query": "old"}}\nbroken\n{"case_key": "id:1", "result": {"query": "new"}}\n')
    assert [x["result"]["query"] for x in files.checkpoint(spark, str(tmp_path / "c.jsonl")).collect()] == ["new"]
    t = frame(spark, [("t", "query", "s", None, 1.0, [], {})], schemas.TRACE)
    sinks.append_traces(t, str(tmp_path / "traces"))
    sinks.append_traces(t, str(tmp_path / "traces"))
    assert files.traces(spark, str(tmp_path / "traces")).where("finished_at IS NOT NULL").count() == 2
    tokens = sparse.tokenised(frame(spark, [(1, "some words")], "doc_id long, text string"))
    posts = sparse.postings(tokens).withColumn("collection", F.lit("c"))
    sinks.save_index(posts, sparse.term_table(posts, sparse.corpus_stats(tokens)), sparse.corpus_stats(tokens), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/postings")).where("collection = 'c'").count() == 2
    assert files.seeded_sample(frame(spark, [(str(i),) for i in range(9)], "case_id string"), 3, 1).count() == 3


def test_stream_ingests_each_document_once(spark, tmp_path):
    source, target = tmp_path / "src", tmp_path / "out"
    schema = "doc_id string, text string, source_path string, collection string"
    rows = [("d1", "First text.", "p1", "c"), ("d2", "Second text.", "p2", "c")]
    for k in range(2):
        frame(spark, rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream_ingest.start(spark.readStream.schema(schema).json(str(source)), str(target), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(target / "chunks")).count() == 2


def test_stream_windows_equal_the_batch(spark, sf, tmp_path):
    rows = tables.stages(spark, sf).select("started_at", "stage", "elapsed_ms")
    rows.write.parquet(str(tmp_path / "e"))
    stream = windows.windowed_latency(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("latency").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    key = lambda df: sorted((str(x["window_start"]), x["stage"], x["n"]) for x in df.collect())
    assert key(spark.table("latency")) == key(windows.windowed_latency(rows))
