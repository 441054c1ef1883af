"""Sources, sinks, runs, traces, tools and plans that have no query of their own."""

from __future__ import annotations

import io
import json
import logging
import math
import random
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry import plugins, tools
from quarry.functions import ids, text
from quarry.functions import query as qf
from quarry.operators import chunks, dense, evaluation, frames, index, ingest, metrics, sparse, traces
from quarry.operators import tools as answers
from quarry.plans import search
from quarry.sources import files, runs, sinks
from quarry.streaming import ingest as streaming


def test_seeded_sample_is_pythons(spark):
    keys = [f"case{i:03}" for i in range(57)]
    cases = spark.createDataFrame([(k,) for k in random.Random(1).sample(keys, 57)], "case_id string").repartition(5)
    got = {x["case_id"] for x in files.seeded_sample(cases, 9, 42).collect()}
    assert got == set(random.Random(42).sample(sorted(keys), 9))
    assert files.seeded_sample(cases, 100, 1).count() == 57


def test_numbered(spark):
    rows = spark.range(200).select((F.col("id") * 7 % 200).alias("k")).repartition(6)
    got = frames.numbered(rows, "k").collect()
    assert sorted((x["k"], x["position"]) for x in got) == [(i, i) for i in range(200)]


def test_benchmark_file(spark, tmp_path):
    row = {"case_id": "a", "question": "q", "answer": "x", "doc_name": "d", "evidence": [{"page_num": 0, "text": "t"}]}
    (tmp_path / "good.jsonl").write_text(json.dumps(row) + "\n\n  \n" + json.dumps(row | {"case_id": "b"}) + "\n")
    assert {x["case_id"] for x in files.benchmark_file(spark, str(tmp_path / "good.jsonl")).collect()} == {"a", "b"}
    (tmp_path / "bad.jsonl").write_text(json.dumps(row) + "\nno json\n")
    with pytest.raises(Exception, match="no benchmark row"):
        files.benchmark_file(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no cases"):
        files.benchmark_file(spark, str(tmp_path / "none.jsonl"))


def test_present(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    assert files.present(spark, str(tmp_path / "a")) == str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        files.present(spark, str(tmp_path / "b"))
    with pytest.raises(IsADirectoryError):
        files.present(spark, str(tmp_path))


def test_archives(spark, tmp_path):
    z, t, bad = (io.BytesIO() for _ in range(3))
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/b.txt", "one")
        f.writestr("a/", "")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("c.txt")
        info.size = 3
        f.addfile(info, io.BytesIO(b"two"))
        link = tarfile.TarInfo("link")
        link.type = tarfile.SYMTYPE
        link.linkname = "/etc"
        f.addfile(link)
    with zipfile.ZipFile(bad, "w") as f:
        f.writestr("../up.txt", "x")
    rows = [("z", bytearray(z.getvalue())), ("t", bytearray(t.getvalue()))]
    got = files.archive_members(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((x["path"], x["member"], bytes(x["content"])) for x in got) == [("t", "c.txt", b"two"), ("z", "a/b.txt", b"one")]
    with pytest.raises(Exception, match="unsafe archive member"):
        files.archive_members(spark.createDataFrame([("b", bytearray(bad.getvalue()))], "path string, content binary")).collect()


def test_artifacts_settings_and_clear(spark, tmp_path):
    listed = spark.createDataFrame([("x/data.jsonl",), ("y/data.jsonl",), ("x/a.pdf",)], "path string")
    got = {x["artifact"]: (x["path"], x["found"]) for x in files.artifacts(listed, {"rows": "data.jsonl", "docs": ".csv"}).collect()}
    assert got == {"rows": ("x/data.jsonl", True), "docs": (None, False)}
    (tmp_path / "s.json").write_text('{"a": 1}')
    assert files.settings(str(tmp_path / "s.json")) == {"a": 1}
    assert files.loader_config_hash({"a": 1, "b": 2}) == files.loader_config_hash({"b": 2, "a": 1})
    (tmp_path / "logs").mkdir()
    assert len(runs.clear(spark, str(tmp_path), ["logs", "none"])) == 1 and (tmp_path / "logs").exists()
    runs.clear(spark, str(tmp_path), ["logs"], dry_run=False)
    assert not (tmp_path / "logs").exists()
    for wrong in ("../x", "/etc", "", "a/../../b"):
        with pytest.raises(ValueError, match="not below"):
            runs.clear(spark, str(tmp_path), [wrong])


def test_parsed_cache_and_vectors(spark, tmp_path):
    docs = spark.createDataFrame([("h1", "p1", "t1"), ("h2", "p2", "t2")], "file_hash string, source_path string, text string")
    path = str(tmp_path / "cache")
    for _ in range(2):
        sinks.cache_put(docs.where("file_hash = 'h1'"), path, "c")
    hits, missing = sinks.cache_get(spark, docs.withColumn("source_path", F.lit("new")), path, "c")
    assert [(x["file_hash"], x["source_path"], x["text"]) for x in hits.collect()] == [("h1", "new", "t1")]
    assert [x["file_hash"] for x in missing.collect()] == ["h2"]
    store = str(tmp_path / "vectors")
    assert sinks.open_vectors(spark, store, 3).count() == 0
    spark.createDataFrame([(1, [1.0, 0.0, 0.0], "default")], "vec_id long, embedding array<float>, collection string").write.mode("append").parquet(f"{store}/dims=3")
    assert sinks.open_vectors(spark, store, 3).count() == 1
    with pytest.raises(ValueError, match="dims=3"):
        sinks.open_vectors(spark, store, 4)


def test_index_reads_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i} word{i % 7} text") for i in range(300)], "doc_id long, text string")
    path = str(tmp_path / "index")
    index.save(docs, path, "c", buckets=8)
    queries = spark.createDataFrame([(1, ["word3", "common"]), (2, ["word200"]), (3, ["absent"])], "query_id long, terms array<string>")
    want = sparse.bm25_topk(queries, docs, 5).collect()
    found = index.search(queries, path, 5, collection="c")
    key = lambda rows: sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in rows)
    assert key(found.collect()) == key(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term, [" in plan
    with pytest.raises(ValueError, match="collection"):
        index.search(queries, path, 5, collection="other")
    assert index.search(queries, str(tmp_path / "no"), 5).count() == 0


def test_runs(spark, tmp_path):
    base = {"ingestion": {"chunk_size": 500}, "embedding": {"provider": "hashing"}}
    made = evaluation.plans(base, [evaluation.Experiment("a"), evaluation.Experiment("b", {"retrieval": {"rrf_k": 10}}), evaluation.Experiment("c", {"ingestion": {"chunk_size": 9}})])
    assert [p.reuses_index_of for p in made] == [None, "a", None]

    def execute(plan):
        if plan.name == "c":
            raise RuntimeError("broken")
        return 1.0 if plan.name == "a" else 0.5

    suite = evaluation.run_suite(made, execute)
    assert suite["errors"] == {"c": "broken"} and set(suite["experiments"]) == {"a", "b"}
    cases = spark.createDataFrame([("a", "1", "q", 2.0, {"m": 1.0})], "experiment string, case_id string, query string, elapsed_ms double, metrics map<string,double>")
    summaries = spark.createDataFrame([(n, 1, 2.0, {"evidence_hit_rate@5": v, "evidence_mrr@5": v}) for n, v in suite["experiments"].items()], "experiment string, query_count long, total_elapsed_ms double, aggregate_metrics map<string,double>")
    path = str(tmp_path / "runs")
    for run in ("r1", "r2"):
        runs.save(spark, path, run, f"2024-{run}", made, cases, summaries, suite["errors"], suite["elapsed_ms"])
    assert [x["run"] for x in runs.discover(spark, path).collect()] == ["r2", "r1"]
    table = {x["experiment"]: x for x in spark.read.option("header", "true").csv(f"{path}/comparison/run=r1").collect()}
    assert (table["c"]["status"], table["c"]["error"], table["b"]["reuses_index_of"]) == ("failed", "broken", "a")
    history = {x["experiment_aliases"]: x for x in runs.export_history(spark, path).collect()}
    assert {k: (x["run_count"], x["hit_rate"]) for k, x in history.items()} == {"a": (2, 1.0), "b": (2, 0.5)}
    assert runs.read(spark, path, "cases").count() == 2


def test_plans_reject_what_is_wrong():
    one = [evaluation.Experiment("a"), evaluation.Experiment("b", enabled=False)]
    for experiments, chosen in (([*one, evaluation.Experiment("a")], None), (one, ["x"]), (one, "a"), (one, ["b"]), ([evaluation.Experiment(" ")], None)):
        with pytest.raises(ValueError):
            evaluation.plans({}, experiments, chosen)
    with pytest.raises(ValueError, match="may not override"):
        evaluation.plans({}, [evaluation.Experiment("a", {"evaluation": {}})])
    name = evaluation.checkpoint_name("my exp!", "f", ["1", "2"], {}, {"provider": "none"}, ["mrr"])
    assert name.startswith("my_exp_") and name == evaluation.checkpoint_name("my exp!", "f", ["1", "2"], {}, {"provider": "none"}, ["mrr"])


def test_metric_names():
    assert evaluation.parse_metric(" MRR@5 ") == ("document_mrr", 5)
    assert evaluation.parse_metric("numeric_accuracy") == ("numeric_accuracy", None)
    for wrong in ("", "a@", "a@0", "a@b@1", "@3", None):
        with pytest.raises(ValueError):
            evaluation.parse_metric(wrong)
    assert evaluation.usable_metrics(["mrr", "mrr@3", "answer_token_f1@2", "page_hit_rate@1"]) == [("mrr@3", "document_mrr", 3), ("page_hit_rate@1", "page_hit_rate", 1)]
    assert evaluation.needs_answer({"evaluation": {"metrics": ["numeric_accuracy"]}}) and evaluation.needs_answer({"evaluation": {"backends": ["Ragas"]}})
    assert not evaluation.needs_answer({"evaluation": {"metrics": ["mrr@5"]}}) and not evaluation.needs_answer(None)
    made = evaluation.configured_evaluators({"evaluation": {"backends": ["custom", "none", "unknown", "benchmark"], "metrics": ["mrr"]}}, plugins.evaluators.create)
    assert len(made) == 2
    with pytest.raises(ValueError, match="unsupported"):
        evaluation.custom_evaluator(["f1"])


def test_page_metrics(spark):
    """Pages where a result has them, else its text, whole or half of it; by hand."""
    evidence = [("Doc A.pdf", 3, "alpha beta gamma delta"), ("b", 1, "one two three four"), ("", 1, "x"), ("c", None, "y")]
    cases = spark.createDataFrame([("k", "1,200", "about $1.2 thousand", evidence)], "case_id string, reference_answer string, answer string, evidences array<struct<document_name:string,page_number:int,text:string>>")
    results = [("k", 1, "ＤＯＣ a", "", {"page_start": "1", "page_end": "2"}), ("k", 2, "x/b.md", "Two, ONE!", {}), ("k", 3, "doc a", "", {"page": "3"}), ("k", 4, "zzz", "alpha", {})]
    got = evaluation.evaluate_cases(cases, spark.createDataFrame(results, "case_id string, rank int, source string, text string, metadata map<string,string>"), ["page_hit_rate@2", "page_hit_rate@3", "document_hit_rate@3", "document_mrr@1", "numeric_accuracy", "answer_token_f1"])
    found = {x["metric"]: round(x["value"], 6) for x in got.collect()}
    assert found == {"page_hit_rate@2": 0.5, "page_hit_rate@3": 1.0, "document_hit_rate@3": round(2 / 3, 6), "document_mrr@1": 1.0, "numeric_accuracy": 1.0, "answer_token_f1": round(2 * 1 / (2 + 4), 6)}


def test_trace_recorder(spark):
    r = traces.Recorder("query", {"query": "x"})
    r.record("dense", {"n": 1}, 1.234)
    with r.timed("dense", {"n": 2}):
        pass
    r.finish()
    assert r.stage_data("dense") == {"n": "2"} and r.stage_data("none") is None
    assert r.elapsed_ms("dense") < 1.2 and r.elapsed_ms() > 0
    with pytest.raises(KeyError):
        r.elapsed_ms("none")
    got = traces.flattened(r.rows(spark)).collect()
    assert [(x["stage"], x["data"]["n"]) for x in got] == [("dense", "1"), ("dense", "2")]
    record = logging.makeLogRecord({"msg": "hello %s", "args": ("you",), "levelname": "INFO", "name": "n", "trace_id": "t"})
    said = json.loads(traces.JsonFormatter().format(record))
    assert (said["message"], said["trace_id"], said["level"]) == ("hello you", "t", "INFO")


def test_tool_server(spark):
    known = tools.Tools()
    known.register("count", lambda n=3: spark.range(n), "numbers", ("n",))
    with pytest.raises(ValueError):
        known.register("count", lambda: None, "", ())
    ask = lambda **k: json.dumps({"jsonrpc": "2.0"} | k)
    lines = [ask(id=1, method="tools/list"), ask(id=2, method="tools/call", params={"name": "count", "arguments": {"n": 2}}), ask(method="notify"), ask(id=3, method="tools/call", params={"name": "x"}), "no json", "", ask(id=4, method="other"), ask(id=5, method="tools/call", params={"name": "count", "arguments": {"m": 1}})]
    out = io.StringIO()
    known.serve(io.StringIO("\n".join(lines)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 2, 3, None, 4, 5]
    assert got[1]["result"]["content"] == [{"id": 0}, {"id": 1}]
    assert [x["error"]["code"] for x in got[2:]] == [-32602, -32700, -32601, -32602]


def test_search_degrades(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", "c", "en", "p1"), (2, "beta gamma", "c", "fr", "p2")], "doc_id long, text string, collection string, doc_type string, source_path string")
    embed = plugins.embedders.create("hashing")()
    vectors = corpus.select("doc_id", embed(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(1, "alpha"), (2, ""), (3, "zzz type:fr"), (4, None)], "query_id long, query string")
    got = {x["query_id"]: x for x in search.answered(asked, corpus, vectors).collect()}
    assert got[1]["result_count"] == 2 and json.loads(got[1]["content"])["results"][0]["chunk_id"] == "1"
    assert got[2]["error"] == got[4]["error"] == "query cannot be empty" and got[2]["is_empty"]
    assert [r["chunk_id"] for r in json.loads(got[3]["content"])["results"]] == ["2"]
    assert search.answered(asked, corpus, index_path="/tmp/no-such-index").where("result_count > 0").count() == 0


def test_ingestion_to_the_end(spark):
    docs = spark.createDataFrame([(1, "Some text here. More of it.", "p1", "c"), (2, " ", "p2", "c"), (3, "Done before.", "p3", "c")], "doc_id long, text string, source_path string, collection string")
    history = spark.createDataFrame([("x", "old", "failed", "c", "e", "2020", "2020")], "file_hash string, file_path string, status string, collection string, error_msg string, processed_at string, updated_at string")
    done = docs.where("doc_id = 3").select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.col("source_path").alias("file_path"), F.lit("success").alias("status"), "collection", F.lit(None).cast("string").alias("error_msg"), F.lit("2021").alias("processed_at"), F.lit("2021").alias("updated_at"))
    out = ingest.run(docs, history.unionByName(done), "2024", embed=plugins.embedders.create("hashing")(8))
    assert {x["doc_id"] for x in out["chunks"].collect()} == {1}
    assert [len(x["embedding"]) for x in out["vectors"].collect()] == [8]
    assert [(x["doc_id"], bool(x["error"])) for x in out["failed"].collect()] == [(2, True)]
    assert sorted((x["file_path"], x["status"]) for x in out["history"].collect()) == [("old", "failed"), ("p1", "success"), ("p2", "failed"), ("p3", "success")]


def test_streamed_document_replaces_itself(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string, source_path string, collection string"
    for k, body in enumerate(("first words here", "second words there", "first words here", "second words there")):
        spark.createDataFrame([(1, body, "p", "c"), (2, "same all along", "q", "c")], schema).coalesce(1).write.mode("append").json(source)
        streaming.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), target, str(tmp_path / "check")).awaitTermination()
        assert sorted(x["text"] for x in streaming.current(spark, target).collect()) == sorted([body, "same all along"]), k
    assert {x["term"] for x in streaming.current_postings(spark, target).collect()} == {"second", "words", "there", "same", "all", "along"}


def test_located():
    body = "a  b\n\nc a  b c"
    assert chunks.located(body, ["a b", "c a", "a b c"]) == [(0, 4), (6, 9), (8, 14)]
    with pytest.raises(ValueError):
        chunks.located(body, ["c", "x"])
    with pytest.raises(ValueError):
        chunks.batched(None, 0)


def test_text_extras(spark):
    rows = spark.createDataFrame([("x ﷐ <b>z</b> ```c``` ﷑ d", "ＡＢ ﬁ ½ Straße"), ("", None)], "t string, u string")
    a, b = rows.select(text.refine(F.col("t")), text.evidence_text(F.col("u"))).collect()
    assert tuple(a) == ("x ﷐ z ```c``` ﷑ d", "ab fi 1 2 strasse")
    assert tuple(b) == ("", "")
    assert ids.key_words("HTTPServerUrl-file_path") == ["http", "server", "url", "file", "path"]
    same = [{"embedding": {"model": "m", "apiKey": "1"}}, {"embedding": {"model": "m", "apiKey": "2"}, "files": {"filePath": "x"}}]
    assert len({ids.settings_fingerprint(x) for x in same}) == 1
    assert (qf.clamped(None), qf.clamped(50), qf.widened(5, True, 20), qf.widened(5, False)) == (5, 20, 20, 5)
    for wrong in ({"query": " "}, {"top_k": 0}, {"top_k": True}):
        with pytest.raises(ValueError):
            qf.checked(**wrong)
    assert "how" in qf.STOPWORDS and "如何" in qf.STOPWORDS
    got = rows.select(answers.enrichment_prompt("T {chunk_text}|", F.lit("y" * 3000)).alias("p")).first()["p"]
    assert len(got) == 2003


def test_dense_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 40 else [0.0, 1.0]) for i in range(80)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    got = dense.dense_topk(q, v.repartition(5), 7).collect()
    assert sorted(x["vec_id"] for x in got) == list(range(7)) and all(math.isclose(x["score"], 1) for x in got)


def test_ids_held_in_chunk_ids(spark):
    """Chunks of documents without a reference are found by equality of parts, not by each chunk against each document."""
    names, parts = ["a", "ab", "", "abc", "b_", "日本", "aa", "zz9", "\U0001f600"], ["a", "", "abcab", "b_b_", "日本日x", "aaaa", None, "\U0001f600a", "zz9"]
    asked, named = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((names, "doc_id"), (parts, "chunk_id")))
    rows = named.select("chunk_id", F.lit("t").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(0).alias("chunk_index"))
    found = answers.document_chunks(asked, rows)
    assert sorted((x["chunk_id"], x["doc_id"]) for x in found.collect()) == sorted((c, d) for c in parts if c is not None for d in names if d in c)
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_meets_in_blocks(spark, monkeypatch):
    """Pairs below the threshold are counted in memory: no join of tokens, whatever the texts share."""
    monkeypatch.setattr(metrics, "AT_ONCE", 7)
    draw = random.Random(3)
    texts = lambda n, most: {i: " ".join(draw.choices(["a", "b", "c", "d", "É", "f."], k=draw.randrange(most))) for i in range(n)}
    want, given = texts(30, 9), texts(70, 14)
    refs, docs = (spark.createDataFrame([*x.items()], f"{k} long, text string").repartition(3) for x, k in ((want, "r"), (given, "c")))
    got = metrics.coverage(refs, docs, "r", "c")
    words = lambda t: Counter(t.lower().replace(".", "").split())
    shares = {(r, c): (words(a) & words(b)).total() / words(a).total() for r, a in want.items() for c, b in given.items() if a}
    assert {(x["r"], x["c"]): round(x["coverage"], 9) for x in got.collect()} == {p: round(s, 9) for p, s in shares.items() if s >= 0.5}
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_documents_move_once(spark, tmp_path):
    """Postings are counted and ranked where their documents lie; an index has its documents' lengths in a bucket of their own."""
    docs = spark.createDataFrame([(i, f"common word{i} word{i % 7} text" if i else "") for i in range(50)], "doc_id long, text string")
    path = str(tmp_path / "index")
    index.save(docs, path, buckets=8)
    stored = spark.read.parquet(f"{path}/postings")
    assert sorted(x["doc_id"] for x in stored.where("bucket = -1").collect()) == list(range(50))
    assert spark.read.parquet(f"{path}/stats").first()["num_docs"] == 50
    ranked = sparse.top_terms(sparse.postings(sparse.tokenised(docs)))
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
