"""Evaluation of retrieval and answers: fields, case metrics, evaluators, experiment plans and suites.

All cases of a run are one plan: metrics come out as rows (case_id, metric,
value), and an evaluator is a function from cases and results to such rows.
Only plans and suites, which a person writes, are plain Python values.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.functions.text import document_name, evidence_text, numeric_accuracy, safe_name, text_matches
from quarry.operators import metrics

#: Where results keep their text, id, document and page, in the order they count.
TEXT_FIELDS = ("text", "content", "page_content", "chunk_text")
ID_FIELDS = ("chunk_id", "id", "document_id", "doc_id")
DOCUMENT_FIELDS = ("document_name", "doc_name", "source_path", "file_path", "filename", "file_name", "source", "document", "path", "title", "source_ref", "document_id", "doc_id")
PAGE_FIELDS = ("page_num", "page", "page_number")
#: Metrics with a cutoff and metrics of answers.
RANKED = ("document_hit_rate", "document_mrr", "page_hit_rate", "evidence_hit_rate", "evidence_mrr")
ANSWERS = ("answer_exact_match", "answer_token_f1", "numeric_accuracy")
#: Sections of the settings that an experiment may override.
SECTIONS = ("llm", "embedding", "vision_llm", "vector_store", "retrieval", "rerank", "ingestion")


def parse_metric(name: str) -> tuple[str, int | None]:
    """Base and cutoff of a metric's name; ``mrr`` means that of documents."""
    found = re.fullmatch(r"([^@]+)(?:@([1-9]\d*|0*[1-9]\d*))?", name.strip().casefold()) if isinstance(name, str) else None
    if not found:
        raise ValueError(f"not a metric's name: {name!r}")
    base = "document_mrr" if found[1] == "mrr" else found[1]
    return base, int(found[2]) if found[2] else None


def usable_metrics(names: Sequence[str]) -> list[tuple[str, str, int | None]]:
    """(name, base, cutoff) of the metrics that can be computed: ranked ones with a cutoff, those of answers without."""
    out = []
    for name in [names] if isinstance(names, str) else names:
        try:
            base, k = parse_metric(name)
        except ValueError:
            continue
        if (base in RANKED and k) or (base in ANSWERS and not k):
            out.append((name.strip().casefold(), base, k))
    return out


def needs_answer(settings: Mapping | None) -> bool:
    """Whether the configured evaluators read a generated answer."""
    found = (settings or {}).get("evaluation") or {}
    backends = {str(x).strip().lower() for x in found.get("backends") or []} | {str(found.get("provider", "")).strip().lower()}
    names = found.get("metrics") or []
    return "ragas" in backends or any(str(x).strip().lower().split("@")[0] in ANSWERS for x in ([names] if isinstance(names, str) else names))


def _given(columns: Iterable[str], fields: Sequence[str]) -> list[Column]:
    """A result's fields: its own columns first, then its metadata."""
    there = set(columns)
    own = [F.col(f"`{x}`").cast("string") for x in fields if x in there]
    return own + ([F.try_element_at("metadata", F.lit(x)) for x in fields] if "metadata" in there else [])


def page_of(value: Column) -> Column:
    """A page number: a whole number from 0, else null."""
    return F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("long")).when(value.rlike("^[0-9]+\\.0+$"), value.try_cast("double").cast("long"))


def extracted(results: DataFrame) -> DataFrame:
    """``results`` with identifier, body, documents (array of comparable names) and pages (array of start, end), wherever they are kept."""
    columns = results.columns
    filled = [F.when(F.trim(x) != "", x) for x in _given(columns, ID_FIELDS)]
    identifier = F.coalesce(*filled, F.lit(""))
    names = F.array_distinct(F.array_compact(F.array(*(F.nullif(document_name(x), F.lit("")) for x in _given(columns, DOCUMENT_FIELDS)))))
    own = F.array_compact(F.array(F.nullif(document_name(identifier), F.lit(""))))
    spans = []
    for source in (lambda f: [F.col(f).cast("string")] if f in columns else [], lambda f: [F.try_element_at("metadata", F.lit(f))] if "metadata" in columns else []):
        start, end = (F.coalesce(*[page_of(x) for x in source(f)], F.lit(None).cast("long")) for f in ("page_start", "page_end"))
        a, b = F.coalesce(start, end), F.coalesce(end, start)
        spans.append(F.when(a.isNotNull(), F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))))
        for f in PAGE_FIELDS:
            page = F.coalesce(*[page_of(x) for x in source(f)], F.lit(None).cast("long"))
            spans.append(F.when(page.isNotNull(), F.struct(page.alias("start"), page.alias("end"))))
    return results.withColumns(
        {
            "identifier": identifier,
            "body": F.coalesce(*_given(columns, TEXT_FIELDS), F.lit("")),
            "documents": F.when(F.size(names) > 0, names).otherwise(own),
            "pages": F.array_distinct(F.array_compact(F.array(*spans))),
        }
    )


def ground_truth(cases: DataFrame) -> DataFrame:
    """Rows (case_id, query, expected_documents, expected_pages, expected_evidence, reference_answer) of cases with ``evidences``."""
    each = lambda f: F.array_distinct(F.array_compact(F.transform("evidences", lambda e: e[f])))
    return cases.select("case_id", "query", each("document_name").alias("expected_documents"), each("page_number").alias("expected_pages"), each("text").alias("expected_evidence"), "reference_answer")


def evaluate_cases(cases: DataFrame, results: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (case_id, metric, value) of the named metrics for all cases.

    Cases have case_id, reference_answer, answer, evidences (array of
    document_name, page_number, text) and, for judged evidence, evidence_ranks;
    results have case_id, rank and fields as :func:`extracted` reads them.  A
    metric that doesn't apply to a case has no row.
    """
    listed = F.posexplode_outer("evidences").alias("evidence", "e")
    wanted = cases.select("case_id", listed).where("e IS NOT NULL").select("case_id", "evidence", document_name(F.col("e.document_name")).alias("document"), F.col("e.page_number").cast("long").alias("page"), evidence_text(F.col("e.text")).alias("wanted"))
    got = extracted(results).select("case_id", "rank", "documents", "pages", F.when(F.size("pages") == 0, evidence_text(F.col("body"))).alias("body"))
    met = wanted.where("document <> ''").join(got, "case_id").where(F.array_contains("documents", F.col("document")))
    inside = F.exists("pages", lambda p: (p["start"] <= F.col("page")) & (F.col("page") <= p["end"]))
    hit = F.when(F.size("pages") > 0, inside).otherwise(text_matches(F.col("wanted"), F.col("body")))
    first = met.groupBy("case_id", "evidence").agg(F.min("rank").alias("rank"), F.min(F.when(F.col("page").isNotNull() & hit, F.col("rank"))).alias("page_rank"))
    ranks = wanted.join(first, ["case_id", "evidence"], "left").groupBy("case_id").agg(
        F.count(F.when(F.col("document") != "", 1)).alias("n_documents"),
        F.count(F.when((F.col("document") != "") & F.col("page").isNotNull(), 1)).alias("n_pages"),
        F.collect_list("rank").alias("ranks"),
        F.collect_list("page_rank").alias("page_ranks"),
    )
    judged = F.col("evidence_ranks") if "evidence_ranks" in cases.columns else F.array().cast("array<int>")
    rows = cases.select("case_id", "reference_answer", "answer", F.size(F.coalesce("evidences", F.array().cast(cases.schema["evidences"].dataType))).alias("n_evidences"), F.coalesce(judged, F.array().cast("array<int>")).alias("judged"))
    rows = rows.join(ranks, "case_id", "left")
    usable = usable_metrics(names)
    if any(base in ("answer_exact_match", "answer_token_f1") for _, base, _ in usable):
        rows = rows.join(metrics.answer_scores(rows.select("case_id", F.col("reference_answer").alias("reference"), "answer"), "case_id"), "case_id", "left")

    def within(ranks: Column, k: int) -> Column:
        return F.filter(F.array_compact(F.coalesce(ranks, F.array().cast("array<int>"))), lambda r: r <= k)

    def share(n: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0))

    def value(base: str, k: int | None) -> Column:
        if base == "document_hit_rate":
            return share(F.size(within(F.col("ranks"), k)), F.col("n_documents"))
        if base == "page_hit_rate":
            return share(F.size(within(F.col("page_ranks"), k)), F.col("n_pages"))
        if base == "evidence_hit_rate":
            return share(F.size(within(F.slice("judged", 1, F.greatest("n_evidences", F.lit(1))), k)), F.col("n_evidences"))
        if base in ("document_mrr", "evidence_mrr"):
            return F.coalesce(1.0 / F.array_min(within(F.col("ranks" if base == "document_mrr" else "judged"), k)), F.lit(0.0))
        return {"answer_exact_match": F.col("exact_match"), "answer_token_f1": F.col("token_f1"), "numeric_accuracy": numeric_accuracy(F.col("reference_answer"), F.coalesce("answer", F.lit("")))}[base]

    pairs = [F.struct(F.lit(name).alias("metric"), value(base, k).alias("value")) for name, base, k in usable]
    if not pairs:
        return rows.select("case_id", F.lit("").alias("metric"), F.lit(0.0).alias("value")).where(F.lit(False))
    return rows.select("case_id", F.inline(F.array(*pairs))).where("value IS NOT NULL")


# Evaluators take cases and results and give rows (case_id, metric, value).


def benchmark_evaluator(names: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda cases, results: evaluate_cases(cases, results, names)


def custom_evaluator(names: Sequence[str] = ("hit_rate", "mrr")) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """hit_rate and mrr over the ids that cases expect (``expected_ids``); other names are an error."""
    wrong = sorted(set(names) - {"hit_rate", "mrr"})
    if wrong:
        raise ValueError(f"unsupported metrics: {', '.join(wrong)}")

    def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
        truth = cases.select("case_id", F.explode_outer("expected_ids").alias("chunk_id"))
        found = metrics.hit_and_mrr(results.select("case_id", "rank", "chunk_id"), truth, item="chunk_id")
        return found.select("case_id", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))))

    return evaluate


def no_evaluator(cases: DataFrame, results: DataFrame) -> DataFrame:
    """No metrics at all."""
    return cases.select("case_id", F.lit("").alias("metric"), F.lit(0.0).alias("value")).where(F.lit(False))


def composite_evaluator(parts: Sequence[Callable[[DataFrame, DataFrame], DataFrame]]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """All parts' metrics; of a metric that several give the last counts.  Parts that can't be planned are left out, unless all can't."""

    def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
        rows, errors = [], []
        for i, part in enumerate(parts):
            try:
                rows.append(part(cases, results).withColumn("__i", F.lit(i)))
            except Exception as e:
                errors.append(str(e))
        if not rows:
            if errors:
                raise RuntimeError("all evaluators failed: " + "; ".join(errors))
            return no_evaluator(cases, results)
        return reduce(DataFrame.unionByName, rows).groupBy("case_id", "metric").agg(F.max_by("value", "__i").alias("value"))

    return evaluate


def configured_evaluators(settings: Mapping, known: Callable[[str], Callable]) -> list[Callable]:
    """The evaluators of ``evaluation.backends``, made by ``known`` from their names; those that can't be made are left out."""
    out = []
    for name in (settings.get("evaluation") or {}).get("backends") or []:
        name = str(name).strip().lower()
        if name in ("composite", "none", "disabled"):
            continue
        try:
            out.append(known(name)((settings.get("evaluation") or {}).get("metrics") or []))
        except (ValueError, ImportError, TypeError):
            continue
    return out


def metric_names(plans: DataFrame, summaries: DataFrame, rows: DataFrame) -> DataFrame:
    """The names (metric) that plans or summaries list in ``metrics`` or that rows have values for, each once and sorted."""
    listed = plans.select(F.explode("metrics").alias("metric")).unionByName(summaries.select(F.explode("metrics").alias("metric")))
    return listed.unionByName(rows.where("value IS NOT NULL").select("metric")).where("metric IS NOT NULL").distinct().orderBy("metric")


def report_total(results: DataFrame) -> DataFrame:
    """One row (n_queries, total_elapsed_ms), never below a thousandth of a millisecond."""
    return results.agg(F.count("*").alias("n_queries"), F.greatest(F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)), F.lit(0.001)).alias("total_elapsed_ms"))


def retrieved_items(results: DataFrame) -> DataFrame:
    """Results as a report keeps them: case_id, rank, id, text, metadata where there is one, and the score if it's a number."""
    columns = results.columns
    own = lambda *fields: F.coalesce(*(F.col(f).cast("string") for f in fields if f in columns), F.lit(None).cast("string"))
    score = F.coalesce(own("score").try_cast("double"), own("relevance_score").try_cast("double"))
    kept = [F.col("metadata")] if "metadata" in columns else []
    return results.select("case_id", "rank", own("id", "chunk_id").alias("id"), own("text", "content", "page_content").alias("text"), *kept, score.alias("score"))


def without_texts(results: DataFrame) -> DataFrame:
    """Results for a console: no answers and no texts of chunks."""
    return results.drop("generated_answer", "reference_answer", "text", "body", "retrieved_results")


def evidence_documents(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (document, path, n_files): the file of each document that evidences name, found by its comparable name.

    ``n_files`` says whether the name is missing (0) or not unique; then the path is null.
    """
    named = cases.select(F.explode("evidences").alias("e")).select(document_name(F.col("e.document_name")).alias("document")).where("document <> ''").distinct()
    by = files.select(document_name(F.col("path")).alias("document"), "path").groupBy("document").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    joined = named.join(by, "document", "left")
    return joined.select("document", F.when(F.col("n") == 1, F.col("path")).alias("path"), F.coalesce("n", F.lit(0)).alias("n_files"))


# Experiments.


@dataclass(frozen=True)
class Experiment:
    name: str
    overrides: Mapping = field(default_factory=dict)
    enabled: bool = True


@dataclass(frozen=True)
class Plan:
    name: str
    settings: Mapping
    fingerprint: str
    collection: str
    reuses_index_of: str | None


def overridden(settings: Mapping, experiment: Experiment) -> dict:
    """Settings with an experiment's overrides; other sections than :data:`SECTIONS` are an error."""
    wrong = sorted(set(map(str, experiment.overrides)) - set(SECTIONS))
    if wrong:
        raise ValueError(f"experiment {experiment.name!r} may not override {', '.join(wrong)}")
    return ids.deep_merge(settings, experiment.overrides)


def plans(settings: Mapping, experiments: Sequence[Experiment], chosen: Sequence[str] | None = None, provider: str = "benchmark", version: str = "1") -> list[Plan]:
    """Plans of the enabled and chosen experiments in their order; a plan names the first one with the same index."""
    experiments = list(experiments) or [Experiment("baseline")]
    names = [x.name for x in experiments]
    if not all(isinstance(x, str) and x.strip() for x in names) or len(set(names)) < len(names):
        raise ValueError("experiments need names, each its own")
    if chosen is not None and (isinstance(chosen, str) or len(set(chosen)) < len(list(chosen)) or set(chosen) - set(names)):
        raise ValueError("chosen experiments are a list of known names, each once")
    out, first = [], {}
    for x in experiments:
        if x.enabled and (chosen is None or x.name in chosen):
            own = overridden(settings, x)
            mark = ids.settings_fingerprint(index_payload(own, provider, version))
            out.append(Plan(x.name, own, mark, ids.collection_name(provider, mark), first.get(mark)))
            first.setdefault(mark, x.name)
    if not out:
        raise ValueError("no enabled experiment was chosen")
    return out


def index_payload(settings: Mapping, provider: str, version: str) -> dict:
    """What decides about an index: the benchmark, ingestion, embedding, store and, where ingestion uses them, models."""
    section = lambda name, *keys: {k: v for k, v in (settings.get(name) or {}).items() if not keys or k in keys}
    out = {"benchmark": {"provider": provider, "dataset_version": version}, "ingestion": section("ingestion"), "embedding": section("embedding", "provider", "model", "dimensions"), "vector_store": section("vector_store", "provider")}
    if any(isinstance(x, Mapping) and x.get("use_llm") for x in (settings.get("ingestion") or {}).values()):
        out["llm"] = section("llm", "provider", "model", "temperature")
    if (settings.get("vision_llm") or {}).get("enabled"):
        out["vision_llm"] = section("vision_llm")
    return out


def run_suite(made: Sequence[Plan], execute: Callable[[Plan], object]) -> dict:
    """Runs each plan by itself, a job each; a plan that fails leaves its error's text and doesn't stop the others."""
    start, reports, errors = time.perf_counter(), {}, {}
    for plan in made:
        try:
            reports[plan.name] = execute(plan)
        except Exception as e:
            errors[plan.name] = str(e) or type(e).__name__
    return {"experiments": reports, "plans": list(made), "errors": errors, "elapsed_ms": (time.perf_counter() - start) * 1000}


def checkpoint_name(experiment: str, fingerprint: str, case_ids: Sequence[str], retrieval: object, rerank: Mapping, names: Sequence[str]) -> str:
    """A stable file name for an experiment on a set of cases."""
    identity = {"experiment": experiment, "index_fingerprint": fingerprint, "case_ids": list(case_ids), "retrieval": repr(retrieval), "rerank": {k: rerank.get(k) for k in ("provider", "model", "top_k")}, "metrics": list(names)}
    mark = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:16]
    return f"{re.sub(r'[^A-Za-z0-9_.-]+', '_', experiment).strip('._')}_{mark}.jsonl"


def config_columns(settings: Column | str = "settings") -> list[Column]:
    """Report columns of nested settings given as JSON; nested values stay JSON, missing ones become blank or their default."""
    s = F.col(settings) if isinstance(settings, str) else settings
    get = lambda path, default="": F.coalesce(F.get_json_object(s, f"$.{path}"), F.lit(default))
    nested = lambda path: F.when(get(path).isin("{}", "[]"), "").otherwise(get(path))
    out = {
        "length_unit": get("ingestion.length_unit", "characters"),
        **{n: get(f"ingestion.{n}") for n in ("chunk_size", "chunk_overlap", "tokenizer_model")},
        **{n: nested(f"ingestion.{n}") for n in ("chunk_refiner", "metadata_enricher")},
        **{f"embedding_{n}": get(f"embedding.{n}") for n in ("provider", "model", "dimensions")},
        **{f"{n}_enabled": get(f"retrieval.enable_{n}", "true") for n in ("dense", "sparse")},
        **{n: get(f"retrieval.{n}") for n in ("dense_top_k", "sparse_top_k", "fusion_top_k", "rrf_k")},
        **{n: get(f"retrieval.{n}", "0.5") for n in ("dense_weight", "sparse_weight")},
        **{n: nested(f"retrieval.{n}") for n in ("query_expansions", "document_routing")},
        "rerank_enabled": get("rerank.enabled", "false"),
        "rerank_provider": get("rerank.provider"),
        "rerank_model": F.coalesce(F.nullif(F.get_json_object(s, "$.rerank.api_args.model"), F.lit("")), get("rerank.model")),
        "rerank_top_k": get("rerank.top_k"),
        "rerank_threshold": get("rerank.api_args.rerank_threshold"),
        "rerank_metadata_fields": nested("rerank.metadata_fields"),
        "vision_enabled": get("vision_llm.enabled", "false"),
        "llm_provider": get("llm.provider"),
        "llm_model": get("llm.model"),
    }
    return [c.alias(n) for n, c in out.items()]


def history_rows(runs: DataFrame, plans_: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row for each summary whose run and plan are known: config_id, run columns, ``settings`` and what the summary measured.

    runs (run, created_at, case_count), plans (run, name, settings as JSON),
    summaries (run, experiment, query_count, total_elapsed_ms, hit_rate, mrr).
    """
    joined = summaries.join(runs, "run").join(plans_.withColumnRenamed("name", "experiment"), ["run", "experiment"])
    config = F.to_json(F.struct(*config_columns()))
    return joined.select(F.substring(F.sha2(config.cast("binary"), 256), 1, 12).alias("config_id"), "experiment", "created_at", F.coalesce("query_count", "case_count").alias("sample_size"), "hit_rate", "mrr", "total_elapsed_ms", "settings")


def reevaluated(traces: DataFrame, default_k: int = 10, reranking: bool = False) -> DataFrame:
    """Stored query traces as queries to run again: query_id, query with its collection as filter, top_k and how many candidates to fetch."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    k = F.coalesce(meta("top_k").try_cast("int"), F.lit(default_k))
    return traces.where(F.coalesce(meta("query"), F.lit("")) != "").select(F.col("trace_id").alias("query_id"), F.concat(meta("query"), F.lit(" collection:"), F.coalesce(meta("collection"), F.lit("default"))).alias("query"), k.alias("top_k"), (k * (2 if reranking else 1)).alias("candidates"))


def report_file(experiment: Column, suffix: str) -> Column:
    return F.concat(safe_name(experiment), F.lit(suffix))
