"""Mixing documents to target weights by soft domain membership, in DataFrame functions only.

A naive Bayes classifier over features of the text learns from a labelled table
how likely each domain is for a document.  The rates r of the documents solve
the nonnegative least squares problem ::

    min over r >= 0   sum_d (E_d - w_d S)^2 / (h_d S^2) + ridge * sum_i T_i / S * (r_i - 1)^2
    E_d = sum_i r_i T_i p_id,   S = sum_i T_i,   h_d = sum_i T_i / S * p_id

with T_i the tokens and p_id the posteriors of document i and w the target
weights, by projected gradient steps.  A step moves each document by itself,
given the domains' totals, so a rate is an expression over a document's own
posteriors; the totals of the next step come from one aggregation over all
documents, of which only three numbers return.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, let
from quarry.llm.rules import SYMBOLS

#: Domains as conditions on the labelled table, in order.
DOMAINS = {"clean": "toxic = 0 AND quality = 1", "low": "toxic = 0 AND quality = 0", "toxic": "toxic = 1"}
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}
#: Labelled rows from which the lexicons come at most; words of a lexicon; what a word needs.
SAMPLE, WORDS, CHI2, EXAMPLES = 20_000, 64, 40.0, 5
#: The step is the greatest that can't overshoot: the scaled problem's curvature is 1 + RIDGE at most.
STEP, RIDGE, ROUNDS, TOLERANCE = 0.999, 1e-3, 80, 1e-5
#: Steps after which the rates so far are kept in a checkpoint.
HOLD = 16
#: Limits between the values of the continuous features.
LENGTHS = (20, 40, 70, 100, 150, 220, 320, 450, 650, 1000, 2000)
SYMBOLS_SHARE = (0.005, 0.02, 0.06, 0.12, 0.2, 0.35, 0.6)
CHARACTERS = (4.4, 5.0, 5.5, 6.0, 6.5, 7.2, 8.0)
HITS = (1, 2, 3, 5, 8, 13, 21)
#: Values of each feature.
SIZES = {"b_length": len(LENGTHS) + 1, "b_symbols": len(SYMBOLS_SHARE) + 1, "b_repeats": 3, "b_word": len(CHARACTERS) + 1} | {f"b_{d}": len(HITS) + 1 for d in DOMAINS}


def label_domain() -> Column:
    """The domain of a labelled row; null where no condition holds."""
    return reduce(lambda rest, d: F.when(F.expr(DOMAINS[d]), d).otherwise(rest), reversed(DOMAINS), F.lit(None).cast("string"))


def lexical(text: Column) -> Column:
    """Words of letters and digits, in lower case: runs without other ASCII characters."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def steps(value: Column, *limits: float) -> Column:
    """How many of the limits a value reaches; the value is evaluated once."""
    return let(value, lambda v: reduce(lambda a, x: a + F.when(v >= x, 1).otherwise(0), limits, F.lit(0)))


def labelled(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, domain), one for each labelled doc_id: the first domain in name order where rows disagree."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_domain().alias("domain")).dropna()
    return rows.groupBy("doc_id").agg(F.min("domain").alias("domain"))


def lexicons(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """For each domain the words that mark it by chi-square over a bounded sample of labelled rows."""
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # bounded by sample
    words = texts.select("domain", F.explode(F.array_union(F.array(F.lit("")), lexical(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS)).where((F.col("n") >= EXAMPLES) | (F.col("word") == ""))
    whole = counts.where("word = ''").withColumnsRenamed({"n": "all", **{d: f"all_{d}" for d in DOMAINS}}).drop("word")
    both = counts.where("word <> ''").crossJoin(F.broadcast(whole))  # one row
    out = {}
    for d in DOMAINS:
        a, n, own, every = (F.col(c).cast("double") for c in (d, "n", f"all_{d}", "all"))
        chi = F.try_divide(every * F.pow(a * every - n * own, F.lit(2.0)), n * (every - n) * own * (every - own))
        found = both.where(a * every > n * own).withColumn("chi", chi).where(F.col("chi") >= CHI2).orderBy(F.desc("chi"), "word").limit(WORDS)
        out[d] = [x["word"] for x in found.select("word").collect()]
    return out


def featured(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """``docs`` with struct ``__f``: tokens (long) and the features of :data:`SIZES` (int)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x)) > 0)
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.regexp_count(body, F.lit(f"[{SYMBOLS}]"))

    def figures(w: Column) -> Column:
        n = F.size(w) - F.when(F.get(w, 0) == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)  # blanks at the ends
        hits = {d: F.size(F.array_intersect(w, F.array(*map(F.lit, words[d])))) if words.get(d) else F.lit(0) for d in DOMAINS}
        return F.struct(
            n.cast("long").alias("tokens"),
            steps(n, *LENGTHS).alias("b_length"),
            steps(symbols / F.greatest(n, F.lit(1)), *SYMBOLS_SHARE).alias("b_symbols"),
            steps(repeats, 1, 4).alias("b_repeats"),
            steps(F.length(body) / F.greatest(n, F.lit(1)), *CHARACTERS).alias("b_word"),
            *(steps(hits[d], *HITS).alias(f"b_{d}") for d in DOMAINS),
        )

    return docs.withColumn("__f", let(lexical(F.col("text")), figures))


def posteriors(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """``rows`` (features) with p_<domain>: naive Bayes with add-one counts of ``trained`` (features, domain, n)."""
    n = F.sum("n")
    prior = {x["domain"]: x["n"] for x in trained.groupBy("domain").agg(n.alias("n")).collect()}
    whole = sum(prior.values())
    scores = {d: F.lit(0.0) for d in DOMAINS}
    pairs = F.explode(F.array(*(F.struct(F.lit(b).alias("feature"), F.col(b).alias("value")) for b in SIZES))).alias("x")
    table = {(x["feature"], x["value"], x["domain"]): x["n"] for x in trained.select("domain", "n", pairs).groupBy("x.feature", "x.value", "domain").agg(n.alias("n")).collect()}
    for d in DOMAINS:
        own = prior.get(d, 0)
        scores[d] = F.lit(own + 1.0) / F.lit(float(whole + len(DOMAINS)))
        for b, size in SIZES.items():
            scores[d] = scores[d] * F.get(F.array(*(F.lit((table.get((b, v, d), 0) + 1.0) / (own + size)) for v in range(size))), F.col(b))
    total = reduce(lambda a, b: a + b, scores.values())
    return rows.withColumns({f"p_{d}": s / total for d, s in scores.items()})


def fitted(rows: DataFrame, targets: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, hold: int = HOLD) -> DataFrame:
    """``rows`` (tokens, p_*) with ``rate``, by projected gradient steps from rates of one.

    Steps end once no domain's share of the tokens moves by more than
    ``tolerance``; a warning says so if ``rounds`` don't suffice for that.
    """
    p = {d: F.col(f"p_{d}") for d in DOMAINS}
    first = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("s"), *(F.sum(F.col("tokens") * p[d]).alias(d) for d in DOMAINS)).first()
    size = float(first["s"]) or 1.0
    mass = {d: max(float(first[d] or 0.0) / size, 1e-9) for d in DOMAINS}
    weight = sum(targets.values())
    now, rate = rows, F.lit(1.0)
    totals = {d: float(first[d] or 0.0) for d in DOMAINS}
    moved = 0.0
    for turn in range(1, rounds + 1):
        push = reduce(lambda a, b: a + b, (F.lit(STEP * (totals[d] - targets[d] / weight * size) / size / mass[d]) * p[d] for d in DOMAINS))
        rate = F.greatest(F.lit(0.0), rate * F.lit(1 - STEP * RIDGE) + F.lit(STEP * RIDGE) - push)
        if turn % hold == 0:
            now, rate = cut(now.withColumn("rate", rate)), F.col("rate")
        got = now.agg(*(F.sum(rate * F.col("tokens") * p[d]).alias(d) for d in DOMAINS)).first()
        moved = max(abs(float(got[d] or 0.0) - totals[d]) for d in DOMAINS) / size
        totals = {d: float(got[d] or 0.0) for d in DOMAINS}
        if moved < tolerance:
            break
    else:
        warnings.warn(f"rates still move the domains' shares by {moved:.1e} after {rounds} steps", stacklevel=2)
    return now.withColumn("rate", rate)


def decided(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, p_<domain>, rate, n_copies), one for each row of ``docs``.

    ``n_copies`` is ``rate`` rounded up or down by a hash of doc_id, so that
    its expectation is ``rate``; rows that share a doc_id are drawn alike.  Null
    and empty texts have no tokens but posteriors and a rate like any others,
    texts of any length are taken whole, and other columns are ignored.
    Without labels the posteriors are even; an empty table gives no rows.  The
    texts are read once for the lexicons and once for the features; the rest
    works on a narrow table of features and posteriors.
    """
    targets = TARGETS if targets is None else targets
    known = labelled(labels)
    narrow = cut(featured(docs.select("doc_id", "text"), lexicons(docs, known)).select("doc_id", "__f.*"))
    trained = cut(narrow.withColumn("doc_id", F.col("doc_id").cast("long")).join(known, "doc_id").groupBy(*SIZES, "domain").agg(F.count("*").alias("n")))
    placed = cut(posteriors(narrow, trained).select("doc_id", "tokens", *(f"p_{d}" for d in DOMAINS)))
    rated = fitted(placed, targets)
    even = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor("rate") + F.when(even < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select("doc_id", F.col("tokens").alias("n_tokens"), *(f"p_{d}" for d in DOMAINS), "rate", copies.cast("long").alias("n_copies"))


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate asks for, with the columns they came with.

    All rows with one doc_id, and all without one, decide alike: as the row
    that asks for most copies.
    """
    copies = decided(docs, labels, targets).groupBy("doc_id").agg(F.max("n_copies").alias("n")).select(F.col("doc_id").alias("__id"), F.sequence(F.lit(1).cast("long"), "n").alias("__each"), "n")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("__key"))
    joined = rows.join(copies.where("n > 0"), F.col("__key").eqNullSafe(F.col("__id")))
    return joined.select("row", F.explode("__each")).select("row.*")
