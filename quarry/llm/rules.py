"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document.  The ledger keeps the
measurements and one failure bit for each rule; a policy is a named, versioned
mask of the bits that reject.  Applying another policy or finding out what a
rule alone rejects is then bit arithmetic over the ledger, not another pass
over the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule with its fixed bit; ``fails`` makes a condition of the measurements."""

    name: str
    bit: int
    fails: Callable[[], Column]


def _n(name: str) -> Column:
    return F.col(name)


#: Bits are never reused, so that old ledgers keep their meaning.
RULES = (
    Rule("too_few_words", 0, lambda: _n("n_words") < 20),
    Rule("repeated_windows", 1, lambda: 100 * _n("n_repeat_words") > 30 * _n("n_words")),
    Rule("symbols", 2, lambda: 2 * _n("n_symbols") > _n("n_words")),
    Rule("duplicate_lines", 3, lambda: (_n("n_dup_lines") >= 4) & (2 * _n("n_dup_lines") > _n("n_lines"))),
    Rule("long_words", 4, lambda: _n("word_chars") > 40 * _n("n_words")),
)
#: Policies by version: the rules whose failure rejects.
POLICIES = {
    "base-1": ("too_few_words", "repeated_windows"),
    "full-1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words"),
}


def mask(policy: str) -> int:
    """The bits that reject under a policy; an unknown name raises ``KeyError``."""
    names = POLICIES[policy]
    return sum(1 << r.bit for r in RULES if r.name in names)


def word_list(text: Column) -> Column:
    """The words of a text: runs without blanks; none for a null text."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(plain) > 0, F.split(plain, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of ``window`` words that the text has twice or more.

    Windows are compared by a 64-bit hash within one text.  The positions of
    the repeated ones come from one sort; each adds the words by which it
    reaches beyond the repeated window before it.  n log n in the words.
    """

    def covered(positions: Column) -> Column:
        first = F.aggregate(
            positions,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )
        return F.coalesce(first, F.lit(0))

    def positions(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        again = F.filter(
            sorted_,
            lambda x, i: ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(sorted_, i + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, window)).alias("h"), i.alias("i")))
        return let(F.sort_array(hashed), lambda s: let(positions(s), covered))

    return let(words, lambda w: F.when(F.size(w) > window, of(w)).otherwise(F.lit(0))).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many of a text's characters are among ``characters``."""
    without = text
    for c in characters:
        without = F.replace(without, F.lit(c), F.lit(""))
    return F.length(text) - F.length(without)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long) added."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)

    def figures(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    names = ("n_words", "n_repeat_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    kept = docs.drop(*names)
    rest = F.struct(*(F.col(f"`{c}`") for c in kept.columns))  # apart, so that no name meets one used here
    both = kept.select(rest.alias("row"), body.alias("body"), let(word_list(F.col(text).cast("string")), figures).alias("w"), let(lines, of_lines).alias("l"))
    return both.select(
        *(F.col("row").getField(c).alias(c) for c in kept.columns),
        "w.n_words",
        "w.n_repeat_words",
        (F.length("body") - count_of(F.col("body"), BLANKS)).cast("long").alias("word_chars"),
        count_of(F.col("body"), SYMBOLS).cast("long").alias("n_symbols"),
        "l.n_lines",
        "l.n_dup_lines",
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failures`` (long), one bit for each rule of :data:`RULES`.

    Every row is kept, whatever repeats; a null text measures as one without
    words.  Existing columns with these names are replaced.
    """
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("failures", bits)


def kept(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_alone (rejected by it alone), n_kept_without (kept if it were left out).

    One aggregation over the ledger's bits; an empty ledger gives zeros.
    """
    m = mask(policy)
    hit = F.col("failures").bitwiseAND(F.lit(m))
    rules = [r for r in RULES if m >> r.bit & 1]
    sums = []
    for r in rules:
        sums += [
            F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}"),
            F.count_if(hit == F.lit(1 << r.bit)).alias(f"a{r.bit}"),
            F.count_if(hit.bitwiseAND(F.lit(m & ~(1 << r.bit))) == 0).alias(f"k{r.bit}"),
        ]
    one = rows.agg(*sums)
    each = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"a{r.bit}").alias("n_alone"), F.col(f"k{r.bit}").alias("n_kept_without")) for r in rules]
    return one.select(F.inline(F.array(*each)))


def clean(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with the columns they came with."""
    width = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*width).alias("row"), F.col("text").cast("string").alias("text"))
    return ledger(rows).where(kept(policy)).select("row.*")
