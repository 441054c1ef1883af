"""Text: tokens, cleaning, titles, summaries, tags, names and numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a token, fenced code and an image placeholder look like.
TOKEN = "[\\p{L}\\p{N}]+(?:[._-][\\p{L}\\p{N}]+)*"
FENCE = "(?s)```.*?```"
PLACEHOLDER = "\\[IMAGE:\\s*([^\\]]+)\\]"


def tokens(text: Column) -> Column:
    """Words of letters and digits; runs joined by a dot, underscore or hyphen stay whole."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def index_terms(text: Column, least: int = 2) -> Column:
    """Tokens as the index holds them: lower case, at least ``least`` characters."""
    return F.filter(F.transform(tokens(text), F.lower), lambda t: F.length(t) >= least)


def refine(text: Column) -> Column:
    """Rule-based cleaning that leaves fenced code alone.

    Rule lines around page marks go with what they enclose, other rule lines,
    comments and tags go, blanks and blank lines are squeezed, lines lose
    their trailing white space.  Parts between fences are cleaned joined by a
    mark, so that patterns may span a fence as they may span any text.
    """
    mark, other = "\ufdd0", "\ufdd1"  # no characters; where a text holds them all the same, they are written with ``other`` meanwhile
    given = F.when(text.rlike(f"[{mark}{other}]"), F.replace(F.replace(text, F.lit(other), F.lit(other + "b")), F.lit(mark), F.lit(other + "a"))).otherwise(text)
    plain = F.array_join(F.split(given, FENCE, -1), mark)
    fences = F.regexp_extract_all(given, F.lit(FENCE), 0)
    #: What goes, and what takes its place.
    for pattern, put in (
        ("(?isu)─{10,}.*?(?:Page \\d+|Footer|Section \\d+|©|Confidential).*?─{10,}", ""),
        ("─{10,}", ""),
        ("(?s)<!--.*?-->", ""),
        ("<[^>]+>", ""),
        (" {2,}", " "),
        ("\\n{3,}", "\n\n"),
        ("[ \\t\\x0B\\f\\r]+(?=\\n|$)", ""),
    ):
        plain = F.regexp_replace(plain, pattern, put)
    parts = F.split(plain, mark, -1)
    whole = F.array_join(F.flatten(F.transform(parts, lambda p, i: F.when(i < F.size(fences), F.array(p, F.get(fences, i))).otherwise(F.array(p)))), "")
    clean = F.regexp_replace(F.when(F.size(fences) > 0, whole).otherwise(plain), "^\\s+|\\s+$", "")
    clean = F.when(clean.contains(other), F.replace(F.replace(clean, F.lit(other + "a"), F.lit(mark)), F.lit(other + "b"), F.lit(other))).otherwise(clean)
    return F.when(F.trim(text) == "", F.lit("")).otherwise(clean)


def title(text: Column) -> Column:
    """A heading at the start, else a short first line, else the first sentence, else the first characters."""
    heading = F.regexp_extract(text, "^#{1,6}\\s+([^\\n]+)", 1)
    line = F.trim(F.split(text, "\\n", 2)[0])
    sentence = F.regexp_replace(F.trim(F.split(text, "[.!?]\\s+", 2)[0]), "[.!?]+$", "")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("Untitled"))
        .when(F.trim(heading) != "", F.trim(heading))
        .when((line != "") & (F.length(line) <= 100) & ~line.rlike("[.,;]$"), line)
        .when((sentence != "") & (F.length(sentence) <= 150), sentence)
        .when(sentence != "", F.concat(F.substring(sentence, 1, 147), F.lit("...")))
        .otherwise(F.concat(F.trim(F.substring(text, 1, 100)), F.when(F.length(text) > 100, F.lit("...")).otherwise(F.lit(""))))
    )


def summary(text: Column, sentences: int = 3, limit: int = 500) -> Column:
    """The first sentences, cut with an ellipsis at ``limit`` characters."""
    first = F.regexp_replace(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+"), 1, sentences), " "), "^\\s+|\\s+$", "")
    return clipped(first, limit)


def clipped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots where something is cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def keyword_tags(text: Column, limit: int = 10) -> Column:
    """Runs of capitalised words, code identifiers and emphasised terms: five of each, sorted, the first ``limit``."""
    word = "(?<![\\p{L}\\p{N}_])"
    end = "(?![\\p{L}\\p{N}_])"
    capitals = F.regexp_extract_all(text, F.lit(f"{word}[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*{end}"), 0)
    names = F.regexp_extract_all(text, F.lit(f"{word}[a-z]+(?:[A-Z][a-z]*)+{end}|{word}[a-z]+_[a-z_]+{end}"), 0)
    strong = F.regexp_extract_all(text, F.lit("\\*\\*.+?\\*\\*|\\*.+?\\*|__.+?__|_.+?_"), 0)
    strong = F.transform(F.slice(strong, 1, 5), lambda x: F.trim(F.regexp_replace(x, "^(\\*\\*|\\*|__|_)|(\\*\\*|\\*|__|_)$", "")))
    every = F.array_union(F.array_union(F.slice(capitals, 1, 5), F.slice(names, 1, 5)), F.filter(strong, lambda x: x != ""))
    return F.slice(F.array_sort(every), 1, limit)


def preview(text: Column, limit: int = 240) -> Column:
    """One line of the text, null if it has none."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return clipped(F.nullif(line, F.lit("")), limit)


def image_refs(text: Column) -> Column:
    """Ids of the image placeholders, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1), lambda t: F.trim(t))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_")


def path_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    name = F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^.*/", "")
    return F.when(name.rlike("^.+\\.[^.]*$"), F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name)


def document_name(value: Column) -> Column:
    """A document reference as comparable name: compatibility form, no quotes, query or fragment, path or suffix, case folded."""
    plain = F.regexp_replace(F.trim(compatible(F.coalesce(value, F.lit("")))), "^[\"']+|[\"']+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "[?#].*$", ""), "\\\\", "/")
    return F.trim(path_stem(F.regexp_replace(plain, "/+$", "")))


def evidence_text(value: Column) -> Column:
    """Compatibility form, case folded, punctuation, symbols and white space as single blanks."""
    return F.trim(F.regexp_replace(compatible(F.coalesce(value, F.lit(""))), "[\\p{P}\\p{S}\\p{Z}\\s]+", " "))


def text_matches(wanted: Column, got: Column) -> Column:
    """Whether a text holds an evidence, whole or half of its tokens; both in the form of :func:`evidence_text`."""
    a, b = F.split(wanted, " "), F.split(got, " ")
    times = lambda words, t: F.size(F.filter(words, lambda x: x == t))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(times(a, t), times(b, t)))
    return (wanted != "") & (got != "") & (got.contains(wanted) | (2 * common >= F.size(a)))


#: Characters that lower case (and "ss" for the sharp s) brings to their folded compatibility form.
PLAIN = "[^\\x00-\\x7F\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u20ac\u2013-\u201e]"


def compatible(value: Column) -> Column:
    """Unicode compatibility form and case folding; Python sees only texts with a character that isn't plain."""
    simple = F.replace(F.lower(value), F.lit("\u00df"), F.lit("ss"))
    return F.coalesce(folded(F.when(value.rlike(PLAIN), value)), simple)


@F.pandas_udf(StringType())
def folded(value: pd.Series) -> pd.Series:
    """Unicode compatibility form and case folding, for which Spark has no function."""
    return value.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def heading(text: Column, within: int) -> Column:
    """The first ``# `` heading in the first lines; null without one."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n", -1), 1, within), stripped)
    return stripped(F.substring(F.get(F.filter(lines, lambda x: x.startswith("# ")), 0), 3, 1 << 30))


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def loader_title(text: Column) -> Column:
    """A loaded document's title: the first ``# `` heading in 20 lines, else the first of 10 lines that isn't blank, else null."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n", -1), 1, 10), stripped)
    return F.coalesce(heading(text, 20), F.get(F.filter(lines, lambda x: x != ""), 0))


def tool_title(given: Column, text: Column, path: Column) -> Column:
    """A summary's title: the given one, a ``# `` heading in 10 lines, the path's stem in title case, else a default."""
    stem = F.initcap(F.translate(path_stem(F.nullif(path, F.lit(""))), "_-", "  "))
    return F.coalesce(F.nullif(given, F.lit("")), heading(text, 10), stem, F.lit("Untitled Document"))


def tool_summary(text: Column, limit: int = 500) -> Column:
    """A preview without headings: the lines with content joined by blanks, cut at ``limit``."""
    lines = F.filter(F.transform(F.split(stripped(text), "\n", -1), stripped), lambda x: (x != "") & ~x.startswith("#"))
    joined = clipped(F.array_join(lines, " "), limit)
    return F.when(F.coalesce(text, F.lit("")) == "", "No summary available.").when(joined == "", "No content preview available.").otherwise(joined)


def display_number(value: Column, digits: int = 4) -> Column:
    """A value for a table: numbers rounded, other texts as they are, blank for none."""
    return F.coalesce(F.round(value.try_cast("double"), digits).cast("string"), value, F.lit(""))


def number_or_zero(value: Column, whole: bool = False) -> Column:
    """A text's number, 0 where it has none; ``whole`` cuts the fraction."""
    found = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return found.cast("long") if whole else found


def half_even(value: Column, digits: int) -> Column:
    """A double rounded as floats are: its multiple by a power of ten to the nearest whole number, halves to the even one."""
    scaled = F.rint(value.cast("double") * 10.0**digits)
    return F.when(F.abs(value) < 2.0**52, scaled / 10.0**digits).otherwise(value)


def fixed(value: Column, digits: int) -> Column:
    """A double with ``digits`` decimals by its exact binary value, halves to even, as C and Python print it.

    Java rounds the shortest decimal instead, by which 0.35 is a half.  The
    product by the power of ten is kept as the sum of two doubles; from 2**52
    on it is printed as Java does.
    """
    size, scale = F.abs(value.cast("double")), 10.0**digits

    def split(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (high, low), (scale_high, scale_low) = split(size), split(F.lit(scale))
    product = size * scale
    rest = high * scale_high - product + high * scale_low + low * scale_high + low * scale_low
    whole = F.floor(product)
    beyond = product - whole - 0.5
    up = (beyond > 0) | ((beyond == 0) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    shown = F.concat(sign, F.floor(n / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("long").cast("string"), digits, "0"))
    return F.when(product < 2.0**52, shown).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def duration(ms: Column) -> Column:
    """Milliseconds to read: seconds from 1000 on."""
    return F.when(ms >= 1000, F.concat(fixed(ms / 1000, 2), F.lit(" s"))).otherwise(F.concat(fixed(ms, 1), F.lit(" ms")))


#: Factors of number suffixes.
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "trillion": 1e12, "%": 0.01, "percent": 0.01, "percentage": 0.01}
#: What a number looks like.
NUMBER = (
    "(?i)(?<![\\p{L}\\p{N}_.])(\\()?\\s*([+-])?\\s*(US\\$|USD|EUR|GBP|CNY|RMB|JPY|CAD|AUD|HKD|[$€£¥])?\\s*([+-])?\\s*"
    "((?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?|\\.\\d+)\\s*(%|percent(?:age)?|thousand|million|billion|trillion|k|m|bn|b)?\\s*(\\))?(?![\\p{L}\\p{N}_])"
)


def numbers(text: Column) -> Column:
    """Numbers of a text as (value, explicit), explicit with a currency or suffix: those first, later ones before earlier."""
    group = lambda i: F.regexp_extract_all(text, F.lit(NUMBER), i)
    each = F.arrays_zip(*(group(i).alias(n) for i, n in enumerate(("open", "sign", "money", "sign2", "number", "suffix", "close"), 1)))
    scale = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv))

    def read(x: Column, i: Column) -> Column:
        size = F.replace(x["number"], F.lit(","), F.lit("")).cast("double") * F.coalesce(F.try_element_at(scale, F.lower(x["suffix"])), F.lit(1.0))
        below = (x["sign"] == "-") | (x["sign2"] == "-") | ((x["open"] != "") & (x["close"] != ""))
        return F.struct(F.when((x["money"] != "") | (x["suffix"] != ""), 0).otherwise(1).alias("k"), (-i).alias("i"), F.when(below, -F.abs(size)).otherwise(size).alias("value"))

    return F.transform(F.array_sort(F.transform(each, read)), lambda x: F.struct(x["value"].alias("value"), (x["k"] == 0).alias("explicit")))


def numeric_accuracy(reference: Column, answer: Column) -> Column:
    """1 if any number of the answer is within 1 % of the reference's first, else 0; null without one in the reference."""
    want, got = numbers(reference), numbers(answer)
    first = F.get(want, 0)["value"]
    close = F.exists(got, lambda x: F.abs(x["value"] - first) <= F.greatest(0.01 * F.greatest(F.abs(x["value"]), F.abs(first)), F.lit(1e-6)))
    return F.when(F.size(want) == 0, F.lit(None).cast("double")).when(close, 1.0).otherwise(0.0)
