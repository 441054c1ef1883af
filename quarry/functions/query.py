"""Query strings: normalisation, inline filters and keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import tokens

#: Words that are no keywords.
STOPWORDS = (
    "如何 怎么 怎样 什么 哪个 哪些 为什么 为何 谁 多少 几 是否 能否 可否 "
    "的 地 得 了 着 过 吗 呢 吧 啊 呀 "
    "在 于 和 与 或 及 并 而 但 但是 因为 所以 如果 那么 虽然 然而 "
    "我 你 他 她 它 我们 你们 他们 这 那 这个 那个 这些 那些 这里 那里 "
    "很 非常 特别 更 最 都 也 还 又 再 已 已经 正在 将 会 能 可以 应该 必须 "
    "是 有 做 进行 使用 通过 个 种 类 ？ 。 ！ ， 、 "
    "a an the in on at to for of with by from as into about through between after before "
    "and or but if then because while although i you he she it we they this that these those what which who whom whose "
    "is am are was were be been being have has had do does did will would could should may might must can "
    "get use make how why when where not no yes so very just also too"
).split()
FILTER = "([\\p{L}\\p{N}_]+):([^\\s]+)"
#: Short names of filter keys.
ALIASES = {"collection": "collection", "col": "collection", "c": "collection", "type": "doc_type", "doc_type": "doc_type", "t": "doc_type", "source": "source_path", "src": "source_path", "s": "source_path", "tag": "tags", "tags": "tags"}


def squeezed(text: Column) -> Column:
    """White space squeezed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def filter_pairs(query: Column) -> Column:
    """The inline ``key:value`` filters in their order, keys brought to their long names; other keys stay as written."""
    q = squeezed(query)
    pairs = F.arrays_zip(F.regexp_extract_all(q, F.lit(FILTER), 1).alias("key"), F.regexp_extract_all(q, F.lit(FILTER), 2).alias("value"))
    names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_element_at(names, F.lower(p["key"])), p["key"]).alias("key"), p["value"].alias("value")))


def filters(query: Column) -> Column:
    """A map of the filters but tags; of equal keys the last wins."""
    pairs = F.filter(filter_pairs(query), lambda p: p["key"] != "tags")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(last)


def tags(query: Column) -> Column:
    """The tags of all tag filters, in their order, repeats kept."""
    return F.flatten(F.transform(F.filter(filter_pairs(query), lambda p: p["key"] == "tags"), lambda p: F.split(p["value"], ",", -1)))


def remainder(query: Column) -> Column:
    """The query without its filters."""
    return squeezed(F.regexp_replace(squeezed(query), FILTER, ""))


def keywords(text: Column, least: int = 1, limit: int = 20, stopwords: list[str] | None = None) -> Column:
    """The first ``limit`` distinct keywords: compared in lower case, first spelling kept, without stop-words."""
    words = F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~F.lower(t).isin(stopwords or STOPWORDS))
    lowered = F.transform(words, F.lower)
    first = F.filter(words, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
    return F.slice(first, 1, limit)


def merged(parsed: Column, explicit: Column) -> Column:
    """Filters of a query with explicit ones over them."""
    kept = F.map_filter(parsed, lambda k, _: ~F.map_contains_key(explicit, k))
    return F.map_concat(kept, explicit)


def stopwords(add: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> list[str]:
    """The stop-words with some more and without some, all in lower case."""
    out = {w.strip().lower() for w in (*STOPWORDS, *add)} - {w.strip().lower() for w in remove}
    return sorted(out - {""})


def plain_terms(query: Column) -> Column:
    """The parts of a query between blanks, for callers without a query parser."""
    return F.filter(F.split(squeezed(query), " "), lambda t: t != "")


def clamped(top_k: int | None, default: int = 5, most: int = 20) -> int:
    """How many results a tool gives: the default for none or zero, ``most`` at most."""
    return min(top_k or default, most)


def widened(top_k: int, reranking: bool, fusion_k: int | None = None) -> int:
    """How many candidates to fetch: twice as many before reranking, and no fewer than the fusion is set to."""
    return max(2 * top_k, fusion_k or 0) if reranking else top_k


def checked(query: str | None = None, top_k: int | None = None) -> None:
    """Raises ``ValueError`` for a blank query or a number of results below one."""
    if query is not None and not query.strip():
        raise ValueError("a query can't be blank")
    if top_k is not None and (isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1):
        raise ValueError("top_k is a whole number above 0")
