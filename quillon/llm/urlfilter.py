"""URL filters: exact host and path rules, then a weighted vocabulary.

The vocabulary is one Aho-Corasick automaton.  A term counts where no ASCII
letter or digit touches it on either side.  One strict term rejects; so do
distinct soft terms whose weights reach the threshold, however often each of
them occurs.

The vocabulary is a parameter: terms with weight and class, from a table or a
tab-separated file (``vocabulary``); the few built-in terms are a default.

Defined cases: a null url, or one without "://", has empty host and path; its
whole text (nothing for null) is still searched.  Rows are judged one by one,
so repeated rows are judged alike; an empty table gives no rows.  Of equally
long rules the first in order counts.  A very long url is searched whole, in
time in proportion to its length.  Only page_id and url are read, whatever
other columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

STRICT_TERMS = ("porn", "xxx", "hentai", "malware", "phishing", "warez", "spam-farm", "escort", "viagra")
SOFT_TERMS = {
    "casino": 1.5, "poker": 1.0, "bet": 0.5, "adult": 1.0, "sex": 1.5, "nude": 1.5, "cheap": 1.0, "pills": 1.0,
    "spam": 1.0, "farm": 0.5, "loan": 1.0, "crack": 1.0, "torrent": 1.0, "free": 0.5, "win": 0.5, "deal": 0.5,
    "click": 0.5, "bonus": 0.5,
}


@dataclass(frozen=True)
class UrlRules:
    """rules: (verdict, host + path prefix); strict and soft terms; soft weight that rejects."""

    rules: tuple[tuple[str, str], ...] = (
        ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
        ("block", "com/de/"),
    )
    strict: tuple[str, ...] = STRICT_TERMS
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT_TERMS))
    threshold: float = 2.0
    least_distinct: int = 2


#: Terms that one automaton in a worker may hold, about 0.3 KB each.
MOST_TERMS = 1_000_000


def vocabulary(terms: DataFrame, **rules) -> UrlRules:
    """Rules with the vocabulary of a table (term, weight, class): class "strict" or "soft".

    Terms are lower-cased; null and empty ones and other classes are left out; the largest weight of a term counts.
    """
    rows = terms.select(F.lower(F.trim("term")).alias("t"), F.col("weight").cast("double").alias("w"), F.lower("class").alias("c"))
    rows = rows.where("t != '' and c in ('strict', 'soft')").groupBy("t", "c").agg(F.max(F.coalesce("w", F.lit(1.0))).alias("w"))
    found = sorted((r.c, r.t, r.w) for r in rows.limit(MOST_TERMS + 1).collect())
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    soft = {t: w for c, t, w in found if c == "soft"}
    return UrlRules(strict=tuple(t for c, t, _ in found if c == "strict"), soft=soft, **rules)


def read_vocabulary(spark: SparkSession, path: str, **rules) -> UrlRules:
    """Rules with the vocabulary of a tab-separated file of term, weight and class without a header."""
    return vocabulary(spark.read.option("sep", "\t").schema("term string, weight double, class string").csv(path), **rules)


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return ascii_lower(host), slash + path


def automaton_of(rules: UrlRules) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in rules.strict:
        a.add_word(term, (term, None))
    for term, weight in rules.soft.items():
        if not a.exists(term):
            a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def term_hits(url: str | None, automaton) -> tuple[set[str], dict[str, float]]:
    """Distinct strict terms, and distinct soft terms with weights, at word boundaries."""
    text = ascii_lower(url or "")
    strict, soft = set(), {}
    for end, (term, weight) in automaton.iter(text):
        start = end + 1 - len(term)
        if (start and text[start - 1] in ALNUM) or (end + 1 < len(text) and text[end + 1] in ALNUM):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return strict, soft


def rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits; hosts are tried by suffix."""
    best = None
    labels = host.split(".") if host else []
    for i in range(len(labels)):
        for prefix, verdict, name in rules.get(".".join(labels[i:]), ()):
            if path.startswith(prefix) and (best is None or len(name) > len(best[1])):
                best = (verdict, name)
    return best


def judge_urls(pages: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """One row per page: host, path, rule and verdict, with the distinct term hits."""

    def make():
        automaton = automaton_of(rules)
        by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, name in rules.rules:
            host, slash, path = name.partition("/")
            by_host.setdefault(host, []).append((slash + path, verdict, name))

        def one(url):
            host, path = host_and_path(url)
            strict, soft = term_hits(url, automaton)
            total = sum(soft[t] for t in sorted(soft))
            rejected = bool(strict) or (len(soft) >= rules.least_distinct and total >= rules.threshold)
            rule = rule_of(host, path, by_host)
            verdict = rule[0] if rule else "block" if rejected else "allow"
            return host, path, rule and rule[1], verdict, len(strict), len(soft), total

        return lambda ids, urls: [ids, *map(list, zip(*map(one, urls)))]

    schema = (
        "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long,"
        " soft_weight double"
    )
    return map_rows(pages, [pages["page_id"].cast("long"), pages["url"].cast("string")], schema, make)
