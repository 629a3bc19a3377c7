"""Spelling variants against brute force: all pairs of words by edit distance."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import queries, variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_words(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by[len(w) + k] if one_apart(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out[w, f, root, n, len(near[w]), words[f] if f else None] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_words(name, request):
    df = request.getfixturevalue(name)
    want = plain_words([(r.doc_id, r.text) for r in df.collect()])
    assert {r.word: r.n for r in variants.count_words(df).collect()} == want


def test_query_against_brute_force(spark, docs, sf_dir):
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    out = got(queries.op13_variant_grouping(spark, sf_dir))
    assert out == plain_groups(words)
    assert sum(f is not None for _, f, *_ in out) > 0


def test_dense_words_chains_and_ties(spark):
    """Few letters, so that keys are shared by many; counts that make chains of several forms."""
    rng = np.random.default_rng(11)
    words = {}
    while len(words) < 700:
        words["".join(rng.choice(list("abé"), int(rng.integers(6, 10))))] = int(5 ** rng.integers(1, 7))
    words |= {"chainn": 5, "chain": 25, "chai": 125, "cha": 625, "ch": 3125, "c": 15625}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    out = got(variants.group(table))
    assert out == plain_groups(words)
    assert ("chainn", "chain", "c", 5, 1, 25) in out


def test_long_words_and_empty_tables(spark, none, edge):
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh"), 20_000))
    words = {long: 40, long[:777] + long[778:]: 8, "x" * 30_000: 5, "x" * 29_999: 30, long[:9] + "z" + long[10:]: 5}
    out = got(variants.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert out == plain_groups(words)
    assert variants.variants(none).count() == 0
    assert variants.variants(edge.withColumn("word", edge["text"]).withColumn("n", edge["rank"])).count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "Colour colors")] * 9 + [(4, "colours ÀÉcole ÀÉcole " * 3)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(variants.variants(df)) == plain_groups(plain_words(rows))


def test_keys():
    """A word and its distinct deletions have distinct keys; equal strings have equal ones."""
    assert len(variants.keys_of("aabbca")) == len({"aabbca"} | {"aabbca"[:i] + "aabbca"[i + 1 :] for i in range(6)})
    assert variants.keys_of("abcd")[1:] == [variants.keys_of(w)[0] for w in ("bcd", "acd", "abd", "abc")]
    assert variants.keys_of("") == [0]
