"""Spelling variants: words one edit apart, each grouped under its most frequent form.

Every word emits a key for itself and for each of its distinct single
deletions.  Words that share a key are candidates, found by an equi-join; exact
distance one is checked on the words.  A word's form is its most frequent near
word, if that is frequent enough, and forms are followed to the last by joins
that double the step.

Keys are 61-bit polynomial hashes of the remaining string, made for all
deletions of a word in one pass over it, and rows carry a word's id, not the
word: a word of a million letters costs a million short rows.  What hashes
throw together the check on the words takes apart.  Two words one replacement
apart share one key, the string without the replaced place, since distinct
deletions that leave equal strings lie in one run of equal letters; two words
one insertion apart share one, the shorter word.  So no pair comes twice.  A key
is shared by at most (letters of the alphabet x its length + 1) words, whatever
the size of the corpus.

Counts are summed in the tasks before they are shuffled.  Each step's table is
saved to the shared folder; n grows by ``ratio`` along forms, so there are at
most log2(log5(n)) rounds.

Defined cases: null and empty texts have no words; a null doc_id is the empty
string where runs are hashed.  Repeated rows count again.  Of near words of
equal n the smallest in code-point order is the form.  An empty table gives no
rows, long texts and long words are read whole, and of the columns only doc_id
and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column
from quillon.llm.store import saved

#: Runs of letters; those of ASCII are in lower case by then.
LETTERS = r"a-zÀ-ÿ"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: A prime and a base for hashes of strings.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


@dataclass(frozen=True)
class VariantRules:
    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    #: One run in so many loses a letter, chosen by a hash of document and run; 0 for none.
    slips: int = 199


def runs_of(text: str | None, least: int) -> Counter:
    """Runs of at least so many letters, A-Z in lower case, with counts."""
    low = (text or "").encode().translate(_LOWER).decode()
    return Counter(re.findall(f"[{LETTERS}]{{{least},}}", low))


def slipped(run: str, seed: int, one_in: int) -> str:
    """The run, or the run less one code point where its hash asks for that; the seed is the hash of what precedes it."""
    h = zlib.crc32(run.encode(), seed)
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, rules: VariantRules = VariantRules()) -> DataFrame:
    """word, n: words of the whole table that are long and frequent enough."""
    least = rules.least_length

    def make():
        held: Counter = Counter()

        def taken():
            out = [list(held.keys()), list(held.values())]
            held.clear()
            return out

        def f(ids, texts):
            for doc, text in zip(ids, texts):
                found = runs_of(text, least)
                if rules.slips:
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in found.items():
                        word = slipped(run, seed, rules.slips)
                        if len(word) >= least:
                            held[word] += n
                else:
                    held.update(found)
            return taken() if len(held) > HELD_WORDS else None

        f.finish = taken
        return f

    parts = map_rows(docs, [docs["doc_id"].cast("long"), text_column(docs)], "word string, n long", make)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.least_count)


def keys_of(word: str) -> list[int]:
    """Hashes of the word and of its distinct single deletions."""
    prefix, weight = [0], [1]
    for c in word:
        prefix.append((prefix[-1] * BASE + ord(c) + 1) % PRIME)
        weight.append(weight[-1] * BASE % PRIME)
    size, out = len(word), [prefix[-1]]
    for i in range(size):
        if i and word[i] == word[i - 1]:
            continue
        after = size - i - 1
        tail = prefix[size] - prefix[i + 1] * weight[after]
        out.append((prefix[i] * weight[after] + tail) % PRIME)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all words exactly one edit apart, each way round."""
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")

    def make():
        def f(ids, texts):
            keys = [keys_of(w) for w in texts]
            return [[k for ks in keys for k in ks], [i for i, ks in zip(ids, keys) for _ in ks]]

        return f

    keys = map_rows(named, [named["id"], named["word"]], "key long, id long", make)
    met = keys.alias("a").join(keys.alias("b"), "key").where("a.id < b.id").select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    left = named.select(F.col("id").alias("a_id"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = named.select(F.col("id").alias("b_id"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = met.join(left, "a_id").join(right, "b_id").where("levenshtein(a, b, 1) = 1")
    each = "named_struct('word', {0}, 'n', {0}_n, 'other', {1}, 'other_n', {1}_n)"
    return near.selectExpr(f"inline(array({each.format('a', 'b')}, {each.format('b', 'a')}))")


def forms(words: DataFrame, rules: VariantRules = VariantRules()) -> DataFrame:
    """word, n, n_near, form and form_n (null where no near word is frequent enough)."""
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    enough = -F.col("best.less") >= rules.ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last form that can be followed; forms must not go round."""
    at = saved(links.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group(words: DataFrame, rules: VariantRules = VariantRules()) -> DataFrame:
    """word, n, n_near, form, form_n and root, for a table of distinct words with counts."""
    found = saved(forms(words, rules))
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, rules: VariantRules = VariantRules()) -> DataFrame:
    """The words of all texts with their near words, forms and roots."""
    return group(saved(count_words(docs, rules)), rules)
