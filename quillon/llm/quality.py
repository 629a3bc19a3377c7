"""Quality rules: divergence of a document from language references.

Each document becomes two histograms, one over character classes and one
over the common words of the known languages plus "any other word".  The
references are the mean histograms of all documents of each known language, so
they cover the whole corpus.  A document's distance is the Jensen-Shannon
distance (base 2, 0 to 1) to the nearest known language, or mixture of two of
them by quarters, as a text may be in both; the word distance that is allowed
falls with the number of words, as the noise of a sample does.
Documents shorter than the guards are not judged by distance, and neither is any
document if none of a known language passes them.

Any other label is vetted: where its mean shares of letters of any script,
digits, blanks, controls, points and symbols are close to a known language's,
its documents, and no others, may also be near the label's own reference.  A
null label, and one that is not vetted, is judged against the known languages.

Defined cases: a null text has no words and no characters; it fails the base
rules.  An empty table gives no rows.  Repeated rows are judged alike, one row
each; of equally near references the first by name counts.  Long texts are
judged whole.  Only doc_id, text and lang are read, whatever other columns are
called.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column
from quillon.llm.store import saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BLANK = " \t\n\x0b\x0c\r"

#: Common words of the languages that have a reference of their own.
COMMON_WORDS = {
    "en": "the of and to in is that it for as was with be by on are this from at or an not have has",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas aux elle ou on",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o",
}

CLASS_NAMES = ("lower", "upper", "digit", "space", "control", "point", "symbol", "accented", "other")


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; the last entry stands for the rest."""
    of = np.full(0x251, CLASS_NAMES.index("other"))
    for cp in range(0x250):
        c = chr(cp)
        if cp < 32 or 0x7F <= cp < 0xA0:
            name = "control"
        elif cp < 0x80:
            name = (
                "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit()
                else "space" if c == " " else "point" if c in ".,;:!?'\"()-" else "symbol"
            )
        else:
            name = "accented" if c.isalpha() else "other"
        of[cp] = CLASS_NAMES.index(name)
    return of


CLASS_OF = _classes()
#: Shares of the first of two known languages in the references of texts in both.
MIXTURES = (0.25, 0.5, 0.75)
#: Histograms are summed as whole numbers of this unit, so sums do not depend on order.
UNIT = 1 << 20


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    guard_chars: int = 200
    guard_words: int = 50
    max_char_distance: float = 0.30
    #: A sample of n words is off its own reference by about 1 / sqrt(n); so much is allowed, and a distance of its own.
    max_word_distance: float = 0.15
    word_distance_noise: float = 1.5
    #: Labels held at a time while histograms are summed; also a limit of the SQL twin, as is the next.
    max_languages: int = 64
    min_documents: int = 30
    max_script_distance: float = 0.12


def vocabulary(common: dict[str, str] = COMMON_WORDS) -> list[str]:
    return sorted({w for words in common.values() for w in words.split()})


def char_histogram(text: str) -> np.ndarray:
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0x250)
    return np.bincount(CLASS_OF, np.bincount(points, minlength=0x251), len(CLASS_NAMES))


def word_histogram(words: list[str], vocab: list[str]) -> np.ndarray:
    get = Counter(words).get
    hits = [get(w, 0) for w in vocab]
    return np.array([*hits, len(words) - sum(hits)], float)


#: Classes that do not depend on the script; the first is letters.
SCRIPT_NAMES = ("letter", "digit", "space", "control", "point", "symbol")
_POINTS = {"P": "point", "N": "digit", "S": "symbol", "Z": "space"}


def script_histogram(chars: np.ndarray, text: str) -> np.ndarray:
    """The character histogram by SCRIPT_NAMES; characters of other scripts go by their Unicode category."""
    of = dict(zip(CLASS_NAMES, map(int, chars)))
    out = dict.fromkeys(SCRIPT_NAMES, 0) | {n: of[n] for n in SCRIPT_NAMES[1:]}
    out["letter"] = of["lower"] + of["upper"] + of["accented"]
    if of["other"]:
        for c, n in Counter(text).items():
            if CLASS_OF[min(ord(c), 0x250)] == CLASS_NAMES.index("other"):
                kind = unicodedata.category(c)[0]
                out["letter" if kind in "LM" else _POINTS.get(kind, "control")] += n
    return np.array([out[n] for n in SCRIPT_NAMES], float)


def js_distances(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances in base 2 of a non-negative vector to each row; 1 if either is empty."""
    sums = references.sum(1)
    if p.sum() <= 0 or not len(references):
        return np.ones(len(references))
    p, q = p / p.sum(), references / np.where(sums > 0, sums, 1)[:, None]
    m = (p + q) / 2

    def part(x):
        return (x * np.log2(np.divide(x, m, out=np.ones_like(m), where=x > 0))).sum(1)

    return np.where(sums > 0, np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2)), 1.0)


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i] = hit[i + 1] = hit[i + 2] = hit[j] = hit[j + 1] = hit[j + 2] = 1
    return sum(hit)


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            if line in seen:
                count += 1
            seen.add(line)
    return count


def language_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, np.ndarray]:
    """Summed unit histograms of all documents that pass the guards, by language.

    The known languages have references of their own, as do the other labels that
    are vetted against them.  Labels are vetted where they are summed; what comes to the
    driver is (languages + vetted labels) * (classes + common words + 1) numbers.
    """
    vocab = vocabulary()
    size, n_script = len(CLASS_NAMES) + len(vocab) + 1, len(SCRIPT_NAMES)

    def make():
        totals: dict[str, np.ndarray] = {}

        def emptied():
            rows = [(k, i, int(v)) for k, x in totals.items() for i, v in enumerate(x) if v]
            totals.clear()
            return [list(c) for c in zip(*rows)] if rows else [[], [], []]

        def f(texts, langs):
            for text, lang in zip(texts, langs):
                if not lang:
                    continue
                words = WORD.findall(text or "")
                if len(words) < rules.guard_words or len(text) < rules.guard_chars:
                    continue
                chars, hits = char_histogram(text), word_histogram(words, vocab)
                script = script_histogram(chars, text)
                both = np.concatenate([chars / chars.sum(), hits / hits.sum(), script / script.sum()])
                totals[lang] = totals.get(lang, 0) + np.rint(both * UNIT).astype(np.int64)
            return emptied() if len(totals) > rules.max_languages else None

        f.finish = emptied
        return f

    part = map_rows(docs, [text_column(docs), docs["lang"].cast("string")], "lang string, bin int, total long", make)
    sums = saved(part.groupBy("lang", "bin").agg(F.sum("total").alias("total")))
    known: dict[str, np.ndarray] = {}
    for r in sums.where(F.col("lang").isin(*COMMON_WORDS)).collect():
        known.setdefault(r.lang, np.zeros(size + n_script))[r.bin] = r.total
    references = {lang: x[:size] for lang, x in known.items()}
    if not known:
        return references
    scripts = np.array([x[size:] for x in known.values()])
    shares = [F.coalesce(F.sum(F.when(F.col("bin") == size + i, F.col("total"))), F.lit(0)) for i in range(n_script)]
    others = sums.where(~F.col("lang").isin(*COMMON_WORDS))

    def vet():
        def f(langs, rows):
            near = [js_distances(np.array(x, float), scripts).min() <= rules.max_script_distance for x in rows]
            return [[lang for lang, ok in zip(langs, near) if ok]]

        return f

    labels = others.groupBy("lang").agg(F.array(*shares).alias("shares"))
    vetted = map_rows(labels, [F.col("lang"), F.col("shares")], "lang string", vet)
    for r in others.where(F.col("bin") < size).join(vetted, "lang").collect():
        references.setdefault(r.lang, np.zeros(size))[r.bin] = r.total
    return references


class Judge:
    """Judges single texts, holding the corpus references."""

    def __init__(self, references: dict[str, np.ndarray], rules: QualityRules):
        self.rules, self.vocab = rules, vocabulary()
        split = len(CLASS_NAMES)
        plain = [
            np.concatenate([x[:split] / x[:split].sum(), x[split:] / x[split:].sum()])
            for lang, x in sorted(references.items()) if lang in COMMON_WORDS
        ]
        mixed = [s * a + (1 - s) * b for a, b in combinations(plain, 2) for s in MIXTURES]
        self.known = np.array(plain + mixed).reshape(len(plain) + len(mixed), split + len(self.vocab) + 1)
        self.vetted = {lang: np.vstack([self.known, x]) for lang, x in references.items() if lang not in COMMON_WORDS}

    def base_failed(self, words: list[str], repeats: int) -> bool:
        n = len(words)
        return n < self.rules.min_words or 100 * repeats > self.rules.max_repeat_percent * n

    def distances(self, text: str, words: list[str], lang: str | None = None) -> tuple[float, float] | None:
        """Character and word distance to the nearest reference for the label; None below the guards."""
        rules, split = self.rules, len(CLASS_NAMES)
        if len(words) < rules.guard_words or len(text) < rules.guard_chars or not len(self.known):
            return None
        known = self.vetted.get(lang, self.known)
        chars = js_distances(char_histogram(text), known[:, :split])
        hits = js_distances(word_histogram(words, self.vocab), known[:, split:])
        nearest = int(np.argmin(chars + hits))
        return float(chars[nearest]), float(hits[nearest])

    def usual(self, words: list[str], distances: tuple[float, float] | None) -> bool:
        if distances is None:
            return True
        rules = self.rules
        allowed = rules.max_word_distance + rules.word_distance_noise / math.sqrt(len(words))
        return distances[0] <= rules.max_char_distance and distances[1] <= allowed

    def kept(self, text: str | None, lang: str | None = None) -> bool:
        """The verdict alone; distances are taken only where the base rules leave the text."""
        text = text or ""
        words = WORD.findall(text)
        return not self.base_failed(words, repeat_words(words)) and self.usual(words, self.distances(text, words, lang))

    def row(self, text: str | None, lang: str | None = None) -> tuple:
        """Base counts, verdict and distances."""
        text = text or ""
        words = WORD.findall(text)
        repeats = repeat_words(words)
        failed, found = self.base_failed(words, repeats), self.distances(text, words, lang)
        shown = [round(d, 6) for d in found] if found else [None, None]
        return (
            len(words), sum(map(len, words)), len(SYMBOL.findall(text)), duplicate_lines(text), repeats,
            failed, not failed and self.usual(words, found), *shown,
        )


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: base counts, distances to the nearest reference, verdict."""
    references = language_references(docs, rules)

    def make():
        row = Judge(references, rules).row
        return lambda ids, texts, langs: [ids, *map(list, zip(*map(row, texts, langs)))]

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, js_char double, js_word double"
    )
    return map_rows(docs, [docs["doc_id"].cast("long"), text_column(docs), docs["lang"].cast("string")], schema, make)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that are kept, with all their columns."""
    judged = Judge(language_references(docs, rules), rules)
    kept = F.pandas_udf(lambda texts, langs: pd.Series(list(map(judged.kept, texts, langs)), dtype=bool), "boolean")
    return docs.where(kept(text_column(docs), docs["lang"].cast("string")))
