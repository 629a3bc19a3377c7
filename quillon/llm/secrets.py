"""Secret scans: base patterns and a battery of randomness tests.

Besides the base patterns, long unbroken tokens are candidates: whole runs of
the widest alphabet and, where a run holds "+", "/", "-" or "_", its pieces
between them.  The smallest alphabet that holds a token (hex, base32, base36,
base62, base64) is its encoding.  Three tests ask whether the token could be
random draws from that alphabet: chi-squared uniformity over cells of the
alphabet (digits, frequent and rare letters of either case, signs), too few
runs of characters of one class, and serial correlation of vowels, which in words
alternate with other letters.  Fisher's method combines their p-values.

A token is called a secret by rejecting that it is *text*: the combined value
is held against those of identifiers glued from the words of all documents (and
of a short list of common words, so that small tables have a null too), by
length.  The share of them that look as random is the token's p-value, by the
fitted tail of the null where few or none do.  A
Benjamini-Hochberg step over the candidates of a document, with weights that
grow with length since long tokens carry more evidence, keeps the share of
identifiers among the reported secrets below ``false_discovery``.  Of
candidates that overlap, the longest that is rejected stays.

Spans cover whole matches, in code points, ends exclusive.  An added span that
overlaps a base span is not added.  Defined cases: a null text is empty and
has no spans; an empty table gives no rows; repeated rows give repeated rows,
judged alike; long texts are scanned whole, in time that grows with their
length and n log n in the number of candidates.  Only doc_id and text are read,
whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column

BASE_KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = [_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")]
ASSIGN = re.compile(rf"""({'|'.join(NAMES)})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Pieces of a run: between "+" and "/", between "-" and "_", and between any of them.
SPLITS = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^+/_-]+"))
_HINT = re.compile("|".join(NAMES))
_SIGN = re.compile(r"[+/_-]")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, the smallest alphabet first.
ALPHABETS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _LOWER + _DIGITS),
    ("BASE36", _UPPER + _DIGITS),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Letters that are frequent in text of most Latin languages.
FREQUENT = frozenset("etaoinsrhl")
VOWELS = frozenset("aeiouAEIOU")
#: Common words of identifiers, for the null of small tables.
IDENTIFIER_WORDS = (
    "get set user name file path request handler manager service factory config parse default value index count total"
    " number string buffer stream reader writer update delete insert select process thread local remote server client list"
    " item map key entry node tree graph matrix image frame window button label text field form table row column query result"
    " error message event listener async task job queue stack cache memory disk socket session cookie header body response"
    " status code version build test model view layout style color font size width height main util data type base class"
).split()
#: Lengths at which the null is taken; a token is held against the longest that is not above its own.
NULL_LENGTHS = (12, 16, 20, 24, 28, 32, 40, 48, 64)
NULL_SIZE = 4000
#: Bins of the null: the normal deviate of the combined p-value, by tenths.
BINS, LOWEST = 128, -8.0
#: Share and least number of the null's highest values that its tail is fitted to.
TAIL, LEAST_TAIL = 0.005, 50
#: One identifier is glued for the null at every so many words of a document.
NULL_EVERY = 96
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NULL_WORD = re.compile(r"[A-Za-z]{2,}")


@dataclass(frozen=True)
class SecretRules:
    false_discovery: float = 0.009
    least_length: int = 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, number of kind, end) of the base matches, sorted."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees >= x), by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def cell_of(c: str) -> int:
    """Digits, frequent and rare capitals, frequent and rare small letters, signs."""
    if c.isdigit():
        return 0
    if c.isalpha():
        return (3 if c.islower() else 1) + (c.lower() not in FREQUENT)
    return 5


def class_of(c: str) -> int:
    return (0, 1, 1, 2, 2, 3)[cell_of(c)]


class Alphabet:
    """What the tests expect of uniform draws."""

    def __init__(self, name: str, letters: str):
        self.name, self.letters, m = name, frozenset(letters), len(letters)
        self.cell = {c: cell_of(c) for c in letters}
        self.cls = {c: class_of(c) for c in letters}
        vowels = sum(c in VOWELS for c in letters) / m
        self.deviate = {c: ((c in VOWELS) - vowels) / math.sqrt(vowels * (1 - vowels)) for c in letters}
        self.shares = {k: n / m for k, n in Counter(self.cell.values()).items()}
        share = [n / m for n in Counter(self.cls.values()).values()]
        self.change = 1 - sum(x * x for x in share)
        self.both = sum(x * (1 - x) ** 2 for x in share)


ENCODINGS = tuple(Alphabet(*x) for x in ALPHABETS)


def encoding_of(token: str) -> Alphabet | None:
    used = set(token)
    return next((a for a in ENCODINGS if used <= a.letters), None)


def battery(token: str, alphabet: Alphabet) -> tuple[float, float, float]:
    """p-values of the uniformity, runs and serial tests under uniform draws from the alphabet."""
    n = len(token)
    count = Counter(map(alphabet.cell.__getitem__, token))
    off = sum((count[k] - n * x) ** 2 / (n * x) for k, x in alphabet.shares.items())
    uniform = chi2_tail(off, len(alphabet.shares) - 1)
    kinds = list(map(alphabet.cls.__getitem__, token))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    x = alphabet.change
    var = (n - 1) * x * (1 - x) + 2 * (n - 2) * (alphabet.both - x * x)
    runs = lower_tail((changes - (n - 1) * x) / math.sqrt(max(var, 1e-9)))
    v = list(map(alphabet.deviate.__getitem__, token))
    serial = lower_tail(sum(a * b for a, b in zip(v, v[1:])) / math.sqrt(max(n - 1, 1)))
    return uniform, runs, serial


def lower_tail(z: float) -> float:
    """P(standard normal <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def combined(ps: tuple[float, ...]) -> float:
    """Fisher's method; the tail of chi-squared with 2k degrees is exact."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= x / i
        total += term
    return min(1.0, math.exp(-x) * total)


def deviate(p: float) -> float:
    """The normal deviate of a probability, to about 0.005 (Abramowitz and Stegun 26.2.23)."""
    if p <= 0:
        return LOWEST
    t = math.sqrt(-2 * math.log(max(min(p, 1 - p), 1e-300)))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return -z if p < 0.5 else z


def randomness_bin(token: str, alphabet: Alphabet) -> int:
    """How random a token looks, as a bin; high is random."""
    return max(0, min(BINS - 1, int((deviate(combined(battery(token, alphabet))) - LOWEST) * 10)))


def glued(words: list[str], length: int, number: int) -> str | None:
    """An identifier of the given length: words in CamelCase and a number, the form that looks most random."""
    out = ""
    for w in words:
        out += w.capitalize()
        if len(out) >= length:
            tail = str(number % 10 ** (1 + number // 10000 % 4))
            return out[: length - len(tail)] + tail
    return None


def null_lengths(rules: SecretRules) -> list[int]:
    return sorted({rules.least_length, *(n for n in NULL_LENGTHS if n > rules.least_length)})


def null_bin(words: list[str], length: int, number: int) -> int | None:
    token = glued(words, length, number)
    alphabet = token and encoding_of(token)
    return randomness_bin(token, alphabet) if alphabet else None


@lru_cache(4)
def common_null(rules: SecretRules) -> dict[int, np.ndarray]:
    """Counts by bin, for each length, of identifiers of common words."""
    rng, out = random.Random(42), {}
    for length in null_lengths(rules):
        bins = [null_bin(rng.choices(IDENTIFIER_WORDS, k=length), length, rng.randrange(1 << 20)) for _ in range(NULL_SIZE)]
        out[length] = np.bincount([b for b in bins if b is not None], minlength=BINS)
    return out


def corpus_null(docs: DataFrame, rules: SecretRules) -> dict[int, np.ndarray]:
    """The same, with identifiers of the words of all documents added; (lengths x bins) numbers reach the driver."""
    lengths = null_lengths(rules)

    def make():
        totals = {n: np.zeros(BINS, np.int64) for n in lengths}

        def f(texts):
            for text in texts:
                words = _NULL_WORD.findall(text or "")
                for k in range(0, len(words), NULL_EVERY):
                    some = words[k : k + NULL_EVERY]
                    mark = zlib.crc32(f"{k}:{some[0]}:{some[-1]}".encode())
                    length = lengths[(mark >> 20) % len(lengths)]
                    b = null_bin(some, length, mark & 0xFFFFF)
                    if b is not None:
                        totals[length][b] += 1

        def finish():
            rows = [(n, b, int(x[b])) for n, x in totals.items() for b in np.flatnonzero(x)]
            return [list(c) for c in zip(*rows)] if rows else [[], [], []]

        f.finish = finish
        return f

    part = map_rows(docs, [text_column(docs)], "length int, bin int, n long", make)
    out = {n: x.copy() for n, x in common_null(rules).items()}
    for r in part.groupBy("length", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.length][r.bin] += r.n
    return out


def p_values(null: dict[int, np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Lengths, and for each length and bin the share of the null that looks as random or more.

    Beyond the bin that TAIL of the null (or LEAST_TAIL of it) reach, the share falls off exponentially with the mean excess of
    those, taken a standard error high; so a value that no identifier has come near has a share far below 1 / size.  The null of z
    values falls off faster than that, which errs towards not reporting.
    """
    lengths, out = sorted(null), []
    for n in lengths:
        count, bins = null[n].astype(float), np.arange(BINS)
        reach = count[::-1].cumsum()[::-1]
        share = (1 + reach) / (1 + count.sum())
        enough = np.flatnonzero(reach >= max(LEAST_TAIL, TAIL * count.sum()))
        if len(enough):
            u = enough[-1]
            excess = (count[u:] * (bins[u:] - u + 0.5)).sum() / reach[u] * (1 + 1 / math.sqrt(reach[u]))
            share[u:] = share[u] * np.exp(-(bins[u:] - u) / excess)
        out.append(share)
    return lengths, np.array(out)


def discovered(tests: list[tuple[float, int]], level: float) -> list[bool]:
    """Weighted Benjamini-Hochberg: (p, length) -> is it rejected?"""
    if not tests:
        return []
    weight = [math.sqrt(n) for _, n in tests]
    scale = len(tests) / sum(weight)
    q = [p / (w * scale) for (p, _), w in zip(tests, weight)]
    order = sorted(range(len(q)), key=q.__getitem__)
    cut = max((k + 1 for k, i in enumerate(order) if q[i] <= level * (k + 1) / len(q)), default=0)
    chosen = set(order[:cut])
    return [i in chosen for i in range(len(q))]


@lru_cache(8)
def _runs(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_-]{{{max(1, least)},}}")


def candidates(text: str, rules: SecretRules):
    """(start, end, token, alphabet) of the runs that fit an alphabet, of the long pieces of those with signs, and of UUIDs without theirs."""
    for m in _runs(rules.least_length).finditer(text):
        spans = {m.span()}
        if _SIGN.search(m[0]):
            spans |= {p.span() for split in SPLITS for p in split.finditer(text, *m.span())}
        for start, end in sorted(s for s in spans if s[1] - s[0] >= rules.least_length):
            alphabet = encoding_of(text[start:end])
            if alphabet:
                yield start, end, text[start:end], alphabet
        for p in UUID.finditer(text, *m.span()) if rules.least_length <= 32 else ():
            token = p[0].replace("-", "")
            alphabet = encoding_of(token)
            if alphabet:
                yield *p.span(), token, alphabet


def random_spans(text: str, rules: SecretRules, null: tuple[list[int], np.ndarray]) -> list[tuple[int, int]]:
    lengths, share = null
    found, tests = [], []
    for start, end, token, alphabet in candidates(text, rules):
        at = bisect_right(lengths, len(token)) - 1
        found.append((start, end))
        tests.append((float(share[at][randomness_bin(token, alphabet)]), len(token)))
    secret = [s for s, x in zip(found, discovered(tests, rules.false_discovery)) if x]
    out: list[tuple[int, int]] = []
    for a, b in sorted(secret, key=lambda s: (s[0] - s[1], s)):  # pieces may overlap: the longest stays
        at = bisect(out, (a, b))
        if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
            out.insert(at, (a, b))
    return out


def scan_text(text: str | None, rules: SecretRules = SecretRules(), null: tuple[list[int], np.ndarray] | None = None):
    """(base spans, added spans), each as (start, number of kind, end); without a null, that of common words."""
    text = text or ""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1] if reach else 0))
    added = []
    for a, b in random_spans(text, rules, null or p_values(common_null(rules))):
        before = bisect(starts, b - 1)  # base spans that begin before the end
        if not before or reach[before - 1] <= a:
            added.append((a, len(BASE_KINDS), b))
    return base, added


def listed(spans) -> str:
    return ",".join(f"{(*BASE_KINDS, 'random')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    null = p_values(corpus_null(docs, rules))

    def make():
        def one(text):
            base, added = scan_text(text, rules, null)
            counts = [sum(k == i for _, k, _ in base) for i in range(len(BASE_KINDS))]
            return *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)

        return lambda ids, texts: [ids, *map(list, zip(*map(one, texts)))]

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    )
    return map_rows(docs, [docs["doc_id"].cast("long"), text_column(docs)], schema, make)
