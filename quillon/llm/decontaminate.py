"""Benchmark decontamination with one Aho-Corasick automaton.

Both sides are normalised to words of digits, ASCII letters in lower case and
non-ASCII bytes.  Every word that a benchmark holds gets one code point of its
own, so a text becomes a string with one character per word, a window of ten
words is a pattern of ten characters, and the place of a match is a word
number, from which the offsets in the original text follow.

A benchmark above BLOCK_WINDOWS windows, or with more distinct words than there
are code points, has several automata.  All of them are broadcast and every text
is read once, past each of them, so a worker holds the whole benchmark, about
0.4 KB a window.

Defined cases: a null text has no words and is clean.  Benchmark rows without
words or with a null item_id take no part.  Equal texts under several ids
count for each id; repeated rows of one id count once.  An empty benchmark
leaves every document clean; an empty table gives no rows.  Repeated documents
are judged alike.  Long texts are scanned whole.  Of the columns only doc_id,
text and item_id are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column

WINDOW = 10
#: Code points for words: below the surrogates and above them.
FIRST, HOLE, HOLE_SIZE, LAST = 0x21, 0xD800, 0x800, 0x10FFFF
MAX_WORDS = LAST - FIRST - HOLE_SIZE
#: One automaton holds at most so many windows (about 0.4 KB each); a larger benchmark has several, searched in one pass.
BLOCK_WINDOWS = 500_000
UNKNOWN = " "

_TABLE = bytes(
    c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 0x20
    for c in range(256)
)
_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_windows(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))]


class Scanner:
    """The automaton of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.code: dict[bytes, str] = {}
        owners: dict[str, set[int]] = {}
        for item, text in items:
            for window in item_windows(words_of(text)):
                owners.setdefault("".join(map(self._code_of, window)), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def _code_of(self, word: bytes) -> str:
        if word not in self.code:
            n = FIRST + len(self.code)
            if len(self.code) >= MAX_WORDS:
                raise ValueError("a block of the benchmark has too many distinct words")
            self.code[word] = chr(n if n < HOLE else n + HOLE_SIZE)
        return self.code[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged runs of hit words (from, to exclusive) and the items they come from."""
        if not self.any:
            return [], set()
        get = self.code.get
        coded = "".join([get(w, UNKNOWN) for w in words])
        spans, items = [], set()
        for end, (length, ids) in self.automaton.iter(coded):
            spans.append((end + 1 - length, end + 1))
            items.update(ids)
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as spans of code points of the original text."""
    if not runs:
        return []
    at = [m.span() for m in _SPAN.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def pieces(words: list[bytes], limit: int) -> list[list[bytes]]:
    """An item's words in stretches of at most ``limit`` windows, which together have the windows of the item."""
    if len(words) < limit + WINDOW:
        return [words] if words else []
    return [words[k : k + limit + WINDOW - 1] for k in range(0, len(words) - WINDOW + 1, limit)]


def blocks(benchmark: DataFrame, limit: int):
    """Lists of (item_id, text) with at most ``limit`` windows and MAX_WORDS distinct words each; items that exceed either are cut."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    block, size, seen = [], 0, set()
    for r in rows.where("i is not null and t is not null").toLocalIterator():
        for words in pieces(words_of(r.t), max(1, min(limit, MAX_WORDS - WINDOW + 1))):
            n = len(item_windows(words))
            new = set(words) - seen
            if block and (size + n > limit or len(seen) + len(new) > MAX_WORDS):
                yield block
                block, size, seen, new = [], 0, set(), set(words)
            block.append((r.i, b" ".join(words).decode()))
            size += n
            seen |= new
    yield block


def _scanners(shared: list, builds=None) -> list[Scanner]:
    """The automata of the broadcast blocks.  Each is built once in a worker process and lives as long as its block."""
    out = []
    for block in shared:
        scanner = block.__dict__.get("scanner")
        if scanner is None:
            scanner = block.__dict__["scanner"] = Scanner(block.value)
            if builds is not None:
                builds.add(1)
        out.append(scanner)
    return out


def _shared(docs: DataFrame, benchmark: DataFrame, block_windows: int) -> list:
    """The blocks of the benchmark, broadcast one by one."""
    return [docs.sparkSession.sparkContext.broadcast(block) for block in blocks(benchmark, block_windows)]


def scan(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, builds=None) -> DataFrame:
    """One row per document: words, hit words, matching items, hit spans of the original text.

    ``builds``, an accumulator, counts the automata that workers build.
    """
    shared = _shared(docs, benchmark, block_windows)

    def make():
        scanners = _scanners(shared, builds)

        def one(text):
            words, runs, items = words_of(text), [], set()
            for scanner in scanners:
                more, found = scanner.scan(words)
                runs += more
                items |= found
            runs = merge(runs) if len(scanners) > 1 else runs
            names = sorted(map(str, items))
            hit = sum(b - a for a, b in runs)
            spans = [list(x) for x in original_spans(text or "", runs)]
            return len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, spans

        return lambda ids, texts: [ids, *map(list, zip(*map(one, texts)))]

    out = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
        " hit_spans array<array<int>>"
    )
    return map_rows(docs, [docs["doc_id"].cast("long"), text_column(docs)], out, make)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS, builds=None
) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    shared = _shared(docs, benchmark, block_windows)

    def clean(texts):
        scanners = _scanners(shared, builds)

        def one(text):
            words = words_of(text)
            return not any(scanner.scan(words)[1] for scanner in scanners)

        return texts.map(one)

    return docs.where(F.pandas_udf(clean, "boolean")(text_column(docs)))
