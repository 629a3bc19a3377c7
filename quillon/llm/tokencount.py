"""Token counts by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens.  Distinct pre-tokens go into a trie of bytes;
each node holds the best unigram score of its prefix and the number of tokens
of that best path, so a prefix that pre-tokens share is scored once.  The node
where a pre-token ends gives its count, which is stored.

Scores are those of a vocabulary file of pieces and log-probabilities
(``piece<TAB>score``), or, where only ranks are known, as in the default file,
Zipf's law: the piece of rank r has log-probability -log((r + 1) * H).  Single
bytes that the vocabulary lacks get the least score of all, less a little.  Ties
go to fewer tokens.  The trie and the stored counts of a worker are dropped
whenever they pass ``max_nodes``, which only costs time; a pre-token above LONG
bytes is scored by the same steps without being kept, so that one text cannot
fill the trie.  No text is cut.

Defined cases: a null or empty text has no tokens.  Repeated rows are counted
alike, an empty table gives no rows, long texts are counted whole.  Only doc_id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import math
import re

from pyspark.sql import DataFrame

from quillon.llm.rowmap import map_rows, text_column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_PIECES = 300_000
PRE_TOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+")
MAX_NODES = 400_000
#: Pre-tokens above so many bytes are scored alone and not kept.
LONG = 256


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces by rank, read on the driver; refuses vocabularies above MAX_PIECES."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    return [piece for _, piece in _bounded(ranked, path)]


def _bounded(pieces: list, path: str) -> list:
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{path} has {len(pieces)} pieces; at most {MAX_PIECES} are sent to the workers")
    return pieces


def read_scores(path: str = VOCABULARY) -> dict[bytes, float]:
    """Log-probabilities by piece: of a file with scores, or by Zipf's law of one with ranks (``.tiktoken``).

    In files with scores "\u2581" stands for a blank; a line without a score, or with an empty piece, is left out.
    """
    if path.endswith(".tiktoken"):
        return zipf_scores(read_vocabulary(path))
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").rpartition("\t") for line in f]
    found = {piece.replace("\u2581", " ").encode(): float(s) for piece, _, s in rows if piece and s.strip()}
    _bounded(list(found), path)
    least = min(found.values(), default=0.0) - 1.0
    return {bytes([b]): least for b in range(256)} | found


def zipf_scores(pieces: list[bytes]) -> dict[bytes, float]:
    harmonic = math.log(sum(1 / (r + 1) for r in range(len(pieces) + 1)))
    scores = {p: -math.log(r + 1) - harmonic for r, p in enumerate(pieces)}
    for b in range(256):
        scores.setdefault(bytes([b]), -math.log(len(pieces) + 1) - harmonic)
    return scores


class TrieCounter:
    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.max_nodes = max_nodes
        #: Pieces as a trie read from the last byte to the first: node -> {byte: node}, and scores.
        self.back: list[dict[int, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, s in scores.items():
            at = 0
            for b in reversed(piece):
                nxt = self.back[at].get(b)
                if nxt is None:
                    nxt = self.back[at][b] = len(self.back)
                    self.back.append({})
                    self.score.append(None)
                at = nxt
            self.score[at] = s
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.stored: dict[str, int] = {}

    def _extend(self, data: bytes, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, -tokens) of data[:end], from those of all shorter prefixes."""
        back, score, at, k, best = self.back, self.score, 0, end, None
        while k:
            k -= 1
            at = back[at].get(data[k], -1)
            if at < 0:
                break
            s = score[at]
            if s is not None:
                before = path[k]
                x = (before[0] + s, before[1] - 1)
                if best is None or x > best:
                    best = x
        return best

    def count(self, token: str) -> int:
        """Tokens of one pre-token."""
        n = self.stored.get(token)
        if n is not None:
            return n
        data = token.encode()
        if len(data) > LONG:
            path = [(0.0, 0)]
            for end in range(1, len(data) + 1):
                path.append(self._extend(data, end, path))
            return -path[-1][1]
        if len(self.children) > self.max_nodes:
            self.clear()
        at, path, children = 0, [self.best[0]], self.children
        for end, b in enumerate(data, 1):
            nxt = children[at].get(b)
            if nxt is None:
                nxt = children[at][b] = len(children)
                children.append({})
                self.best.append(self._extend(data, end, path))
            at = nxt
            path.append(self.best[at])
        n = self.stored[token] = -path[-1][1]
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, pre-tokens) of a text."""
        parts = PRE_TOKEN.findall(text or "")
        get, count = self.stored.get, self.count
        total = 0
        for p in parts:
            n = get(p)
            total += count(p) if n is None else n
        return total, len(parts)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per document: tokens, pre-tokens and bytes of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_scores(vocabulary))

    def make():
        counter = TrieCounter(shared.value, max_nodes)

        def f(ids, texts):
            tokens, parts = zip(*map(counter.text, texts))
            return [ids, list(tokens), list(parts), [len((t or "").encode()) for t in texts]]

        return f

    schema = "doc_id long, n_tokens long, n_pretokens long, n_bytes long"
    return map_rows(docs, [docs["doc_id"].cast("long"), text_column(docs)], schema, make)
