"""Toxicity: a convolutional text classifier with thresholds by language.

A word's embedding is the sum of hashed rows: one for the word and one for each
of a few of its beginnings and its end, so that inflected forms share most of
theirs.  Filters of several widths run over the embeddings of a text, each
filter's largest value is kept, and a logistic unit weighs them.  The network is
trained in numpy on the driver; texts are scored in the workers, whole.

Filters are linear, so a worker keeps for each word it has met the word's share
in every place of every filter: a filter's value at a place is a sum of gathered
numbers, and texts are taken in blocks of words whatever their length.

Fit: at most ``docs_per_class`` rows of each label, at hashed places among the
labelled rows outside the held-out fold and the calibration fold, whole texts of
at most ``most_chars`` code points.  The same rows give word counts by language,
which tell the language of a text from the text.  Thresholds: all labelled rows
of the calibration fold are scored, counted by language, label and value, and
the threshold of a language is in the middle of those of best F1.  Languages with fewer
than ``least_labels`` rows of either label share one.  A score is the sigmoid of
the distance from the threshold, so 0.5 is the threshold everywhere.

Defined cases: null and empty texts and those without letters have no words and
get the score of no evidence.  Rows without doc_id are neither held out nor
learned from.  Of several labels of an id the largest counts; of several texts
under one id the first in order is learned from.  Without labels of both kinds every score
is the share of toxic ones, 0 if there are none.  Repeated rows are scored
alike, an empty table gives no rows, and other columns than doc_id, text, lang
and toxic are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column
from quillon.llm.store import saved

WORD = re.compile(r"[^\W\d_]+")
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Values are counted in bins of this size between -LIMIT and LIMIT.
BIN, LIMIT = 1 / 32, 16.0
#: Words that a worker keeps, and words that are convolved at once.
HELD_WORDS, BLOCK = 150_000, 32_768
LANGUAGE_BUCKETS = 1 << 13
PREFIXES, SUFFIX = (4, 5, 6), 5


@dataclass(frozen=True)
class ToxicityRules:
    docs_per_class: int = 2000
    most_chars: int = 20_000
    buckets: int = 1 << 16
    dimensions: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    epochs: int = 3
    least_steps: int = 200
    batch: int = 16
    rate: float = 0.003
    seed: int = 7
    #: A language has a threshold of its own from so many rows of each label, and word counts from so many sampled ones.
    least_labels: int = 10


def grams(word: str, buckets: int) -> list[int]:
    """Hash buckets of a word, of its beginnings and of its end; bucket 0 is empty."""
    marked = f"<{word}>"
    parts = [marked, *(marked[:k] for k in PREFIXES if len(marked) > k)]
    if len(marked) > SUFFIX:
        parts.append(marked[-SUFFIX:])
    found = [1 + zlib.crc32(p.encode()) % (buckets - 1) for p in parts]
    return found + [0] * (len(PREFIXES) + 2 - len(found))


class Words:
    """Numbers for words in the order they come; number 0 is no word."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.number: dict[str, int] = {}
        self.rows: list[list[int]] = [[0] * (len(PREFIXES) + 2)]

    def of(self, words: list[str]) -> np.ndarray:
        number, rows, out = self.number, self.rows, []
        for w in words:
            k = number.get(w)
            if k is None:
                k = number[w] = len(rows)
                rows.append(grams(w, self.buckets))
            out.append(k)
        return np.array(out, dtype=np.int64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Network:
    """Embedding rows, filters by width, weights of the largest values, and a constant."""

    def __init__(self, rules: ToxicityRules):
        rng = np.random.default_rng(rules.seed)
        self.rules, self.widths, self.n = rules, rules.widths, rules.filters
        self.rows = (rng.standard_normal((rules.buckets, rules.dimensions)) * 0.1).astype(np.float32)
        self.rows[0] = 0
        self.taps = [(rng.standard_normal((w, rules.dimensions, rules.filters)) * 0.3).astype(np.float32) for w in rules.widths]
        self.bias = np.zeros(len(rules.widths) * rules.filters, np.float32)
        self.weight = (rng.standard_normal(len(self.bias)) * 0.1).astype(np.float32)
        self.constant = np.zeros(1, np.float32)

    def shares(self, buckets: np.ndarray) -> np.ndarray:
        """What words add to the values of the filters, by place within a filter."""
        vectors = self.rows[buckets].astype(np.float64).sum(axis=1)
        return np.concatenate([vectors @ place for taps in self.taps for place in taps], axis=1).astype(np.float32)

    def values(self, shares: np.ndarray, numbers: np.ndarray) -> Iterator[np.ndarray]:
        """For each width, the filters' values at all places but the last ones, where a filter would reach past the end."""
        size, at = len(numbers) - max(self.widths) + 1, 0
        for w in self.widths:
            out = shares[numbers[:size], at : at + self.n]
            for place in range(1, w):
                lo = at + place * self.n
                out += shares[numbers[place : size + place], lo : lo + self.n]
            at += w * self.n
            yield out

    def largest(self, shares: np.ndarray, pieces: list[np.ndarray]) -> np.ndarray:
        """The largest value of every filter in every piece; -inf where there are no words.

        A piece ends in as many numbers as the widest filter reaches past its first place; no filter starts there.
        """
        reach = max(self.widths) - 1
        stream = np.concatenate([*pieces, np.zeros(reach, np.int64)])
        of = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        closed = np.concatenate([np.arange(len(x)) >= len(x) - reach for x in pieces])
        best = np.full((len(pieces), len(self.bias)), -np.inf, np.float32)
        for k in range(0, len(of), BLOCK):
            owner = of[k : k + BLOCK]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            found = np.concatenate(list(self.values(shares, stream[k : k + len(owner) + reach])), axis=1)
            found[closed[k : k + BLOCK]] = -np.inf
            here = owner[first]
            best[here] = np.maximum(best[here], np.maximum.reduceat(found, first, axis=0))
        return best

    def value(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.weight + self.constant


class Adam:
    """Steps for one array, or for some rows of it."""

    def __init__(self, at: np.ndarray, rate: float):
        self.at, self.rate, self.step = at, rate, 0
        self.mean, self.square = np.zeros_like(at), np.zeros_like(at)

    def move(self, slope: np.ndarray, rows=slice(None)) -> None:
        self.step += 1
        self.mean[rows] += 0.1 * (slope - self.mean[rows])
        self.square[rows] += 0.01 * (slope * slope - self.square[rows])
        # Rows that are met now and then are not corrected for their start, which only slows their first steps.
        self.at[rows] -= self.rate * self.mean[rows] / (np.sqrt(self.square[rows]) + 1e-6)


def train(texts: list[str], toxic: list[int], rules: ToxicityRules = ToxicityRules()) -> Network:
    """A network fitted to texts and labels by stochastic gradients of the logistic loss."""
    net, words = Network(rules), Words(rules.buckets)
    numbers, y = [words.of(words_of(t)) for t in texts], np.array(toxic, np.float32)
    buckets = np.array(words.rows, np.int64)
    share = y.mean()
    net.constant[:] = np.log(share / (1 - share))
    parts = [Adam(x, rules.rate) for x in (*net.taps, net.bias, net.weight, net.constant)]
    rows = Adam(net.rows, 3 * rules.rate)
    rng = np.random.default_rng(rules.seed)
    batches = -(-len(texts) // rules.batch)
    for _ in range(max(rules.epochs, -(-rules.least_steps // batches))):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), rules.batch):
            _descend(net, [numbers[i] for i in order[k : k + rules.batch]], y[order[k : k + rules.batch]], buckets, parts, rows)
    return net


def _descend(net: Network, texts: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, parts: list[Adam], rows: Adam) -> None:
    """One step on a batch.  Only the places of the largest values have slopes."""
    used, local = np.unique(np.concatenate([[0], *texts]), return_inverse=True)
    vectors = net.rows[buckets[used]].sum(axis=1)
    shares = np.concatenate([vectors @ place for taps in net.taps for place in taps], axis=1)
    reach, at, n = max(net.widths) - 1, 1, net.n
    best = np.full((len(texts), len(net.bias)), -np.inf, np.float32)
    place = np.zeros(best.shape, np.int64)
    padded = []
    for i, t in enumerate(texts):
        own = np.concatenate([local[at : at + len(t)], np.zeros(reach, np.int64)])
        at += len(t)
        padded.append(own)
        if len(t):
            found = np.concatenate(list(net.values(shares, own)), axis=1)
            place[i] = found.argmax(axis=0)
            best[i] = found[place[i], np.arange(found.shape[1])]
    open_ = np.maximum(best + net.bias, 0)
    off = (1 / (1 + np.exp(-(open_ @ net.weight + net.constant))) - y) / len(y)
    slope = np.outer(off, net.weight) * (open_ > 0)
    by_word = np.zeros_like(vectors)
    tap_slopes = []
    for k, (w, taps) in enumerate(zip(net.widths, net.taps)):
        part, here = slope[:, k * n : (k + 1) * n], place[:, k * n : (k + 1) * n]
        slopes = np.zeros_like(taps)
        for i in np.flatnonzero(part.any(axis=1)):
            for j in range(w):
                met = padded[i][here[i] + j]
                slopes[j] += vectors[met].T * part[i]
                np.add.at(by_word, met, part[i][:, None] * taps[j].T)
        tap_slopes.append(slopes)
    for adam, s in zip(parts, (*tap_slopes, slope.sum(axis=0), open_.T @ off, off.sum(keepdims=True))):
        adam.move(s)
    touched = np.flatnonzero(by_word.any(axis=1))
    if len(touched):
        cells = buckets[used[touched]]
        hit, where = np.unique(cells, return_inverse=True)
        total = np.zeros((len(hit), by_word.shape[1]), np.float32)
        np.add.at(total, where.ravel(), np.repeat(by_word[touched], cells.shape[1], axis=0))
        rows.move(total[hit > 0], hit[hit > 0])


@dataclass
class Languages:
    """Log shares of hashed words, by language."""

    names: list[str]
    logs: np.ndarray

    @classmethod
    def learn(cls, texts: list[str], langs: list[str | None], rules: ToxicityRules) -> Languages:
        rows = Counter(x for x in langs if x is not None)
        names = sorted(x for x, n in rows.items() if n >= rules.least_labels)
        counts = np.full((len(names), LANGUAGE_BUCKETS), 0.1)
        for t, x in zip(texts, langs):
            if x in names:
                own = [grams(w, rules.buckets)[0] % LANGUAGE_BUCKETS for w in words_of(t)]
                counts[names.index(x)] += np.bincount(own, minlength=LANGUAGE_BUCKETS)
        return cls(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


class Scorer:
    """Values and languages of texts; keeps the shares of the words it has met."""

    def __init__(self, net: Network, languages: Languages):
        self.net, self.languages = net, languages
        self._empty()

    def _empty(self) -> None:
        self.words = Words(self.net.rules.buckets)
        self.shares = np.zeros((1024, sum(self.net.widths) * self.net.n), np.float32)
        self.own = np.zeros(1024, np.int64)
        self.known = 1

    def _extend(self) -> None:
        """Shares of the words that came since the last call."""
        rows = np.array(self.words.rows[self.known :], np.int64)
        if not len(rows):
            return
        end = self.known + len(rows)
        if end > len(self.shares):
            size = max(2 * len(self.shares), end)
            self.shares = np.concatenate([self.shares, np.zeros((size - len(self.shares), self.shares.shape[1]), np.float32)])
            self.own = np.concatenate([self.own, np.zeros(size - len(self.own), np.int64)])
        self.shares[self.known : end] = self.net.shares(rows)
        self.own[self.known : end] = rows[:, 0] % LANGUAGE_BUCKETS
        self.known = end

    def _taken(self, held: list[tuple[int, np.ndarray]], best: np.ndarray, likely: np.ndarray) -> None:
        """Works off pieces of texts that are held, and forgets words if there are many."""
        if not held:
            return
        self._extend()
        reach = max(self.net.widths) - 1
        at = [i for i, _ in held]
        np.maximum.at(best, at, self.net.largest(self.shares, [x for _, x in held]))
        for i, x in held:
            met, times = np.unique(self.own[x[: len(x) - reach]], return_counts=True)
            likely[i] += self.languages.logs[:, met] @ times.astype(np.float32)
        held.clear()
        if self.known > HELD_WORDS:
            self._empty()

    def many(self, texts: list[str | None]) -> tuple[list[float], list[str]]:
        """The network's value and the language ("" where none fits) of each text."""
        names, reach = self.languages.names, max(self.net.widths) - 1
        best = np.full((len(texts), len(self.net.bias)), -np.inf, np.float32)
        likely = np.zeros((len(texts), len(names)))
        held, size, empty = [], 0, []
        for i, text in enumerate(texts):
            words = words_of(text)
            empty.append(not words)
            for k in range(0, len(words), BLOCK):
                piece = self.words.of(words[k : k + BLOCK + reach])
                after = np.zeros(max(0, reach - max(0, len(words) - k - BLOCK)), np.int64)
                held.append((i, np.concatenate([piece, after])))
                size += len(piece)
                if size > 2 * BLOCK:
                    self._taken(held, best, likely)
                    size = 0
        self._taken(held, best, likely)
        langs = ["" if none or not names else names[int(x.argmax())] for none, x in zip(empty, likely)]
        return self.net.value(best).astype(float).tolist(), langs


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) and fold of every id outside the held-out fold."""
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    return (
        marks.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % FOLDS).where(F.col("fold") != HELD_OUT)
    )


def sample(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> list:
    """(toxic, text, lang) of the rows that the network is fitted to, at most ``docs_per_class`` of each label."""
    known = labelled(labels).where(F.col("fold") != CALIBRATION)
    share = {r["toxic"]: 2 * rules.docs_per_class / r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return []
    place = F.crc32(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string"))) / float(1 << 32)
    chosen = known.withColumn("place", place).where(F.col("place") < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    read = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"), docs["lang"].cast("string").alias("lang")
    ).where(f"text is not null and length(text) <= {rules.most_chars}")
    rows = (
        read.join(F.broadcast(chosen), "doc_id")  # about twice docs_per_class ids of each label
        .groupBy("toxic", "place", "doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).collect()
    )
    out = []
    for label in (0, 1):
        own = sorted((r for r in rows if r["toxic"] == label), key=lambda r: (r["place"], r["doc_id"]))
        out += [(label, r["row"]["text"], r["row"]["lang"]) for r in own[: rules.docs_per_class]]
    return out


def best_threshold(positive: np.ndarray, negative: np.ndarray) -> float:
    """The middle of the bins' edges that give the best F1, from counts by bin."""
    hit = np.r_[positive[::-1].cumsum()[::-1], 0]
    false = np.r_[negative[::-1].cumsum()[::-1], 0]
    f1 = 2 * hit / np.maximum(hit + false + positive.sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    end = best[0] + np.flatnonzero(np.diff(np.r_[best, best[-1] + 2]) > 1)[0]
    return float((best[0] + end) / 2 * BIN - LIMIT)


def calibrate(counts: list, rules: ToxicityRules = ToxicityRules()) -> tuple[dict[str, float], float]:
    """Thresholds by language, and the one that the others share, from (lang, toxic, bin, n)."""
    bins = int(2 * LIMIT / BIN)
    of: dict[str, np.ndarray] = {}
    for lang, toxic, at, n in counts:
        of.setdefault(lang, np.zeros((2, bins), np.int64))[toxic, min(max(at, 0), bins - 1)] += n
    pooled = sum(of.values(), np.zeros((2, bins), np.int64))
    fits = lambda c: (c.sum(axis=1) >= rules.least_labels).all()
    common = best_threshold(pooled[1], pooled[0]) if fits(pooled) else 0.0
    return {k: best_threshold(c[1], c[0]) for k, c in of.items() if k and fits(c)}, common


def score(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """One row per document: fold, score, whether it is toxic, and the language whose threshold was taken."""
    doc_id = docs["doc_id"].cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    rows = sample(docs, labels, rules)
    if len({r[0] for r in rows}) < 2:
        share = labelled(labels).agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        out = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.lit(share).alias("score"), F.lit("").alias("language"))
        return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")
    toxic, texts, langs = (list(x) for x in zip(*rows))
    model = train(texts, toxic, rules), Languages.learn(texts, langs, rules)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size that rules give it

    def make():
        scorer = Scorer(*shared.value)

        def f(ids, held, texts):
            return [ids, held, *scorer.many(texts)]

        return f

    scored = saved(map_rows(docs, [doc_id, held, text_column(docs)], "doc_id long, held_out boolean, value double, language string", make))
    at = F.floor((F.col("value") + LIMIT) / BIN).cast("int")
    counts = (
        scored.where(f"crc32(cast(doc_id as string)) % {FOLDS} = {CALIBRATION}").groupBy("doc_id", "language", at.alias("at")).count()
        .join(labelled(labels).where(F.col("fold") == CALIBRATION), "doc_id").groupBy("language", "toxic", "at").agg(F.sum("count"))
        .collect()  # bins x labels x languages
    )
    own, common = calibrate([tuple(r) for r in counts], rules)
    threshold = F.coalesce(*(F.when(F.col("language") == lang, t) for lang, t in own.items()), F.lit(common))
    out = scored.withColumn("score", F.round(1 / (1 + F.exp(threshold - F.col("value"))), 6))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")
