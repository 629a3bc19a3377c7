"""Audit of how filters interact: what each would remove, in every order.

A document's failures are the bits of a mask.  Parts are histograms over the
masks: of all documents, of those labelled good, of those labelled toxic.
Stacked as rows they are multiplied by integer matrices of masks by (order,
step), one matrix for each outcome, so no document is judged once per order.

``audit`` takes the five filters of FILTERS; a row filter is a condition on a
text's features, and the last one asks whether a smaller doc_id has the same
text.  ``outcomes`` and ``product`` take any histograms of any filters.

Equal texts are found by SHA-256 and the smallest doc_id of each, joined back
on both, so a group of copies is never one task; rows are counted by id, text
and mask first and by id and mask before labels are joined, so neither is a
repeated or null id.  Histograms have at most 32 rows a part.

Defined cases: a null text is the empty text, a null lang the empty string.  A
row without a doc_id is never a copy of a smaller one, makes no other row one,
and has no labels; repeated rows of one id are counted each, none is smaller.  A
label of an id counts if any of its rows has it; null labels count as none.  An
empty table gives no rows.  Texts are read whole; of the columns only doc_id,
text, lang, quality and toxic are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import text_column
from quillon.llm.store import saved

#: Failure conditions on a text's features, by letter.  The filter of copies comes after them.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "has_symbol",
}
COPY = "E"
HISTOGRAMS = ("n", "good", "toxic")


def features(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    return {
        "n_words": F.size(words).cast("long"),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        "n_chars": F.length(text).cast("long"),
        "has_symbol": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """doc_id, part, digest of the text, and the bits of the row filters that it fails."""
    read = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
        F.coalesce(text_column(docs), F.lit("")).alias("text"),
    )
    seen = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in features(F.col("text")).items()))
    mask = sum((F.expr(f"int({x})") * (1 << i) for i, x in enumerate(filters.values())), F.lit(0))
    return seen.select("doc_id", "part", "digest", mask.alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, mask, and how many documents, good ones and toxic ones have that mask."""
    rows = saved(masks(docs, filters).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    by_id = (
        rows.join(first, ["digest", "doc_id"], "left")
        .withColumn("mask", F.col("mask") + copy.cast("int") * (1 << len(filters)))
        .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    )
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"], labels["toxic"]).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("is_toxic"),
    )
    return by_id.join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )


def outcomes(names: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) by column, and an integer matrix of masks by columns for each outcome."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    orders = ["".join(p) for p in permutations(names)]
    columns = [(o, s) for o in orders for s in range(1, len(names) + 1)]
    own = np.array([bit[o[s - 1]] for o, s in columns])
    before = np.array([sum(bit[f] for f in o[: s - 1]) for o, s in columns])
    mask = np.arange(1 << len(names))[:, None]
    removed = ((mask & before == 0) & (mask & own != 0)).astype(np.int64)
    of_filter = np.stack([removed[:, own == b].sum(axis=1) for b in bit.values()], axis=1)
    return columns, {
        "kept": (mask & (before | own) == 0).astype(np.int64),
        "removed": removed,
        "redundant": ((mask & before != 0) & (mask & own != 0)).astype(np.int64),
        "unique_fails": (mask == own).astype(np.int64),
        "shapley": of_filter[:, [list(bit.values()).index(b) for b in own]],
    }


def product(found: DataFrame, names: str) -> DataFrame:
    """Histograms (part, mask, n, good, toxic) times the matrices: one row per part, order and step."""
    size = 1 << len(names)
    cells = F.collect_list(F.struct("mask", *HISTOGRAMS))  # at most one for each mask
    schema = (
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, of = outcomes(names)
        orders, steps = (list(x) for x in zip(*columns))
        for b in batches:
            for part, cell in zip(b["part"].to_pylist(), b["cells"].to_pylist()):
                stacked = np.zeros((len(HISTOGRAMS), size), dtype=np.int64)
                for c in cell:
                    stacked[:, c["mask"]] = [c[h] for h in HISTOGRAMS]
                every, (_, good, toxic) = {k: stacked[0] @ of[k] for k in of}, stacked @ of["removed"]
                rows = {
                    "part": [part] * len(columns), "filter_order": orders, "step": pa.array(steps, pa.int32()), "kept": every["kept"],
                    "removed": every["removed"], "redundant": every["redundant"], "unique_fails": every["unique_fails"],
                    "good_lost": good, "toxic_lost": toxic, "shapley": every["shapley"],
                }
                yield pa.RecordBatch.from_pydict(rows)

    return found.groupBy("part").agg(cells.alias("cells")).mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step: kept, removed, redundant, unique, labels lost, and the filter's sum over all orders."""
    names = "".join(FILTERS) + COPY
    assert len(outcomes(names)[0]) == len(names) * factorial(len(names))
    return product(histograms(docs, labels), names)
