"""Language identification by compression.

Each language gets a zstandard raw-content dictionary, made of a bounded
sample of labelled training documents.  A whole text is encoded in blocks with
every dictionary, and the language with the fewest bytes wins.  The score is
how much smaller it is than the runner-up; narrow margins are marked rejected.

The sample: a piece of at most ``chars_per_document`` characters, at a place of
the whole text chosen by a hash of doc_id, from at most ``docs_per_language``
documents of every labelled language, chosen by another, whose crc32 of doc_id is
not 2 modulo 4.  Nothing else is limited.  More than ``coders_at_once`` languages
are scored in groups, so workers hold no more prepared dictionaries than that.
Case is folded on both sides.

Defined cases: null texts and texts without letters are "und" with score 0, as
is every text if nothing could be learned.  A null doc_id is neither held out
nor learned from; of several texts under one doc_id and language the first in
order is learned from.  Ties go to the language with more training documents,
then by name.  Repeated rows are predicted alike, an empty table gives no rows,
long texts are encoded whole, and other columns than doc_id, text and lang are
not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column


@dataclass(frozen=True)
class LanguageRules:
    docs_per_language: int = 100
    chars_per_document: int = 600
    coders_at_once: int = 64
    level: int = 12
    block: int = 2048
    steepness: float = 40.0
    least_margin: float = 0.01


def learn(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> list[tuple[str, bytes]]:
    """(language, dictionary content), most frequent language first."""
    known = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"), docs["lang"].cast("string").alias("lang")
    ).where("doc_id is not null and text is not null and lang is not null and crc32(cast(doc_id as string)) % 4 != 2")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return []
    wanted = docs.sparkSession.createDataFrame([(r["lang"], 2 * rules.docs_per_language / r["count"]) for r in counts], "lang string, share double")
    place = F.expr("crc32(concat('dictionary:', cast(doc_id as string))) / 4294967296D")
    begin = F.expr(f"cast(1 + crc32(concat('piece:', cast(doc_id as string))) % (greatest(length(text) - {rules.chars_per_document}, 0) + 1) as int)")
    rows = (
        known.withColumn("place", place)
        .join(F.broadcast(wanted), "lang")  # a number per language
        .where("place < share")
        .select("lang", "doc_id", "place", F.col("text").substr(begin, F.lit(rules.chars_per_document)).alias("text"))
        .groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text"))
        .collect()
    )
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.place, r.doc_id)):
        by.setdefault(r.lang, []).append(r.text)
    return [
        (r["lang"], "\n".join(by[r["lang"]][: rules.docs_per_language]).lower().encode()) for r in counts if r["lang"] in by
    ]


def batch_classifier(model: list[tuple[str, bytes]], rules: LanguageRules = LanguageRules()):
    """A function texts -> [(language, score, margin)]."""
    groups = [model[k : k + rules.coders_at_once] for k in range(0, len(model), rules.coders_at_once)]

    def prepared(group):
        coders = []
        for lang, content in group:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=rules.level)
            coders.append((lang, zstandard.ZstdCompressor(level=rules.level, dict_data=d, write_content_size=False, write_dict_id=False)))
        return coders

    kept = prepared(groups[0]) if len(groups) == 1 else None

    def decided(sizes):
        if len(sizes) == 1:
            return sizes[0][2], 1.0, 1.0
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][2], 1 - math.exp(-rules.steepness * margin), margin

    def many(texts):
        judged = [bool(t and groups and any(map(str.isalpha, t))) for t in texts]
        data = [t.lower().encode() if ok else b"" for t, ok in zip(texts, judged)]
        best: list[list] = [[] for _ in texts]
        for g, group in enumerate(groups):
            coders = kept or prepared(group)
            for i, x in enumerate(data):
                if not judged[i]:
                    continue
                sizes = best[i]
                for rank, (lang, coder) in enumerate(coders, g * rules.coders_at_once):
                    total = sum(len(coder.compress(x[k : k + rules.block])) for k in range(0, len(x), rules.block))
                    sizes.append((total, rank, lang))
                best[i] = sorted(sizes)[:2]
        return [decided(sizes) if sizes else ("und", 0.0, 0.0) for sizes in best]

    return many


def classifier(model: list[tuple[str, bytes]], rules: LanguageRules = LanguageRules()):
    """A function text -> (language, score, margin)."""
    many = batch_classifier(model, rules)
    return lambda text: many([text])[0]


def identify(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> DataFrame:
    """One row per document: fold, predicted language, score, and whether the margin is too narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, rules))  # bounded, see above

    def make():
        many = batch_classifier(shared.value, rules)

        def f(ids, held, texts):
            langs, scores, margins = zip(*many(texts))
            return [ids, held, list(langs), list(scores), list(margins), [m < rules.least_margin for m in margins]]

        return f

    held = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == 2, F.lit(False))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    return map_rows(docs, [docs["doc_id"].cast("long"), held, text_column(docs)], schema, make)
