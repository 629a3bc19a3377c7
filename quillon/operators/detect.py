"""Scoring of spans against a reference bank, and the detection pipelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vectors as V

MAX_BANK = 4096


def bank_prefix(bank: DataFrame, size: int | None, most: int = 30) -> DataFrame:
    """The first k phrases of the ordered bank, k clamped to [1, most]."""
    return bank if size is None else bank.where(F.col("rid") < max(1, min(size, most)))


def bank_row(bank: DataFrame) -> DataFrame:
    """The bank as one row, in order; refuses banks that are too large to broadcast."""
    pairs = F.array_sort(F.collect_list(F.struct("rid", "embedding")))
    one = bank.limit(MAX_BANK + 1).agg(pairs.alias("pairs"))  # one more than allowed tells that it is too large
    checked = F.when(F.size("pairs") <= MAX_BANK, F.transform("pairs", lambda p: p["embedding"])).otherwise(
        F.raise_error(F.lit(f"the bank has more than {MAX_BANK} vectors"))
    )
    return one.select(checked.alias("bank"))


def score(spans: DataFrame, bank: DataFrame, engine: str = "sql") -> DataFrame:
    """Adds s_inst, the largest similarity to the bank, without a shuffle.

    The bank is one broadcast row (engine "sql"), or a matrix that Arrow
    batches of spans are multiplied with (engine "arrow", for many spans).
    """
    if engine == "sql":
        joined = spans.crossJoin(F.broadcast(bank_row(bank)))
        best = F.array_max(F.transform("bank", lambda r: V.dot(F.col("embedding"), r)))
        return joined.withColumn("s_inst", best).drop("bank")
    if engine != "arrow":
        raise ValueError(f"unknown engine: {engine}")
    matrix = np.array(bank_row(bank).first()[0], dtype=np.float64)

    def most(vectors: pd.Series) -> pd.Series:
        known = vectors.notna()
        best = np.full(len(vectors), np.nan)
        if known.any():
            best[known] = (np.stack(vectors[known].to_numpy()).astype(np.float64) @ matrix.T).max(axis=1)
        return pd.Series(best).where(known.to_numpy(), None)

    return spans.withColumn("s_inst", F.pandas_udf(most, "double")("embedding"))


def cross_join_score(spans: DataFrame, bank: DataFrame, block: int = MAX_BANK) -> DataFrame:
    """(span_id, s_inst) for banks that do not fit one row: spans stream past one block of the bank after the other.

    A block is one broadcast row of at most ``block`` vectors, so nothing that is broadcast grows with the bank.
    """
    parts = max(1, -(-bank.count() // block))
    place = F.pmod(F.xxhash64("rid"), F.lit(parts))
    best = None
    for k in range(parts):
        held = bank.where(place == k).agg(F.collect_list("embedding").alias("block"))
        most = F.array_max(F.transform("block", lambda r: V.dot(F.col("embedding"), r)))
        scored = spans.crossJoin(F.broadcast(held)).select("span_id", most.alias("s_inst"))
        best = scored if best is None else best.unionByName(scored)
    return best.groupBy("span_id").agg(F.max("s_inst").alias("s_inst"))


#: Images that choices are scored against at once, as one broadcast row.
MAX_IMAGES = 4096


def choice_scores(choices: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, label, score): for each image and label the best of the label's choices.

    The choices, which may be many, stream past the images, a block of which is one broadcast row; partial maxima
    leave one row a task for each image and label.
    """
    parts = max(1, -(-images.count() // MAX_IMAGES))
    place, best = F.pmod(F.xxhash64("image_id"), F.lit(parts)), None
    for k in range(parts):
        held = images.where(place == k).agg(F.collect_list(F.struct("image_id", "embedding")).alias("block"))
        rows = choices.crossJoin(F.broadcast(held)).select("label", "embedding", F.explode("block").alias("im"))
        scored = rows.select(F.col("im.image_id"), "label", V.dot(F.col("im.embedding"), F.col("embedding")).alias("score"))
        scored = scored.groupBy("image_id", "label").agg(F.max("score").alias("score"))
        best = scored if best is None else best.unionByName(scored)
    return best


def with_risk(spans: DataFrame, images: DataFrame, lam: float, floor: float | None = -0.1) -> DataFrame:
    """Adds s_inc and risk = s_inst + lam * s_inc, by lookup of the image's embedding.

    floor=None leaves s_inc unclamped, as candidate selection does.
    """
    image = images.select(F.col("image_id").alias("of_image"), F.col("embedding").alias("image_embedding"))
    cos = V.dot(F.col("embedding"), F.col("image_embedding"))
    s_inc = -cos if floor is None else V.inconsistency(cos, floor)
    return (
        spans.join(image, F.col("image_id") == F.col("of_image"))
        .withColumn("s_inc", s_inc)
        .withColumn("risk", F.col("s_inst") + F.lit(lam) * F.col("s_inc"))
        .drop("of_image", "image_embedding")
    )


def selected(scored: DataFrame) -> DataFrame:
    """(image_id, selected_id, estimated_risk): the candidate of least risk for each image, the first on ties."""
    best = F.min_by("span_id", F.struct(F.round("risk", 9), "span_id"))
    return scored.groupBy("image_id").agg(best.alias("selected_id"), F.min("risk").alias("estimated_risk"))


def max_risk(images: DataFrame, scored: DataFrame, column: str = "risk") -> DataFrame:
    """Per image the largest risk, 0 for images without spans."""
    most = scored.groupBy("image_id").agg(F.max(column).alias("m"))
    return images.join(most, "image_id", "left").withColumn("max_risk", F.coalesce("m", F.lit(0.0))).drop("m")


def flags(images: DataFrame, scored: DataFrame, tau, column: str = "risk") -> DataFrame:
    """Per image whether a span reaches tau; images without spans are never flagged."""
    hit = scored.where(F.col(column) >= tau).select("image_id").distinct().withColumn("hit", F.lit(1))
    return images.join(hit, "image_id", "left").withColumn("flagged", F.coalesce("hit", F.lit(0))).drop("hit")


def window_scores(spans: DataFrame, images: DataFrame, bank: DataFrame, sizes=(1, 2, 3)) -> DataFrame:
    """Windows of spans with s_inst and the cosine to their image.

    A window's vector is the normalised sum of its spans' vectors.  An image's spans, which are few, make one row, so
    vectors move once and are summed and multiplied with the bank as matrices.
    """
    matrix = np.array(bank_row(bank).first()[0], dtype=np.float64)
    image = images.select(F.col("image_id").alias("of_image"), F.col("embedding").alias("image_embedding"))
    own = spans.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "embedding"))).alias("own"))
    rows = own.join(image, F.col("image_id") == F.col("of_image"))

    def scores(flat: pd.Series, n_spans: pd.Series, of_image: pd.Series) -> pd.DataFrame:
        made = []
        for vectors, n, whole in zip(flat, n_spans, of_image):
            v, found = np.asarray(vectors, np.float64).reshape(n, -1), []
            for s in sorted(sizes):
                m = n - s + 1
                if m <= 0:
                    continue
                total = v[:m].copy()
                for k in range(1, s):
                    total += v[k : m + k]
                unit = total / np.linalg.norm(total, axis=1, keepdims=True)
                found.append((np.arange(m), np.full(m, s), (unit @ matrix.T).max(axis=1), unit @ np.asarray(whole, np.float64)))
            made.append([np.concatenate(c) for c in zip(*found)] if found else [[], [], [], []])
        return pd.DataFrame(made, columns=["first", "size", "s_inst", "cos"])

    kinds = "first array<int>, size array<int>, s_inst array<double>, cos array<double>"
    flat = F.flatten(F.transform("own", lambda p: p["embedding"]))
    found = F.pandas_udf(scores, kinds)(flat, F.size("own"), F.col("image_embedding"))
    each = rows.select("image_id", F.transform("own", lambda p: p["span_id"]).alias("ids"), found.alias("f")).select(
        "image_id", "ids", F.posexplode(F.arrays_zip("f.first", "f.size", "f.s_inst", "f.cos")).alias("cand_idx", "w")
    )
    members = F.slice("ids", F.col("w.first") + 1, F.col("w.size"))
    return each.select("image_id", "cand_idx", F.col("w.size").alias("size"), members.alias("members"), "w.s_inst", "w.cos")


def firewall(
    spans: DataFrame, images: DataFrame, bank: DataFrame, kind: str = "cmc", lam: float = 0.5, tau: float = 0.5,
    sizes=(1, 2, 3),
) -> DataFrame:
    """Candidates above tau with their score: kind "semantic" (s_inst) or "cmc" (risk).

    tau = -10 redacts everything.
    """
    if kind not in ("semantic", "cmc"):
        raise ValueError(f"unknown firewall: {kind}")
    risk = F.col("s_inst") if kind == "semantic" else F.col("s_inst") + F.lit(lam) * V.inconsistency(F.col("cos"))
    scored = window_scores(spans, images, bank, sizes).withColumn("score", risk)
    return scored.where(F.col("score") >= tau).select("image_id", "cand_idx", "size", "members", "score")


def keyword_terms(words: DataFrame, tokens=X.SUSPICIOUS_TOKENS) -> DataFrame:
    """Distinct (image_id, term) of suspicious words, empty terms dropped."""
    norm = X.normalize(F.col("text"))
    return (
        words.withColumn("term", norm).where(X.contains_any(F.col("term"), tokens) & (F.col("term") != ""))
        .select("image_id", "term").distinct()
    )


def agreed_terms(words: DataFrame, views: DataFrame | None = None, tokens=X.SUSPICIOUS_TOKENS, least_views: int = 2) -> DataFrame:
    """Distinct (image_id, term): suspicious words of the image, and those that enough views of it agree on."""
    terms = keyword_terms(words, tokens)
    if views is None:
        return terms
    seen = (
        views.withColumn("term", X.normalize(F.col("text")))
        .where(X.contains_any(F.col("term"), tokens) & (F.col("term") != ""))
        .groupBy("image_id", "term").agg(F.countDistinct("view").alias("n"))
        .where(F.col("n") >= least_views).select("image_id", "term")
    )
    return terms.union(seen).distinct()


def keyword_firewall(words: DataFrame, views: DataFrame | None = None, tokens=X.SUSPICIOUS_TOKENS, least_views: int = 2) -> DataFrame:
    """Suspicious words of each image; terms that enough views agree on are added to the primary ones."""
    named = agreed_terms(words, views, tokens, least_views).withColumn("listed", F.lit(True))
    marked = words.withColumn("term", X.normalize(F.col("text"))).join(named, ["image_id", "term"], "left")
    return marked.where(F.col("listed") | X.contains_any(F.col("term"), tokens)).drop("listed")


def detector(kind: str):
    """The firewall of a configuration's defense type."""
    if kind == "none":
        return None
    return {"semantic": firewall, "cmc": firewall}.get(kind, keyword_firewall)
