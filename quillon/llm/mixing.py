"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations.

Documents are summed to cells of (source, language, topic).  The cells' token
weights are raked: each axis in turn is scaled to its target shares of the
token budget, and no cell may get more than the tokens it has, until a round
moves almost nothing.  While the counted cells are few, the whole fit is one
expression over a row of arrays; beyond that, sums by axis are joined back.
A document is then kept with the probability of its cell, decided by a hash of doc_id.

Targets are explicit shares, or, by default, the corpus' own shares raised to
a power below one, which lifts small sources.  Cells stay a DataFrame and are
broadcast only if they are counted to be few.

Defined cases: nulls in an axis are a group of their own; a null text has no
tokens, and its cell's probability is that of the cell, or 1 for cells without
tokens; a null doc_id hashes as the empty string; repeated rows are decided
alike, as are ties.  An empty table gives no rows.  Long texts are counted
whole.  Only doc_id, text, source and lang are read for the decision; sampled
rows keep all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.store import saved

AXES = ("source", "lang", "topic")
#: Topics by the first pattern that a text has.
TOPIC_RULES = (
    ("table", r" \| "),
    ("notice", r"(?:[Ll]icen[cs]e|LICENSE|[Cc]opyright|COPYRIGHT)"),
    ("markup", r"[#$%&*]{3}"),
    ("record", r"[0-9]{6}"),
)
#: Strings of which a text with the pattern holds at least one; the quick search for them comes first.
TOPIC_HINTS = {"table": (" | ",), "notice": ("icen", "LICENSE", "opyright", "COPYRIGHT")}
BROADCAST_CELLS = 100_000
HOT_SHARE = 1000


@dataclass(frozen=True)
class MixRules:
    budget: float = 0.5
    #: Rounds end when one moves less than this share of the budget, at the latest after so many.
    tolerance: float = 1e-12
    rounds: int = 100
    seed: int = 42
    #: A column of the documents that holds their topic; without one, topics go by TOPIC_RULES.
    topic_column: str | None = None
    power: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.7, "topic": 0.9})
    #: axis -> {value: share}; values that are not listed get nothing.
    targets: dict[str, dict[str, float]] = field(default_factory=dict)


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, pattern in reversed(TOPIC_RULES):
        found = text.rlike(pattern)
        if name in TOPIC_HINTS:
            found = reduce(or_, [F.contains(text, F.lit(hint)) for hint in TOPIC_HINTS[name]]) & found
        topic = F.when(found, name).otherwise(topic)
    return topic


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on doc_id and seed alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _small(df: DataFrame, n_cells: int) -> DataFrame:
    return F.broadcast(df) if n_cells <= BROADCAST_CELLS else df


def _targets(cells: DataFrame, axis: str, rules: MixRules) -> DataFrame:
    """(axis, share) with shares that add up to one."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("t"))
    if axis in rules.targets:
        pairs = [x for pair in rules.targets[axis].items() for x in map(F.lit, pair)]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(axis)), F.lit(0.0)).cast("double")
    else:
        raw = F.when(F.col("t") > 0, F.pow("t", F.lit(float(rules.power[axis])))).otherwise(0.0)
    sums = sums.select(axis, raw.alias("raw"))
    whole = sums.agg(F.sum("raw").alias("whole"))
    return sums.crossJoin(F.broadcast(whole)).select(  # one row
        F.col(axis), F.expr("coalesce(try_divide(raw, whole), 0D)").alias("share")
    )


def _let(name: str, value: str, body: str) -> str:
    """The body with the value, computed once, under a name."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, unused) -> {name}, {name} -> {body})"


def _round_sql(goal: float) -> str:
    """Weights s.w after one round over the axes; c are the cells, g the members of each group by axis."""
    w = "s.w"
    for k, axis in enumerate(AXES):
        have = f"transform(g.{axis}, m -> aggregate(m, 0D, (a, i) -> a + w{k}[i]))"
        scale = f"coalesce(try_divide(x.share_{axis} * {goal!r}D, have{k}[x.of_{axis}]), 0D)"
        step = f"transform(c, (x, i) -> least(w{k}[i] * {scale}, x.tokens))"
        w = _let(f"w{k}", w, _let(f"have{k}", have, step))
    return w


def _rake_in_a_row(raked: DataFrame, goal: float, rules: MixRules) -> DataFrame:
    """The fit of counted, few cells as one expression over one row of arrays; each step takes time linear in the cells.

    Rounds end when one moves less than ``tolerance`` of the token budget.
    """
    cells = F.array_sort(F.collect_list(F.struct(*AXES, "tokens", "w", *[f"share_{a}" for a in AXES])))
    row = raked.select(*AXES, F.col("tokens").cast("double").alias("tokens"), "w", *[f"share_{a}" for a in AXES]).agg(cells.alias("c"))
    # nulls are a group of their own: to_json tells them from any name
    named = {a: f"to_json(named_struct('v', x.{a}))" for a in AXES}
    row = row.selectExpr("c", *[f"array_sort(array_distinct(transform(c, x -> {named[a]}))) as k_{a}" for a in AXES])
    row = row.selectExpr("c", *[
        f"map_from_arrays(k_{a}, sequence(0, size(k_{a}) - 1)) as m_{a}" for a in AXES
    ]).selectExpr(
        f"transform(c, x -> named_struct({', '.join(f'{a!r}, x.{a}' for a in AXES)}, 'tokens', x.tokens, 'w', x.w, "
        + ", ".join(f"'share_{a}', x.share_{a}, 'of_{a}', m_{a}[{named[a]}]" for a in AXES) + ")) as c",
        *[f"size(m_{a}) as n_{a}" for a in AXES],
    )
    members = ", ".join(
        f"'{a}', transform(array_sort(collect_of_{a}), p -> p.m)" for a in AXES
    )
    groups = [
        row.select(F.posexplode("c").alias("i", "x")).groupBy(F.col(f"x.of_{a}").alias("k")).agg(F.sort_array(F.collect_list("i")).alias("m"))
        .agg(F.collect_list(F.struct("k", "m")).alias(f"collect_of_{a}"))
        for a in AXES
    ]
    for one in groups:  # one row each
        row = row.crossJoin(F.broadcast(one))
    row = row.selectExpr("c", f"named_struct({members}) as g")
    moved = f"aggregate(zip_with(s.w, w, (p, q) -> abs(p - q)), 0D, (a, d) -> a + d) > {rules.tolerance * goal!r}D"
    step = f"if(s.go, {_let('w', _round_sql(goal), f'named_struct({chr(39)}w{chr(39)}, w, {chr(39)}go{chr(39)}, {moved})')}, s)"
    fitted = f"""aggregate(sequence(1, {rules.rounds}), named_struct('w', transform(c, x -> x.w), 'go', true),
      (s, round) -> {step}, s -> s.w)"""
    row = row.withColumn("fitted", F.expr(fitted))
    out = row.select(F.explode(F.expr("transform(c, (x, i) -> named_struct('x', x, 'w', fitted[i]))")).alias("o"))
    return out.select(*[F.col(f"o.x.{a}").alias(a) for a in AXES], F.col("o.x.tokens").alias("tokens"), F.col("o.w").alias("w"))


def _rake_by_sums(raked: DataFrame, goal: float, rules: MixRules) -> DataFrame:
    """The fit of many cells: sums by axis are joined back, which spreads over the cluster."""
    for _ in range(rules.rounds):
        raked = raked.withColumn("old_w", F.col("w"))
        for axis in AXES:
            sums = raked.groupBy(F.col(axis).alias("of")).agg(F.sum("w").alias("have"))
            scale = F.coalesce(F.try_divide(F.col(f"share_{axis}") * F.lit(goal), F.col("have")), F.lit(0.0))
            raked = raked.join(sums, F.col(axis).eqNullSafe(F.col("of"))).withColumn(
                "w", F.least(F.col("w") * scale, F.col("tokens").cast("double"))
            ).drop("of", "have")
        raked = saved(raked)
        moved = raked.agg(F.sum(F.abs(F.col("w") - F.col("old_w")))).first()[0] or 0.0
        raked = raked.drop("old_w")
        if moved <= rules.tolerance * goal:
            break
    return raked


def fit(cells: DataFrame, rules: MixRules = MixRules()) -> tuple[DataFrame, int]:
    """Cells with their weight w and probability p, and their number."""
    cells = saved(cells)
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    cells = cells.coalesce(max(1, n // BROADCAST_CELLS))
    raked = cells.withColumn("w", F.col("tokens") * F.lit(rules.budget))
    for axis in AXES:
        share = _targets(cells, axis, rules).select(F.col(axis).alias("of"), F.col("share").alias(f"share_{axis}"))
        raked = raked.join(_small(share, n), F.col(axis).eqNullSafe(F.col("of"))).drop("of")
    raked = saved(raked)
    goal = float(total) * rules.budget
    raked = (_rake_in_a_row if n <= BROADCAST_CELLS else _rake_by_sums)(raked, goal, rules)
    p = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)
    return saved(raked.select(*AXES, F.col("tokens").cast("long").alias("tokens"), "w", p.alias("p"))), n


def residuals(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """(axis, value, target, got): tokens that each group should and does get; they differ where groups lack tokens."""
    keyed = _keyed(docs, rules)
    cells = saved(keyed.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    fitted, _ = fit(cells, rules)
    whole = fitted.agg((F.sum("tokens") * rules.budget).alias("goal"))
    parts = []
    for axis in AXES:
        got = fitted.groupBy(F.col(axis).alias("value")).agg(F.sum("w").alias("got"))
        share = _targets(cells, axis, rules).select(F.col(axis).alias("of"), "share")
        parts.append(
            got.join(share, F.col("value").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(whole))  # one row
            .select(F.lit(axis).alias("axis"), "value", (F.col("share") * F.col("goal")).alias("target"), "got")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _keyed(docs: DataFrame, rules: MixRules) -> DataFrame:
    """The rows as one struct, with the cell, tokens and draw beside it."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        docs["lang"].cast("string").alias("lang"),
        (docs[rules.topic_column].cast("string") if rules.topic_column else topic_of(text)).alias("topic"),
        tokens_of(text).alias("tokens"),
    )


def _decided(keyed: DataFrame, rules: MixRules) -> DataFrame:
    cells = saved(keyed.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    fitted, n = fit(cells, rules)
    p = fitted.select(*[F.col(a).alias(f"cell_{a}") for a in AXES], "p")
    same = [F.col(a).eqNullSafe(F.col(f"cell_{a}")) for a in AXES]
    if n <= BROADCAST_CELLS:
        found = keyed.join(F.broadcast(p), same)
    else:
        # cells of more than one in HOT_SHARE of the documents are fewer than HOT_SHARE: their rows are not shuffled
        p = saved(p.join(cells.select(*AXES, "n_docs"), same).drop(*AXES))
        least = (cells.agg(F.sum("n_docs")).first()[0] or 0) // HOT_SHARE
        hot = F.broadcast(p.where(F.col("n_docs") > least).drop("n_docs"))
        cold = p.where(F.col("n_docs") <= least).drop("n_docs")
        found = keyed.join(hot, same).unionByName(keyed.join(hot, same, "left_anti").join(cold, same))
    return found.withColumn("selected", draw(F.col("doc_id"), rules.seed) < F.col("p"))


def mix(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """One row per document: cell, tokens, probability and decision."""
    keyed = saved(_keyed(docs, rules).drop("row"))  # narrow, so the texts are read once
    return _decided(keyed, rules).select(
        "doc_id", *AXES, F.col("tokens").alias("n_tokens"), F.round("p", 6).alias("p"), "selected"
    )


def sample(docs: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """The selected documents with all their columns."""
    return _decided(_keyed(docs, rules), rules).where("selected").select("row.*")
