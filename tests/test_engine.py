"""Operators on small tables: edge cases, quirks and properties."""

import json
import math
from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import seeds
from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import calibrate as C
from quillon.operators import balltree, compare, detect, grid, plugins, report, run
from quillon.operators import metrics as M
from quillon.operators import prefix
from quillon.operators import resample as R
from quillon.operators import spans as S
from quillon.sources import files, images, manifest, samples, sinks
from quillon.streaming import events as E
from quillon.streaming import thresholds as T


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# ---- text ----------------------------------------------------------------


def test_normalize(spark):
    texts = ["  A b’c\tD--e ", "", None, "İx", "..."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == ["a b c d e", "", None, "i x", ""]


def test_judge(spark):
    L = F.lit
    said, want = L("I think B."), L(" b ")
    row = one(
        spark, X.judge(said, want, "mcq").alias("mcq"), X.judge(said, want, "exact").alias("exact"), X.judge(said, want, "contains").alias("contains"),
        X.judge(said, L(None).cast("string"), "mcq").alias("none"), X.judge(said, want, "none").alias("off"),
        X.judge(L("I cannot help"), L(""), "auto", expected=L("Refuse")).alias("auto"), X.judge(L("x"), L("A"), "auto", task_type=L("mcq")).alias("auto_mcq"),
        X.mcq_choice(L("such a day")).alias("article"),
        X.is_refusal(L("I’m sorry")).alias("strict"), X.is_refusal(L("I’m sorry"), strict=False).alias("fixed"),
    )
    assert row.asDict() == {
        "mcq": 1, "exact": 0, "contains": 1, "none": None, "off": None, "auto": 1, "auto_mcq": 0, "article": "A", "strict": False, "fixed": True,
    }
    with pytest.raises(ValueError):
        X.judge(said, want, "other")
    assert len(set(X.REFUSAL_MARKERS)) == len(X.REFUSAL_MARKERS)


def test_targets_and_verdicts(spark):
    L = F.lit
    choices = F.array(L("A. x"), L("b"), L("C) y"))
    row = one(
        spark, X.default_target(L("a"), choices).alias("t"), X.default_target(L(None).cast("string"), F.array().cast("array<string>")).alias("none"),
        X.matches_target(L(" c "), L("C")).alias("m"), X.verdict_category(L("unsafe\nS1")).alias("c1"), X.verdict_category(L("S5 unsafe")).alias("c2"),
        X.verdict_category(L("unsafe")).alias("c3"), X.verdict_category(L("safe\nS1")).alias("c4"),
    )
    assert tuple(row) == ("C", None, 1, "S1", "S5", "unsafe_unspecified", "safe")


def test_anchor(spark):
    df = spark.createDataFrame([("one two", "one two three", True), ("one", "one", False), ("x", "", False), ("bone two", "one two", True)], "t string, a string, w boolean")
    assert all(r.g == r.w for r in df.select("w", X.anchor_retained(F.col("t"), F.col("a")).alias("g")).collect())


# ---- vectors and boxes ---------------------------------------------------


def box(b):
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("ltrb", b)])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 20)] * 4), min_size=2, max_size=2))
def test_iou_properties(spark, boxes):
    a, b = [(min(x, u), min(y, v), max(x, u), max(y, v)) for x, y, u, v in boxes]
    r = one(spark, V.iou(box(a), box(b)).alias("ab"), V.iou(box(b), box(a)).alias("ba"), V.iou(box(a), box(a)).alias("aa"))
    assert r.ab == r.ba and 0 <= r.ab <= 1 and r.aa in (0.0, 1.0)


def test_geometry(spark):
    L = F.lit
    r = one(
        spark, V.iou(box((0, 0, 0, 0)), box((0, 0, 0, 0))).alias("zero"), V.padded(box((3, 20, 30, 40))).alias("pad"),
        V.polygon_box(F.array(F.array(L(1.5), L(2.0)), F.array(L(9.0), L(2.0)))).alias("flat"), V.cosine(F.array(L(0.0)), F.array(L(1.0))).alias("none"),
        V.inconsistency(L(0.7)).alias("low"), V.inconsistency(L(-0.7)).alias("high"),
    )
    assert r.zero == 0 and tuple(r.pad) == (0, 12, 38, 48) and r.flat is None and r.none is None and (r.low, r.high) == (-0.1, 0.7)


# ---- spans ---------------------------------------------------------------


def plain_lines_regions(words):
    words = sorted(words, key=lambda w: (w["top"], w["left"], w["ord"]))
    lines = []
    for w in words:
        p = lines[-1][-1] if lines else None
        if p and abs(w["top"] - p["top"]) < max(p["height"], w["height"]) * 0.7 and w["left"] - p["left"] - p["width"] < 40:
            lines[-1].append(w)
        else:
            lines.append([w])
    regions, state = [], None
    for x in lines:
        l, t = min(w["left"] for w in x), min(w["top"] for w in x)
        r, b = max(w["left"] + w["width"] for w in x), max(w["top"] + w["height"] for w in x)
        if state and t - state[2] < 60 and not (r < state[0] or l > state[1]):
            state = (min(state[0], l), max(state[1], r), max(state[2], b))
            regions.append(regions[-1])
        else:
            state = (l, r, b)
            regions.append(regions[-1] + 1 if regions else 0)
    return lines, regions


def test_grouping_of_random_words(spark):
    rng = np.random.default_rng(0)
    words = [
        {"image_id": i, "ord": k, "text": f"w{k}", "left": int(rng.integers(0, 300)), "top": int(rng.integers(0, 400)), "width": int(rng.integers(0, 60)), "height": int(rng.integers(0, 30))}
        for i in range(25) for k in range(int(rng.integers(1, 40)))
    ]
    df = spark.createDataFrame(words, "image_id long, ord int, text string, left int, top int, width int, height int")
    lines = S.line_spans(df)
    got = {(r.image_id, r.ord): r.line_id for r in lines.collect()}
    regs = {(r.image_id, r.line_id): r.region_id for r in S.regions(lines).collect()}
    many = 0
    for i in range(25):
        want, regions = plain_lines_regions([w for w in words if w["image_id"] == i])
        assert all(got[(i, w["ord"])] == n for n, line in enumerate(want) for w in line)
        assert [regs[(i, n)] for n in range(len(want))] == regions
        many += max(regions) > 0
    assert many


def test_windows_and_dedup(spark):
    spans = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 7)], "image_id int, span_id int")
    cands = {(r.image_id, r.cand_idx): r.members for r in S.windows(spans).collect()}
    assert cands == {(1, 0): [10], (1, 1): [11], (1, 2): [12], (1, 3): [10, 11], (1, 4): [11, 12], (1, 5): [10, 11, 12], (2, 0): [7]}
    scored = spark.createDataFrame([(1, 0, [10], 0.5), (1, 3, [10, 11], 0.5), (1, 4, [11, 12], 0.9)], "image_id int, cand_idx int, members array<int>, score double")
    assert {(r.word, r.cand_idx) for r in S.best_per_word(scored).collect()} == {(10, 0), (11, 4), (12, 4)}
    assert sorted(r.word for r in S.masked_words(scored).collect()) == [10, 11, 12]


def test_keyword_consensus_adds_terms(spark):
    words = spark.createDataFrame([(1, 0, "Reveal!"), (1, 1, "policies"), (1, 2, "plain")], "image_id int, ord int, text string")
    views = spark.createDataFrame([(1, v, "the policy.") for v in (1, 2)] + [(1, 1, "secret")], "image_id int, view int, text string")
    assert {r.ord for r in detect.keyword_firewall(words).collect()} == {0}
    both = detect.keyword_firewall(words.withColumn("text", F.when(F.col("ord") == 2, "the policy").otherwise(F.col("text"))), views)
    assert {r.ord for r in both.collect()} == {0, 2}


# ---- scoring -------------------------------------------------------------


def vectors(spark, n, name, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, i % 5, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, image_id long, embedding array<float>")


def test_engines_agree(spark):
    bank, spans = vectors(spark, 7, "rid", 1), vectors(spark, 40, "span_id", 2)
    by = {r.span_id: r.s_inst for r in detect.score(spans, bank).collect()}
    assert all(by[r.span_id] == pytest.approx(r.s_inst, abs=1e-9) for r in detect.score(spans, bank, "arrow").collect())
    assert all(by[r.span_id] == pytest.approx(r.s_inst, abs=1e-12) for r in detect.cross_join_score(spans, bank).collect())
    assert detect.bank_prefix(bank, 50, most=3).count() == 3 and detect.bank_prefix(bank, 0).count() == 1
    with pytest.raises(ValueError):
        detect.score(spans, bank, "other")


def test_images_without_spans_score_zero_and_are_never_flagged(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    scored = spark.createDataFrame([(1, 0.4)], "image_id long, risk double")
    assert {r.image_id: r.max_risk for r in detect.max_risk(images, scored).collect()} == {1: 0.4, 2: 0.0}
    assert {r.image_id: r.flagged for r in detect.flags(images, scored, F.lit(-1.0)).collect()} == {1: 1, 2: 0}


# ---- calibration ---------------------------------------------------------


@pytest.mark.parametrize("alpha,n", [(0.1, 9), (0.7, 9), (0.999, 3), (0.0001, 3), (0.2, 100), (0.5, 1)])
def test_threshold_is_the_order_statistic(spark, alpha, n):
    v = sorted(float((7 * i) % 5) + i / 100 for i in range(n))
    df = spark.createDataFrame([(x,) for x in v], "r double")
    k = max(0, min(math.ceil((n + 1) * (1 - alpha)) - 1, n - 1))
    assert C.threshold(df, "r", alpha).first().tau == v[k]


def test_ranked_values_by_group_with_ties_and_nulls(spark):
    rows = [("a", 1.0)] * 50 + [("a", 2.0)] + [(None, float(i)) for i in range(10)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.n, r.median, r.p95) for r in M.latency(df, "g", "x").collect()}
    assert got == {"a": (51, 1.0, 1.0), None: (10, 5.0, 9.0)}


def test_known_figures(spark):
    L = F.lit
    r = one(
        spark, C.bound(0.2, L(100)).alias("bound"), C.vmf_kappa(L(0.0382175), 1152).alias("k0"), C.vmf_kappa(L(0.6547029), 1152).alias("k1"),
        C.levy_bound(1152, L(0.1)).alias("levy"), C.dkw_bound(L(100), 0.05).alias("dkw"), C.beta_sd(0.1, L(100)).alias("sd"),
    )
    assert r.bound == pytest.approx(0.20990099) and r.k0 == pytest.approx(44.0909, abs=1e-3) and r.k1 == pytest.approx(1319.5386, abs=1e-2)
    assert r.k0 / r.k1 == pytest.approx(0.033414, abs=1e-6)
    assert r.levy == pytest.approx(0.0031511, abs=1e-7) and r.dkw == pytest.approx(1.2130613) and r.sd == pytest.approx(0.03)


@pytest.mark.parametrize("levels", [0, 1, 2, 3])
def test_order_statistics_under_skew(spark, levels):
    """One value of 1e12 among 200,000, a value that half of the rows have, and a group of its own: exact, in even slices."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random(99_999), [1e12], np.full(100_000, 0.25)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0), (None, None), (None, 2.0)], "g string, x double").repartition(8)
    ranks = {"low": F.lit(0), "middle": F.floor(F.col("n") / 2), "high": F.col("n") - 1}
    got = {r.g: r for r in C.ranked_values(df, ["g"], "x", ranks, levels).collect()}
    x = np.sort(x)
    assert (got["a"].n, got["a"].low, got["a"].middle, got["a"].high) == (200_000, x[0], x[100_000], 1e12)
    assert (got["b"].middle, got[None].n, got[None].high) == (7.0, 1, 2.0)
    counted = df.where("g = 'a'").groupBy("g", "x").count()
    sizes = [r["count"] for r in C.sliced(counted, ["g"]).groupBy("slice").count().collect()]
    assert len(sizes) == C.SLICES and max(sizes) <= 2 * 100_001 / C.SLICES
    assert C.levels_for(10) == 0 and C.levels_for(C.FEW + 1) == 1 and C.levels_for(C.SORTED * C.SLICES + 1) == 2


def test_prefix_scans(spark):
    """Sums and minima against loops, with null groups and nulls, one long series over several tasks, and ties of range ends."""
    rng = np.random.default_rng(8)
    rows = [(("u", "v", None)[int(k)], i, None if rng.random() < 0.1 else int(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 3000), rng.integers(-50, 50, 3000)))]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, t long, x long").repartition(5)
    state, want = {}, {}
    for g, t, x in rows:
        total, least = state.get(g, (0, None))
        total, least = total + (x or 0), least if x is None else x if least is None else min(least, x)
        state[g] = want[t] = total, least
    sums = {r.t: r.s for r in prefix.running(df, ["t"], "x", "s", "sum", ["g"]).collect()}
    mins = {r.t: r.best for r in compare.running_best(df, ["g"], "t", "x").collect()}
    assert {t: (sums[t], mins[t]) for t in sums} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    one = prefix.running(df, ["t"], "x", "s", "sum")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert one.rdd.getNumPartitions() >= 2  # one series, several tasks
    parts = [r["count"] for r in one.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= 3 and max(parts) < 2000
    total, xs = 0, {}
    for _, t, x in rows:
        total += x or 0
        xs[t] = total
    assert {r.t: r.s for r in one.collect()} == xs
    assert sorted((r["index"], r.t) for r in prefix.numbered(df, ["t"]).collect()) == [(i, i) for i in range(3000)]
    assert prefix.numbered(df.where("t < 0"), ["t"]).count() == 0
    assert prefix.numbered(df.where("t = 7"), ["t"]).first().asDict().keys() == {"g", "t", "x", "index"}


def test_resplits_agree_with_permutations(spark):
    """Drawn ranks give the thresholds and shares of their own split exactly, and the distribution that permuting rows gives."""
    rng = np.random.default_rng(2)
    pool = np.round(rng.random(120), 2)  # with ties
    df = spark.createDataFrame([(float(v),) for v in pool] + [(None,)], "x double").repartition(5)
    for n_cal, n_test in ((30, None), (30, 40), (100, None)):
        got = C.resplit(df, "x", n_cal, [0.1, 0.3], 400, n_test).collect()
        assert len(got) == 800
        x = np.sort(pool)
        counters, others = C._counters(np.arange(400), 7)
        for r in got:
            cal, test = C.split_ranks(counters[r.b], others[r.b], n_cal, n_test, 120)
            rest = np.setdiff1d(np.arange(120), cal) if test is None else test
            k = min(int(np.ceil((n_cal + 1) * (1 - r.alpha))) - 1, n_cal - 1)
            assert len(set(cal)) == n_cal and r.tau == x[cal[k]] and r.fpr == pytest.approx((x[rest] >= r.tau).mean())
        shares = []
        for _ in range(4000):
            p = rng.permutation(pool)
            tau = np.sort(p[:n_cal])[min(int(np.ceil((n_cal + 1) * 0.9)) - 1, n_cal - 1)]
            shares.append((p[n_cal : n_cal + n_test if n_test else None] >= tau).mean())
        mine = [r.fpr for r in got if r.alpha == 0.1]
        assert np.mean(mine) == pytest.approx(np.mean(shares), abs=4 * np.std(shares) / 20)
        assert np.quantile(mine, [0.1, 0.9]) == pytest.approx(np.quantile(shares, [0.1, 0.9]), abs=0.03)
    whole = C.resplit(df, "x", 120, [0.1], 3).collect()
    assert {r.fpr for r in whole} == {None}
    s = {r.alpha: r for r in C.resplit_summary(C.resplit(df, "x", 30, [0.1], 200), 30).collect()}
    assert s[0.1].n == 200 and s[0.1].bound == pytest.approx(0.1 + 1 / 31)


def test_draws_are_uniform():
    counters, others = C._counters(np.arange(3000), 1)
    seen = np.zeros(40)
    for c, o in zip(counters, others):
        drawn = C.drawn_ranks(c, o, 10, 40)
        assert len(set(drawn)) == 10
        seen[drawn] += 1
    assert abs(seen / 3000 - 0.25).max() < 0.04
    assert C.drawn_ranks(counters[0], others[0], 3, 10**12).max() < 10**12


def test_ball_tree_is_exact_and_prunes(spark):
    """Clustered, equal and random vectors: the values of all pairs, with few of them compared where vectors lie in clusters."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16))
    clustered = (centres[rng.integers(0, 40, 6000)] + 0.05 * rng.standard_normal((6000, 16)))
    clustered /= np.linalg.norm(clustered, axis=1, keepdims=True)
    for bank in (clustered, rng.standard_normal((300, 16)), np.ones((100, 16)), clustered[:1]):
        queries = np.concatenate([clustered[:200] + 0.02 * rng.standard_normal((200, 16)), rng.standard_normal((50, 16)), np.zeros((1, 16))])
        tree = balltree.BallTree.of(bank, 16)
        best, compared = tree.best(queries)
        assert best == pytest.approx((queries @ bank.T).max(axis=1), abs=1e-12)
        assert sorted(map(tuple, tree.vectors)) == sorted(map(tuple, bank))
        if len(bank) == 6000:
            assert compared[:200].mean() < 0.1 * len(bank)
    rows = [(i, list(map(float, v))) for i, v in enumerate(clustered[:3000])]
    bank = spark.createDataFrame([*rows, (-1, None)], "rid long, embedding array<double>")
    spans = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(clustered[3000:3300])] + [(999, None)], "span_id long, embedding array<double>")
    got = {r.span_id: r for r in balltree.score(spans, bank, block=1000).collect()}
    want = {r.span_id: r.s_inst for r in detect.cross_join_score(spans, bank.where("rid >= 0"), 1000).collect()}
    assert {k: r.s_inst for k, r in got.items()} == pytest.approx(want)
    assert sum(r.n_compared for r in got.values()) < 0.5 * 300 * 3000 and {r.n_bank for r in got.values()} == {3000}
    assert {r.s_inst for r in balltree.score(spans, bank.where("rid < 0")).collect()} == {None}


def test_roc_handles_empty_denominators(spark):
    df = spark.createDataFrame([(0.5, 1), (0.4, 0)], "score double, positive int")
    rows = {r.tau: r for r in C.roc(df, [0.4, 0.5, 9.0]).collect()}
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].f1) == (1, 0, 1.0) and rows[9.0].precision == rows[9.0].f1 == 0.0 and rows[0.4].fpr == 1.0


# ---- resampling and metrics ----------------------------------------------


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(60)] + [(99, None)], "k int, x double")
    r = R.bootstrap_ci(df, ["k"], "x", 200).first()
    assert r.n == 60 and r.mean == 0.5 and r.lo < 0.5 < r.hi
    again = R.bootstrap_ci(df, ["k"], "x", 200).first()
    assert tuple(r) == tuple(again)
    p = R.bootstrap_ci(df, ["k"], "x", 400, engine="poisson").first()
    assert p.n == 60 and p.mean == 0.5 and abs(p.lo - r.lo) < 0.08 and abs(p.hi - r.hi) < 0.08
    with pytest.raises(ValueError, match="unknown bootstrap engine"):
        R.bootstrap_ci(df, ["k"], "x", 10, engine="other")
    n = R.numpy_ci(df.withColumn("g", F.lit(1)), ["g"], "k", "x", 2000).first()
    rng = np.random.default_rng(7)
    x = np.array([i % 2 for i in range(60)], float)
    lo, hi = np.quantile(x[rng.integers(0, 60, size=(2000, 60))].mean(axis=1), [0.025, 0.975])
    assert (n.lo, n.hi) == (pytest.approx(lo), pytest.approx(hi))


def test_bootstrap_of_every_group_at_once(spark):
    """Groups of their own sizes, null group and null values; intervals near numpy's; the engines agree."""
    rng = np.random.default_rng(1)
    x = {"a": rng.random(300), "b": rng.integers(0, 2, 80).astype(float), None: np.array([3.0])}
    rows = [(g, i, float(v)) for g, vs in x.items() for i, v in enumerate(vs)] + [("a", 999, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, x double").repartition(7)
    for engine in ("poisson", "indexed"):
        got = {r.g: r for r in R.bootstrap_ci(df, ["k"], "x", engine=engine, by=["g"]).collect()}
        assert set(got) == {"a", "b", "c", None} and got["c"].n == 0 and got["c"].lo is None
        assert got[None].n == 1 and got[None].lo == got[None].hi == got[None].mean == 3.0
        for g in ("a", "b"):
            means = x[g][rng.integers(0, len(x[g]), (20_000, len(x[g])))].mean(axis=1)
            lo, hi = np.quantile(means, [0.025, 0.975])
            assert got[g].n == len(x[g]) and got[g].mean == pytest.approx(x[g].mean())
            assert (got[g].lo, got[g].hi) == (pytest.approx(lo, abs=0.1 * (hi - lo)), pytest.approx(hi, abs=0.1 * (hi - lo)))
    assert R.summarize_rate(df.where("g = 'b'"), ["k"], "x").first().ci95_halfwidth > 0
    alone = R.poisson_replicates(df.where("g = 'a'"), ["k"], "x", 101).orderBy("b").collect()
    both = R.poisson_replicates(df.withColumn("y", -F.col("x")), ["k"], ["x", "y"], 101, by=["g"]).where("g = 'a'")
    assert [r.m for r in alone] == pytest.approx([r.m for r in both.where("name = 'x'").orderBy("b").collect()])
    assert [r.m for r in alone] == pytest.approx([-r.m for r in both.where("name = 'y'").orderBy("b").collect()])


def test_poisson_weights_have_the_right_shares():
    keys = np.arange(4000, dtype=np.uint32)
    w = R.poisson_weights(keys, keys[::-1], 501, 7)
    assert w.shape == (4000, 501) and abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_bootstraps_need_no_single_task(spark):
    """No plan of the one-pass engine sorts or numbers a whole sample."""
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    plan = R.bootstrap_ci(df, ["id"], "x", 50)._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan.split("MapInArrow")[-1]


def test_main_table_and_paired_tests(spark):
    def rows(run, variant, verdicts, flag=1):
        return [(run, str(i), "c", variant, "clean", "center", None, flag, None, v) for i, v in enumerate(verdicts)]

    all_rows = (
        rows("full", "attacked", [1] * 30) + rows("full", "defended_attack", [1, 0] * 15)
        + rows("fallback", "attacked", [1, 1, 0, None]) + rows("fallback", "base", [0, 0])
        + rows("unjudged", "attacked", [1, 1, 1]) + rows("unjudged", "defended_attack", [None, None], flag=0)
        + rows("bare", "base", [0])
    )
    df = spark.createDataFrame(all_rows, RECORDS)
    names = spark.createDataFrame([(r,) for r in ("full", "fallback", "unjudged", "bare", "none")], "run string")
    got = {r.run: r for r in report.main_table(df, names, 500).collect()}
    assert (got["full"].target, got["full"].n, got["full"].unsafe, got["full"].flag) == ("defended_attack", 30, 0.5, 1.0)
    assert 0.2 < got["full"].unsafe_lo < 0.5 < got["full"].unsafe_hi < 0.8
    assert (got["fallback"].target, got["fallback"].n, got["fallback"].flag_lo) == ("attacked", 3, 1.0)
    assert got["fallback"].unsafe == pytest.approx(2 / 3)
    late = got["unjudged"]  # a defended group is there, so nothing falls back
    assert (late.target, late.unsafe, late.unsafe_lo, late.flag, late.flag_hi, late.n) == ("defended_attack", None, None, 0.0, 0.0, 2)
    assert (got["bare"].state, got["bare"].n, got["bare"].target) == ("ok", 0, None)
    assert (got["none"].state, got["none"].n, got["none"].unsafe) == ("missing", None, None)
    tests = report.paired_tests(df, [("full", "fallback"), ("full", "none"), ("bare", "full")], ["full", "unjudged"], 500)
    by = {(r.a, r.b): r for r in tests.collect()}
    assert by["full", "fallback"].n_pairs == 3 and by["full", "fallback"].mean_diff == pytest.approx(1 / 3)
    assert by["full", "none"].state == "missing" and by["bare", "full"].state == "no overlap" and by["bare", "full"].n_pairs == 0
    own = by["full attacked", "full defended_attack"]
    assert (own.n_pairs, own.mean_diff, own.p_value) == (30, 0.5, 0.0)
    assert by["unjudged attacked", "unjudged defended_attack"].state == "no overlap"


def test_paired(spark):
    far = spark.createDataFrame([(i, 1, 0) for i in range(40)], "k int, a int, b int")
    same = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "k int, a int, b int")
    assert R.paired_test(far, ["k"], 50).first().mean_diff == 1.0
    r = R.paired_test(same, ["k"], 50).first()
    assert (r.mean_diff, r.p_value, r.n_pairs) == (0.0, 1.0, 40)
    wide = R.paired_test(far, ["k"], 50, engine="poisson").first()
    assert (wide.mean_diff, wide.n_pairs, wide.lo, wide.hi) == (1.0, 40, 1.0, 1.0)
    empty = R.paired_test(far.limit(0), ["k"], 50).first()
    assert empty.n_pairs == 0 and empty.mean_diff is None


def test_wrapping_is_linear_and_greedy(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join("é" * int(n) for n in rng.integers(1, 30, 400)), "", "  one\n\n two ", "x" * 50 + " y\tz " + "w" * 11, None, "a " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for width in (1, 10, 24):
        got = {r.i: r.lines for r in df.select("i", X.wrapped("text", width).alias("lines")).collect()}
        for i, t in enumerate(texts):
            lines = []
            for w in [w for w in (t or "").replace("\n", " ").split(" ") if w]:
                if lines and len(lines[-1]) + 1 + len(w) <= width:
                    lines[-1] += " " + w
                else:
                    lines.append(w)
            assert got[i] == (None if t is None else lines)


def test_stream_thresholds(spark, tmp_path):
    """After every batch the stream's threshold is the table's; repeated rows, a batch written again and a restart change nothing."""
    rng = np.random.default_rng(3)
    schema = "id long, kind string, ts timestamp, score double"
    parts = [[(100 * p + i, "ab"[i % 2], datetime(2024, 1, 1, p, i % 60), None if i == 7 else float(rng.random())) for i in range(100)] for p in range(3)]
    parts[1] += parts[0][:20]  # rows that came before
    late = [(999, "a", datetime(2023, 1, 1), 5.0)]  # long after the watermark
    (tmp_path / "in").mkdir()
    seen = []
    for k, rows in enumerate([*parts, late]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        T.follow(stream, "kind", "score", "id", str(tmp_path / "counts"), str(tmp_path / "state"), late="3 hours").awaitTermination()
        seen += rows if k < 3 else []
        table = T.thresholds(T.counts(spark.createDataFrame(seen, schema), "kind", "score", "id"), 0.1).collect()
        got = T.thresholds(T.last_counts(spark, str(tmp_path / "counts")), 0.1).collect()
        assert sorted(got) == sorted(table) and {r["group"] for r in got} == {"a", "b"}
    last = sorted((tmp_path / "counts").iterdir(), key=lambda p: int(p.name.split("=")[1]))[1]
    again = spark.createDataFrame(spark.read.parquet(str(last)).collect(), "group string, score double, n long")
    T.sink(str(tmp_path / "counts"))(again, int(last.name.split("=")[1]))
    assert sorted(T.thresholds(T.last_counts(spark, str(tmp_path / "counts")), 0.1).collect()) == sorted(table)


RECORDS = "run string, sample_id string, category string, variant string, transform string, attack_position string, judged_correct int, firewall_flagged int, matched_attack_target int, is_unsafe int"


def test_summaries(spark):
    rows = [
        ("r", "1", "", "base", "clean", None, 1, 0, None, None), ("r", "1", "c", "attacked", "clean", "center", None, 0, None, 1),
        ("r", "2", None, "attacked", "blur", "center", None, 0, None, 0),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    by = {r.variant: r for r in M.summary(df, "variant").collect()}
    assert by["base"].unsafe_rate is None and by["attacked"].unsafe_rate == 0.5 and by["attacked"].judge_rate is None
    assert [r.category for r in M.by_category(df).collect()] == ["c"]
    assert {(r.dim, r.key) for r in M.all_groups(df).collect()} == {("variant", "base"), ("variant", "attacked"), ("transform", "clean"), ("transform", "blur"), ("category", "c")}
    red = M.reduction(df).first()
    assert red.attacked == 0.5 and red.defended is None and red.absolute is None
    main = report.main_rows(df).first()
    assert main.attacked_unsafe == 0.5 and main.defended_unsafe is None
    assert M.summary(df.limit(0), "variant").count() == 0


def test_pairs(spark):
    a = spark.createDataFrame([("1", "base", "clean", None, 1), ("1", "attacked", "clean", "x", 0)], "sample_id string, variant string, transform string, attack_position string, is_unsafe int")
    assert compare.pair_runs(a, a).count() == 2 and compare.pair_runs(a, a, variants=["base"]).count() == 1
    dup = a.withColumn("o", F.lit(1)).union(a.withColumn("is_unsafe", F.lit(7)).withColumn("o", F.lit(2)))
    assert {r.is_unsafe for r in compare.last_wins(dup, compare.KEY, "o").collect()} == {7}


# ---- grid, sources, sinks, plug-ins --------------------------------------


def test_grid(spark):
    s = spark.createDataFrame([(0, "a"), (1, "b")], "index long, sample_id string")
    df = grid.expand(s)
    assert df.count() == 2 * (1 + 3 * 6) and df.where("variant in ('base', 'defended_control') and attack_position is not null").count() == 0
    assert grid.expand(s, transforms=("clean",), base=False, control=False).count() == 4
    with pytest.raises(ValueError):
        grid.expand(s, transforms=("clean", "warp"))


def test_manifests(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 0, "img": "x.png", "prompt": "p"}\n\n{"sample_id": "s", "img": "/y.png", "question": "q", "hint": " h "}\n')
    (tmp_path / "b.json").write_text('{"data": [{"id": "k", "image": "z", "prompt": "p", "choices": ["A. one", "B. two"], "answer": "A", "more": 1}]}')
    (tmp_path / "c.json").write_text('[{"id": "k"}, {"id": "l"}]')
    a = manifest.read(spark, str(tmp_path / "a.jsonl")).withColumn("ord", F.monotonically_increasing_id())
    out = {r.sample_id: r for r in manifest.normalise(a, "/m", "/root").collect()}
    assert set(out) == {"sample_00000", "s"} and out["s"].prompt == "q\n\nHint: h" and out["s"].image_path == "/y.png" and out["sample_00000"].image_path == "/root/x.png"
    b = manifest.normalise(manifest.read(spark, str(tmp_path / "b.json")).withColumn("ord", F.lit(0)), "/m").first()
    assert (b.attack_target, b.task_type, b.metadata) == ("B", "mcq", '{"more":1}') and b.prompt.endswith("Answer with the best option.")
    assert manifest.read(spark, str(tmp_path / "c.json")).count() == 2
    with pytest.raises(ValueError):
        manifest.read(spark, "x.csv")
    bad = a.withColumn("img", F.lit(None).cast("string"))
    assert manifest.normalise(bad, "/m", strict=False).count() == 0
    with pytest.raises(Exception, match="is missing: image"):
        manifest.normalise(bad, "/m").collect()


def test_manifest_documents(spark, tmp_path):
    """Lists, objects with other keys beside the list, records that hold "data" themselves; anything else raises."""
    (tmp_path / "a.json").write_text('{"version": 1, "data": [{"id": "k", "n": 1, "data": [2]}, {"id": "l"}], "origin": {"x": 1}}')
    (tmp_path / "b.json").write_text('[{"id": "k", "data": [{"id": 7}]}]')
    (tmp_path / "c.json").write_text('{"version": 1, "data": {"id": "k"}}')
    (tmp_path / "d.json").write_text('{"version": 1}')
    (tmp_path / "e.json").write_text('{"data": []}')
    a = manifest.read(spark, str(tmp_path / "a.json"))
    assert set(a.columns) == {"id", "n", "data"} and sorted(a.select("id", "n").collect()) == [("k", 1), ("l", None)]
    assert [r.id for r in manifest.read(spark, str(tmp_path / "b.json")).collect()] == ["k"]
    assert manifest.read(spark, str(tmp_path / "e.json")).count() == 0
    for name in ("c.json", "d.json"):
        with pytest.raises(Exception, match="no list of records"):
            manifest.read(spark, str(tmp_path / name))
    (tmp_path / "f.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED_RECORD|malformed"):
        manifest.read(spark, str(tmp_path / "f.json"))


def test_samples_of_mixed_records(spark, tmp_path):
    lines = [
        {"id": 0, "image": "a.png", "question": "Q?", "A": "x", "B": 2, "C": None, "D": True, "E": 1.0, "answer": "A", "extra": [1, {"z": 2}], "hint": " h "},
        {"sample_id": "s1", "img": "/abs/b.png", "prompt": " P ", "options": {"B": "two", "A": 1, "C": None}, "category": " c "},
        {"id": 12, "image": {"path": "q.png"}, "question": "Q2", "choices": ["A) a", 3, None, False], "attack_target": "Z", "flag": True, "task_type": "vqa"},
        {"image": "", "image_path": "c.png", "prompt": "", "question": "last", "choices": [], "options": "[\"A. x\"]"},
    ]
    (tmp_path / "m.jsonl").write_text("\n \n".join(map(json.dumps, lines)))
    (tmp_path / "m.json").write_text(json.dumps({"n": 4, "data": lines}))
    got = [r.asDict() for r in samples.samples(spark, str(tmp_path / "m.jsonl"), "/img").orderBy("index").collect()]
    assert got == [r.asDict() for r in samples.samples(spark, str(tmp_path / "m.json"), "/img").orderBy("index").collect()]
    assert [r["sample_id"] for r in got] == ["sample_00000", "s1", "12", "sample_00003"]
    assert [r["image_path"] for r in got] == ["/img/a.png", "/abs/b.png", "/img/q.png", "/img/c.png"]
    assert [r["choices"] for r in got] == [["A. x", "B. 2", "D. True", "E. 1.0"], ["A. 1", "B. two", "C. None"], ["A) a", "3", "None", "False"], ["A. x"]]
    assert [r["attack_target"] for r in got] == ["B", "A", "Z", "A"] and [r["task_type"] for r in got] == ["mcq", "mcq", "vqa", "mcq"]
    assert got[0]["prompt"].startswith("Q?\n\nHint: h\n\nChoices:\nA. x\nB. 2\nD. True\n") and got[1]["category"] == "c"
    assert json.loads(got[0]["metadata"]) == {"extra": [1, {"z": 2}], "question_text": "Q?", "hint": "h", "attack_target": "B"}
    assert json.loads(got[2]["metadata"]) == {"flag": True, "question_text": "Q2", "attack_target": "Z"}
    assert [r.sample_id for r in samples.samples(spark, str(tmp_path / "m.jsonl"), limit=2).orderBy("index").collect()] == ["sample_00000", "s1"]
    (tmp_path / "bad.jsonl").write_text('{"image": "x", "prompt": "p"}\n{"prompt": "p"}\n{"image": "y"}\n')
    assert [r["index"] for r in samples.samples(spark, str(tmp_path / "bad.jsonl"), strict=False).collect()] == [0]
    with pytest.raises(Exception, match="record 1 is missing: image"):
        samples.samples(spark, str(tmp_path / "bad.jsonl"), limit=2).collect()
    (tmp_path / "empty.jsonl").write_text(" \n")
    assert samples.samples(spark, str(tmp_path / "empty.jsonl")).count() == 0


@pytest.mark.parametrize("kind", ["parquet", "jsonl"])
def test_records_are_numbered_in_file_order(spark, tmp_path, kind):
    """Four files whose sizes differ, so that tasks do not read them in the order of their names; small blocks; no gaps."""
    path = tmp_path / f"m.{kind}"
    at = 0
    for i, n in enumerate((3, 500, 1, 60)):
        rows = spark.range(at, at + n).selectExpr("id as n", "repeat('x', 40) as image", "'p' as prompt").coalesce(1)
        at += n
        part = str(tmp_path / f"part{i}")
        rows.write.parquet(part) if kind == "parquet" else rows.write.json(part)
        path.mkdir(exist_ok=True)
        next(p for p in (tmp_path / f"part{i}").iterdir() if p.name.startswith("part-")).rename(path / f"f{i}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = files.records(spark, str(path)).selectExpr("index", "variant_get(record, '$.n', 'bigint') as n").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["index"], r.n) for r in got) == [(i, i) for i in range(564)]
    config = manifest.RunConfig.of({"manifest_path": str(path), "output_dir": str(tmp_path / "out"), "transforms": ["clean"], "limit": 40})
    none = spark.createDataFrame([], "sample_id string, variant string, transform string, response string")
    run.run(spark, config, none)
    rows = spark.read.json(str(tmp_path / "out" / "records.json")).where("variant = 'attacked'").collect()
    assert sorted(r.sample_id for r in rows) == [f"sample_{i:05d}" for i in range(40)]
    assert all(r.attack_position == grid.POSITIONS[int(r.sample_id[-5:]) % 3] for r in rows)


def test_choices_of_real_files(spark, tmp_path):
    """Lists, objects, options and columns, each row by its own first that is not empty."""
    lines = [
        '{"id": "a", "img": "x", "prompt": "p", "choices": {"B": "two", "A": "one"}, "answer": "A"}',
        '{"id": "b", "img": "x", "prompt": "p", "options": ["A. yes", "B. no"], "answer": "B"}',
        '{"id": "c", "img": "x", "prompt": "p", "A": "red", "C": "blue", "answer": "C"}',
        '{"id": "d", "img": "x", "prompt": "p", "choices": {}, "options": [], "B": "only"}',
        '{"id": "e", "img": "x", "prompt": "p"}',
    ]
    want = {
        "a": (["A. one", "B. two"], "B", "mcq"), "b": (["A. yes", "B. no"], "A", "mcq"), "c": (["A. red", "C. blue"], "A", "mcq"),
        "d": (["B. only"], "B", "mcq"), "e": ([], None, "open"), "f": (["A. x", "y"], "A", "mcq"),
    }
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    both = lines + ['{"id": "f", "img": "x", "prompt": "p", "choices": ["A. x", "y"]}']  # lists and objects in one file
    (tmp_path / "b.jsonl").write_text("\n".join(both))
    for name, n in (("a.jsonl", 5), ("b.jsonl", 6)):
        df = manifest.read(spark, str(tmp_path / name)).withColumn("ord", F.lit(0))
        got = {r.sample_id: (r.choices, r.attack_target, r.task_type) for r in manifest.normalise(df, "/m").collect()}
        assert got == {k: v for k, v in want.items() if k in "abcdef"[:n]}
    mapped = spark.createDataFrame([({"B": "two", "A": "one"},), ({},), (None,)], "choices map<string,string>")
    assert [r[0] for r in mapped.select(manifest.choices_of(mapped)).collect()] == [["A. one", "B. two"], [], []]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest"
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little")
    bmp = b"BM" + bytes(16) + (33).to_bytes(4, "little") + (44).to_bytes(4, "little")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = [(0, str(tmp_path / "a.png"), None), (1, str(tmp_path / "broken.png"), None), (2, "/nowhere.png", None), (3, None, bytearray(gif)), (4, str(tmp_path / "a.png"), bytearray(bmp)), (5, None, bytearray(b"\xff\xd8\xff\xe0"))]
    df = spark.createDataFrame(rows, "index long, image_path string, image_bytes binary")
    got = {r["index"]: tuple(r["header"]) for r in images.decoded(df, str(tmp_path)).collect()}
    assert got == {0: ("png", 640, 480), 3: ("gif", 300, 7), 4: ("bmp", 33, 44), 5: ("jpeg", None, None)}
    assert {r["index"] for r in images.decoded(df).collect()} == {3, 4, 5}


def test_a_whole_run(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(f'{{"id": "s{i}", "img": "{i}.png", "prompt": "p", "answer": "A", "category": "c", "choices": ["A. x", "B. y"]}}' for i in range(3)))
    config = manifest.RunConfig.of({"manifest_path": str(tmp_path / "m.jsonl"), "output_dir": str(tmp_path / "out"), "judge_mode": "mcq", "transforms": ["clean", "jpeg"], "odd": 1})
    assert manifest.RunConfig.unknown({"seed": 1, "odd": 1}) == ["odd"]
    cells = [(f"s{i}", v, t) for i in range(3) for v, ts in (("base", ["clean"]), ("attacked", ["clean", "jpeg"]), ("defended_attack", ["clean", "jpeg"]), ("defended_control", ["clean", "jpeg"])) for t in ts]
    cell = "sample_id string, variant string, transform string"
    responses = spark.createDataFrame([(*c, "B" if c[1] == "attacked" else "A") for c in cells], cell + ", response string")
    detections = spark.createDataFrame([(*c, ["reveal"]) for c in cells if c[1] != "defended_control"], cell + ", suspicious_terms array<string>")
    verdicts = spark.createDataFrame([(*c, "unsafe\nS1" if c[1] == "attacked" else "safe") for c in cells[:14]], cell + ", raw string")
    summary = {r.variant: r for r in run.run(spark, config, responses, detections, verdicts).collect()}
    assert set(summary) == {"base", "attacked", "defended_attack", "defended_control"}
    rows = spark.read.json(str(tmp_path / "out" / "records.json")).collect()
    assert len(rows) == 21 and {(r.variant, r.firewall_flagged) for r in rows} == {("base", 0), ("attacked", 0), ("defended_attack", 1), ("defended_control", 0)}
    assert all(r.matched_attack_target == 1 and r.judged_correct == 0 for r in rows if r.variant == "attacked")
    assert sum(r.is_unsafe is None for r in rows) == 7
    again = replace(config, output_dir=str(tmp_path / "again"))
    both = {"first": config, "second": again}
    assert run.queue(spark, both, lambda c: (responses, detections)) == ["second"] and run.queue(spark, both, lambda c: (responses,)) == []
    found = manifest.read_summaries(spark, str(tmp_path / "out" / "summary.json" / "*.txt")).first()
    assert '"attacked"' in found.value
    with pytest.raises(ValueError, match="unknown transforms"):
        run.work(spark.range(1), manifest.RunConfig(transforms=("warp",)))


def test_artifacts_seeds_and_command_line(spark, tmp_path, capsys):
    from quillon import __main__ as cli

    (tmp_path / "a.json").write_text('{"final_text": "x", "final_loss": 0.5, "steps": [1, 2]}')
    assert tuple(manifest.read_artifact(spark, str(tmp_path / "a.json")).first()) == ("x", 0.5, "")
    with pytest.raises(FileNotFoundError):
        manifest.read_artifact(spark, str(tmp_path / "none.json"))
    assert seeds.seed_for("a") == seeds.seed_for("a") != seeds.seed_for("b") != seeds.seed_for("b", 7) and 0 <= seeds.seed_for("a") < 2**31
    assert cli.main(["list"]) == 0 and "op114_iou" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "none", "a", "b"])


def test_limits_are_checked(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, x double")
    monkeypatch.setattr(R, "MAX_SAMPLE", 10)
    with pytest.raises(ValueError, match="poisson"):
        R.replicates(df, ["k"], "x", 5)
    with pytest.raises(ValueError, match="25 values are needed"):
        C.resplit(df, "x", 20, [0.1], 3, n_test=5)
    bank = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "rid int, embedding array<double>")
    monkeypatch.setattr(detect, "MAX_BANK", 10)
    with pytest.raises(Exception, match="more than 10 vectors"):
        detect.bank_row(bank).collect()
    spans = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "span_id int, embedding array<double>")
    got = {r.span_id: r.s_inst for r in detect.cross_join_score(spans, bank, block=3).collect()}
    assert got == {i: i + 19.0 for i in range(5)}
    monkeypatch.setattr(detect, "MAX_IMAGES", 2)
    few = spans.select(F.col("span_id").alias("image_id"), "embedding")
    choices = bank.select(F.expr("string(rid % 2)").alias("label"), "embedding")
    got = {(r.image_id, r.label): r.score for r in detect.choice_scores(choices, few).collect()}
    assert got == {(i, str(p)): i + 18.0 + p for i in range(5) for p in (0, 1)}


def test_configs_and_sinks(spark, tmp_path):
    c = manifest.RunConfig.of({"cmc_lambda": 0.1, "transforms": ["clean"], "odd": 1})
    assert c.cmc_lambda == 0.1 and c.transforms == ("clean",) and c.judge_mode == "none"
    assert len(manifest.grid_of({}, "r", a=(1, 2), b=(3,))) == 2
    df = spark.createDataFrame([("a", [1, 2])], "k string, v array<int>")
    for rows in (df, df.limit(0)):
        sinks.write_csv(rows, str(tmp_path / "csv"))
        sinks.write_json(rows, str(tmp_path / "json"))
    assert sinks.document(df, "k").first()[0] == '{"a":{"v":[1,2]}}'
    assert sinks.markdown(sinks.flat(df), "k").first()[0] == "| k | v |\n|---|---|\n| a | [1,2] |"
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "summary.json").write_text('{"x": 1}')
    found = manifest.read_summaries(spark, str(tmp_path / "runs" / "*" / "summary.json"))
    assert [r.run for r in found.collect()] == ["r1"]
    runs = spark.createDataFrame([("r1",), ("r2",)], "run string")
    assert [r.run for r in manifest.pending(runs, found.select("run")).collect()] == ["r2"]


def test_plugins(spark):
    with pytest.raises(RuntimeError, match="no plug-in"):
        plugins.apply("ocr", spark.range(1))
    plugins.register("safety", lambda df: df.withColumn("raw_verdict", F.lit("safe")))
    assert plugins.apply("safety", spark.range(1)).first().raw_verdict == "safe"


def test_batched_models_and_backends(spark):
    def make():
        return lambda texts, marks: [[float(len(t)), float(len(texts)), float(m)] for t, m in zip(texts, marks)]

    encode = plugins.batched("text_encoder", make, ["text", "mark"], "embedding", "array<double>", batch=4)
    df = spark.createDataFrame([("x" * i, i) for i in range(10)], "text string, mark int").coalesce(1)
    plugins.register("text_encoder", encode)
    got = [r.embedding for r in plugins.apply("text_encoder", df).orderBy("mark").collect()]
    assert [x[0] for x in got] == [x[2] for x in got] == list(map(float, range(10))) and max(x[1] for x in got) == 4
    one = plugins.batched("generate", lambda: lambda prompts: [p.upper() for p in prompts], ["text"], "response", "string", batch=3)
    assert {r.response for r in one(df).collect()} == {"X" * i for i in range(10)}
    short = plugins.batched("generate", lambda: lambda prompts: prompts[:1], ["text"], "response", "string")
    with pytest.raises(Exception, match="returned 1 results"):
        short(df).collect()
    with pytest.raises(ValueError):
        plugins.batched("none", make, [], "x", "string")
    plugins.register_backend("upper", one)
    assert plugins.backend("upper") is one
    with pytest.raises(ValueError, match="unknown backend"):
        plugins.backend("other")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), "click", float(m)) for h in range(4) for m in (0, 30)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.windowed(E.read_events(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("seen").collect()} == {tuple(r) for r in E.windowed(df).collect()}


def test_numbered_is_the_seeded_order(spark):
    from quillon.operators import grid

    ids = spark.range(500)
    got = {r.place: r.id for r in grid.numbered(ids, "id", slice_rows=7).collect()}
    assert [got[i] for i in range(500)] == [r.id for r in grid.shuffled(ids, "id").collect()]
    assert grid.numbered(ids.where("id < 0"), "id").count() == 0


def test_progress(spark):
    from pyspark.sql import functions as F

    from quillon.operators import progress

    df, seen = progress.observed(spark.range(10), "ten", even=F.count_if(F.col("id") % 2 == 0))
    assert df.count() == 10 and seen.get == {"even": 5}
    rows = spark.createDataFrame([("a", True), ("a", None), (None, False)], "k string, ok boolean")
    got = {(r.k, r.done, r.total, r.share) for r in progress.counters(rows, ["k"], F.col("ok")).collect()}
    assert got == {("a", 1, 2, 0.5), (None, 0, 1, 0.0)}
