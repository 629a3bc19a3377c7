"""Queries over aggregations, calibration, resampling and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import calibrate as C
from quillon.operators import compare, detect
from quillon.operators import metrics as M
from quillon.operators import progress, report
from quillon.operators import resample as R
from quillon.operators.resample import N_BOOT
from quillon.plans.base import (
    RESPONSES, WITH_RISK, counters_sql, dot, draw, indexed_sql, mixed, norm, paired_sql, poisson_sql, query, records,
)
from quillon.plans.q_tables import _risk
from quillon.sources import fixtures as FX

REC = f"WITH {records()}"


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_UNSAFE = {v: f"avg(is_unsafe::DOUBLE) FILTER (variant = '{v}')" for v in ("attacked", "defended_attack")}


@query("op053_empty_mean", "SELECT n_name, round(coalesce(avg(c_acctbal), 0), 6) AS mean FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9900 GROUP BY n_name")
def _(spark, d):
    rich = FX.table(spark, d, "customer").where("c_acctbal > 9900")
    return FX.table(spark, d, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.round(M.mean0(F.col("c_acctbal")), 6).alias("mean"))


def _summary_sql(by):
    return f"{REC} SELECT {by}, count(*) AS count, round(coalesce(avg(firewall_flagged), 0), 6) AS flag_rate, round(avg(judged_correct), 6) AS judge_rate, avg(matched_attack_target)::DOUBLE AS attack_target_rate, round(avg(is_unsafe), 6) AS unsafe_rate FROM rec GROUP BY {by}"


@query("op054_variant_summary", _summary_sql("variant"))
def _(spark, d):
    return _r6(M.summary(FX.records(spark, d), "variant"), "flag_rate", "judge_rate", "unsafe_rate")


@query("op055_transform_summary", _summary_sql("transform"))
def _(spark, d):
    return _r6(M.summary(FX.records(spark, d), "transform"), "flag_rate", "judge_rate", "unsafe_rate")


@query("op056_category_summary", f"{REC} SELECT category, count(*) AS count, round({_UNSAFE['attacked']}, 6) AS attacked_unsafe, round({_UNSAFE['defended_attack']}, 6) AS defended_unsafe FROM rec WHERE coalesce(category, '') <> '' GROUP BY category")
def _(spark, d):
    return _r6(M.by_category(FX.records(spark, d)), "attacked_unsafe", "defended_unsafe")


@query("op057_grouping_sets", f"{REC} SELECT dim, key, count, unsafe_rate, flag_rate FROM (SELECT CASE WHEN variant IS NOT NULL THEN 'variant' WHEN transform IS NOT NULL THEN 'transform' ELSE 'category' END AS dim, coalesce(variant, transform, category) AS key, count(*) AS count, round(avg(is_unsafe), 6) AS unsafe_rate, round(avg(firewall_flagged), 6) AS flag_rate FROM rec GROUP BY GROUPING SETS ((variant), (transform), (category))) WHERE key IS NOT NULL")
def _(spark, d):
    return _r6(M.all_groups(FX.records(spark, d)), "unsafe_rate", "flag_rate")


@query("op058_asr_reduction", f"{REC}, r AS (SELECT round({_UNSAFE['attacked']}, 4) AS attacked, round({_UNSAFE['defended_attack']}, 4) AS defended FROM rec) SELECT attacked, defended, round(attacked - defended, 4) AS absolute, CASE WHEN attacked > 0 THEN round((attacked - defended) / attacked, 4) END AS relative FROM r")
def _(spark, d):
    return M.reduction(FX.records(spark, d))


@query("op059_latency_stats", "WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS median, v[least(len(v) - 1, CAST(floor(0.95::DOUBLE * len(v)) AS BIGINT)) + 1] AS p95, mean FROM s")
def _(spark, d):
    return _r6(M.latency(FX.table(spark, d, "events"), "event_type", "value"), "mean")


def _pilot(spark, d):
    docs = FX.table(spark, d, "documents")
    a = F.col("doc_id")
    return docs.select(
        F.when(a % 4 == 0, "control").otherwise("attack").alias("variant"), F.when(a % 3 == 0, "clean").when(a % 3 == 1, "crop").otherwise("blur").alias("transform"),
        (a % 5 != 0).cast("int").alias("attack_detected_before"), (a % 7 == 0).cast("int").alias("attack_detected_after"),
        (a % 11 != 0).cast("int").alias("anchor_detected_after"), (a % 13 == 0).cast("int").alias("firewall_flagged"),
    )


_PILOT = """WITH p AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'control' ELSE 'attack' END AS variant, (['clean','crop','blur'])[doc_id % 3 + 1] AS transform,
  CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END AS ab, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS aa, CASE WHEN doc_id % 11 <> 0 THEN 1 ELSE 0 END AS na, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS ff FROM documents)"""


@query("op060_pilot_summary", f"""{_PILOT} SELECT count(*) FILTER (variant = 'attack') AS num_attack_records, count(*) FILTER (variant = 'control') AS num_control_records,
  round(avg(ab) FILTER (variant = 'attack' AND transform = 'clean'), 6) AS clean_asr_proxy, round(avg(aa) FILTER (variant = 'attack' AND transform = 'clean'), 6) AS defended_clean_asr_proxy,
  round(avg(ab) FILTER (variant = 'attack' AND transform <> 'clean'), 6) AS transformed_asr_proxy, round(avg(aa) FILTER (variant = 'attack' AND transform <> 'clean'), 6) AS defended_transformed_asr_proxy,
  round(avg(ff) FILTER (variant = 'control'), 6) AS control_false_positive_rate, round(avg(na) FILTER (variant = 'control'), 6) AS control_benign_retention_after FROM p""")
def _(spark, d):
    out = M.pilot_summary(_pilot(spark, d))
    return _r6(out, *[c for c in out.columns if not c.startswith("num")])


@query("op060_pilot_by_transform", f"{_PILOT} SELECT transform, round(avg(ab), 6) AS attack_detection_rate, round(avg(aa), 6) AS defended_attack_rate, round(avg(na), 6) AS benign_anchor_retention_after FROM p WHERE variant = 'attack' GROUP BY transform")
def _(spark, d):
    out = M.pilot_by_transform(_pilot(spark, d))
    return _r6(out, *out.columns[1:])


_QUALITY = "WITH vals AS (SELECT 1 AS g, doc_id AS k, quality AS x FROM labels)"
_LABELS = _QUALITY.replace("doc_id AS k", "CAST(doc_id AS VARCHAR) AS k")
_MEAN = "(SELECT round(avg(x), 6) FROM vals)"


@query("op061_bootstrap_ci", f"{indexed_sql(_QUALITY, N_BOOT)} SELECT {_MEAN} AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT n FROM n) AS n FROM reps")
def _(spark, d):
    return _r6(R.bootstrap_ci(FX.table(spark, d, "labels"), ["doc_id"], "quality", engine="indexed"), "mean", "lo", "hi")


@query("op061_bootstrap_poisson", f"{poisson_sql(_LABELS, N_BOOT)} SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM reps")
def _(spark, d):
    return _r6(R.interval(R.poisson_replicates(FX.table(spark, d, "labels"), ["doc_id"], "quality")), "lo", "hi")


_BY_LANG = "WITH vals AS (SELECT lang AS g, CAST(doc_id AS VARCHAR) AS k, quality AS x FROM labels JOIN documents USING (doc_id))"


@query("op061_bootstrap_groups", f"{poisson_sql(_BY_LANG, N_BOOT)} SELECT lang, mean, lo, hi, n FROM (SELECT g AS lang, round(avg(x), 6) AS mean, count(x) AS n FROM vals GROUP BY g) JOIN (SELECT g AS lang, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM reps GROUP BY g) USING (lang)")
def _(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", "lang")
    rows = FX.table(spark, d, "labels").join(docs, "doc_id")
    return _r6(R.bootstrap_ci(rows, ["doc_id"], "quality", by=["lang"]), "mean", "lo", "hi")


@query("op061_bootstrap_numpy")
def _(spark, d):
    return R.numpy_ci(FX.records(spark, d), ["variant"], "sample_id", "is_unsafe", 10_000)


@query("op062_bootstrap_picked", f"{indexed_sql(_QUALITY, 1000, 42)}, s AS (SELECT list(m ORDER BY m) AS v FROM reps) SELECT round(v[25 + 1], 6) AS lo, round(v[975 + 1], 6) AS hi FROM s")
def _(spark, d):
    reps = R.replicates(FX.table(spark, d, "labels"), ["doc_id"], "quality", 1000, 42)
    return _r6(R.picked_interval(reps, 1000), "lo", "hi")


_DIFF = f"""{REC}, vals AS (SELECT 1 AS g, a.sample_id || '/' || a.transform AS k, a.is_unsafe - b.is_unsafe AS x FROM rec a JOIN rec b ON a.sample_id = b.sample_id AND a.transform = b.transform
  AND a.attack_position = b.attack_position AND a.variant = 'attacked' AND b.variant = 'defended_attack')"""
_TESTED = "round(mean_diff, 6) AS mean_diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p_value, 6) AS p_value, n_pairs"


@query("op063_paired_bootstrap", f"{poisson_sql(_DIFF, N_BOOT)}, {paired_sql()} SELECT {_TESTED} FROM tested")
def _(spark, d):
    pairs = compare.pair_variants(FX.records(spark, d))
    return _r6(R.paired_test(pairs, ["sample_id", "transform"]), "mean_diff", "lo", "hi", "p_value")


@query("op064_summarize_rate", f"{poisson_sql(_LABELS, N_BOOT)} SELECT {_MEAN} AS rate, round(quantile_cont(m, 0.025), 6) AS ci95_lo, round(quantile_cont(m, 0.975), 6) AS ci95_hi, round((quantile_cont(m, 0.975) - quantile_cont(m, 0.025)) / 2, 6) AS ci95_halfwidth, (SELECT count(x) FROM vals) AS n FROM reps")
def _(spark, d):
    return _r6(R.summarize_rate(FX.table(spark, d, "labels"), ["doc_id"], "quality"), "rate", "ci95_lo", "ci95_hi", "ci95_halfwidth")


@query("op065_mean_sample_sd", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return FX.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.count("value").alias("n"))


@query("op066_population_sd_tail", "SELECT event_type, round(stddev_pop(value), 6) AS sd, round(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0 END), 6) AS tail FROM events GROUP BY event_type")
def _(spark, d):
    return FX.table(spark, d, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg((F.col("value") > 100).cast("double")), 6).alias("tail"))


TAUS = [0.1, 0.15, 0.2, 0.22, 0.25, 0.28, 0.3, 0.32, 0.35, 0.4, 0.5, 1.1]
_TAU_ROWS = ", ".join(f"({t}::DOUBLE)" for t in TAUS)


def _roc_sql(score):
    return f"""{WITH_RISK}, c AS (SELECT tau, count(*) FILTER (hit AND pos) AS tp, count(*) FILTER (NOT hit AND pos) AS fn, count(*) FILTER (hit AND NOT pos) AS fp, count(*) FILTER (NOT hit AND NOT pos) AS tn
  FROM (SELECT tau, {score} >= tau AS hit, label >= 5 AS pos FROM risk, (VALUES {_TAU_ROWS}) t(tau)) GROUP BY tau),
  q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c)
  SELECT tau, tp, fn, fp, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM q"""


def _roc(spark, d, score):
    rows = _risk(spark, d).select(F.col(score).alias("score"), (F.col("label") >= 5).cast("int").alias("positive"))
    return _r6(C.roc(rows, TAUS), "precision", "recall", "fpr", "f1")


@query("op067_confusion_rates", _roc_sql("risk"))
def _(spark, d):
    return _roc(spark, d, "risk")


_MAX = f"{WITH_RISK}, mx AS (SELECT i.image_id, coalesce(max(risk), 0) AS max_risk FROM images i LEFT JOIN risk r ON i.image_id = r.image_id GROUP BY ALL)"


def _tau(alpha):
    return f"tau AS (SELECT count(*) AS n, list(max_risk ORDER BY max_risk)[CAST(greatest(least(ceil((count(*) + 1) * {1 - alpha!r}::DOUBLE) - 1, count(*) - 1), 0) AS BIGINT) + 1] AS tau FROM mx WHERE image_id < 25)"


def _max(spark, d):
    return detect.max_risk(FX.images(spark, d).select("image_id"), _risk(spark, d))


@query("op068_conformal_threshold", f"{_MAX}, {_tau(0.1)} SELECT n, round(tau, 6) AS tau FROM tau")
def _(spark, d):
    return _r6(C.threshold(_max(spark, d).where("image_id < 25"), "max_risk", 0.1), "tau")


@query("op069_max_risk_per_image", f"{_MAX} SELECT image_id, round(max_risk, 6) AS max_risk FROM mx")
def _(spark, d):
    return _r6(_max(spark, d), "max_risk")


@query("op070_coverage_bound", "SELECT label, round(0.2::DOUBLE + 1.0::DOUBLE / (count(*) + 1), 9) AS bound FROM embeddings GROUP BY label")
def _(spark, d):
    return FX.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", F.round(C.bound(0.2, F.col("n")), 9).alias("bound"))


@query("op071_empirical_fpr", f"{_MAX}, {_tau(0.1)} SELECT round(any_value(tau), 6) AS tau, round(avg(CASE WHEN max_risk >= tau THEN 1.0::DOUBLE ELSE 0 END), 6) AS fpr, round(0.1::DOUBLE + 1.0::DOUBLE / (any_value(n) + 1), 6) AS bound, avg(CASE WHEN max_risk >= tau THEN 1.0::DOUBLE ELSE 0 END) <= 0.1::DOUBLE + 1.0::DOUBLE / (any_value(n) + 1) AS within, any_value(n) AS n_cal, count(*) AS n_test FROM mx, tau WHERE image_id >= 25")
def _(spark, d):
    rows = _max(spark, d)
    return _r6(C.false_positives(rows.where("image_id >= 25"), "max_risk", C.threshold(rows.where("image_id < 25"), "max_risk", 0.1), 0.1), "tau", "fpr", "bound")


N_SPLITS, N_CAL, ALPHAS = 2000, 20, (0.05, 0.1, 0.2)


def splits_sql(pool: str, n_cal: int, n_splits: int, alphas, n_test: int | None = None, draws: int = 400, name: str = "f") -> str:
    """CTEs that end in f(b, alpha, tau, fpr), of a table pool(x): splits by drawn ranks, as ``operators.calibrate`` draws them."""
    k = "CAST(greatest(least(ceil(({0} + 1) * (1.0::DOUBLE - alpha)) - 1, {0} - 1), 0) AS BIGINT) + 1".format(n_cal)
    share = "(s.n - r.begin - (len(cal) - len(list_filter(cal, lambda y: y < r.begin)))) / (s.n - len(cal))::DOUBLE"
    if n_test:
        share = "len(list_filter(test, lambda y: y >= r.begin)) / len(test)::DOUBLE"
    return f"""ranked AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) - 1 AS rank, rank() OVER (ORDER BY x) - 1 AS begin FROM {pool} WHERE x IS NOT NULL),
  size AS (SELECT count(*) AS n FROM ranked),
  cn AS MATERIALIZED (SELECT b, c, xor(c, 2654435769::UBIGINT) AS e, {mixed('e', 'o')} FROM ({counters_sql(n_splits, 7)})),
  dr AS (SELECT b, n, j, xor(j, c) AS y, {mixed('y', 'g')}, g + o & 4294967295::UBIGINT AS z, {mixed('z', 'h')}, xor(h, o) AS t, {mixed('t', 'l')},
    CAST((h & 2147483647::UBIGINT) * 4294967296::UBIGINT + l AS BIGINT) % n AS rank FROM cn, size, (SELECT CAST(unnest(range({draws})) AS UBIGINT) AS j)),
  came AS (SELECT b, n, rank, row_number() OVER (PARTITION BY b ORDER BY min(j)) AS pos FROM dr GROUP BY b, n, rank),
  split AS MATERIALIZED (SELECT b, n, list(rank ORDER BY rank) FILTER (pos <= {n_cal}) AS cal, list(rank ORDER BY rank) FILTER (pos > {n_cal} AND pos <= {n_cal + (n_test or 0)}) AS test FROM came GROUP BY b, n),
  {name} AS (SELECT s.b, alpha, r.x AS tau, {share} AS fpr FROM (SELECT *, cal[{k}] AS rank FROM split, (SELECT unnest({[float(a) for a in alphas]}::DOUBLE[]) AS alpha)) s JOIN ranked r USING (rank))"""


_SPLITS = f"{_MAX}, pool AS (SELECT max_risk AS x FROM mx), {splits_sql('pool', N_CAL, N_SPLITS, ALPHAS)}"
_SUMMARY = """SELECT alpha, round(avg(fpr), 6) AS mean_fpr, round(quantile_cont(fpr, 0.025), 6) AS lo, round(quantile_cont(fpr, 0.975), 6) AS hi,
  round(alpha + 1.0::DOUBLE / {0}, 6) AS bound, avg(fpr) <= alpha + 1.0::DOUBLE / {0} AS within, round(avg((fpr <= alpha + 1.0::DOUBLE / {0})::INT), 6) AS share_within, round(stddev_pop(fpr), 6) AS sd, count(*) AS n FROM f GROUP BY alpha"""


@query("op072_resplit_bootstrap", f"{_SPLITS} {_SUMMARY.format(N_CAL + 1)}")
def _(spark, d):
    return _r6(C.resplit_summary(_splits(spark, d), N_CAL), "mean_fpr", "lo", "hi", "bound", "share_within", "sd")


def _splits(spark, d):
    return C.resplit(_max(spark, d), "max_risk", N_CAL, list(ALPHAS), N_SPLITS)


_SPAN_SPLITS = f"{WITH_RISK}, pool AS (SELECT risk AS x FROM risk), {splits_sql('pool', 100, N_SPLITS, ALPHAS)}"


@query("op072_resplit_spans", f"{_SPAN_SPLITS} {_SUMMARY.format(101)}")
def _(spark, d):
    """The risks of all spans as the pool, which grows with the table."""
    fprs = C.resplit(_risk(spark, d).select("risk"), "risk", 100, list(ALPHAS), N_SPLITS)
    return _r6(C.resplit_summary(fprs, 100), "mean_fpr", "lo", "hi", "bound", "share_within", "sd")


@query("op073_vmf_concentration", f"""{WITH_RISK}, r AS (SELECT (SELECT greatest(least(avg({dot('s.embedding', 'i.embedding')}), 0.99::DOUBLE), 0.01::DOUBLE) FROM spans s JOIN images i USING (image_id)) AS r0,
  (SELECT greatest(least(avg(s_inst), 0.99::DOUBLE), 0.01::DOUBLE) FROM scored) AS r1), k AS (SELECT r0 * (64 - r0 * r0) / (1 - r0 * r0) AS kappa0, r1 * (64 - r1 * r1) / (1 - r1 * r1) AS kappa1 FROM r) SELECT round(kappa0, 6) AS kappa0, round(kappa1, 6) AS kappa1, round(kappa0 / kappa1, 6) AS lam FROM k""")
def _(spark, d):
    """Mean cosines of two groups of pairs: spans with their image, and spans with the nearest of the bank."""
    return _r6(_vmf(spark, d).select("kappa0", "kappa1", "lam"), "kappa0", "kappa1", "lam")


def _vmf(spark, d):
    scored = detect.with_risk(detect.score(FX.spans(spark, d), FX.bank(spark, d)), FX.images(spark, d), 0.5, floor=None)
    r = scored.agg(F.avg(-F.col("s_inc")).alias("r0"), F.avg("s_inst").alias("r1"), F.count("*").alias("n_spans"))
    k = r.select("n_spans", "r0", "r1", C.vmf_kappa(F.col("r0"), 64).alias("kappa0"), C.vmf_kappa(F.col("r1"), 64).alias("kappa1"))
    return k.withColumn("lam", F.col("kappa0") / F.col("kappa1"))


_U = lambda seed: f"(({draw(seed, 'p', 'i')}) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query("op074_levy_tail", f"""WITH g AS (SELECT p, {_U(1)} AS u1, {_U(2)} AS u2 FROM range(2000) a(p), range(64) b(i)),
  xy AS (SELECT p, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS x, sqrt(-2 * ln(u1)) * sin(2 * pi() * u2) AS y FROM g),
  c AS (SELECT p, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS c FROM xy GROUP BY p)
  SELECT t, avg(CASE WHEN c > t THEN 1.0::DOUBLE ELSE 0 END) AS tail, round(exp(-64 * t * t / 2), 9) AS bound FROM c, (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS t) GROUP BY t""")
def _(spark, d):
    """Share of random unit pairs with an inner product above t, against the bound; normal draws from md5."""
    dim, n = 64, 2000
    rows = spark.range(n * dim).select((F.col("id") / dim).cast("long").alias("p"), (F.col("id") % dim).alias("i"))
    u = lambda seed: (C.hash_key(seed, F.col("p"), F.col("i")).cast("double") + 0.5) / 4294967296.0
    r, angle = F.sqrt(-2 * F.log(u(1))), 2 * math.pi * u(2)
    xy = rows.select("p", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = xy.groupBy("p").agg((F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("c"))
    ts = F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.3)))).alias("t")
    out = pairs.select("c", ts).groupBy("t").agg(F.avg((F.col("c") > F.col("t")).cast("double")).alias("tail"))
    return out.withColumn("bound", F.round(C.levy_bound(dim, F.col("t")), 9))


N_DIRECTIONS, TAILS = 32, (0.05, 0.1, 0.15, 0.2)
_LEVY = f"""gauss AS (SELECT p, i, sqrt(-2 * ln({_U(1)})) * cos(2 * pi() * ({_U(2)})) AS z FROM range({N_DIRECTIONS}) a(p), range(64) b(i)),
  direction AS (SELECT p, list(z ORDER BY i) AS z, sqrt(sum(z * z)) AS len FROM gauss GROUP BY p),
  inner_ AS (SELECT list_inner_product(embedding::DOUBLE[], z) / len / sqrt({dot('embedding', 'embedding')}) AS c FROM embeddings, direction),
  levy AS (SELECT t, avg((c > t)::INT) AS tail, exp(-64 * t * t / 2) AS bound FROM inner_, (SELECT unnest({list(TAILS)}::DOUBLE[]) AS t) GROUP BY t)"""


@query("op074_levy_directions", f"WITH {_LEVY} SELECT t, round(tail, 6) AS tail, round(bound, 6) AS bound, round(tail / bound, 6) AS ratio, tail <= bound AS holds FROM levy")
def _(spark, d):
    """All embeddings against random directions."""
    return _r6(_levy(spark, d), "tail", "bound", "ratio")


def _levy(spark, d):
    rows = spark.range(N_DIRECTIONS * 64).select((F.col("id") / 64).cast("long").alias("p"), (F.col("id") % 64).alias("i"))
    u = lambda seed: (C.hash_key(seed, F.col("p"), F.col("i")).cast("double") + 0.5) / 4294967296.0
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    drawn = rows.select("p", "i", z.alias("z")).groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("zs"))
    directions = drawn.select(V.normalized(F.transform("zs", lambda x: x["z"])).alias("v"))
    unit = FX.table(spark, d, "embeddings").select(V.normalized(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    return C.levy_check(unit, directions, 64, list(TAILS))


EPSILONS, TURNS = (0.01, 0.05, 0.1, 0.2), 20
_LIPSCHITZ = f"""turned AS (SELECT span_id, image_id, embedding, epsilon, list_transform(range(0, 64), lambda k: sin(k * 12.9898::DOUBLE + span_id + 977 * turn)) AS z
    FROM spans, (SELECT unnest({list(EPSILONS)}::DOUBLE[]) AS epsilon), range({TURNS}) t(turn)),
  pushed AS (SELECT span_id, image_id, epsilon, list_transform(range(1, 65), lambda k: embedding[k]::DOUBLE + epsilon * z[k] / sqrt(list_inner_product(z, z))) AS v FROM turned),
  own AS (SELECT span_id, s_inst - 0.5::DOUBLE * {dot('s.embedding', 'i.embedding')} AS risk FROM scored s JOIN images i USING (image_id)),
  near_ AS (SELECT rid, list(rid) AS g, any_value(embedding)::DOUBLE[] AS embedding FROM bank GROUP BY rid),
  after_ AS (SELECT p.span_id, epsilon, v, (SELECT max(list_inner_product(v, n.embedding)) FROM near_ n) / sqrt(list_inner_product(v, v))
    - 0.5::DOUBLE * list_inner_product(v, i.embedding::DOUBLE[]) / sqrt(list_inner_product(v, v)) AS risk FROM pushed p JOIN images i USING (image_id)),
  lipschitz AS (SELECT epsilon, max(abs(a.risk - o.risk)) AS worst, 1.5::DOUBLE * epsilon AS bound FROM after_ a JOIN own o USING (span_id) GROUP BY epsilon)"""


def _lipschitz(spark, d):
    risk = lambda s: detect.with_risk(detect.score(s, FX.bank(spark, d), "arrow"), FX.images(spark, d), 0.5, floor=None)
    return C.lipschitz_check(FX.spans(spark, d).select("span_id", "image_id", "embedding"), risk, list(EPSILONS), 0.5, TURNS)


@query("op075_lipschitz_norms", f"{WITH_RISK}, {_LIPSCHITZ} SELECT epsilon, round(worst, 6) AS worst, round(bound, 6) AS bound, round(worst / bound, 6) AS ratio, worst <= bound + 1e-6 AS holds FROM lipschitz")
def _(spark, d):
    """All spans, pushed to four distances."""
    return _r6(_lipschitz(spark, d), "worst", "bound", "ratio")


_MOVED = f"""{WITH_RISK}, noisy AS (SELECT span_id, image_id, embedding, list_transform(range(0, 64), lambda k: sin(k * 12.9898::DOUBLE + span_id)) AS z FROM spans),
  moved AS (SELECT span_id, image_id, list_transform(range(1, 65), lambda k: embedding[k]::DOUBLE + 0.05::DOUBLE * z[k] / sqrt(list_inner_product(z, z))) AS embedding FROM noisy),
  best AS (SELECT span_id, m.image_id, m.embedding, max({dot('m.embedding', 'b.embedding')}) AS s_inst FROM moved m, bank b GROUP BY ALL),
  other AS (SELECT span_id, s_inst + 0.5::DOUBLE * greatest(-{dot('best.embedding', 'i.embedding')}, -0.1::DOUBLE) AS risk FROM best JOIN images i ON best.image_id = i.image_id)"""


@query("op075_lipschitz", f"{_MOVED} SELECT round(max(abs(a.risk - o.risk)), 6) AS most, 1.5::DOUBLE * 0.05::DOUBLE AS bound FROM risk a JOIN other o USING (span_id)")
def _(spark, d):
    """Largest change of risk under perturbations of norm eps, against (1 + lambda) * eps."""
    eps = 0.05
    spans = FX.spans(spark, d)
    noise = F.transform("embedding", lambda x, i: F.sin(i * 12.9898 + F.col("span_id")))
    moved = F.zip_with("embedding", V.normalized(F.col("noise")), lambda x, z: x.cast("double") + z * eps)
    other = spans.withColumn("noise", noise).withColumn("embedding", moved).drop("noise")
    risk = lambda s: detect.with_risk(detect.score(s, FX.bank(spark, d)), FX.images(spark, d), 0.5)
    both = risk(spans).select("span_id", F.col("risk").alias("a")).join(risk(other).select("span_id", F.col("risk").alias("b")), "span_id")
    return both.agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("most")).withColumn("bound", F.lit(1.5 * eps))


N_REPEATS = 500
_DKW = f"{WITH_RISK}, pool AS (SELECT risk AS x FROM risk), {splits_sql('pool', 50, N_REPEATS, [0.1], 80)}"
_DKW_ROW = """SELECT alpha, avg(fpr) AS mean, stddev_pop(fpr) AS sd, sqrt(alpha * (1 - alpha) / 50.0::DOUBLE) AS beta_sd, 2 * exp(-2.0::DOUBLE * 50 * 0.05::DOUBLE * 0.05::DOUBLE) AS dkw_bound,
  avg((abs(fpr - alpha) > 0.05::DOUBLE + 2.0::DOUBLE / 50)::INT) AS excess FROM f GROUP BY alpha"""


@query("op076_dkw_beta_bounds", f"{_DKW}, k AS ({_DKW_ROW}) SELECT alpha, round(mean, 6) AS mean, round(sd, 6) AS sd, round(beta_sd, 6) AS beta_sd, round(dkw_bound, 6) AS dkw_bound, round(excess, 6) AS excess, excess <= dkw_bound + 0.05::DOUBLE AS dkw_holds FROM k")
def _(spark, d):
    """500 splits into a calibration part and a test part of given sizes."""
    return _r6(_concentration(spark, d), "mean", "sd", "beta_sd", "dkw_bound", "excess")


def _concentration(spark, d):
    fprs = C.resplit(_risk(spark, d).select("risk"), "risk", 50, [0.1], N_REPEATS, n_test=80)
    return C.concentration(fprs, 50)


@query("op078_retention", f"{REC}, r AS (SELECT category, avg(judged_correct) FILTER (variant = 'base') AS base, avg(judged_correct) FILTER (variant = 'defended_control') AS control FROM rec GROUP BY category) SELECT category, round(control / nullif(base, 0), 6) AS retention FROM r")
def _(spark, d):
    rows = report.utility(FX.records(spark, d).withColumn("run", F.col("category")))
    return rows.select(F.col("run").alias("category"), F.round("retention", 6).alias("retention"))


@query("op079_sorted_terms", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS terms FROM documents GROUP BY lang")
def _(spark, d):
    terms = F.array_sort(F.collect_set(F.nullif("source", F.lit(""))))
    return FX.table(spark, d, "documents").groupBy("lang").agg(F.array_join(terms, ",").alias("terms"))


@query("op080_score_histogram", f"{WITH_RISK}, h AS (SELECT least(CAST(floor(s_inst / 0.05::DOUBLE) AS INT), 19) AS bin, count(*) AS count FROM risk WHERE s_inst > 0.01 AND s_inst <= 1 GROUP BY ALL) SELECT bin, count, round(count / (sum(count) OVER () * 0.05), 6) AS density FROM h")
def _(spark, d):
    rows = _risk(spark, d).where("s_inst > 0.01")
    return _r6(M.histogram(rows, "s_inst", [i / 20 for i in range(21)]), "density")


@query("op081_fpr_histogram", f"{_SPLITS}, g AS (SELECT least(CAST(floor(fpr / (1.0::DOUBLE / 25)) AS INT), 24) AS bin FROM f WHERE alpha = 0.1) SELECT bin, count(*) AS count, round(count(*) / (sum(count(*)) OVER () * 0.04), 6) AS density FROM g GROUP BY bin")
def _(spark, d):
    return _r6(M.histogram(_splits(spark, d).where("alpha = 0.1"), "fpr", [i / 25 for i in range(26)]), "density")


# ---- scalar functions ----------------------------------------------------

RESP = f"WITH {RESPONSES}"
_MCQ = r"nullif(regexp_extract(upper(response), '\b([A-E])\b', 1), '')"


def _resp(spark, d):
    return FX.responses(spark, d)


@query("op098_normalize_text", f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents")
def _(spark, d):
    return FX.table(spark, d, "documents").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("digest"))


@query("op099_mcq_choice", f"{RESP} SELECT conv_id, turn, {_MCQ} AS choice FROM resp")
def _(spark, d):
    return _resp(spark, d).select("conv_id", "turn", X.mcq_choice(F.col("response")).alias("choice"))


@query("op100_judge_modes", f"""{RESP} SELECT conv_id, turn, CAST({norm('response')} = lower(answer) AS INT) AS exact, CAST(contains({norm('response')}, lower(answer)) AS INT) AS contains_,
  CAST(coalesce({_MCQ}, '') = answer AS INT) AS mcq, CAST(contains({norm('response')}, lower(answer)) AS INT) AS auto FROM resp""")
def _(spark, d):
    a, b = F.col("response"), F.col("answer")
    return _resp(spark, d).select("conv_id", "turn", *[X.judge(a, b, m).alias(n) for m, n in (("exact", "exact"), ("contains", "contains_"), ("mcq", "mcq"), ("auto", "auto"))])


_MARKS = " OR ".join(f"contains({norm('response')}, '{m}')" for m in X.refusal_markers() if "’" not in m)


@query("op101_refusal", f"{RESP}, x AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'Sorry -- I am UNABLE to, ' || response ELSE response END AS response FROM resp) SELECT conv_id, turn, CAST({_MARKS} AS INT) AS refused FROM x")
def _(spark, d):
    said = F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("Sorry -- I am UNABLE to, "), "response")).otherwise(F.col("response"))
    return _resp(spark, d).select("conv_id", "turn", X.judge(said, F.lit(None).cast("string"), "refusal").alias("refused"))


@query("op102_match_target", f"{RESP} SELECT conv_id, turn, CAST(coalesce({_MCQ}, upper(trim(response))) = answer AS INT) AS matched FROM resp")
def _(spark, d):
    return _resp(spark, d).select("conv_id", "turn", X.matches_target(F.col("response"), F.col("answer")).alias("matched"))


@query("op103_choice_label", r"SELECT item_id, nullif(regexp_extract(trim(text), '^\s*([A-Z])[.):-]?\s*', 1), '') AS label FROM benchmark")
def _(spark, d):
    return FX.table(spark, d, "benchmark").select("item_id", X.choice_label(F.col("text")).alias("label"))


@query("op104_parse_choice", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN chr(CAST(65 + item_id % 5 AS INT)) END AS label, replace(text, chr(10), ' ') AS body FROM benchmark")
def _(spark, d):
    clean = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    c = F.when(F.col("item_id") % 2 == 0, F.concat(F.expr("chr(65 + item_id % 5)"), F.lit(") "), clean)).otherwise(clean)
    label, body = X.split_choice(F.col("c"))
    return FX.table(spark, d, "benchmark").withColumn("c", c).select("item_id", label.alias("label"), body.alias("body"))


@query("op105_choice_candidates", "SELECT item_id, 'Question: ' || text || chr(10) || 'Answer: A. x' || chr(10) || 'Question: ' || text || chr(10) || 'Answer: B. y' AS candidates FROM benchmark")
def _(spark, d):
    made = F.transform(F.array(F.lit("A. x"), F.lit("B. y")), lambda c: F.concat(F.lit("Question: "), F.col("text"), F.lit("\nAnswer: "), c))
    return FX.table(spark, d, "benchmark").select("item_id", F.array_join(made, "\n").alias("candidates"))


def _verdicts(spark, d):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "safe").when(k == 1, "unsafe\nS1").when(k == 2, "unsafe").when(k == 3, "S5 UNSAFE").otherwise(" Unsafe\n ")
    return FX.table(spark, d, "customer").select("c_custkey", raw.alias("raw"))


@query("op106_verdict", "SELECT c_custkey, c_custkey % 5 <> 0 AS is_unsafe FROM customer")
def _(spark, d):
    return _verdicts(spark, d).select("c_custkey", X.verdict_unsafe(F.col("raw")).alias("is_unsafe"))


@query("op107_verdict_category", "SELECT c_custkey, (['safe','S1','unsafe_unspecified','S5','unsafe_unspecified'])[c_custkey % 5 + 1] AS category FROM customer")
def _(spark, d):
    return _verdicts(spark, d).select("c_custkey", X.verdict_category(F.col("raw")).alias("category"))


@query("op108_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def _(spark, d):
    e = FX.table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("first"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("first")), 6).alias("cos"))


@query("op109_dot_normalize", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def _(spark, d):
    e = F.col("embedding")
    return FX.table(spark, d, "embeddings").select("vec_id", F.round(V.dot(e, e), 6).alias("dot"), F.round(F.get(V.normalized(e), F.lit(0)), 6).alias("first"))


@query("op110_risk_score", f"{WITH_RISK} SELECT span_id, round(s_inc, 6) AS s_inc, round(risk, 6) AS risk FROM risk")
def _(spark, d):
    return _r6(_risk(spark, d).select("span_id", "s_inc", "risk"), "s_inc", "risk")


@query("op111_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value / 100 - 1))), 6) AS p FROM events")
def _(spark, d):
    return FX.table(spark, d, "events").select("event_id", F.round(V.sigmoid(F.col("value") / 100 - 1), 6).alias("p"))


@query("op116_rounding", "SELECT event_type, round(avg(value), 4) AS r4, round(avg(value), 1) AS r1 FROM events GROUP BY event_type")
def _(spark, d):
    return FX.table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("r4"), F.round(F.avg("value"), 1).alias("r1"))


@query("op117_percent_format", f"{REC} SELECT variant, printf('%.1f%%', 100 * avg(is_unsafe)) AS shown FROM rec GROUP BY variant")
def _(spark, d):
    return FX.records(spark, d).groupBy("variant").agg(X.percent(F.avg("is_unsafe")).alias("shown"))


@query("op118_bounds", "SELECT p_size, round(exp(-1152 * pow(p_size / 500.0::DOUBLE, 2) / 2), 9) AS levy, round(sqrt(0.09::DOUBLE / p_size), 9) AS sd FROM part GROUP BY p_size")
def _(spark, d):
    sizes = FX.table(spark, d, "part").select("p_size").distinct()
    return sizes.select("p_size", F.round(C.levy_bound(1152, F.col("p_size") / F.lit(500.0)), 9).alias("levy"), F.round(C.beta_sd(0.1, F.col("p_size")), 9).alias("sd"))


@query("op119_array_functions", "SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS most, round(list_reverse_sort(embedding)[2]::DOUBLE, 6) AS second, len(embedding[1:10]) AS n FROM embeddings")
def _(spark, d):
    e = F.col("embedding")
    return FX.table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(e).cast("double"), 6).alias("most"), F.round(F.get(F.sort_array(e, False), F.lit(1)).cast("double"), 6).alias("second"), F.size(F.slice(e, 1, 10)).cast("long").alias("n"))


@query("op120_map_functions", "SELECT n_nationkey, 'A. ' || n_name || '/B. ' || n_regionkey AS rendered, CASE WHEN n_nationkey % 7 > n_regionkey THEN 'A' ELSE 'B' END AS best FROM nation")
def _(spark, d):
    m = F.create_map(F.lit("B"), F.col("n_regionkey").cast("string"), F.lit("A"), F.col("n_name"))
    shown = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    by_label = F.map_entries(F.create_map(F.lit("A"), (F.col("n_nationkey") % 7).cast("double"), F.lit("B"), F.col("n_regionkey").cast("double")))
    best = F.array_max(F.transform(by_label, lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]  # B on ties
    return FX.table(spark, d, "nation").select("n_nationkey", F.array_join(shown, "/").alias("rendered"), best.alias("best"))


@query("op121_json_optional_keys", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS lacking FROM events")
def _(spark, d):
    v = F.try_parse_json("props")
    return FX.table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").alias("lacking"))


@query("op082_progress_counters", f"WITH {records()} SELECT variant, transform, count(*) FILTER (judged_correct = 1) AS done, count(*) AS total, count(*) FILTER (judged_correct = 1)::DOUBLE / count(*) AS share FROM rec GROUP BY ALL")
def _(spark, d):
    return progress.counters(FX.records(spark, d), ["variant", "transform"], F.col("judged_correct") == 1)
