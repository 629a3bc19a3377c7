"""Operators over whole tables against brute force."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillon.llm import mixing, sharding, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """[(doc_id, fp)] -> Counter of (doc_id, fp, component)"""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in rows:
        least[find(f)] += [d] if d is not None else []
    return Counter((d, f"{f:016x}", min(least[find(f)], default=None)) for d, f in rows)


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_simhash(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("limits", [(2048, 1 << 19), (16, 1 << 19), (64, 100), (16, 100)])
def test_links_of_dense_and_sparse_groups(spark, limits):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 400)}
    core = int(rng.integers(0, 1 << 63))
    for _ in range(1500):  # a dense group and chains that leave it
        x = core
        for b in rng.integers(0, 64, int(rng.integers(0, 9))):
            x ^= 1 << int(b)
        fps.add(x)
    rows = [(i, simhash.signed(f)) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    found = {r.fp: r.keep_doc for r in simhash.component_map(df, *limits).collect()}
    want = {f: c for _, f, c in plain_components([(i, f & (2**64 - 1)) for i, f in rows])}
    assert {f"{f & (2**64 - 1):016x}": c for f, c in found.items()} == want


@pytest.mark.parametrize("leaf", [1, 8])
def test_bk_tree_finds_all_within_the_radius(leaf):
    rng = np.random.default_rng(5)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.arange(600, dtype=np.uint64)]))
    queries = np.array([0, 77, values[100], values[2000] ^ np.uint64(5)], dtype=np.uint64)
    tree = simhash.BkTree.loads(simhash.BkTree(values, leaf).dumps())
    assert sorted(tree.values) == sorted(values)
    got = Counter((int(q), int(tree.values[v])) for qs, vs in tree.search(queries) for q, v in zip(qs, vs))
    want = Counter((i, int(v)) for i, q in enumerate(queries) for v in values if (int(v) ^ int(q)).bit_count() <= 3)
    assert got == want
    for node in range(len(tree.low)):  # children are keyed by the distance to the pivot
        for c in range(tree.first[node], tree.last[node]):
            below = tree.values[tree.low[c] : tree.high[c]]
            assert (np.bitwise_count(below ^ tree.values[tree.low[node]]) == tree.key[c]).all()
    assert list(simhash.BkTree(values[:0]).search(queries)) == []


def test_bk_tree_prunes_on_real_fingerprints():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    fps = np.unique(np.array([simhash.fingerprint(t) for t in texts], np.uint64))
    tree, links = simhash.BkTree(fps), set()
    for q, v in tree.search(fps):
        links |= {(int(fps[a]), int(tree.values[b])) for a, b in zip(q, v) if fps[a] != tree.values[b]}
    want = set()
    for i in range(0, len(fps), 512):
        a, b = np.nonzero(np.bitwise_count(fps[i : i + 512, None] ^ fps) <= 3)
        want |= {(int(fps[i + x]), int(fps[y])) for x, y in zip(a, b) if i + x != y}
    assert links == want and links
    # edges were followed at every query, and more were left than taken
    assert tree.followed > 50 * len(fps) and tree.pruned > tree.followed


def test_groups_beyond_the_broadcast_lose_nothing(spark):
    rng = np.random.default_rng(7)
    a = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    b = [x ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for x, (i, j, k) in zip(a, rng.integers(0, 64, (300, 3)))]
    df = spark.createDataFrame([(simhash.signed(x),) for x in a + b], "fp long")
    for bits in (1, 5, 16):
        groups = defaultdict(set)
        for r in simhash.members(df, 600, bits, 8).collect():
            groups[r.fp].add((r.quarter, r.value))
        assert all(groups[simhash.signed(x)] & groups[simhash.signed(y)] for x, y in zip(a, b))
    assert simhash.group_bits(1 << 19, 1 << 15, 1 << 19) == 0 and simhash.group_bits(1 << 20, 1 << 15, 1 << 19) == 5
    assert simhash.group_bits(1 << 40, 1 << 15, 1 << 19) == 16


def test_components_with_a_hub(spark):
    rows = [(i, 0) for i in range(1, 3000)] + [(5000 + i, 5000 + i - 1) for i in range(1, 40)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(3000)} | {5000 + i: 5000 for i in range(40)}


def test_keep_one(edge, docs, none):
    for df in (docs, edge):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
        groups = defaultdict(set)
        for d, f, c in plain_components(rows):
            groups[(c, f) if c is None else c].add(f)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        out = kept.collect()
        comp = {(d, f): c for d, f, c in plain_components(rows)}
        roots = [comp[(r.doc_id, f"{plain_fingerprint(r.text):016x}")] for r in out]
        assert len(roots) == len(set(roots)) == len(set(comp.values()))
        assert all(r.doc_id == c for r, c in zip(out, roots))
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_sharding(edge, docs, none):
    for df in (docs, edge):
        rows = sharding.assign(df).collect()
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
        counts = Counter(r.shard for r in rows)
        assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts[s] for s in range(16)) <= 1
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    big = sharding.assign(docs).collect()
    for source, n in Counter(r.source for r in big).items():
        per = Counter(r.shard for r in big if r.source == source)
        assert all(abs(per[s] - n / 16) <= 2 for s in range(16))
    assert sharding.assign(none).count() == 0


def test_sharding_buckets_agree(docs, monkeypatch):
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs).collect()}
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs).collect()} == one


def test_sharding_spreads_rows_without_and_with_repeated_ids(spark, monkeypatch):
    """20,000 texts under no id and as many under one: no bucket of the hash has more than a few hundred."""
    seen = []
    ranked = sharding._ranked

    def noted(rows, by, bucket, *rest):
        seen.append(max(r["count"] for r in rows.groupBy(*by, bucket).count().collect()))
        return ranked(rows, by, bucket, *rest)

    monkeypatch.setattr(sharding, "_ranked", noted)
    rows = [(None, f"text {i}", "a") for i in range(20_000)] + [(5, f"other {i}", "b") for i in range(20_000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.groupBy("shard").count().select("count").distinct().count() == 1
    assert max(seen) <= 4 * sharding.BUCKET_ROWS


def test_sharding_with_a_hot_source_and_odd_names(spark):
    rows = [(i, "x" * (i % 7), "hot" if i % 2 else None if i % 3 else "\x00") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.assign(df).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, _, s in rows)
    for source in ("hot", None, "\x00"):
        per = Counter(r.shard for r in got if r.source == source)
        n = sum(per.values())
        assert all(abs(per[s] - n / 16) <= 2 for s in range(16))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sharding.assign(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(source#\d+, ", plan) and not re.search(r"SortMergeJoin \[(no_source#\d+, )?name#\d+\]", plan)


def test_store(spark, tmp_path, monkeypatch):
    from quillon.llm import store

    with store.scratch(spark):
        df = store.saved(spark.range(10))
        folder = store._SCRATCH[-1][0].removeprefix("file:")
        assert df.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder) and not store._SCRATCH

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.ready(Session())


def plain_rake(cells, rules):
    total = sum(cells.values())
    w = {k: t * rules.budget for k, t in cells.items()}
    for _ in range(rules.rounds):
        for i, axis in enumerate(mixing.AXES):
            own = defaultdict(float)
            for k, t in cells.items():
                own[k[i]] += t
            raw = {v: (rules.targets[axis].get(v, 0.0) if axis in rules.targets else t ** rules.power[axis] if t else 0.0) for v, t in own.items()}
            have = defaultdict(float)
            for k, x in w.items():
                have[k[i]] += x
            for k in w:
                goal = raw[k[i]] / sum(raw.values()) * total * rules.budget if sum(raw.values()) else 0
                w[k] = min(cells[k], w[k] * goal / have[k[i]] if have[k[i]] else 0.0)
    return {k: w[k] / t if t else 1.0 for k, t in cells.items()}


@pytest.mark.parametrize("targets", [{}, {"lang": {"en": 0.5, "fr": 0.5}}])
def test_mixing(edge, docs, targets):
    rules = mixing.MixRules(targets=targets)
    for df in (docs, edge):
        rows = mixing.mix(df, rules).collect()
        assert len(rows) == df.count()
        cells = defaultdict(int)
        for r in rows:
            cells[(r.source, r.lang, r.topic)] += r.n_tokens
        p = plain_rake(cells, rules)
        assert all(r.p == pytest.approx(p[(r.source, r.lang, r.topic)], abs=1e-5) for r in rows)
        picked = Counter(r.doc_id for r in rows if r.selected)
        out = mixing.sample(df, rules)
        assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == picked
    tokens = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert all(r.n_tokens == tokens[r.doc_id] for r in mixing.mix(docs).collect())


def test_mixing_reaches_the_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = mixing.MixRules()
    rows = mixing.mix(df, rules).collect()
    total = sum(r.n_tokens for r in rows)
    for axis in mixing.AXES:
        tokens, got = Counter(), Counter()
        for r in rows:
            tokens[r[axis]] += r.n_tokens
            got[r[axis]] += r.n_tokens * r.p
        raw = {v: t ** rules.power[axis] for v, t in tokens.items()}
        for v, x in raw.items():
            assert got[v] == pytest.approx(x / sum(raw.values()) * rules.budget * total, rel=1e-4)
    found = mixing.residuals(df, rules).collect()
    assert {r.axis for r in found} == set(mixing.AXES)
    assert all(abs(r.target - r.got) <= 1e-9 * r.target for r in found)


def test_mixing_goes_on_where_sources_and_languages_are_tied(spark):
    """Cells far from independent need more than a few rounds."""
    rows = [(i, "w " * (1 + (50 if i % 2 == i // 2 % 2 else 1) * (i % 5)), f"l{i // 2 % 2}", f"s{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.48, "s1": 0.52}, "lang": {"l0": 0.49, "l1": 0.51}}
    rules = mixing.MixRules(targets=targets, budget=0.3)
    found = {(r.axis, r.value): r for r in mixing.residuals(df, rules).collect()}
    assert all(abs(r.target - r.got) <= 1e-6 * r.target for r in found.values())
    few = mixing.residuals(df, mixing.MixRules(targets=targets, budget=0.3, rounds=2)).collect()
    assert max(abs(r.target - r.got) / r.target for r in few) > 1e-6


def test_mixing_by_a_topic_column(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", "s", ("a", "b", None)[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    rules = mixing.MixRules(topic_column="subject", targets={"topic": {"a": 0.6, "b": 0.4}}, budget=0.3)
    found = {r.value: r for r in mixing.residuals(df, rules).collect() if r.axis == "topic"}
    assert set(found) == {"a", "b", None} and found[None].got == 0
    assert all(r.got == pytest.approx(r.target, rel=1e-9) for r in found.values())
    assert {r.topic for r in mixing.mix(df, rules).where("selected").collect()} == {"a", "b"}


def test_mixing_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0


def test_mixing_with_many_cells_is_the_same(docs, monkeypatch):
    rules = mixing.MixRules(rounds=3)
    few = {r.doc_id: r.p for r in mixing.mix(docs, rules).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(mixing, "HOT_SHARE", 8)  # some cells are hot, some are not
    many = {r.doc_id: r.p for r in mixing.mix(docs, rules).collect()}
    assert few.keys() == many.keys() and all(few[d] == pytest.approx(many[d], abs=2e-6) for d in few)
