"""The filter audit against its SQL twin and against filters applied one after another."""

import os
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from quillon.llm import interaction, oracles, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int, text string"


def failures(rows):
    """[(doc_id, text, lang)] -> the set of letters that each row fails."""
    least = defaultdict(list)
    for d, t, _ in rows:
        least[t or ""] += [] if d is None else [d]
    out = []
    for d, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > min(least[t]),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    fails, out = failures(rows), Counter()
    for part in {lang or "" for _, _, lang in rows}:
        members = [(d, f) for (d, _, lang), f in zip(rows, fails) if (lang or "") == part]
        table = {}
        for order in permutations("ABCDE"):
            left = members
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                earlier = sum(x in f for _, f in members) - len(gone)
                left = [m for m in left if x not in m[1]]
                lost = [sum(d in marked for d, _ in gone) for marked in (good, toxic)]
                table["".join(order), step, x] = [len(left), len(gone), earlier, sum(f == {x} for _, f in members), *lost]
        shapley = Counter()
        for (_, _, x), v in table.items():
            shapley[x] += v[1]
        for (order, step, x), v in table.items():
            out[part, order, step, *v, shapley[x]] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_edge_rows_and_clashing_columns(spark, edge):
    rows = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    rows += [(20 + i, "A " * 120 if i % 2 else None, None) for i in range(9)] + [(3, "", "en"), (None, "", "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (22, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, n int, part string")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], LABELS)
    assert got(interaction.audit(docs, marks)) == plain_audit(rows, labels)


def test_empty_tables(spark, none, edge):
    marks = spark.createDataFrame([], LABELS)
    assert interaction.audit(none, marks).count() == 0
    assert {r.good_lost + r.toxic_lost for r in interaction.audit(edge, marks).collect()} == {0}


def test_a_third_of_the_rows_are_copies(spark):
    """Copies under ids of their own, under one id and under none: counted right, and no task joins them by text alone."""
    rows = [(i, "same text", "en") for i in range(300)] + [(7, f"text {i}", "en") for i in range(300)] + [(None, f"t {i % 5}", None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = [(i, i % 2, i % 3) for i in range(300)]
    assert got(interaction.audit(docs, spark.createDataFrame([(*m, "") for m in marks], LABELS))) == plain_audit(rows, marks)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in ("documents", "labels"):
        path = f"{sf_dir}/{f}.parquet"
        con.execute(f"create view {f} as select * from '{path}{'/**/*.parquet' if os.path.isdir(path) else ''}'")
    want = Counter(con.execute(f"select {', '.join(COLUMNS)} from ({oracles.oracle_sql()['op12_filter_interaction']})").fetchall())
    assert got(queries.op12_filter_interaction(spark, sf_dir)) == want


@pytest.mark.parametrize("names", ["A", "ABC", "ABCDE"])
def test_matrices(names):
    columns, of = interaction.outcomes(names)
    size = 1 << len(names)
    assert all(m.shape == (size, len(columns)) and m.dtype.kind == "i" for m in of.values())
    for at, (order, step) in enumerate(columns):
        own = names.index(order[step - 1])
        before = of["kept"][:, at - 1] if step > 1 else 1
        assert (of["kept"][:, at] + of["removed"][:, at] == before).all()
        fails = [mask >> own & 1 for mask in range(size)]
        assert (of["removed"][:, at] + of["redundant"][:, at] == fails).all()
