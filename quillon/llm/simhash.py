"""SimHash near-duplicates: 64-bit fingerprints, broadcast BK-trees, components.

Fingerprints are distinct-ed first and dealt by hash into shards of about
``TREE_VALUES`` values.  Each shard becomes one BK-tree: the children of a node
are keyed by the integer Hamming distance to its pivot, and a search follows
only edges whose key is within the radius of the distance to the pivot.  Up to
``BROADCAST_VALUES`` fingerprints, all trees together have a known size and are
broadcast; blocks of fingerprints stream past them, each against the trees
of its own shard and of those before it, so every pair is met once.

Beyond that, searching every tree would grow with the square of the corpus.
Two fingerprints that differ in at most three bits agree in one quarter of
their bits, so each goes to one group for each quarter, by its first bits; the
trees are those of shards of a group and travel by shuffle to the query blocks
of that group.  No link is lost either way, and nothing is capped.

What a block finds in a tree is reduced to a spanning forest where it is found.
The forests are joined to components by alternating large and small stars,
saved each round.  A value has at most 43,744 others within three bits, so a
dense group costs no more than that for each of its values.

Defined cases: a null text has no words; texts without words have fingerprint
zero and link like any other; long texts are hashed piece by piece.  Null
doc_ids take part in links but never name a component unless it has no other
id.  Repeated rows give repeated rows.  Ties do not arise: a component is named
by its smallest doc_id.  An empty table gives no rows.  Of the input's columns
only doc_id and text are read, whatever the others are called.
"""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.rowmap import map_rows, text_column
from quillon.llm.store import saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
RADIUS = 3
#: Values of a node that is searched without children.
LEAF = 8
#: Values of a shard's tree (about 20 bytes each), and of a block of queries.
TREE_VALUES = 1 << 15
QUERY_VALUES = 1 << 10
#: All trees are broadcast up to so many values: about 10 MB.
BROADCAST_VALUES = 1 << 19
#: Quarters of a fingerprint, one of which two linked ones share.
QUARTERS = 4
HOT_SHARE = 1000
#: Shingles hashed at a time, so that a long text needs little memory.
PIECE = 1 << 16
#: Pairs of query and node that a search holds at a time.
FRONTIER = 1 << 18


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of the 3-word shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER)
    words = [w.encode() for w in WORD.findall(words.decode())]
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(shingles), PIECE):
        h = np.array([digest(s, SEED) for s in shingles[k : k + PIECE]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(shingles), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def make():
        return lambda ids, texts: [ids, [signed(fingerprint(t)) for t in texts]]

    return map_rows(docs, [docs["doc_id"].cast("long"), text_column(docs)], "doc_id long, fp long", make)


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + count[0] - 1, begin[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


class BkTree:
    """A BK-tree over distinct unsigned 64-bit values, in flat arrays, searched for many queries at once.

    Node k owns values[low[k]:high[k]].  With children (first[k] < last[k]), the
    first of them is its pivot, and child c holds those at distance key[c] from
    it; without, all of them are compared.  ``followed`` and ``pruned`` count
    the child edges that searches took and left.
    """

    def __init__(self, values: np.ndarray, leaf: int = LEAF):
        values = np.array(values, np.uint64)
        low, high, key = np.array([0]), np.array([len(values)]), np.array([0])
        levels, made = [], 1
        while len(low):
            inner = high - low > leaf
            begin, count = low[inner] + 1, (high - low)[inner] - 1
            at, owner = _ragged(begin, count), np.repeat(np.arange(len(begin)), count)
            d = np.bitwise_count(values[at] ^ values[begin - 1][owner]).astype(np.int64)
            order = np.lexsort((d, owner))
            values[at], owner, d = values[at[order]], owner[order], d[order]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (d[1:] != d[:-1])])) if len(d) else np.empty(0, int)
            kids = np.bincount(owner[new], minlength=len(begin)) if len(d) else np.empty(0, int)
            first, last = np.zeros(len(low), int), np.zeros(len(low), int)
            last[inner] = made + np.cumsum(kids)
            first[inner] = last[inner] - kids
            levels.append((low, high, key, first, last))
            made += len(new)
            ends = np.append(new[1:], len(d))
            low, high, key = at[new], at[ends - 1] + 1 if len(new) else at[new], d[new]
        self.values = values
        self.low, self.high, self.key, self.first, self.last = (np.concatenate(x) for x in zip(*levels))
        self._prepare()

    def _prepare(self) -> None:
        inner = np.flatnonzero(self.last > self.first)
        #: For a node with children and a distance, the first child whose key is not below it.
        self.table = np.empty((len(inner), 66), np.int32)
        self.row = np.full(len(self.low), -1, np.int32)
        self.row[inner] = np.arange(len(inner))
        parent = np.repeat(inner, (self.last - self.first)[inner])  # of node 1, 2, ...
        self.table[:] = 1 + np.searchsorted(parent * 128 + self.key[1:], inner[:, None] * 128 + np.arange(66))
        self.followed = self.pruned = 0

    def dumps(self) -> bytes:
        sizes = np.array([len(self.values), len(self.low)], np.int64)
        rest = np.stack([self.low, self.high, self.first, self.last, self.key]).astype(np.int32)
        return sizes.tobytes() + self.values.tobytes() + rest.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> BkTree:
        tree = cls.__new__(cls)
        n, nodes = np.frombuffer(data, np.int64, 2)
        tree.values = np.frombuffer(data, np.uint64, n, 16)
        rest = np.frombuffer(data, np.int32, 5 * nodes, 16 + 8 * n).reshape(5, nodes)
        tree.low, tree.high, tree.first, tree.last, tree.key = rest.astype(np.int64)
        tree._prepare()
        return tree

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of queries, numbers of values) within the radius, in pieces."""
        if not len(self.values):
            return
        todo = [(np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            row = self.row[node]
            flat = row < 0
            if flat.any():
                begin, count = self.low[node[flat]], (self.high - self.low)[node[flat]]
                at, own = _ragged(begin, count), np.repeat(q[flat], count)
                near = np.bitwise_count(queries[own] ^ self.values[at]) <= radius
                if near.any():
                    yield own[near], at[near]
                q, node, row = q[~flat], node[~flat], row[~flat]
            if not len(q):
                continue
            pivot = self.low[node]
            d = np.bitwise_count(queries[q] ^ self.values[pivot]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], pivot[near]
            begin = self.table[row, np.maximum(d - radius, 0)].astype(np.int64)
            count = self.table[row, np.minimum(d + radius + 1, 65)] - begin
            took = int(count.sum())
            self.followed += took
            self.pruned += int((self.last - self.first)[node].sum()) - took
            if took:
                todo.append((np.repeat(q, count), _ragged(begin, count)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) of the components that the links (a, b) of signed values make."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    below = label < np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def found_edges(tree: BkTree, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the queries and the values of a tree."""
    a = b = np.empty(0, np.int64)
    for q, v in tree.search(queries, radius):
        x, y = queries[q].view(np.int64), tree.values[v].view(np.int64)
        other = x != y
        a, b = np.concatenate([a, x[other]]), np.concatenate([b, y[other]])
        if len(a) > FRONTIER:
            a, b = forest(a, b)
    return forest(a, b)


def group_bits(n: int, tree_values: int, broadcast_values: int) -> int:
    """Bits of a quarter that name a group; none while all trees can be broadcast."""
    return 0 if n <= broadcast_values else min(64 // QUARTERS, max(1, math.ceil(math.log2(n / tree_values))))


def members(distinct: DataFrame, n: int, bits: int, tree_values: int = TREE_VALUES) -> DataFrame:
    """(fp, quarter, value, parts, part): each fingerprint in its groups, of which the large have several shards."""
    if bits == 0:
        grouped = distinct.selectExpr("fp", "0 as quarter", "0 as value", f"{max(1, -(-n // tree_values))} as parts")
    else:
        width = 64 // QUARTERS
        keys = [
            f"named_struct('quarter', {k}, 'value', cast(shiftrightunsigned(fp, {k * width}) & {(1 << bits) - 1}L as int))"
            for k in range(QUARTERS)
        ]
        keyed = distinct.select("fp", F.expr(f"inline(array({', '.join(keys)}))"))
        sizes = keyed.groupBy("quarter", "value").agg(F.expr(f"cast(ceil(count(*) / {tree_values}) as int)").alias("parts"))
        grouped = keyed.join(F.broadcast(sizes), ["quarter", "value"])  # at most 4 * 2^16 rows
    return grouped.withColumn("part", F.expr("cast(pmod(xxhash64(fp, 1), parts) as int)"))


def trees(dealt: DataFrame) -> DataFrame:
    """(quarter, value, parts, part, tree): the BK-tree of each shard."""
    shards = dealt.groupBy("quarter", "value", "parts", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps"))

    def build(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                values = one.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                tree = BkTree(np.random.default_rng(SEED).permutation(values))
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([tree.dumps()], pa.binary())], names=[*one.schema.names[:4], "tree"])

    return shards.mapInArrow(build, "quarter int, value int, parts int, part int, tree binary")


def links(
    distinct: DataFrame, n: int, tree_values: int = TREE_VALUES, broadcast_values: int = BROADCAST_VALUES
) -> DataFrame:
    """Edges (a, b) with b < a that connect all fingerprints within the radius, as forests of (block, tree) pairs."""
    bits = group_bits(n, tree_values, broadcast_values)
    dealt = members(distinct, n, bits, tree_values)
    group = ["quarter", "value"]
    block = F.expr(f"cast(pmod(xxhash64(fp, 2), {max(1, tree_values // QUERY_VALUES)}) as int)").alias("block")
    queries = dealt.groupBy(*group, "parts", "part", block).agg(F.collect_list("fp").alias("fps"))
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, n // QUERY_VALUES + 1)
    if bits == 0:  # all trees at most broadcast_values * 20 bytes
        kept = F.broadcast(saved(trees(dealt)).withColumnRenamed("part", "i").drop("parts"))
        queries = queries.repartition(tasks, *group, "part", "block").withColumn("i", F.explode(F.expr("sequence(0, part)")))
        met = queries.join(kept, [*group, "i"])
    else:
        queries = queries.withColumn("i", F.explode(F.expr("sequence(0, part)")))
        sent = trees(dealt).withColumn("j", F.explode(F.expr("sequence(part, parts - 1)"))).withColumnRenamed("part", "i").drop("parts")
        met = queries.withColumnRenamed("part", "j").join(sent, [*group, "i", "j"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches):
        held: OrderedDict = OrderedDict()  # the last trees; a tree is about 1 MB
        for batch in batches:
            for row in range(batch.num_rows):
                *key, fps, data = batch.slice(row, 1).columns
                key = tuple(x[0].as_py() for x in key)
                tree = held.pop(key, None) or BkTree.loads(data[0].as_py())
                held[key] = tree
                if len(held) > 16:
                    held.popitem(last=False)
                found = found_edges(tree, fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    return met.select(*group, "i", "fps", "tree").mapInArrow(search, "a long, b long").distinct()


def _with_hot(rows: DataFrame, by_key: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """rows joined with by_key, which has one row a key and the count of its rows.

    Keys of more than one in HOT_SHARE of the n rows are fewer than HOT_SHARE;
    they are broadcast, so no task gets all rows of such a key.
    """
    least = max(n // HOT_SHARE, 1000)
    hot = F.broadcast(by_key.where(F.col(count) > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(by_key.where(F.col(count) <= least), key)
    return rows.join(hot, key).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component."""
    edges, before = saved(edges), None
    while True:
        mark = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if mark == before:
            break
        before = mark
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.expr("least(u, min(v))").alias("m"), F.count("*").alias("k"))
        large = _with_hot(both, least, "u", "k", 2 * mark[0]).where("v > u and v != m").select(F.col("v").alias("u"), "m").distinct()
        large = saved(large)
        least = large.groupBy("u").agg(F.min("m").alias("m2"), F.count("*").alias("k"))
        small = (
            _with_hot(large, least, "u", "k", 2 * mark[0])
            .selectExpr("inline(array(named_struct('a', u, 'b', m2), named_struct('a', m, 'b', m2)))")
            .where("a != b")
            .distinct()
        )
        edges = saved(small)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root"), F.col("root")).distinct())


def component_map(
    prints: DataFrame, tree_values: int = TREE_VALUES, broadcast_values: int = BROADCAST_VALUES
) -> DataFrame:
    """(fp, keep_doc, keep_fp, n_docs): for each fingerprint, the smallest document of its component."""
    by_fp = saved(
        prints.groupBy("fp").agg(
            F.expr("min(struct(doc_id is null as no_id, doc_id, fp))").alias("best"), F.count("*").alias("n_docs")
        )
    )
    n = by_fp.count()
    linked = saved(components(links(by_fp.select("fp"), n, tree_values, broadcast_values)))
    best = (
        linked.join(by_fp, F.col("node") == F.col("fp"))
        .groupBy("root")
        .agg(F.min("best").alias("least"), F.count("*").alias("k"))
    )
    of = _with_hot(linked, best, "root", "k", n).select(F.col("node").alias("fp"), "least")
    return by_fp.join(of, "fp", "left").selectExpr(
        "fp", "coalesce(least, best).doc_id as keep_doc", "coalesce(least, best).fp as keep_fp", "n_docs"
    )


def near_duplicates(
    docs: DataFrame, tree_values: int = TREE_VALUES, broadcast_values: int = BROADCAST_VALUES
) -> DataFrame:
    """One row per document: fingerprint and component."""
    prints = saved(fingerprints(docs))
    found = saved(component_map(prints, tree_values, broadcast_values).select("fp", "keep_doc", "n_docs"))
    return _with_hot(prints, found, "fp", "n_docs", prints.count()).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("keep_doc").alias("component_id"),
    )


def keep_one(docs: DataFrame, tree_values: int = TREE_VALUES, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    A doc_id that several rows have, and components without any doc_id, keep
    one row each; only the rows of these ids take a second path, where they exist.
    """
    prints = saved(fingerprints(docs))
    keep = component_map(prints, tree_values, broadcast_values).select("keep_doc", "keep_fp").distinct()
    rows = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    named = keep.join(rows, F.col("keep_doc") == F.col("doc_id")).selectExpr("keep_doc", "keep_fp", "n > 1 as odd")
    keep = saved(named.unionByName(keep.where("keep_doc is null").withColumn("odd", F.lit(True))))
    ids = keep.where("not odd").select(F.col("keep_doc").alias("doc_id"))
    plain = docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")
    odd = keep.where("odd").select("keep_doc", "keep_fp")
    return plain if odd.isEmpty() else plain.unionByName(_keep_with_prints(docs, odd))


def _keep_with_prints(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """For ids that several rows have, or none: one row of each kept (doc_id, fp), found with the fingerprint beside the row.

    Rows without an id are told apart by their fingerprints alone, so they do not meet in one task.
    """
    mark = F.pandas_udf(lambda texts: texts.map(lambda t: signed(fingerprint(t))), "long")
    ids = keep.where("keep_doc is not null").select("keep_doc").distinct()
    own = docs.join(ids, docs["doc_id"].cast("long") == ids["keep_doc"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    own = own.select(F.struct(*[own[c] for c in docs.columns]).alias("row"), mark(text_column(own)).alias("fp"))
    own = own.join(
        keep, (own["fp"] == keep["keep_fp"]) & own["row.doc_id"].cast("long").eqNullSafe(keep["keep_doc"]), "left_semi"
    )
    text = F.to_json("row")
    return (
        own.groupBy(F.col("row.doc_id").alias("k1"), F.col("fp").alias("k2"))
        .agg(F.min_by("row", text).alias("row"))
        .select("row.*")
    )
