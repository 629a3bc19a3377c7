"""Exact similarity to large banks of reference vectors, by ball trees.

A node is a ball around its vectors: no inner product with a query can be above that with the centre plus the radius times the
query's length.  Queries go down the tree in batches; those whose best so far is above a node's bound leave it out.  Nothing
is approximated: values are those of comparing all pairs.

The bank is taken in blocks of a bounded number of vectors, each a broadcast tree that the queries stream past, so nothing that is
broadcast grows with the bank.  Null vectors have a null similarity, as has every query against an empty bank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of the bank that are broadcast at once, and of a leaf.
BLOCK, LEAF = 65_536, 32
#: Added to bounds, so that rounding never drops the best.
SLACK = 1e-9


@dataclass
class BallTree:
    """Vectors in the order of the leaves; nodes as ranges of them with centre, radius and children (-1 for leaves)."""

    vectors: np.ndarray
    begin: list[int]
    end: list[int]
    centre: np.ndarray
    radius: np.ndarray
    left: list[int]
    right: list[int]

    @classmethod
    def of(cls, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order, begin, end, centre, radius, left, right = np.arange(len(vectors)), [], [], [], [], [], []

        def add(a: int, b: int) -> int:
            own, node = vectors[order[a:b]], len(begin)
            middle = own.mean(axis=0)
            away = np.sqrt(((own - middle) ** 2).sum(axis=1))
            begin.append(a), end.append(b), centre.append(middle), radius.append(float(away.max())), left.append(-1), right.append(-1)
            return node

        open_ = [add(0, len(vectors))]
        while open_:  # halves along the line between two far vectors
            node = open_.pop()
            a, b = begin[node], end[node]
            if b - a <= leaf or radius[node] == 0:
                continue
            own = vectors[order[a:b]]
            far = own[((own - centre[node]) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            place = np.argsort(own @ (other - far), kind="stable")
            order[a:b] = order[a:b][place]
            left[node], right[node] = add(a, (a + b) // 2), add((a + b) // 2, b)
            open_ += [left[node], right[node]]
        return cls(vectors[order], begin, end, np.array(centre), np.array(radius), left, right)

    def best(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the largest inner product with any vector, and the number of vectors it was compared with."""
        long = np.sqrt((queries * queries).sum(axis=1))
        best, compared = np.full(len(queries), -np.inf), np.zeros(len(queries), np.int64)
        todo = [(0, np.arange(len(queries)), queries @ self.centre[0] + long * self.radius[0])]
        while todo:
            node, own, bound = todo.pop()
            own = own[bound + SLACK > best[own]]
            if not len(own):
                continue
            if self.left[node] < 0:
                block = self.vectors[self.begin[node] : self.end[node]]
                best[own] = np.maximum(best[own], (queries[own] @ block.T).max(axis=1))
                compared[own] += len(block)
                continue
            sides = []
            for child in (self.left[node], self.right[node]):
                sides.append((child, own, queries[own] @ self.centre[child] + long[own] * self.radius[child]))
            nearer = sides[0][2] >= sides[1][2]  # each query goes to its nearer side first
            far = [(sides[1][0], own[nearer], sides[1][2][nearer]), (sides[0][0], own[~nearer], sides[0][2][~nearer])]
            near = [(sides[0][0], own[nearer], sides[0][2][nearer]), (sides[1][0], own[~nearer], sides[1][2][~nearer])]
            todo += far + near
        return best, compared


def score(spans: DataFrame, bank: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(span_id, s_inst, n_compared, n_bank): the largest similarity to the bank and how many of its vectors were compared."""
    spark = spans.sparkSession
    known = bank.where(F.col("embedding").isNotNull())
    n = known.count()
    parts = max(1, -(-n // block))
    place = F.pmod(F.xxhash64("rid"), F.lit(parts))
    kind = spans.schema["span_id"].dataType.simpleString()
    out = None
    for k in range(parts):
        vectors = known.where(place == k).select("embedding").toArrow()["embedding"]  # about ``block`` vectors
        held = np.array(vectors.to_pylist(), np.float64)
        tree = spark.sparkContext.broadcast(BallTree.of(held, leaf) if len(held) else None)

        def run(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = batch["embedding"].is_valid().to_numpy(zero_copy_only=False)
                best, compared = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, np.int64)
                if tree.value is not None and given.any():
                    found = tree.value.best(np.array([v for v in batch["embedding"].to_pylist() if v is not None], np.float64))
                    best[given], compared[given] = found
                yield pa.RecordBatch.from_arrays([batch["span_id"], pa.array(best, mask=np.isnan(best)), pa.array(compared)], names=["span_id", "s_inst", "n_compared"])

        scored = spans.select("span_id", "embedding").mapInArrow(run, f"span_id {kind}, s_inst double, n_compared bigint")
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("span_id").agg(F.max("s_inst").alias("s_inst"), F.sum("n_compared").alias("n_compared")).withColumn("n_bank", F.lit(n))
