"""Running sums and minima over long series, in parallel.

Rows are dealt out by ranges of (group, order) and sorted, each task runs over
its own range, and what a group brought along from the ranges before is added.
That is one value per range at most, since only the first group of a range can
have begun earlier, so it is broadcast whatever the number of rows.  One series
of any length takes as many tasks as there are ranges.

The sorted rows are saved once, so both passes see the same ranges.  The order must tell
rows of a group apart; rows that tie may come in any order.  Nulls do not change
a running value, which is null for a minimum, 0 for a sum, before the first other value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.sinks import saved

KINDS = {"sum": "long", "min": "double"}


def _changes(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Whether a row's group differs from the row before; false for the first."""
    n, out = batch.num_rows, np.zeros(batch.num_rows, bool)
    for name in by:
        here, before = batch[name].slice(1), batch[name].slice(0, n - 1)
        same = pc.or_(pc.equal(here, before).fill_null(False), pc.and_(pc.is_null(here), pc.is_null(before)))
        out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def _own_range(batches: Iterator[pa.RecordBatch], by: list[str], value: str, how: str) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted range with a running value of each group in column "run"."""
    group, carry = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _changes(batch, by).cumsum()
        given = batch[value].to_numpy(zero_copy_only=False)
        known = ~pd.isna(given)
        if how == "sum":
            x = pd.Series(np.where(known, given, 0).astype(np.int64)).groupby(at).cumsum().to_numpy(copy=True)
        else:
            x = pd.Series(np.where(known, given, np.inf).astype(float)).groupby(at).cummin().to_numpy(copy=True)
        ends = [tuple(batch[c][k].as_py() for c in by) for k in (0, -1)]
        if group == ends[0]:
            x[at == 0] = x[at == 0] + carry if how == "sum" else np.minimum(x[at == 0], carry)
        group, carry = ends[1], x[-1]
        run = pa.array(x) if how == "sum" else pa.array(x, mask=np.isinf(x))
        yield pa.RecordBatch.from_arrays([*batch.columns, run], names=[*batch.schema.names, "run"])


def running(df: DataFrame, order: list[str], value: str, out: str, how: str = "min", by: list[str] | None = None) -> DataFrame:
    """The rows with the running sum (of integers) or minimum of a column up to and with each row, in order within by."""
    by = by or []
    kind = KINDS[how]
    rows = df.withColumn(out, F.col(value).cast(kind))
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("range", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    stored = saved(dealt.mapInArrow(lambda batches: _own_range(batches, by, out, how), f"{fields}, run {kind}"))
    combine = F.sum if how == "sum" else F.min
    totals = stored.groupBy("range", *by).agg(combine(out).alias("total"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    carried = totals.withColumn("carry", combine("total").over(before)).where("carry is not null").select(
        F.col("range").alias("c_range"), *[F.col(b).alias(f"c_{b}") for b in by], "carry"
    )
    same = [F.col("range") == F.col("c_range"), *[F.col(b).eqNullSafe(F.col(f"c_{b}")) for b in by]]
    joined = stored.join(F.broadcast(carried), same, "left")  # at most a row a range
    total = F.col("run") + F.coalesce("carry", F.lit(0)) if how == "sum" else F.least("run", "carry")
    return joined.select(*df.columns, total.alias(out))


def numbered(df: DataFrame, order: list[str], out: str = "index", by: list[str] | None = None) -> DataFrame:
    """The rows with their 0-based place in the order, without gaps, within by."""
    counted = running(df.withColumn("one_row", F.lit(1)), order, "one_row", out, "sum", by)
    return counted.withColumn(out, F.col(out) - 1).drop("one_row")
