"""Progress counters: what a running query has done, told beside its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and counters that Spark fills while an action reads them (rows, if none is named)."""
    seen = Observation(name)
    wanted = counters or {"rows": F.count(F.lit(1))}
    return df.observe(seen, *[c.alias(k) for k, c in wanted.items()]), seen


def counters(df: DataFrame, by: list[str], done: Column) -> DataFrame:
    """Rows done, all rows and the share done, by group; a group without rows does not appear."""
    finished = F.count_if(F.coalesce(done, F.lit(False)))
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        finished.alias("done"), total.alias("total"), (finished.cast("double") / total).alias("share")
    )
