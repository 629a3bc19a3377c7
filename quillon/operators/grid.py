"""The work grid: every sample by variant and transform, with its conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRANSFORMS = ("clean", "resize", "jpeg", "crop", "rerender", "blur")
POSITIONS = ("bottom_right", "top_right", "center")
CONDITIONS = ("visible", "bounded", "paraphrase", "adaptive", "gcg")


def check_transforms(names) -> None:
    odd = sorted(set(names) - set(TRANSFORMS))
    if odd:
        raise ValueError(f"unknown transforms: {odd}")


def cyclic(values, index: Column) -> Column:
    """values[index modulo their number]."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(index, F.lit(len(values))).cast("int"))


def condition(kind: Column) -> Column:
    """Known conditions as they are, anything else is the first."""
    return F.when(kind.isin(*CONDITIONS), kind).otherwise(F.lit(CONDITIONS[0]))


def expand(
    samples: DataFrame, transforms=TRANSFORMS, base: bool = True, attacked: bool = True, defended: bool = True,
    control: bool = True, positions=POSITIONS,
) -> DataFrame:
    """samples (with 0-based index) -> base once, and each other variant once per transform.

    One explode of literals, no join and no shuffle.
    """
    check_transforms(transforms)
    on = {"attacked": attacked, "defended_attack": defended, "defended_control": control}
    cells = [("base", "clean")] * base + [(v, t) for t in transforms for v, use in on.items() if use]
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(t).alias("transform")) for v, t in cells])
    placed = F.when(F.col("variant").isin("attacked", "defended_attack"), cyclic(positions, F.col("index")))
    return (
        samples.withColumn("cell", F.explode(rows)).select("*", "cell.variant", "cell.transform").drop("cell")
        .withColumn("attack_position", placed)
    )


def synthetic(spark: SparkSession, n: int, **dimensions) -> DataFrame:
    """n generated samples with cyclic dimensions."""
    df = spark.range(n).withColumnRenamed("id", "index")
    return df.select("index", F.format_string("sample_%05d", "index").alias("sample_id"), *[cyclic(v, F.col("index")).alias(k) for k, v in dimensions.items()])


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A seeded order of the rows, the same on every run."""
    from quillon.operators.calibrate import hash_key

    return df.withColumn("shuffle_key", hash_key(seed, F.col(key))).orderBy("shuffle_key", key)


#: Rows wanted in a slice of the hash range, and the most slices.
SLICE_ROWS, MOST_SLICES = 50_000, 65_536


def numbered(df: DataFrame, key: str, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds place, the 0-based position of a row in its seeded order.

    Rows are ranked within slices of the hash range, and the sizes of the
    slices before are added, so no task sorts the whole table.
    """
    from quillon.operators.calibrate import hash_key

    slices = max(1, min(MOST_SLICES, -(-df.count() // slice_rows)))
    keyed = df.withColumn("shuffle_key", hash_key(seed, F.col(key)))
    keyed = keyed.withColumn("slice", F.expr(f"shuffle_key * {slices}L div 4294967296L"))
    sizes = keyed.groupBy("slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("slice").orderBy("shuffle_key", key)
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1)
    return (
        ranked.join(F.broadcast(starts), "slice")  # at most MOST_SLICES rows
        .withColumn("place", (F.col("place") + F.col("begin")).cast("long"))
        .drop("slice", "begin", "shuffle_key")
    )
