"""Ranges of an order, for sums and ranks over all rows that no single task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, MOST = 500_000, 512


def range_of(df: DataFrame, column: str, rows: int = ROWS) -> Column:
    """The number of a row's range in the order of a column; ranges hold about so many rows, equal values one range.

    The edges are approximate quantiles, at most MOST of them; what they are does not change a sum or a rank.
    """
    n = df.count()
    parts = min(MOST, -(-n // rows))
    if parts < 2:
        return F.lit(0)
    edges = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10 * parts).alias("e")).first()["e"]
    held = F.array(*[F.lit(e) for e in sorted(set(edges or []))])
    return F.size(F.filter(held, lambda e: e < F.col(column)))


def sums_before(df: DataFrame, column: str, value: str, out: str, rows: int = ROWS) -> DataFrame:
    """df with the sum of value over the rows before each in the order of a column that has no equal values: ranges are
    summed, the few sums are accumulated, and a window runs within each range."""
    ranged = df.withColumn("_range", range_of(df, column, rows))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most MOST rows
    bases = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.col("_within")).drop("_range", "_base", "_within")


def average_ranks(df: DataFrame, column: str, out: str, rows: int = ROWS) -> DataFrame:
    """df with the average rank of each row's value, from 1; nulls have none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = sums_before(counts, "_v", "_n", "_before", rows).select("_v", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def ranks_within(df: DataFrame, by: str, digest: str, key: str, out: str) -> DataFrame:
    """df with the place of each row in its group, from 1, in the order of a hexadecimal digest and, of equal ones, a key.

    A group is ranked in 4096 ranges of the digest, so that a large one is no single task.
    """
    ranged = df.withColumn("_range", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = ranged.groupBy(by, "_range").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(by, "_range").orderBy(digest, key))
    joined = ranged.withColumn("_within", within).join(bases, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(out, F.col("_base") + F.col("_within")).drop("_range", "_by", "_r", "_base", "_within")
