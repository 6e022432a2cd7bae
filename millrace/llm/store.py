"""Size-checked broadcasts and running sums over tables in the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

from millrace.session import stash

#: Bytes of a table that is sent to every executor.
BROADCAST_BYTES = 16 << 20


def _bytes(field: StructField):
    """The bytes that a value of a column takes."""
    if isinstance(field.dataType, ArrayType):
        return F.coalesce(F.size(field.name) * 8, F.lit(0)) + 16
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a stashed table if its rows take no more than limit bytes, 32 for each and what its
    columns hold; beyond, the join shuffles both sides."""
    size = df.agg(F.sum(sum((_bytes(f) for f in df.schema.fields), F.lit(32)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def own(name: str) -> str:
    """A column name of the operators, which no table has."""
    return f"__millrace_{name}"


def prefix_sums(df: DataFrame, value: str, out: str, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of value over the rows before each, in this order, for each group of the columns by, which
    hold no nulls. Neither the table nor a group of any size is in one task: rows are summed in ranges, and the
    sums of ranges, a row for each that a group is in, carry on from one to the next. Rows must not be equal in order.
    """
    part, ahead = own("range"), own("ahead")
    ranged = stash(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(part, *by).agg(F.sum(value).alias(ahead))
    earlier = F.sum(ahead).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(part, *by, F.coalesce(earlier, F.lit(0)).alias(ahead))
    running = F.sum(value).over(Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(totals, [part, *by]).withColumn(out, F.col(ahead) + F.coalesce(running, F.lit(0))).drop(part, ahead)


def replacing(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add: a clashing input column is replaced."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])
