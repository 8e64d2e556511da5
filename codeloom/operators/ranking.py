"""Row numbers of a whole order, without one task per group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import stored


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of every row in its group, by ``order``.

    The rows are range-partitioned and sorted on (group, order), so a group of any size is
    spread over many tasks; a row's place is its place in its partition plus what the
    partitions before hold of the group.  Only counts by group and partition meet in a
    window.  Nulls come first; rows which are equal in all named columns are numbered in any
    order.  The rows are stored with their numbers, which a repeated task cannot change.
    """
    row, part, tie = f"_{name}_row", f"_{name}_part", f"_{name}_tie"
    placed = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*group, *order, tie).drop(tie)
    placed = stored(placed.withColumn(row, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(row, 33))
    owner = [F.col(c).alias(f"_of_{c}") for c in group]
    counts = placed.groupBy(*owner, F.col(part).alias("_at")).agg(F.count("*").alias("n"), F.min(row).alias("first"))
    whole = [f"_of_{c}" for c in group] or [F.lit(0)]
    before = Window.partitionBy(*whole).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    offsets = stored(counts.withColumn("_offset", offset).drop("n", "first"))
    same = [F.col(f"_of_{c}").eqNullSafe(F.col(c)) for c in group]
    met = placed.join(offsets, reduce(and_, same, F.col(part) == F.col("_at")))
    return met.withColumn(name, F.col(row) + F.col("_offset")).select(*df.columns, name)
