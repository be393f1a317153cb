"""Physical order within origins, without one task for an origin.

The rows of an origin are dealt by ranges of RANGE_BYTES of their start offset. What a row needs of
the rows before it is found within its range, and what a range needs of the ranges before it is
carried by one small row for each range: its last row's end, and its count. Only these small rows
meet by origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BYTES = 1 << 22
NO_START = -(2**63)


def range_of(start: Column, range_bytes: int = RANGE_BYTES) -> Column:
    """Number of the range of a start offset; rows without one come before all others."""
    return F.coalesce(F.floor(start / range_bytes).cast("long"), F.lit(NO_START))


def ordered(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """rows with `previous_end`, the end of the row before in the origin (by start, then end; NULL
    for the first), and `place`, from 1. A NULL identity counts as an empty one. The window and
    the join share one shuffle of the rows."""
    keys = ["__s", "__o", "__range"]
    cut = rows.withColumns({"__s": F.coalesce("source_id", F.lit("")), "__o": F.coalesce("origin_id", F.lit("")), "__range": range_of(F.col("start_offset"), range_bytes)})
    has = F.col("start_offset").isNotNull().alias("has")
    ends = cut.groupBy(*keys).agg(F.max(F.struct(has, "start_offset", "end_offset"))["end_offset"].alias("end"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__s", "__o").orderBy("__range")
    carried = ends.select(*keys, F.lag("end").over(before).alias("__end"), (F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    within = Window.partitionBy(*keys).orderBy("start_offset", "end_offset")
    out = cut.withColumns({"__place": F.row_number().over(within), "__lag": F.lag("end_offset").over(within)}).join(carried, keys)
    previous = F.when(F.col("__place") == 1, F.col("__end")).otherwise(F.col("__lag"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], previous.alias("previous_end"), (F.col("__before") + F.col("__place")).alias("place"))
