"""Rows with the last row of another table before them.

Both tables are put in one order, in slices: within a slice a window carries the last row of the other table, and from
slice to slice what each of them ends with is carried by a window over the slices alone. So a key with a third of all rows
is worked on in as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str], slice: Column, value: Column, out: str) -> DataFrame:
    """``left`` with ``out``: the ``value`` of the last row of ``right`` that is equal in ``by`` and not after it in ``order``, or null.

    Both tables have the columns of ``by`` and ``order``. ``slice`` is made of them and must not fall as ``order`` rises.
    Without ``by`` all rows are of one key, and the slices, one row each, are carried over in one task. Nulls are equal in
    ``by``, and come first in ``order``. Of several rows of ``right`` at one place any one counts.
    """
    keys = [F.col(c).alias(f"by_{k}") for k, c in enumerate(by)]
    names = [f"by_{k}" for k in range(len(by))]
    place = [slice.alias("slice"), F.struct(*[F.col(c).alias(f"o_{k}") for k, c in enumerate(order)]).alias("place")]
    row = F.struct(*[F.col(c) for c in left.columns])
    ours = left.select(*keys, *place, F.lit(1).alias("side"), row.alias("row"))
    theirs = right.select(*keys, *place, F.lit(0).alias("side"), F.struct(value.alias("value")).alias("found"))
    rows = ours.withColumn("found", F.lit(None).cast(theirs.schema["found"].dataType)).unionByName(theirs.withColumn("row", F.lit(None).cast(ours.schema["row"].dataType)))

    within = Window.partitionBy(*names, "slice").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("found", F.last("found", ignorenulls=True).over(within)).where("side = 1")
    # What slices end with; those of left rows alone are there too, to be handed what earlier ones ended with.
    ends = ours.select(*names, "slice").distinct().withColumn("own", F.lit(None).cast(theirs.schema["found"].dataType))
    ends = ends.unionByName(theirs.groupBy(*names, "slice").agg(F.max_by("found", "place").alias("own")))
    earlier = Window.partitionBy(*names).orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("own", ignorenulls=True).over(earlier)).where("carried IS NOT NULL")
    ends = ends.groupBy(*names, "slice").agg(F.first("carried").alias("carried")).select(*[F.col(c).alias(f"of_{c}") for c in names], F.col("slice").alias("of_slice"), "carried")
    same = F.col("slice").eqNullSafe(F.col("of_slice"))
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    met = inside.join(ends, same, "left")
    return met.select("row.*", F.coalesce("found", "carried")["value"].alias(out))
