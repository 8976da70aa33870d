"""Places of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place_in_group(rows: DataFrame, group: str, part: Column, order: list[str], total: str | None = None) -> DataFrame:
    """Adds ``place``, a row's number from 1 within its group, by ``part`` and then ``order``; null groups and parts are groups and parts too, nulls last.

    A part is a value that grows with the order (an hour, a range of ids), so a group is cut into many parts and none is
    sorted as a whole. Parts are counted, those before each are added up over one row a part, and rows are numbered within
    theirs. With ``total``, the sum of that column over all rows up to each is added as ``total``. Also adds ``part``.
    """
    held = rows.withColumn("part", part)
    summed = [F.count("*").alias("_n")] + ([F.sum(total).alias("_sum")] if total else [])
    earlier = Window.partitionBy("_group").orderBy(F.col("_part").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(F.col(group).alias("_group"), F.col("part").alias("_part")).agg(*summed)
    before = sizes.select("_group", "_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_sum")[: len(summed)]))
    within = Window.partitionBy(group, "part").orderBy(*(F.col(c).asc_nulls_last() for c in order))
    numbered = held.withColumn("_at", F.row_number().over(within))
    if total:
        numbered = numbered.withColumn("_run", F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.join(before, F.col(group).eqNullSafe(F.col("_group")) & F.col("part").eqNullSafe(F.col("_part")))
    made = [(F.col("_n") + F.col("_at")).alias("place")] + ([(F.col("_sum") + F.col("_run")).alias("total")] if total else [])
    return joined.select(*rows.columns, "part", *made)
