"""Row numbers and running sums in large groups: a group is cut into buckets in order, so that no task sorts a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sums_before(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], amount: Column, before: str, total: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its group that stand before it, and over the whole group.

    ``bucket`` must rise with ``order``. Sums of buckets (groups x buckets, few) are added up first; then each bucket
    is ordered by itself.
    """
    rows = df.withColumns({"__bucket": bucket, "__amount": amount})
    group = Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum("__amount").alias("__sum"))
    upto = F.sum("__sum").over(group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")
    names = [*keys, "__bucket"]
    sums = sums.select(*(F.col(k).alias(f"__of_{i}") for i, k in enumerate(names)), upto.alias("__offset"), F.sum("__sum").over(group).alias(total))
    joined = rows.join(sums, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(names))))
    earlier = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.col("__offset") + F.coalesce(F.sum("__amount").over(earlier), F.lit(0))
    return joined.select(*df.columns, found.alias(before), total)
