"""Long tracks in pieces: windows over a bounded number of consecutive rows, with the neighbouring rows that they reach for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pieces:
    """A piece has ``rows`` rows. They are numbered by spans of ``span`` units of time, which should hold about as many."""

    rows: int
    span: float

    def __post_init__(self) -> None:
        if self.rows < 1 or self.span <= 0:
            raise ValueError("a piece has at least one row, and a span is longer than 0")


def piece() -> WindowSpec:
    """The rows of a piece in order, those before and after it included."""
    return Window.partitionBy("object_id", "piece").orderBy("seq")


def numbered(segments: DataFrame, how: Pieces) -> DataFrame:
    """``segments`` with each row's number ``seq`` in its track, the track's rows ``n``, and its first and last time, ``begin`` and ``end``.

    Each span is ordered by itself; counts of spans (tracks x spans, few) tell how many rows stand before it. Rows of
    one object and time are in any order. Without object_id or time a row is in no track, and goes.
    """
    rows = segments.where(F.col("object_id").isNotNull() & F.col("time").isNotNull()).withColumn("span", F.floor(F.col("time") / F.lit(float(how.span))))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("object_id", "span").orderBy("time")))
    whole = Window.partitionBy("object_id")
    spans = rows.groupBy("object_id", "span").agg(F.count("*").alias("rows"), F.min("time").alias("low"), F.max("time").alias("high"))
    upto = F.sum("rows").over(whole.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    spans = spans.select("object_id", "span", upto.alias("before"), F.sum("rows").over(whole).alias("n"), F.min("low").over(whole).alias("begin"), F.max("high").over(whole).alias("end"))
    return rows.join(spans, ["object_id", "span"]).select(*segments.columns, (F.col("before") + F.col("place")).alias("seq"), "n", "begin", "end")


def dealt(rows: DataFrame, how: Pieces, before: int = 0, after: int = 0) -> DataFrame:
    """``rows`` dealt by ``seq`` into pieces; ``own`` is false for those that only stand ``before`` or ``after`` a piece's own.

    Such a row is there once more for each piece that reaches for it, so there are (before + after) / rows times more.
    """
    of = lambda seq: F.floor((seq - 1) / F.lit(how.rows))
    seq = F.col("seq")
    last = of(F.least(seq + before, F.col("n")))
    return rows.withColumn("piece", F.explode(F.sequence(of(F.greatest(seq - after, F.lit(1))), last))).withColumn("own", F.col("piece") == of(seq))


def carried(rows: DataFrame, amount: str, first: list[str]) -> DataFrame:
    """``rows``, each in its own piece only, with the sum of ``amount`` over the pieces before, and ``origin``, the track's first row's columns ``first``."""
    pieces = rows.groupBy("object_id", "piece").agg(F.sum(amount).alias("sum"), F.min_by(F.struct(*first), "seq").alias("head"))
    order = Window.partitionBy("object_id").orderBy("piece")
    earlier = F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(pieces.select("object_id", "piece", F.coalesce(earlier, F.lit(0.0)).alias("sum_before"), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("origin")), ["object_id", "piece"])


def running(amount: Column) -> Column:
    """The sum of ``amount`` over a piece's rows up to this one."""
    return F.sum(amount).over(piece().rowsBetween(Window.unboundedPreceding, 0))
