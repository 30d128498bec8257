"""Cleaning of tracks: averages of equal times, interpolation, gaps, categories and parameters found in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AXES, track
from ..functions.pieces import Pieces, dealt, numbered, piece


class EmptyTracksError(ValueError):
    """No track is left after formatting."""


def _gaps(times: DataFrame, pieces: Pieces | None) -> DataFrame:
    """object_id and ``gap``, each row's time since the one before; null for the first."""
    gap = F.col("time") - F.lag("time").over(track() if pieces is None else piece())
    if pieces is None:
        return times.select("object_id", gap.alias("gap"))
    return dealt(numbered(times, pieces), pieces, before=1).select("object_id", "own", gap.alias("gap")).where("own").select("object_id", "gap")


def intervals(segments: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """Differences of consecutive distinct times per object, to six digits."""
    times = segments.select("object_id", "time").distinct()
    return _gaps(times, pieces).select("object_id", F.round("gap", 6).alias("dt")).where("dt is not null")


def detect_dt(segments: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """The most frequent interval, of equally frequent ones the least."""
    return intervals(segments, pieces).groupBy("dt").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dt").limit(1).select("dt")


def detect_tau(segments: DataFrame) -> DataFrame:
    """The most distinct times of any object."""
    return segments.groupBy("object_id").agg(F.count_distinct("time").alias("n")).agg(F.max("n").alias("tau"))


def average_duplicates(segments: DataFrame) -> DataFrame:
    """One row per object and time, with mean coordinates."""
    return segments.groupBy("object_id", "time").agg(*(F.avg(c).alias(c) for c in AXES))


def interpolate(segments: DataFrame, dt: float, pieces: Pieces | None = None) -> DataFrame:
    """Each object on the grid from its first time by ``dt``, linear between samples and constant beyond them.

    Of rows with one time the last stays (by coordinates, as a table has no order). The samples around a grid time
    come from one window over samples and grid together; with ``pieces`` over those of a span of time, to which the
    nearest samples of the spans before and after are carried.
    """
    last = segments.groupBy("object_id", "time").agg(F.max(F.struct(*AXES)).alias("p"))
    ends = last.groupBy("object_id").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    steps = F.ceil((F.col("last") + F.lit(dt / 2) - F.col("first")) / F.lit(dt)).cast("int")
    grid = ends.select("object_id", "first", F.explode(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1)).alias("i")).select("object_id", (F.col("first") + F.col("i") * F.lit(float(dt))).alias("time"))
    sample = F.struct(F.col("time").alias("t"), *(F.col(f"p.{c}").alias(c) for c in AXES))
    both = last.select("object_id", "time", sample.alias("s"), F.lit(False).alias("grid")).unionByName(grid.select("object_id", "time", F.lit(None).cast("struct<t:double,x:double,y:double,z:double>").alias("s"), F.lit(True).alias("grid")))
    keys = ["object_id"]
    if pieces is not None:
        both, keys = _beside(both, pieces.span), ["object_id", "span"]
    w = Window.partitionBy(*keys).orderBy("time")
    before = F.last("s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("s", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    if pieces is not None:
        before, after = F.coalesce(before, "s_before"), F.coalesce(after, "s_after")
    around = both.select("object_id", "time", "grid", before.alias("a"), after.alias("b")).where("grid")

    def at(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        share = F.try_divide(F.col("time") - F.col("a.t"), F.col("b.t") - F.col("a.t"))
        return F.when(F.col("b").isNull(), a).when(F.col("a").isNull(), b).otherwise(a + (b - a) * F.coalesce(share, F.lit(0.0)))

    return around.select("object_id", "time", *(at(c).alias(c) for c in AXES))


def _beside(rows: DataFrame, span: float) -> DataFrame:
    """``rows`` with their ``span`` of time, and the last sample of the spans before, ``s_before``, and the first of those after, ``s_after``."""
    rows = rows.withColumn("span", F.floor(F.col("time") / F.lit(float(span))))
    is_sample = F.col("s").isNotNull()
    spans = rows.groupBy("object_id", "span").agg(F.min_by("s", F.when(is_sample, F.col("time"))).alias("low"), F.max_by("s", F.when(is_sample, F.col("time"))).alias("high"))
    order = Window.partitionBy("object_id").orderBy("span")
    earlier = F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.join(spans.select("object_id", "span", earlier.alias("s_before"), later.alias("s_after")), ["object_id", "span"])


def drop_gapped(segments: DataFrame, dt: float, pieces: Pieces | None = None) -> DataFrame:
    """Objects of one row, or whose consecutive times all differ by ``dt``, within a relative 1e-5 and an absolute 1e-8."""
    near = F.abs(F.col("gap") - F.lit(dt)) <= F.lit(1e-8 + 1e-5 * abs(dt))
    kept = _gaps(segments.select("object_id", "time"), pieces).select("object_id", near.alias("near")).groupBy("object_id").agg(F.bool_and(F.coalesce("near", F.lit(True))).alias("ok")).where("ok")
    return segments.join(kept, "object_id", "left_semi")


def removed_objects(before: DataFrame, after: DataFrame, reason: str = "Gaps") -> DataFrame:
    """The objects that are gone, and why."""
    return before.select("object_id").distinct().join(after.select("object_id").distinct(), "object_id", "left_anti").withColumn("reason", F.lit(reason))


def require_tracks(segments: DataFrame) -> DataFrame:
    """``segments``, or an error where it has no rows."""
    if segments.isEmpty():
        raise EmptyTracksError("no objects are left after formatting; check dt, or turn interpolation on")
    return segments


def default_category(segments: DataFrame) -> DataFrame:
    """Category '0' for every object."""
    return segments.select("object_id").distinct().withColumn("category", F.lit("0"))


def surviving_categories(categories: DataFrame, segments: DataFrame) -> DataFrame:
    return categories.join(segments.select("object_id").distinct(), "object_id", "left_semi")


def is_flat(segments: DataFrame) -> DataFrame:
    """One row: whether all z are 0."""
    return segments.agg((F.coalesce(F.max(F.abs("z")), F.lit(0.0)) == 0).alias("two_dimensional"))
