"""Row-level kinematics and lagged displacements and turning angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import AXES, angle, distance, non_zero, squared, track
from ..functions.pieces import Pieces, carried, dealt, numbered, piece, running


def kinematics(segments: DataFrame, dt: float, arrest_limit: float, pieces: Pieces | None = None) -> DataFrame:
    """Displacement, path, velocity and acceleration of each row, plain and filtered; one sort per object serves all.

    With ``pieces`` no window holds a whole track: a piece sees the two rows before it, and path and first point are
    carried over from the pieces before.
    """
    here = [F.col(c) for c in AXES]
    if pieces is None:
        w = track()
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        rows = segments.select("object_id", "time", *AXES, F.row_number().over(w).alias("seq"), _step(w), distance(here, [F.first(c).over(upto) for c in AXES]).alias("total_displacement"))
        rows = _speeds(rows.withColumn("path_length", F.sum("inst_displacement").over(upto)), w, dt, arrest_limit)
    else:
        w = piece()
        rows = dealt(numbered(segments, pieces), pieces, before=2)
        rows = _speeds(rows.withColumns({"inst_displacement": _step(w)}), w, dt, arrest_limit).where("own")
        rows = carried(rows, "inst_displacement", list(AXES))
        rows = rows.withColumns({"total_displacement": distance(here, [F.col("origin")[c] for c in AXES]), "path_length": F.col("sum_before") + running(F.col("inst_displacement"))})
    return rows.select("object_id", "time", *AXES, "seq", "inst_displacement", "total_displacement", "path_length", "velocity", "moving", "acceleration", "velocity_filtered", "acceleration_filtered")


def _step(w: WindowSpec) -> Column:
    return F.coalesce(distance([F.col(c) for c in AXES], [F.lag(c).over(w) for c in AXES]), F.lit(0.0)).alias("inst_displacement")


def _speeds(rows: DataFrame, w: WindowSpec, dt: float, arrest_limit: float) -> DataFrame:
    rows = rows.withColumns({"velocity": F.col("inst_displacement") / F.lit(float(dt)), "moving": F.col("inst_displacement") > F.lit(float(arrest_limit))})
    before = F.lag("velocity").over(w)
    return rows.withColumns({"acceleration": F.when(F.col("seq") >= 3, (F.col("velocity") - before) / F.lit(float(dt))).otherwise(0.0), "velocity_filtered": F.when(F.col("moving"), F.col("velocity")).otherwise(0.0), "acceleration_filtered": F.when(F.col("moving"), (F.col("velocity") - F.coalesce(before, F.col("velocity"))) / F.lit(float(dt))).otherwise(0.0)})


def in_order(segments: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """object_id, seq and position of each row."""
    if pieces is None:
        return segments.select("object_id", F.row_number().over(track()).alias("seq"), *AXES)
    return numbered(segments, pieces).select("object_id", "seq", "n", *AXES)


def _windows(rows: DataFrame, pieces: Pieces | None, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec]:
    """``rows`` for windows that reach so many rows back and ahead, and the window; rows that are not ``own`` only serve others."""
    if pieces is None:
        return rows.withColumn("own", F.lit(True)), Window.partitionBy("object_id").orderBy("seq")
    return dealt(rows, pieces, before, after), piece()


def lagged(segments: DataFrame, tau: int, pieces: Pieces | None = None) -> DataFrame:
    """object_id, seq, tau and the squared displacement since ``tau`` rows before, for 1 .. tau.

    Lags are taken from one window, over a track or over one of its ``pieces``: few are columns of it, many the list of
    the last ``tau`` positions, so that only the rows themselves are shuffled.
    """
    rows, w = _windows(in_order(segments, pieces), pieces, before=tau)
    if tau <= 20:
        each = [F.struct(F.lit(k).alias("tau"), squared([F.col(c) for c in AXES], [F.lag(c, k).over(w) for c in AXES]).alias("sq")) for k in range(1, tau + 1)]
        return rows.select("object_id", "seq", "own", F.array(*each).alias("all")).where("own").select("object_id", "seq", F.explode("all").alias("e")).select("object_id", "seq", "e.tau", "e.sq").where("sq is not null")
    last = rows.select("object_id", "seq", "own", *AXES, F.collect_list(F.struct(*AXES)).over(w.rowsBetween(-tau, -1)).alias("last")).where("own")
    back = last.select("object_id", "seq", *AXES, F.size("last").alias("n"), F.posexplode("last").alias("place", "p"))
    return back.select("object_id", "seq", (F.col("n") - F.col("place")).alias("tau"), squared([F.col(c) for c in AXES], [F.col("p")[c] for c in AXES]).alias("sq")).where("sq is not null")


def euclid_lags(segments: DataFrame, tau: int, pieces: Pieces | None = None) -> DataFrame:
    """Distance to the row ``tau`` before."""
    return lagged(segments, tau, pieces).select("object_id", "seq", "tau", F.sqrt("sq").alias("euclid"))


def turning_angles(segments: DataFrame, tau: int, pieces: Pieces | None = None) -> DataFrame:
    """Angle between the displacement over ``tau`` rows and the next one, at the row where the first begins."""
    rows, w = _windows(in_order(segments, pieces), pieces, after=2 * tau)
    if tau <= 20:
        each = []
        for k in range(1, tau + 1):
            u = [F.lead(c, k).over(w) - F.col(c) for c in AXES]
            v = [F.lead(c, 2 * k).over(w) - F.lead(c, k).over(w) for c in AXES]
            each.append(F.struct(F.lit(k).alias("tau"), *(a.alias(f"u{c}") for a, c in zip(u, AXES)), *(a.alias(f"v{c}") for a, c in zip(v, AXES))))
        moved = rows.select("object_id", "seq", "own", F.array(*each).alias("all")).where("own").select("object_id", "seq", F.explode("all").alias("e")).select("object_id", "seq", "e.*")
    else:
        ahead = rows.select("object_id", "seq", "own", *AXES, F.collect_list(F.struct(*AXES)).over(w.rowsBetween(1, 2 * tau)).alias("next")).where("own")
        lag = F.explode(F.sequence(F.lit(1), F.floor(F.size("next") / 2).cast("int"))).alias("tau")
        moved = ahead.where(F.size("next") > 1).select("object_id", "seq", *AXES, "next", lag)
        middle, end = F.get("next", F.col("tau") - 1), F.get("next", 2 * F.col("tau") - 1)
        moved = moved.select("object_id", "seq", "tau", *((middle[c] - F.col(c)).alias(f"u{c}") for c in AXES), *((end[c] - middle[c]).alias(f"v{c}") for c in AXES))
    turned = angle([F.col(f"u{c}") for c in AXES], [F.col(f"v{c}") for c in AXES])
    return moved.select("object_id", "seq", "tau", turned.alias("angle")).where("angle is not null")


def angle_medians(angles: DataFrame) -> DataFrame:
    return angles.groupBy("object_id", "tau").agg(F.median("angle").alias("median_angle"))


def max_angle(medians: DataFrame, median_of_medians: bool = False) -> DataFrame:
    """The greatest median angle over tau, or the median of the medians."""
    return medians.groupBy("object_id").agg((F.median if median_of_medians else F.max)("median_angle").alias("median_turning_angle"))


def euclid_medians(lags: DataFrame) -> DataFrame:
    """Median of the distances that are not 0, where there are at least three."""
    found = lags.groupBy("object_id", "tau").agg(F.count(non_zero(F.col("euclid"))).alias("n"), F.median(non_zero(F.col("euclid"))).alias("m"))
    return found.select("object_id", "tau", F.when(F.col("n") > 2, F.col("m")).alias("euclid_median")).where("euclid_median is not null")


def overall_euclid_median(medians: DataFrame) -> DataFrame:
    return medians.groupBy("object_id").agg(F.median("euclid_median").alias("overall_euclidean_median"))


def filled_taus(long: DataFrame, value: str) -> DataFrame:
    """Without the lags at which all values are null or 0, which have no column in the wide table."""
    used = long.groupBy("tau").agg(F.max(F.abs(value)).alias("m")).where("m > 0").select("tau")
    return long.join(F.broadcast(used), "tau", "left_semi")


def wide(long: DataFrame, value: str, taus: list[int], prefix: str) -> DataFrame:
    """One column per lag, for sinks."""
    return long.groupBy("object_id").pivot("tau", taus).agg(F.first(value)).select("object_id", *(F.col(str(k)).alias(f"{prefix}_{k}") for k in taus))
