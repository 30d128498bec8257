"""One row of features per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.columns import AXES, angle, middle, non_zero, ratio, squared
from . import kinematics as kin
from . import msd as m

STATISTICS = tuple(f"{s}_{q}" for q in ("velocity", "acceleration", "absolute_acceleration") for s in ("mean", "median", "stdev"))


def _geometry_sums(arrest_limit: float) -> list[Column]:
    return [
        F.count("*").alias("n"),
        (F.max(F.when(F.col("seq") == 2, F.col("time"))) - F.max(F.when(F.col("seq") == 1, F.col("time")))).alias("step"),
        F.max("path_length").alias("path_length"),
        F.max_by("total_displacement", "seq").alias("final_euclidean"),
        F.max("total_displacement").alias("max_euclidean"),
        F.count_if((F.col("inst_displacement") != 0) & (F.col("inst_displacement") < arrest_limit)).alias("slow"),
    ]


def _geometry_columns() -> dict[str, Column]:
    step = F.coalesce(F.abs("step"), F.lit(0.0))
    duration = F.col("n") * step
    return {
        "duration": duration, "path_length": F.col("path_length"), "final_euclidean": F.col("final_euclidean"), "max_euclidean": F.col("max_euclidean"),
        "displacement_ratio": ratio(F.col("final_euclidean"), F.col("max_euclidean")),
        "outreach_ratio": ratio(F.col("max_euclidean"), F.col("path_length")),
        "straightness": ratio(F.col("final_euclidean"), F.col("path_length")) * F.sqrt(duration),
        "arrest_coefficient": ratio(F.col("slow") * step, duration),
    }


def geometry(rows: DataFrame, arrest_limit: float) -> DataFrame:
    """Duration, lengths and ratios of each object from its kinematics."""
    found = rows.groupBy("object_id").agg(*_geometry_sums(arrest_limit))
    return found.select("object_id", "n", *(c.alias(k) for k, c in _geometry_columns().items()))


def _statistics_sums(arrest_limit: float) -> list[Column]:
    """Of velocity and accelerations that aren't 0: mean, deviation and the values themselves, which are put in order once a group."""
    if arrest_limit == 0:
        later = F.col("seq") >= 2
        v, a = non_zero(F.when(later, F.col("velocity"))), non_zero(F.when(later, F.col("acceleration")))
    else:
        v, a = non_zero(F.col("velocity_filtered")), non_zero(F.col("acceleration_filtered"))
    named = (("velocity", v), ("acceleration", a), ("absolute_acceleration", F.abs(a)))
    return [f(c).alias(f"{p}_{n}") for n, c in named for p, f in (("mean", F.avg), ("stdev", F.stddev_samp))] + [F.collect_list(v).alias("velocities"), F.collect_list(a).alias("accelerations")]


def _statistics_columns(arrest_limit: float, moving: int) -> dict[str, Column]:
    lists = {"velocity": F.col("velocities"), "acceleration": F.col("accelerations"), "absolute_acceleration": F.transform("accelerations", F.abs)}
    value = lambda s: middle(F.sort_array(lists[s[7:]])) if s.startswith("median_") else F.col(s)
    enough = F.size("accelerations") >= moving if arrest_limit else F.lit(True)
    return {s: F.when(F.col("n") >= moving, F.when(enough, F.coalesce(value(s), F.lit(0.0))).otherwise(0.0)) for s in STATISTICS}


def statistics(rows: DataFrame, arrest_limit: float, moving: int) -> DataFrame:
    """The nine statistics of velocity and acceleration; null for objects of fewer than ``moving`` rows."""
    found = rows.groupBy("object_id").agg(F.count("*").alias("n"), *_statistics_sums(arrest_limit))
    return found.select("object_id", *(c.alias(k) for k, c in _statistics_columns(arrest_limit, moving).items()))


def _of_lags(tracks: DataFrame, tau: int, median_of_angles: bool) -> DataFrame:
    """``tracks``, whose positions in order are arrays x, y and z, with median distance, greatest MSD and turning angle over the lags.

    The same as ``kinematics.euclid_medians``, ``msd.msd`` and ``kinematics.angle_medians`` tell from rows, without a row
    for a point and lag: a lag's values are put in order in the object's own row.
    """
    n = F.size(AXES[0])
    at = lambda i: [F.get(c, i) for c in AXES]
    lags = lambda most: F.when(most >= 1, F.sequence(F.lit(1), F.least(F.lit(tau), most))).otherwise(F.array().cast("array<int>"))
    ordered = lambda values, kept: F.sort_array(F.filter(values, kept))

    def turned(k: Column) -> Column:
        def moved(i: Column) -> Column:
            a, b, c = at(i), at(i + k), at(i + 2 * k)
            return F.struct(*((q - p).alias(f"u{x}") for x, p, q in zip(AXES, a, b)), *((q - p).alias(f"v{x}") for x, p, q in zip(AXES, b, c)))

        each = F.transform(F.sequence(F.lit(0), n - 1 - 2 * k), moved)
        return F.transform(each, lambda e: angle([e[f"u{x}"] for x in AXES], [e[f"v{x}"] for x in AXES]))

    out = tracks.withColumns({
        "squares": F.transform(lags(n - 1), lambda k: ordered(F.transform(F.sequence(k, n - 1), lambda i: squared(at(i), at(i - k))), lambda s: s > 0)),
        "angles": F.transform(lags(F.floor((n - 1) / 2).cast("int")), lambda k: ordered(turned(k), F.isnotnull)),
    })
    known = lambda values: F.filter(values, F.isnotnull)
    out = out.withColumns({
        "medians": known(F.transform("squares", lambda s: F.when(F.size(s) > 2, middle(s, F.sqrt)))),
        "angles": known(F.transform("angles", lambda a: middle(a))),
        "maximum_msd": F.array_max(F.transform("squares", lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, b: a + b) / F.size(s)))),
    })
    return out.withColumns({"overall_euclidean_median": middle(F.sort_array("medians")), "median_turning_angle": middle(F.sort_array("angles")) if median_of_angles else F.array_max("angles")}).drop("squares", "angles", "medians")


def _whole_tracks(segments: DataFrame, cfg: RunConfig) -> DataFrame:
    """Everything from one pass over the rows of kinematics: sums and ordered positions of an object meet where its rows are."""
    rows = kin.kinematics(segments.where("object_id is not null"), cfg.dt, cfg.arrest_limit)
    track = F.collect_list(F.struct("seq", *AXES)).alias("track")
    found = rows.groupBy("object_id").agg(*_geometry_sums(cfg.arrest_limit), *_statistics_sums(cfg.arrest_limit), track)
    # Made by a function, so that the optimizer does not take the axes apart anew for each use of them.
    found = found.withColumn("track", F.sort_array("track")).withColumns({c: F.transform("track", lambda p: p[c]) for c in AXES})  # noqa: B023
    found = found.select("object_id", *(c.alias(k) for k, c in (_geometry_columns() | _statistics_columns(cfg.arrest_limit, cfg.moving)).items()), *AXES)
    return _of_lags(found, cfg.tau, cfg.median_of_angles).drop(*AXES)


def _tracks_in_pieces(segments: DataFrame, cfg: RunConfig, curves: DataFrame | None) -> DataFrame:
    pieces = cfg.pieces
    rows = kin.kinematics(segments, cfg.dt, cfg.arrest_limit, pieces)
    curves = m.msd(segments, cfg.tau, pieces) if curves is None else curves
    out = geometry(rows, cfg.arrest_limit).join(statistics(rows, cfg.arrest_limit, cfg.moving), "object_id")
    out = out.join(kin.overall_euclid_median(kin.euclid_medians(kin.euclid_lags(segments, cfg.tau, pieces))), "object_id", "left")
    out = out.join(kin.max_angle(kin.angle_medians(kin.turning_angles(segments, cfg.tau, pieces)), cfg.median_of_angles), "object_id", "left")
    return out.join(m.max_msd(curves), "object_id", "left")


def presented(summary: DataFrame) -> DataFrame:
    """For display: 0 becomes blank, except that an arrest coefficient is 0 where it would be blank."""
    numbers = [f.name for f in summary.schema.fields if f.dataType.typeName() in ("double", "long", "integer") and f.name != "object_id"]
    shown = summary.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in numbers})
    return shown.withColumn("arrest_coefficient", F.coalesce("arrest_coefficient", F.lit(0.0))) if "arrest_coefficient" in numbers else shown


def summarize(segments: DataFrame, categories: DataFrame, cfg: RunConfig, hull: DataFrame | None = None, helicity: DataFrame | None = None, curves: DataFrame | None = None) -> DataFrame:
    """All features; objects without a category are 'Unknown'. Whole tracks take one pass; ``curves`` serve tracks in pieces."""
    out = _tracks_in_pieces(segments, cfg, curves) if cfg.pieces else _whole_tracks(segments, cfg)
    extra = []
    for table in (hull, helicity):
        if table is not None:
            out = out.join(table, "object_id", "left")
            extra.append([c for c in table.columns if c != "object_id"])
    out = out.join(categories, "object_id", "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))
    volume = extra.pop(0) if hull is not None else []
    arrest = ["arrest_coefficient"] if cfg.arrest_limit else []
    turning = extra.pop(0) if helicity is not None else []
    return out.select("object_id", "category", "duration", "path_length", "final_euclidean", "max_euclidean", "overall_euclidean_median", "maximum_msd", *volume, "displacement_ratio", "outreach_ratio", "straightness", "median_turning_angle", *arrest, *STATISTICS, *turning)


def far_enough(summary: DataFrame, least: float) -> DataFrame:
    """Objects whose greatest distance from the start is at least ``least``; 0 turns the filter off."""
    return summary.where(F.col("max_euclidean") >= least) if least > 0 else summary


def restricted(table: DataFrame, summary: DataFrame) -> DataFrame:
    """``table`` of the objects that are still in ``summary``."""
    return table.join(summary.select("object_id"), "object_id", "left_semi")
