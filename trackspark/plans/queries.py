"""The registered queries over the derived tracks, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AttractorConfig, MLConfig, RunConfig
from ..functions.pieces import Pieces
from ..operators import attractors, contacts, figures, formatting, helicity, kinematics, ml, msd, replicates, shape, stats
from ..operators import summary as features
from ..sources import adapters as src
from ..sources import generator, tables

TAU = 10
CFG = RunConfig(dt=1.0, tau=TAU, arrest_limit=60.0, moving=4)
CHAINS = AttractorConfig(distance_threshold=40.0, approach_ratio=0.5, min_proximity=10.0, time_persistence=4, max_gaps=2)
CONTACT = 5.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Named parts of the SQL; each may use the ones before it.
PARTS = dict(src.SQL)


def _sql(body: str) -> str:
    """``body`` after the parts that it needs."""
    needed: list[str] = []

    def tokens(text: str) -> list[str]:
        return text.replace("(", " ").replace(")", " ").replace(",", " ").split()

    def need(text: str, own: str = "") -> None:
        for name in PARTS:
            if name != own and name in tokens(text) and name not in needed:
                need(PARTS[name], name)
                if name not in needed:
                    needed.append(name)

    need(body)
    recursive = any(n in tokens(PARTS[n]) for n in needed)
    return ("with " + "recursive " * recursive + ", ".join(f"{n} as ({PARTS[n]})" for n in needed) + " " if needed else "") + body


def _round(c: str, digits: int) -> Column:
    """``F.round``, which goes by way of decimals only for numbers that are large or next to a tie."""
    scaled = F.col(c) * F.lit(10.0**digits)
    whole = F.rint(scaled)
    plain = (F.abs(F.col(c)) < 1e6) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Numbers as comparable between engines: rounded, and without a negative zero."""
    kinds = dict(df.dtypes)
    return df.select(*((_round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else (F.round(c, digits) + 0.0).alias(c) if kinds[c] == "float" else F.col(f"`{c}`").cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(f"`{c}`") for c in df.columns))


def _query(name: str, sql: str | None = None, digits: int = 6) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: rounded(f(spark, folder), digits)
        if sql is not None:
            ORACLES[name] = _sql(sql)
        return f

    return register


def r(*columns: str, digits: int = 6) -> str:
    """SQL that rounds columns under their own names; ``expression:name`` names an expression."""
    parts = [(c.rpartition(":")[0], c.rpartition(":")[2]) if ":" in c else (c, c) for c in columns]
    return ", ".join(f"round({e}, {digits}) + 0.0 as {n}" for e, n in parts)


# Sources --------------------------------------------------------------------------------------------------------------


def _typed_in(spark: SparkSession, d: str) -> DataFrame:
    """Rows as they stand in a file: text, some of it no number, under headers of another kind."""
    rows = src.day_points(spark, d)
    x = F.when(F.floor("x") % 7 == 0, F.lit("n/a")).otherwise(F.round("x", 3).cast("string"))
    return rows.select(F.col("object_id").cast("string").alias("Parent ID"), F.col("time").cast("string").alias("Frame"), x.alias("Position X"), F.round("y", 3).cast("string").alias("Coordinate Y"), F.lit("note").alias("comment"))


@_query("segments_scan", f"select object_id, {r('time')}, case when floor(x) % 7 <> 0 then round(round(x, 3), 6) + 0.0 end as x, {r('round(y, 3):y')}, 0.0::double as z from day_points")
def _(spark, d):
    return tables.segments(_typed_in(spark, d))


@_query("categories_scan", "select user_id as object_id, min(event_type)::varchar as category from events group by user_id")
def _(spark, d):
    return tables.categories(src.table(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("Type")))


# Formatting -----------------------------------------------------------------------------------------------------------


@_query("autodetect_dt", f"select {r('dt')} from (select object_id, round(time - lag(time) over (partition by object_id order by time), 6) as dt from (select distinct object_id, time from day_points)) where dt is not null group by dt order by count(*) desc, dt limit 1")
def _(spark, d):
    return formatting.detect_dt(src.day_points(spark, d))


@_query("autodetect_tau", "select max(n) as tau from (select count(distinct time) as n from day_points group by object_id)")
def _(spark, d):
    return formatting.detect_tau(src.day_points(spark, d))


@_query("multitrack", f"select object_id, {r('time', 'x', 'y', 'z')} from day_tracks")
def _(spark, d):
    return formatting.average_duplicates(src.day_points(spark, d))


PARTS["grid"] = "select object_id, t0 + unnest(range(greatest(ceil(t1 + 0.5 - t0)::bigint, 1))) * 1.0::double as time from (select object_id, min(time) as t0, max(time) as t1 from day_tracks group by object_id)"
PARTS["filled"] = "select g.object_id, g.time, " + ", ".join(f"case when b.time is null then a.{c} when a.time is null then b.{c} when b.time = a.time then a.{c} else a.{c} + (b.{c} - a.{c}) * ((g.time - a.time) / (b.time - a.time)) end as {c}" for c in "xyz") + " from grid g asof left join day_tracks a on g.object_id = a.object_id and g.time >= a.time asof left join day_tracks b on g.object_id = b.object_id and g.time <= b.time"


@_query("interpolate", f"select object_id, {r('time', 'x', 'y', 'z')} from filled")
def _(spark, d):
    return formatting.interpolate(src.day_tracks(spark, d), 1.0)


PARTS["gapless"] = "select object_id from (select object_id, abs(time - lag(time) over (partition by object_id order by time) - 1) <= 1e-8 + 1e-5 as near from day_tracks) group by object_id having coalesce(bool_and(near), true)"


@_query("drop_gapped", f"select object_id, {r('time', 'x', 'y', 'z')} from day_tracks where object_id in (select object_id from gapless )")
def _(spark, d):
    return formatting.drop_gapped(src.day_tracks(spark, d), 1.0)


@_query("removed_objects", "select distinct object_id, 'Gaps' as reason from day_tracks where object_id not in (select object_id from gapless )")
def _(spark, d):
    tracks = src.day_tracks(spark, d)
    return formatting.removed_objects(tracks, formatting.drop_gapped(tracks, 1.0))


@_query("default_category", "select distinct object_id, '0' as category from step_tracks")
def _(spark, d):
    return formatting.default_category(src.step_tracks(spark, d))


@_query("surviving_categories", "select object_id, category from user_categories where object_id in (select object_id from gapless )")
def _(spark, d):
    return formatting.surviving_categories(src.user_categories(spark, d), formatting.drop_gapped(src.day_tracks(spark, d), 1.0))


@_query("flat_detection", "select coalesce(max(abs(z)), 0) = 0 as two_dimensional from step_tracks")
def _(spark, d):
    return formatting.is_flat(src.step_tracks(spark, d))


# Kinematics -----------------------------------------------------------------------------------------------------------

PARTS["kin1"] = "select *, row_number() over w as seq, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2), 0) as inst_displacement, sqrt((x - first(x) over w) ** 2 + (y - first(y) over w) ** 2 + (z - first(z) over w) ** 2) as total_displacement from step_tracks window w as (partition by object_id order by time)"
PARTS["kin2"] = "select *, sum(inst_displacement) over w as path_length, inst_displacement / 1.0 as velocity, inst_displacement > 60 as moving, lag(inst_displacement) over w as before from kin1 window w as (partition by object_id order by time)"
PARTS["kin"] = "select *, case when seq >= 3 then velocity - before else 0 end as acceleration, case when moving then velocity else 0 end as velocity_filtered, case when moving then velocity - coalesce(before, velocity) else 0 end as acceleration_filtered from kin2"


@_query("displacements", f"select object_id, {r('time', 'inst_displacement', 'total_displacement', 'path_length')} from kin")
def _(spark, d):
    return kinematics.kinematics(src.step_tracks(spark, d), 1.0, 60.0).select("object_id", "time", "inst_displacement", "total_displacement", "path_length")


@_query("velocities", f"select object_id, {r('time', 'velocity', 'acceleration', 'velocity_filtered', 'acceleration_filtered')}, moving from kin")
def _(spark, d):
    return kinematics.kinematics(src.step_tracks(spark, d), 1.0, 60.0).select("object_id", "time", "velocity", "acceleration", "velocity_filtered", "acceleration_filtered", "moving")


PARTS["steps"] = "select object_id, row_number() over (partition by object_id order by time) as seq, x, y, z from step_tracks"
PARTS["lag_rows"] = f"select b.object_id, b.seq, t.tau, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 as sq from steps a, (select unnest(range(1, {TAU + 1})) as tau) t, steps b where a.object_id = b.object_id and b.seq = a.seq + t.tau"
PARTS["angle_parts"] = f"select a.object_id, a.seq, t.tau, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - b.x as vx, c.y - b.y as vy, c.z - b.z as vz from steps a, (select unnest(range(1, {TAU + 1})) as tau) t, steps b, steps c where a.object_id = b.object_id and b.seq = a.seq + t.tau and a.object_id = c.object_id and c.seq = a.seq + 2 * t.tau"
PARTS["angle_norms"] = "select *, ux * vx + uy * vy + uz * vz as dot, sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz) as norms from angle_parts"
PARTS["angles"] = "select object_id, seq, tau, degrees(acos(greatest(-1, least(1, dot / norms)))) as angle from angle_norms where norms > 0"


@_query("euclid_lags", f"select object_id, seq, tau, {r('sqrt(sq):euclid')} from lag_rows")
def _(spark, d):
    return kinematics.euclid_lags(src.step_tracks(spark, d), TAU)


@_query("turning_angles", f"select object_id, seq, tau, {r('angle', digits=3)} from angles", digits=3)
def _(spark, d):
    return kinematics.turning_angles(src.step_tracks(spark, d), TAU)


PIECES = Pieces(16, 12.0)


@_query("drop_gapped_pieces", f"select object_id, {r('time', 'x', 'y', 'z')} from day_tracks where object_id in (select object_id from gapless )")
def _(spark, d):
    return formatting.drop_gapped(src.day_tracks(spark, d), 1.0, PIECES)


@_query("interpolate_pieces", f"select object_id, {r('time', 'x', 'y', 'z')} from filled")
def _(spark, d):
    return formatting.interpolate(src.day_tracks(spark, d), 1.0, PIECES)


@_query("kinematics_pieces", f"select object_id, {r('time', 'inst_displacement', 'total_displacement', 'path_length', 'velocity', 'acceleration', 'velocity_filtered', 'acceleration_filtered')}, moving from kin")
def _(spark, d):
    return kinematics.kinematics(src.step_tracks(spark, d), 1.0, 60.0, PIECES).drop("seq", "x", "y", "z")


@_query("euclid_lags_pieces", f"select object_id, seq, tau, {r('sqrt(sq):euclid')} from lag_rows")
def _(spark, d):
    return kinematics.euclid_lags(src.step_tracks(spark, d), TAU, PIECES)


@_query("turning_angles_pieces", f"select object_id, seq, tau, {r('angle', digits=3)} from angles", digits=3)
def _(spark, d):
    return kinematics.turning_angles(src.step_tracks(spark, d), TAU, PIECES)


PARTS["angle_medians"] = "select object_id, tau, median(angle) as median_angle from angles group by object_id, tau"


@_query("angle_medians", f"select object_id, tau, {r('median_angle', digits=3)} from angle_medians", digits=3)
def _(spark, d):
    return kinematics.angle_medians(kinematics.turning_angles(src.step_tracks(spark, d), TAU))


@_query("max_turning_angle", f"select object_id, {r('max(median_angle):median_turning_angle', digits=3)} from angle_medians group by object_id", digits=3)
def _(spark, d):
    return kinematics.max_angle(kinematics.angle_medians(kinematics.turning_angles(src.step_tracks(spark, d), TAU)))


PARTS["euclid_meds"] = "select object_id, tau, median(sqrt(sq)) filter (sq <> 0) as euclid_median from lag_rows group by object_id, tau having count(*) filter (sq <> 0) > 2"


@_query("euclid_medians", f"select object_id, tau, {r('euclid_median')} from euclid_meds")
def _(spark, d):
    return kinematics.euclid_medians(kinematics.euclid_lags(src.step_tracks(spark, d), TAU))


@_query("overall_euclid_median", f"select object_id, {r('median(euclid_median):overall_euclidean_median')} from euclid_meds group by object_id")
def _(spark, d):
    return kinematics.overall_euclid_median(kinematics.euclid_medians(kinematics.euclid_lags(src.step_tracks(spark, d), TAU)))


PARTS["emptied"] = "select object_id, seq, tau, case when tau % 3 <> 0 then sqrt(sq) else 0 end as euclid from lag_rows"


@_query("filled_taus", f"select object_id, seq, tau, {r('euclid')} from emptied where tau in (select tau from emptied group by tau having max(euclid) > 0)")
def _(spark, d):
    """Every third lag is 0 throughout."""
    lags = kinematics.euclid_lags(src.step_tracks(spark, d), TAU)
    return kinematics.filled_taus(lags.withColumn("euclid", F.when(F.col("tau") % 3 != 0, F.col("euclid")).otherwise(0.0)), "euclid")


@_query("euclid_medians_wide", "select object_id, " + ", ".join(f"round(max(euclid_median) filter (tau = {k}), 6) + 0.0 as euclid_{k}" for k in range(1, TAU + 1)) + " from euclid_meds group by object_id")
def _(spark, d):
    return kinematics.wide(kinematics.euclid_medians(kinematics.euclid_lags(src.step_tracks(spark, d), TAU)), "euclid_median", list(range(1, TAU + 1)), "euclid")


# Mean squared displacement --------------------------------------------------------------------------------------------

PARTS["msds"] = "select object_id, tau, avg(sq) as msd from lag_rows where sq > 0 group by object_id, tau"
PARTS["points"] = "select object_id, category, tau, msd, log10(tau) as log_tau, log10(msd) as log_msd from msds join user_categories using (object_id)"
PARTS["curve"] = "select category, tau, log_tau, avg(log_msd) as log_msd from points group by all"


def _fit(curve: str, keys: str, r2: float) -> str:
    return f"""select {keys}, regr_slope(log_msd, log_tau) as slope, case when max(log_msd) = min(log_msd) then 0 else regr_r2(log_msd, log_tau) end as r2, max(tau) as max_tau, count(*) as points from (
        select *, greatest(4, coalesce(min(case when pos >= 4 and coalesce(run_r2, 0) < {r2} then pos end) over (partition by {keys}) - 1, 2147483647)) as last from (
        select {keys}, tau, log_tau, log_msd, row_number() over w as pos, case when max(log_msd) over w = min(log_msd) over w then 0 else regr_r2(log_msd, log_tau) over w end as run_r2
        from {curve} window w as (partition by {keys} order by log_tau rows between unbounded preceding and current row))) where pos <= last group by {keys}"""


def _curves(spark: SparkSession, d: str) -> DataFrame:
    return msd.msd(src.step_tracks(spark, d), TAU)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return msd.loglog_points(_curves(spark, d), src.user_categories(spark, d))


@_query("msd_object", f"select object_id, tau, {r('msd', digits=4)} from msds", digits=4)
def _(spark, d):
    return _curves(spark, d)


@_query("msd_wide", "select object_id, " + ", ".join(f"round(max(msd) filter (tau = {k}), 4) + 0.0 as msd_{k}" for k in range(1, TAU + 1)) + " from msds group by object_id", digits=4)
def _(spark, d):
    return kinematics.wide(_curves(spark, d), "msd", list(range(1, TAU + 1)), "msd")


@_query("msd_many_lags", f"select object_id, tau, {r('avg(sq):msd', digits=4)} from (select b.object_id, t.tau, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 as sq from supplier_tracks a, (select unnest(range(1, 61)) as tau) t, supplier_tracks b where a.object_id = b.object_id and b.time = a.time + t.tau) where sq > 0 group by object_id, tau", digits=4)
def _(spark, d):
    return msd.msd(src.supplier_tracks(spark, d), 60)


@_query("msd_summary", f"select tau, {r('avg(msd):mean', 'stddev_samp(msd):stdev', digits=4)} from msds group by tau", digits=4)
def _(spark, d):
    return msd.msd_summary(_curves(spark, d))


@_query("msd_category", f"select tau, category, {r('avg(msd):mean', 'stddev_samp(msd):stdev', digits=4)} from msds join user_categories using (object_id) group by tau, category", digits=4)
def _(spark, d):
    return msd.msd_by_category(_curves(spark, d), src.user_categories(spark, d))


@_query("msd_max", f"select object_id, {r('max(msd):maximum_msd', digits=4)} from msds group by object_id", digits=4)
def _(spark, d):
    return msd.max_msd(_curves(spark, d))


@_query("msd_loglog_points", f"select object_id, category, tau, {r('msd', 'log_tau', 'log_msd', digits=4)} from points", digits=4)
def _(spark, d):
    return _points(spark, d)


@_query("msd_category_curve", f"select category, tau, {r('log_tau', 'log_msd')} from curve")
def _(spark, d):
    return msd.category_curve(_points(spark, d))


@_query("loglog_prefix_fit", f"select category, {r('slope', 'r2', digits=4)}, max_tau, points from ({_fit('curve', 'category', 0.995)})", digits=4)
def _(spark, d):
    return msd.prefix_fit(msd.category_curve(_points(spark, d)))


PARTS["bent"] = "select category, tau, log10(tau) as log_tau, (1 + k / 10.0::double) * log10(least(tau, 4 + k)) + case when tau > 4 + k then 0.3 * (tau % 2) else 0 end as log_msd from (select distinct category, substr(category, 2)::int as k from user_categories ), (select unnest(range(1, 13)) as tau)"


def _bent(spark: SparkSession, d: str) -> DataFrame:
    """Curves that are straight up to another lag in each category, and zigzag after it."""
    k, tau = F.substring("category", 2, 9).cast("int"), F.col("tau")
    rows = src.user_categories(spark, d).select("category").distinct().withColumn("tau", F.explode(F.sequence(F.lit(1), F.lit(12))))
    bent = (1 + k / 10) * F.log10(F.least(tau, 4 + k)) + F.when(tau > 4 + k, 0.3 * (tau % 2)).otherwise(0.0)
    return rows.select("category", "tau", F.log10("tau").alias("log_tau"), bent.alias("log_msd"))


@_query("loglog_prefix_fit_bent", f"select category, {r('slope', 'r2', digits=4)}, max_tau, points from ({_fit('bent', 'category', 0.995)})", digits=4)
def _(spark, d):
    return msd.prefix_fit(_bent(spark, d))


PARTS["boot_objects"] = "select category, object_id, place // 4096 as block, place % 4096 as item, least(4096, n - place // 4096 * 4096) as size, n from (select category, object_id, row_number() over (partition by category order by object_id) - 1 as place, count(*) over (partition by category) as n from (select distinct category, object_id from points ))"
PARTS["boot_blocks"] = "select category, boot, (('0x' || substr(md5('42:' || category || ':' || boot || ':' || draw), 1, 8))::bigint % n) // 4096 as block, count(*) as hits from (select category, n, boot, unnest(range(1, n + 1)) as draw from (select category, count(*) as n, unnest(range(1, 1001)) as boot from boot_objects group by category)) group by all"
PARTS["boot_seeds"] = "select category, boot, block, (('0x' || substr(md5('42:' || category || ':' || boot || ':' || block), 1, 8))::bigint + 2654435769 * unnest(range(0, hits))) % 4294967296 as x from boot_blocks"
PARTS["boot_mix1"] = "select category, boot, block, (xor(x, x >> 16)::hugeint * 2246822507 % 4294967296)::bigint as x from boot_seeds"
PARTS["boot_mix2"] = "select category, boot, block, (xor(x, x >> 13)::hugeint * 3266489909 % 4294967296)::bigint as x from boot_mix1"
PARTS["draws"] = "select m.category as category, boot, object_id, count(*) as weight from (select category, boot, block, xor(x, x >> 16) as x from boot_mix2 ) m join (select distinct category, block, size from boot_objects ) s on s.category = m.category and s.block = m.block join boot_objects o on o.category = m.category and o.block = m.block and o.item = m.x % s.size group by all"
PARTS["boot_curve"] = "select category, boot, tau, log_tau, sum(log_msd * weight) / sum(weight) as log_msd from draws join points using (category, object_id) group by all"


@_query("bootstrap_ci", f"select category, {r('quantile_cont(slope, 0.05):ci_low', 'quantile_cont(slope, 0.95):ci_high', digits=4)}, count(*) as samples from ({_fit('boot_curve', 'category, boot', 0.995)}) where points >= 4 group by category", digits=4)
def _(spark, d):
    slopes = msd.bootstrap_slopes(_points(spark, d), 1000, 42)
    return slopes.groupBy("category").agg(F.percentile("slope", F.array(F.lit(0.05), F.lit(0.95))).alias("ci"), F.count("*").alias("samples")).select("category", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "samples")


# Summary --------------------------------------------------------------------------------------------------------------

PARTS["geometry"] = """select object_id, n, n * step as duration, path_length, final_euclidean, max_euclidean,
    case when max_euclidean = 0 then 0 else final_euclidean / max_euclidean end as displacement_ratio, case when path_length = 0 then 0 else max_euclidean / path_length end as outreach_ratio,
    case when path_length = 0 then 0 else final_euclidean / path_length end * sqrt(n * step) as straightness, case when n * step = 0 then 0 else slow * step / (n * step) end as arrest_coefficient
    from (select object_id, count(*) as n, coalesce(abs(max(time) filter (seq = 2) - max(time) filter (seq = 1)), 0) as step, max(path_length) as path_length, arg_max(total_displacement, seq) as final_euclidean,
    max(total_displacement) as max_euclidean, count(*) filter (inst_displacement <> 0 and inst_displacement < 60) as slow from kin group by object_id)"""
_GEOMETRY = ("duration", "path_length", "final_euclidean", "max_euclidean", "displacement_ratio", "outreach_ratio", "straightness", "arrest_coefficient")
PARTS["statistics"] = "select object_id, " + ", ".join(
    f"case when count(*) >= 4 then case when count(*) filter (acceleration_filtered <> 0) >= 4 then coalesce({f}({e}) filter ({e} <> 0), 0) else 0 end end as {p}_{n}"
    for n, e in (("velocity", "velocity_filtered"), ("acceleration", "acceleration_filtered"), ("absolute_acceleration", "abs(acceleration_filtered)"))
    for p, f in (("mean", "avg"), ("median", "median"), ("stdev", "stddev_samp"))
) + " from kin group by object_id"


def _kin(spark: SparkSession, d: str) -> DataFrame:
    return kinematics.kinematics(src.step_tracks(spark, d), CFG.dt, CFG.arrest_limit)


@_query("summary_geometry", f"select object_id, n, {r(*_GEOMETRY)} from geometry")
def _(spark, d):
    return features.geometry(_kin(spark, d), CFG.arrest_limit)


@_query("summary_statistics", f"select object_id, {r(*features.STATISTICS)} from statistics")
def _(spark, d):
    return features.statistics(_kin(spark, d), CFG.arrest_limit, CFG.moving)


PARTS["statistics_unfiltered"] = "select object_id, " + ", ".join(
    f"case when count(*) >= 4 then coalesce({f}({e}) filter (seq >= 2 and {e} <> 0), 0) end as {p}_{n}"
    for n, e in (("velocity", "velocity"), ("acceleration", "acceleration"), ("absolute_acceleration", "abs(acceleration)"))
    for p, f in (("mean", "avg"), ("median", "median"), ("stdev", "stddev_samp"))
) + " from kin group by object_id"


@_query("summary_statistics_unfiltered", f"select object_id, {r(*features.STATISTICS)} from statistics_unfiltered")
def _(spark, d):
    return features.statistics(kinematics.kinematics(src.step_tracks(spark, d), 1.0, 0.0), 0.0, 4)


PARTS["summary"] = """select object_id, category, duration, path_length, final_euclidean, max_euclidean, o.m as overall_euclidean_median, q.m as maximum_msd, displacement_ratio, outreach_ratio, straightness, a.m as median_turning_angle, arrest_coefficient,
    s.* exclude (object_id) from geometry g join statistics s using (object_id) left join (select object_id, median(euclid_median) as m from euclid_meds group by object_id) o using (object_id)
    left join (select object_id, max(msd) as m from msds group by object_id) q using (object_id) left join (select object_id, max(median_angle) as m from angle_medians group by object_id) a using (object_id) left join user_categories using (object_id)"""
_SUMMARY = ("duration", "path_length", "final_euclidean", "max_euclidean", "overall_euclidean_median", "maximum_msd", "displacement_ratio", "outreach_ratio", "straightness", "median_turning_angle", "arrest_coefficient", *features.STATISTICS)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return features.summarize(src.step_tracks(spark, d), src.user_categories(spark, d), CFG)


@_query("summary_full", f"select object_id, category, {r(*_SUMMARY, digits=3)} from summary", digits=3)
def _(spark, d):
    return _summary(spark, d)


@_query("summary_presented", "select object_id, category, " + ", ".join(f"round(nullif({c}, 0), 3) + 0.0 as {c}" if c != "arrest_coefficient" else f"round({c}, 3) + 0.0 as {c}" for c in _SUMMARY) + " from summary", digits=3)
def _(spark, d):
    return features.presented(_summary(spark, d))


@_query("maxeuclid_filter", f"select object_id, category, {r(*_SUMMARY, digits=3)} from summary where max_euclidean >= (select floor(median(max_euclidean)) from geometry )", digits=3)
def _(spark, d):
    """From the median of the greatest distances on, so that about half of the objects go."""
    whole = _summary(spark, d)
    return features.far_enough(whole, float(whole.agg(F.floor(F.median("max_euclidean"))).first()[0]))


@_query("replicate_features", f"select feature, category, replicate, {r('median(value):median', digits=4)}, count(value) as n from (unpivot (select category, 'r' || (object_id % 3) as replicate, {', '.join(_SUMMARY)} from summary ) on {', '.join(_SUMMARY)} into name feature value value) group by all", digits=4)
def _(spark, d):
    runs = _summary(spark, d).withColumn("replicate", F.concat(F.lit("r"), F.col("object_id") % 3))
    return replicates.replicate_medians(replicates.long_features(runs))


def _medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of three replicates, rounded so that ties are the same for all engines."""
    runs = _summary(spark, d).withColumn("replicate", F.concat(F.lit("r"), F.col("object_id") % 3))
    return replicates.replicate_medians(replicates.long_features(runs)).withColumn("median", F.round("median", 5))


PARTS["rep_long"] = f"select feature, category, round(median(value), 5) as value from (unpivot (select category, object_id % 3 as replicate, {', '.join(_SUMMARY)} from summary ) on {', '.join(_SUMMARY)} into name feature value value) group by feature, category, replicate"


@_query("category_medians", f"select feature, category, {r('median(value):median', digits=4)}, count(*) as n from rep_long group by feature, category", digits=4)
def _(spark, d):
    return replicates.category_medians(_medians(spark, d))


def _rank_parts(name: str, source: str) -> None:
    """Ranks, sums by category, H and z of a long table (feature, category, value)."""
    PARTS[f"{name}_rk"] = f"select feature, category, value, count(*) over (partition by feature, value) as tie, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double as rk from {source} where value is not null"
    PARTS[f"{name}_sums"] = f"select feature, category, count(*) as n, sum(rk) as r from {name}_rk group by feature, category"
    PARTS[f"{name}_all"] = f"select feature, count(*)::double as total, sum((tie * tie - 1)::double) as ties from {name}_rk group by feature"
    PARTS[f"{name}_h"] = f"select feature, groups, (12 / (total * (total + 1)) * s - 3 * (total + 1)) / (1 - ties / (total ** 3 - total)) as h from (select feature, count(*) as groups, sum(r * r / n) as s from {name}_sums group by feature) join {name}_all using (feature)"
    PARTS[f"{name}_z"] = f"select a.feature as feature, a.category as cat_a, b.category as cat_b, (a.r / a.n - b.r / b.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)) as z from {name}_sums a join {name}_sums b on a.feature = b.feature and a.category < b.category join {name}_all t on a.feature = t.feature"
    PARTS[f"{name}_p"] = f"select *, {_tail('z * z', '0.5')} as p from {name}_z"
    PARTS[f"{name}_holm"] = f"select feature, cat_a, cat_b, z, p, max(least(1, p * (m - k + 1))) over (partition by feature order by k) as p_holm from (select *, row_number() over (partition by feature order by p, cat_a, cat_b) as k, count(*) over (partition by feature) as m from {name}_p )"


def _tail(x: str, a: str) -> str:
    """The chance that a chi-squared variable of 2 ``a`` degrees of freedom exceeds ``x``: one less the series of the incomplete gamma function."""
    return f"greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda n: exp(-({x}) / 2 + ({a} + n) * ln(greatest(({x}) / 2, 1e-300)) - lgamma({a} + n + 1)))))"


_rank_parts("rep", "rep_varied")
PARTS["rep_sizes"] = "select feature, count(distinct value) as k, count(*) as n from rep_long group by feature"
PARTS["rep_varied"] = "select * from rep_long where feature in (select feature from rep_sizes where k > 1)"


@_query("replicate_stats", f"""select feature, 'skipped' as test, 'all' as comparison, null::double as statistic, null::double as p_value, n from rep_sizes where k <= 1
    union all select feature, 'kruskal', 'all', {r('h:statistic', digits=4)}, round({_tail('h', '(groups - 1) / 2.0')}, 4) + 0.0, n from rep_h join rep_sizes using (feature)
    union all select feature, 'dunn', cat_a || ' vs ' || cat_b, round(z, 4) + 0.0, round(p_holm, 4) + 0.0, n from rep_holm join rep_sizes using (feature)""", digits=4)
def _(spark, d):
    return replicates.replicate_stats(_medians(spark, d))


# Contacts and attractors ----------------------------------------------------------------------------------------------

PARTS["met"] = f"select a.object_id, b.object_id as object_compare, a.time from day_tracks a join day_tracks b on a.time = b.time and a.object_id < b.object_id and abs(a.x - b.x) <= {CONTACT} and abs(a.y - b.y) <= {CONTACT} and abs(a.z - b.z) <= {CONTACT}"
PARTS["contact_rows"] = "select c.object_id, c.category, coalesce(n, 0) as n_contacts, coalesce(t, 0) as total_time, coalesce(m, 0) as median_duration from user_categories c left join (select object_id, count(distinct object_compare) as n, count(*) * 1.0::double as t, (count(*) + 1) / 2.0::double as m from met group by object_id) using (object_id)"


def _met(spark: SparkSession, d: str) -> DataFrame:
    return contacts.contacts(src.day_tracks(spark, d), CONTACT)


def _each(spark: SparkSession, d: str) -> DataFrame:
    return contacts.summary_of_counts(contacts.partners(src.day_tracks(spark, d), CONTACT), src.user_categories(spark, d), 1.0)


@_query("contacts_all", f"select object_id, object_compare, {r('time')} from met")
def _(spark, d):
    return _met(spark, d)


@_query("contacts_euclidean", f"select a.object_id, b.object_id as object_compare, {r('a.time:time')} from day_tracks a join day_tracks b on a.time = b.time and a.object_id < b.object_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= {CONTACT}")
def _(spark, d):
    return contacts.contacts(src.day_tracks(spark, d), CONTACT, euclidean=True)


@_query("contacts_minus_dividing", f"select object_id, object_compare, {r('time')} from met where abs(object_compare - object_id) <> 1")
def _(spark, d):
    return contacts.minus_dividing(_met(spark, d))


@_query("contacts_minus_dead", f"select object_id, object_compare, {r('time')} from met where object_id in (select object_id from geometry where arrest_coefficient < (select round(median(arrest_coefficient), 3) + 0.0005 from geometry ))")
def _(spark, d):
    """Up to the median of the coefficients, so that about half of the objects count as dead."""
    geometry = features.geometry(_kin(spark, d), CFG.arrest_limit)
    return contacts.minus_dead(_met(spark, d), geometry, geometry.agg(F.round(F.median("arrest_coefficient"), 3) + 0.0005).first()[0])


@_query("contacts_summary", f"select object_id, category, n_contacts, {r('total_time', 'median_duration')} from contact_rows")
def _(spark, d):
    return _each(spark, d)


PARTS["both_met"] = "select object_id, object_compare, time from met union select object_compare, object_id, time from met"
PARTS["met_events"] = "select object_id, object_compare, count(*) * 1.0::double as duration from (select *, sum(fresh) over (partition by object_id, object_compare order by time) as event from (select *, coalesce(time - lag(time) over (partition by object_id, object_compare order by time) > 1.5, true)::int as fresh from both_met )) group by object_id, object_compare, event"


@_query("contacts_summary_both_sides", f"select object_id, category, coalesce(n, 0) as n_contacts, {r('coalesce(t, 0):total_time', 'coalesce(m, 0):median_duration')} from user_categories left join (select object_id, count(distinct object_compare) as n, sum(duration) as t, median(duration) as m from met_events group by object_id) using (object_id)")
def _(spark, d):
    return contacts.summary_of_durations(contacts.durations(src.day_tracks(spark, d), CONTACT, 1.0), src.user_categories(spark, d), 1.0)


@_query("contacts_per_category", f"select category, count(*) as total_objects, {r('100.0 * count(*) filter (n_contacts > 0) / count(*):pct_with_contact', '100.0 * count(*) filter (n_contacts >= 3) / count(*):pct_with_3plus', 'median(n_contacts) filter (n_contacts > 0):median_contacts', 'median(total_time) filter (n_contacts > 0):median_time', 'median(median_duration) filter (n_contacts > 0):median_duration')} from contact_rows group by category")
def _(spark, d):
    return contacts.contacts_per_category(_each(spark, d))


PARTS["pair_rows"] = "select a.object_id as attractor_id, ca.category as attractor_type, b.object_id as attracted_id, cb.category as attracted_type, a.time, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as distance from day_tracks a join day_tracks b on a.time = b.time and a.object_id <> b.object_id join user_categories ca on ca.object_id = a.object_id join user_categories cb on cb.object_id = b.object_id"
PARTS["chain1"] = "select * from (select *, distance > 0 and distance < 40 as near, sum((not (distance > 0 and distance < 40))::int) over (partition by attractor_id, attracted_id order by time rows unbounded preceding) as segment from pair_rows ) where near"
PARTS["chain2"] = "select *, coalesce(distance >= lag(distance) over (partition by attractor_id, attracted_id, segment order by time), false) as away from chain1"
PARTS["chain3"] = "select *, sum((not away)::int) over (partition by attractor_id, attracted_id, segment order by time rows unbounded preceding) as run from chain2"
PARTS["chain4"] = "select *, away and sum(away::int) over (partition by attractor_id, attracted_id, segment, run order by time rows unbounded preceding) % 3 = 0 as breaks from chain3"
PARTS["chain5"] = "select *, sum(breaks::int) over (partition by attractor_id, attracted_id, segment order by time rows unbounded preceding) as chain from chain4"
PARTS["chain6"] = "select * from (select *, max(chain) over (partition by attractor_id, attracted_id, segment) as last_chain from chain5 ) where chain = last_chain"
PARTS["chains"] = "select * from (select *, count(*) over c as n, arg_min(distance, time) over c as d0, arg_max(distance, time) over c as d1, min(distance) over c as dm from chain6 window c as (partition by attractor_id, attracted_id, segment)) where n >= 4 and d1 < d0 * 0.5 and dm <= 10"
PARTS["day_velocity"] = "select object_id, time, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2), 0) as velocity from day_tracks window w as (partition by object_id order by time)"


def _chains(spark: SparkSession, d: str) -> DataFrame:
    return attractors.found(src.day_tracks(spark, d), src.user_categories(spark, d), CHAINS)


@_query("attractor_events", f"select attractor_id, attractor_type, attracted_id, attracted_type, {r('time', 'distance')} from chains")
def _(spark, d):
    return _chains(spark, d)


PARTS["all_chains"] = "select * from (select *, count(*) over c as n, arg_min(distance, time) over c as d0, arg_max(distance, time) over c as d1, min(distance) over c as dm from chain5 window c as (partition by attractor_id, attracted_id, segment, chain)) where n >= 3 and d1 < d0 * 0.5 and dm <= 10"


@_query("attractor_broken_chains", f"select attractor_id, attractor_type, attracted_id, attracted_type, {r('time', 'distance')} from all_chains")
def _(spark, d):
    cfg = replace(CHAINS, broken_chains=True, time_persistence=3)
    return attractors.found(src.day_tracks(spark, d), src.user_categories(spark, d), cfg)


@_query("attractor_enriched", f"select attractor_type, attractor_id, {r('a.velocity:attractor_velocity')}, attracted_type, attracted_id, {r('b.velocity:attracted_velocity', 'c.time:time', 'distance', 'b.velocity - a.velocity:velocity_difference')} from chains c left join day_velocity a on a.object_id = attractor_id and a.time = c.time left join day_velocity b on b.object_id = attracted_id and b.time = c.time")
def _(spark, d):
    tracks = src.day_tracks(spark, d)
    return attractors.enriched(tracks, src.user_categories(spark, d), kinematics.kinematics(tracks, 1.0, 3.0), CHAINS)


# Learning -------------------------------------------------------------------------------------------------------------

_DIMS = [f"d{i:02d}" for i in range(64)]
PARTS["matrix"] = "select vec_id as object_id, label::varchar as category, " + ", ".join(f"embedding[{i + 1}]::double as {c}" for i, c in enumerate(_DIMS)) + " from embeddings"
PARTS["logged"] = "select object_id, category, " + ", ".join(f"sign({c}) * ln(1 + abs({c})) as {c}" for c in _DIMS) + " from matrix where " + " and ".join(f"{c} is not null" for c in _DIMS)
PARTS["scaled"] = "select object_id, category, " + ", ".join(f"({c} - avg({c}) over ()) / case when stddev_pop({c}) over () > 1e-12 then stddev_pop({c}) over () else 1 end as {c}" for c in _DIMS) + " from logged"
PARTS["long_matrix"] = f"select * from (unpivot (select object_id, category, {', '.join(_DIMS)} from matrix ) on {', '.join(_DIMS)} into name feature value value)"


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return ml.standardized(ml.signed_log(src.embedding_features(spark, d)))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return src.embedding_features(spark, d).unpivot(["object_id", "category"], _DIMS, "feature", "value")


@_query("category_filter", f"select object_id, category, {r(*_DIMS)} from matrix where category in ('1', '2', '3')")
def _(spark, d):
    return ml.chosen_categories(src.embedding_features(spark, d), ("1", "2", "3"))


@_query("min_samples_filter", f"select object_id, category, {r(*_DIMS)} from matrix where category in (select category from matrix group by category having count(*) >= 50)")
def _(spark, d):
    return ml.enough_samples(src.embedding_features(spark, d), 50)


@_query("signed_log_zscore", f"select object_id, category, {r(*_DIMS)} from scaled")
def _(spark, d):
    return _scaled(spark, d)


@_query("variance_filter", f"select object_id, category, {r(*_DIMS)} from logged")
def _(spark, d):
    """Two features beside the dimensions, a constant and one that hardly varies, go."""
    rows = ml.signed_log(src.embedding_features(spark, d))
    return ml.varying(rows.withColumns({"constant": F.lit(1.0), "still": F.col("d00") * 1e-4}), 1e-5)


@_query("corr_pairs", "select * from (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) + 0.0 as correlation from scaled" for i, a in enumerate(_DIMS) for b in _DIMS[i + 1 :]) + ")")
def _(spark, d):
    return ml.correlations(_scaled(spark, d))


#: Features that follow others closely: two groups, and two more that are near each other but are never merged.
_NEAR = {"e00": "2 * d00 + 0.1 * d40", "e01": "0.15 * d41 - d01", "e02": "3 * d00 - 0.2 * d45", "f02": "d02 + 0.04 * d42", "g02": "d02 + 0.3 * d43", "h02": "d02 + 0.3 * d43 + 0.04 * d44"}
_ALL = [*_DIMS, *_NEAR]
PARTS["near_matrix"] = "select *, " + ", ".join(f"{e} as {n}" for n, e in _NEAR.items()) + " from matrix"
PARTS["near_logged"] = "select object_id, category, " + ", ".join(f"sign({c}) * ln(1 + abs({c})) as {c}" for c in _ALL) + " from near_matrix where " + " and ".join(f"{c} is not null" for c in _DIMS)
PARTS["near_scaled"] = "select object_id, category, " + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}" for c in _ALL) + " from near_logged"
PARTS["near_long"] = f"select * from (unpivot (select object_id, {', '.join(_ALL)} from near_scaled ) on {', '.join(_ALL)} into name feature value value)"
PARTS["near_pairs"] = "select a.feature as feature_a, b.feature as feature_b, corr(a.value, b.value) as correlation from near_long a join near_long b on a.object_id = b.object_id and a.feature < b.feature group by all"
PARTS["near_ranked"] = "select *, row_number() over (order by abs(correlation) desc, feature_a, feature_b) as k from near_pairs where abs(correlation) >= 0.95"
PARTS["near_groups"] = """select 0::bigint as k, map([]::varchar[], []::bigint[]) as m, 0::bigint as n union all
    select r.k, case when m[feature_a] is not null and m[feature_b] is null then map_concat(m, map([feature_b], [m[feature_a]])) when m[feature_b] is not null and m[feature_a] is null then map_concat(m, map([feature_a], [m[feature_b]]))
    when m[feature_a] is null then map_concat(m, map([feature_a, feature_b], [n, n])) else m end, n + (m[feature_a] is null and m[feature_b] is null)::bigint from near_groups g join near_ranked r on r.k = g.k + 1"""


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    rows = src.embedding_features(spark, d)
    return ml.prepared(rows.select("*", *(F.expr(e).alias(n) for n, e in _NEAR.items())), MLConfig(), 5)


@_query("corr_groups", "select feature_a, feature_b, round(correlation, 6) + 0.0 as correlation, abs(correlation) >= 0.95 as meets, coalesce(m[feature_a] = m[feature_b], false) as grouped, coalesce(m[feature_a], -1) as group_a, coalesce(m[feature_b], -1) as group_b from near_pairs, (select m from near_groups order by k desc limit 1)")
def _(spark, d):
    """Features that stand alone have the group -1 here."""
    return _near(spark, d)[1]["feature_correlations"].fillna(-1, ["group_a", "group_b"])


_TOGETHER = [["d00", "e00", "e02"], ["d01", "e01"], ["d02", "f02"], ["g02", "h02"]]


@_query("aggregated_features", "select object_id, category, " + ", ".join(f'round(({" + ".join(g)}) / {len(g)}, 6) + 0.0 as "{", ".join(g)}"' for g in [*_TOGETHER, *([c] for c in _ALL if not any(c in g for g in _TOGETHER))]) + " from near_scaled")
def _(spark, d):
    """The means of the groups that these features make, beside all others."""
    return _near(spark, d)[0]


_rank_parts("dim", "long_matrix")


@_query("kw_statistic", f"select feature, groups, {r('h', digits=4)} from dim_h", digits=4)
def _(spark, d):
    return stats.kruskal_wallis(_long(spark, d)).select("feature", "groups", "h")


@_query("kw_p_values", f"select feature, round({_tail('h', '(groups - 1) / 2.0')}, 5) + 0.0 as p from dim_h", digits=5)
def _(spark, d):
    return stats.kruskal_wallis(_long(spark, d)).select("feature", "p")


@_query("dunn_z", f"select feature, cat_a, cat_b, {r('z', digits=4)} from dim_z", digits=4)
def _(spark, d):
    return stats.dunn(_long(spark, d)).select("feature", "cat_a", "cat_b", "z")


@_query("rank_p_values", f"select feature, cat_a, cat_b, {r('z', 'p', 'p_holm', digits=4)} from dim_holm", digits=4)
def _(spark, d):
    return stats.dunn(_long(spark, d))


PARTS["parts_split"] = "select object_id, category, row_number() over (partition by category order by md5('42:' || object_id)) > count(*) over (partition by category) * 0.6::double as test from matrix"


@_query("stratified_split", "select object_id, category, test from parts_split")
def _(spark, d):
    return ml.split(src.embedding_features(spark, d)).select("object_id", "category", "test")


@_query("k_folds", "select object_id, category, (row_number() over (partition by category order by md5('42:' || object_id)) - 1) % 5 as fold from matrix")
def _(spark, d):
    return ml.folds(src.embedding_features(spark, d), 5).select("object_id", "category", "fold")


PARTS["said"] = "select category, case when d00 > 0 then category else '1' end as prediction from matrix"


@_query("classification_report", f"""select category, {r('precision', 'recall')}, {r('case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end:f1')}, support, {r('(select count(*) filter (category = prediction) / count(*)::double from said ):accuracy')} from (
    select category, support, coalesce(hit / called::double, 0) as precision, hit / support::double as recall from (select category, count(*) as support, count(*) filter (category = prediction) as hit from said group by category) left join (select prediction as category, count(*) as called from said group by prediction) using (category))""")
def _(spark, d):
    rows = src.embedding_features(spark, d)
    return ml.report(rows.select("category", F.when(F.col("d00") > 0, F.col("category")).otherwise("1").alias("prediction")))


@_query("pca_scores")
def _(spark, d):
    return ml.pca(_scaled(spark, d))["pc_scores"]


def _said(found: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Importances and report of trained trees as rows (table, name, measure, value), so that they are trained once."""
    keys = [F.col(k) for k in keys]
    ranked = found["tree_features"].select(*keys, F.lit("features").alias("table"), F.col("feature").alias("name"), F.lit("importance").alias("measure"), F.col("importance").alias("value"))
    measures = ("precision", "recall", "f1", "support", "accuracy")
    told = found["tree_report"].select(*keys, F.col("category").alias("name"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("e"))
    return ranked.unionByName(told.select(*keys, F.lit("report").alias("table"), "name", "e.measure", "e.value"))


@_query("boosted_trees")
def _(spark, d):
    return _said(ml.boosted_trees(_scaled(spark, d), MLConfig(search=False)))


@_query("pairwise_trees")
def _(spark, d):
    found = ml.pairwise_trees(_scaled(spark, d), MLConfig(search=False, trees=5))
    return _said(found, "cat_a", "cat_b") if found else spark.createDataFrame([], "cat_a string, cat_b string, table string, name string, measure string, value double")


@_query("searched_trees")
def _(spark, d):
    """The parameters that win of eight points of a grid of all axes, and how well their trees tell categories apart."""
    grid = {"n_estimators": [2, 4], "learning_rate": [0.1, 0.3], "max_depth": [2, 3], "gamma": [0.0, 0.1], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 3], "reg_alpha": [0.0, 0.1], "reg_lambda": [0.1, 1.0]}
    found = ml.boosted_trees(_scaled(spark, d), MLConfig(draws=8, grid=grid))
    return found["tree_report"].join(found["tree_hyperparams"], "method")


# Shape and figures ----------------------------------------------------------------------------------------------------


@_query("convex_hull")
def _(spark, d):
    return shape.hull(src.step_tracks(spark, d), 4)


PARTS["h1"] = "select object_id, time, x, y, z, row_number() over w as seq, count(*) over o as n, (max(time) over o - min(time) over o) / (count(*) over o - 1) as step from step_tracks window w as (partition by object_id order by time), o as (partition by object_id)"


def _grad(c: str, seq: str = "seq", n: str = "n") -> str:
    return f"case when {seq} = 1 then (lead({c}) over w - {c}) / step when {seq} = {n} then ({c} - lag({c}) over w) / step else (lead({c}) over w - lag({c}) over w) / (2 * step) end"


_W = "window w as (partition by object_id order by time)"
PARTS["h2"] = f"select *, {', '.join(f'{_grad(c)} as v{c}' for c in 'xyz')} from h1 {_W}"
PARTS["h3"] = f"select *, {', '.join(f'{_grad(f'v{c}')} as a{c}' for c in 'xyz')}, " + ", ".join(f"lag(v{a}) over w * v{b} - lag(v{b}) over w * v{a} as c{c}" for a, b, c in ("yzx", "zxy", "xyz")) + f" from h2 {_W}"
PARTS["h4"] = f"select *, {', '.join(f'case when seq >= 2 then {_grad(f'c{c}', 'seq - 1', 'n - 1')} end as g{c}' for c in 'xyz')} from h3 {_W}"
PARTS["h5"] = "select object_id, case when seq >= 2 then (vx * gx + vy * gy + vz * gz) / (vx * vx + vy * vy + vz * vz + 1e-8) end as h, case when seq <= n - 2 then sqrt((vy * az - vz * ay) ** 2 + (vz * ax - vx * az) ** 2 + (vx * ay - vy * ax) ** 2) / (sqrt(vx * vx + vy * vy + vz * vz) ** 3 + 1e-8) end as k from h4"


@_query("helicity_raw", f"select object_id, {r('avg(h):mean_helicity', 'median(h):median_helicity', 'avg(k):mean_curvature', 'median(k):median_curvature', digits=4)} from h5 group by object_id", digits=4)
def _(spark, d):
    return helicity.helicity(src.step_tracks(spark, d), 4, smoothing=False)


@_query("helicity_pieces", f"select object_id, {r('avg(h):mean_helicity', 'median(h):median_helicity', 'avg(k):mean_curvature', 'median(k):median_curvature', digits=4)} from h5 group by object_id", digits=4)
def _(spark, d):
    return helicity.helicity(src.step_tracks(spark, d), 4, smoothing=False, pieces=PIECES)


_TWIST = ("mean_helicity", "median_helicity", "mean_curvature", "median_curvature")
PARTS["twist"] = "select object_id, avg(h) as mean_helicity, median(h) as median_helicity, avg(k) as mean_curvature, median(k) as median_curvature from h5 group by object_id"


@_query("summary_with_helicity", f"select object_id, category, {r('duration', 'max_euclidean', 'straightness', *_TWIST, digits=3)} from summary left join twist using (object_id)", digits=3)
def _(spark, d):
    rows = src.step_tracks(spark, d)
    whole = features.summarize(rows, src.user_categories(spark, d), CFG, helicity=helicity.helicity(rows, 4, smoothing=False))
    return whole.select("object_id", "category", "duration", "max_euclidean", "straightness", *_TWIST)


@_query("moving_filter", f"select object_id, category, {r('mean_velocity', 'median_velocity', digits=3)} from summary where mean_velocity <> 0 or median_velocity <> 0", digits=3)
def _(spark, d):
    """Objects that the velocity filter leaves no velocity go."""
    return ml.moving_only(_summary(spark, d), True).select("object_id", "category", "mean_velocity", "median_velocity")


@_query("slope_bars", f"select category, {r('slope', '1.5 * slope - slope:above', 'slope - 0.75 * slope:below', digits=4)} from ({_fit('bent', 'category', 0.995)})", digits=4)
def _(spark, d):
    """Bars of given intervals around the slopes of the bent curves."""
    return figures.slope_bars(msd.prefix_fit(_bent(spark, d)).withColumns({"ci_low": F.col("slope") * 0.75, "ci_high": F.col("slope") * 1.5}))


@_query("helicity_smoothed")
def _(spark, d):
    return helicity.helicity(src.step_tracks(spark, d), 4)


PARTS["zeroed"] = "select object_id, category, time, x, y, z, x - first(x) over w as x0, y - first(y) over w as y0, z - first(z) over w as z0 from (select *, count(*) over (partition by object_id) as n from step_tracks join user_categories using (object_id)) where n >= 2 window w as (partition by object_id order by time)"


@_query("zeroed_tracks", f"select object_id, category, {r('time', 'x', 'y', 'z', 'x0', 'y0', 'z0')} from zeroed")
def _(spark, d):
    return figures.tracks(src.step_tracks(spark, d), src.user_categories(spark, d))


@_query("axis_ranges", "select mode, axis, low, high, max(high - low) over (partition by mode) as range, (low + high) / 2 as centre from (select mode, axis, " + r("min(v):low", "max(v):high") + " from (" + " union all ".join(f"select '{m}' as mode, '{c}' as axis, {c}{s} as v from zeroed" for m, s in (("raw", ""), ("zeroed", "0")) for c in "xyz") + ") group by mode, axis)")
def _(spark, d):
    return rounded(figures.axis_ranges(figures.tracks(src.step_tracks(spark, d), src.user_categories(spark, d))))


@_query("violins", f"select feature, category, {r('quantile_cont(value, 0.25):q1', 'median(value):median', 'quantile_cont(value, 0.75):q3', digits=4)}, count(value) as n from (unpivot (select category, {', '.join(_SUMMARY)} from summary ) on {', '.join(_SUMMARY)} into name feature value value) group by feature, category", digits=4)
def _(spark, d):
    return figures.violins(_summary(spark, d))


@_query("category_colors", "select category, (dense_rank() over (order by category) - 1) % 10 as color from (select distinct category from user_categories )")
def _(spark, d):
    return figures.category_colors(src.user_categories(spark, d))


@_query("msd_lines", f"select category, tau, {r('log_tau', 'log_msd', 'case when tau <= max_tau then y0 + slope * (log_tau - x0) end:fit', digits=4)} from curve join (select category, arg_min(log_msd, log_tau) as y0, min(log_tau) as x0 from curve group by category) using (category) join ({_fit('curve', 'category', 0.995)}) using (category)", digits=4)
def _(spark, d):
    curve = msd.category_curve(_points(spark, d))
    return figures.msd_lines(curve, msd.prefix_fit(curve))


@_query("generated_tracks")
def _(spark, d):
    return generator.generated(spark)[0]
