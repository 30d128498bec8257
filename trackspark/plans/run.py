"""A whole analysis as one plan: every table of the results, lazily."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import attractors, contacts, figures, formatting, helicity, kinematics, ml, msd, replicates, shape
from ..operators import summary as features
from ..sources import tables


def settings(segments: DataFrame, cfg: RunConfig) -> DataFrame:
    """Parameter and value, as text."""
    return segments.sparkSession.createDataFrame([(k, str(v)) for k, v in asdict(cfg).items()], "parameter string, value string")


def formatted(segments: DataFrame, cfg: RunConfig) -> tuple[DataFrame, DataFrame]:
    """Cleaned tracks, and the objects removed for gaps."""
    tracks = formatting.average_duplicates(segments) if cfg.multitrack else segments
    kept = formatting.interpolate(tracks, cfg.dt, cfg.pieces) if cfg.interpolate else formatting.drop_gapped(tracks, cfg.dt, cfg.pieces)
    return kept, formatting.removed_objects(tracks, kept)


class RunLog:
    """Time-stamped messages of a run, as a table; a message under a key that is there replaces it."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple[datetime, str]] = {}

    def note(self, key: str, message: str) -> None:
        self.rows[key] = (datetime.now(timezone.utc), message)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, at, text) for k, (at, text) in self.rows.items()], "step string, at timestamp, message string")


def run(segments: DataFrame, categories: DataFrame | None = None, cfg: RunConfig = RunConfig()) -> dict[str, DataFrame]:
    """All result tables by name. Tracks and summary feed many of them and are kept."""
    log = RunLog()
    log.note("formatting", "interpolated" if cfg.interpolate else "tracks with gaps removed")
    tracks, removed = formatted(segments, cfg)
    tracks = formatting.require_tracks(tracks.persist())
    flat = bool(formatting.is_flat(tracks).first()[0])
    log.note("dimensions", "two: no hull, no helicity" if flat else "three")
    has_categories = categories is not None
    kinds = formatting.surviving_categories(categories, tracks) if has_categories else formatting.default_category(tracks)
    curves = msd.msd(tracks, cfg.tau, cfg.pieces)
    hull = None if flat else shape.hull(tracks, cfg.moving, cfg.hull_times_duration)
    twist = helicity.helicity(tracks, cfg.moving, pieces=cfg.pieces) if cfg.helicity and not flat else None
    whole = features.summarize(tracks, kinds, cfg, hull, twist, curves)
    table = features.far_enough(whole, cfg.min_max_euclid).persist()
    removed = removed.unionByName(formatting.removed_objects(whole, table, "Min. Max. Euclidean"))
    curves = features.restricted(curves, table)
    points = msd.loglog_points(curves, kinds)
    fits = msd.loglog_fits(points)
    out = {
        "settings": settings(segments, cfg), "removed_objects": removed, "features": table, "summary_features": features.presented(table),
        "euclidean_medians": features.restricted(kinematics.euclid_medians(kinematics.euclid_lags(tracks, cfg.tau, cfg.pieces)), table),
        "turning_angles": features.restricted(kinematics.angle_medians(kinematics.turning_angles(tracks, cfg.tau, cfg.pieces)), table),
        "mean_squared_displacements": curves, "msd_summary": msd.msd_summary(curves), "msd_loglog_fits": fits,
        "figure_tracks": figures.tracks(tracks, table), "figure_violins": figures.violins(table), "figure_slopes": figures.slope_bars(fits), "figure_msd": figures.msd_lines(msd.category_curve(points), fits), "figure_colors": figures.category_colors(kinds),
    }
    if cfg.wide:
        # A column for each lag that any object has a value at.
        taus = list(range(1, cfg.tau + 1))
        for name, value, prefix in (("euclidean_medians", "euclid_median", "euclid"), ("turning_angles", "median_angle", "angle"), ("mean_squared_displacements", "msd", "msd")):
            used = {r["tau"] for r in kinematics.filled_taus(out[name], value).select("tau").distinct().collect()}
            out[f"{name}_wide"] = kinematics.wide(out[name], value, [t for t in taus if t in used], prefix)
    if has_categories:
        out["msd_category"] = msd.msd_by_category(curves, kinds)
    if cfg.verbose:
        out["calculations"] = kinematics.kinematics(tracks, cfg.dt, cfg.arrest_limit, cfg.pieces)
    if cfg.contacts:
        found = contacts.contacts(tracks, cfg.contact_length, cfg.euclidean_contacts)
        out["contacts_all"] = found
        found = contacts.minus_dividing(found) if cfg.contact_div_filter else found
        if cfg.contact_div_filter:
            out["contacts_minus_dividing"] = found
        out["contacts_minus_dead"] = contacts.minus_dead(found, table, cfg.arrested, cfg.both_sides_dead)
        out["contacts_summary"] = contacts.contacts_summary(out["contacts_minus_dead"], table.select("object_id", "category"), cfg.dt, cfg.both_sides_contacts)
        out["contacts_per_category"] = contacts.contacts_per_category(out["contacts_summary"])
    if cfg.attractors:
        log.note("attractors", "chains of objects that come nearer")
        out["attractors"] = attractors.enriched(tracks, kinds, kinematics.kinematics(tracks, cfg.dt, cfg.arrest_limit, cfg.pieces), cfg.attractor)
    log.note("plan", f"{len(out)} tables planned")
    out["runtime_log"] = log.table(segments.sparkSession)
    return out


def compare_replicates(spark: SparkSession, pattern: str) -> dict[str, DataFrame]:
    """Medians and rank tests over the replicates whose features ``pattern`` names (``tables.replicate_folder``)."""
    return replicates.compare(tables.read_replicates(spark, pattern))


def learn(table: DataFrame, cfg: RunConfig = RunConfig()) -> dict[str, DataFrame]:
    """Components, rank tests over them, and boosted trees on features and on component scores."""
    from ..operators import stats

    table = ml.without_unused(table, cfg.arrest_limit)
    matrix, steps = ml.prepared(table, cfg.ml, cfg.ml.min_samples)
    out = ml.pca(matrix, cfg.ml.explained)
    names = [c for c in out["pc_scores"].columns if c.startswith("PC")]
    out |= {f"figure_{k}": v for k, v in figures.pc_views(out["pc_scores"]).items()}
    long = out["pc_scores"].unpivot(["object_id", "category"], names, "feature", "value")
    out |= {"kruskal": stats.kruskal_wallis(long).withColumnRenamed("feature", "pc"), "dunn": stats.dunn(long).withColumnRenamed("feature", "pc")}
    trees, _ = ml.prepared(table, cfg.ml, cfg.ml.min_samples_trees)
    out |= ml.boosted_trees(trees, cfg.ml)
    out |= {f"pairwise_{k}": v for k, v in ml.pairwise_trees(trees, cfg.ml).items()}
    out |= {f"pc_{k}": v for k, v in ml.boosted_trees(ml.enough_samples(out["pc_scores"], cfg.ml.min_samples_trees), cfg.ml).items()}
    return out | (steps if cfg.verbose else {})
