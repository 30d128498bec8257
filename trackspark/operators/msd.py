"""Mean squared displacement, its summaries and log-log fits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import sums_before
from ..functions.pieces import Pieces
from .kinematics import lagged


def msd(segments: DataFrame, tau: int, pieces: Pieces | None = None) -> DataFrame:
    """Mean of the squared displacements over 0 per object and lag."""
    return lagged(segments, tau, pieces).where("sq > 0").groupBy("object_id", "tau").agg(F.avg("sq").alias("msd"))


def msd_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("tau").agg(F.avg("msd").alias("mean"), F.stddev_samp("msd").alias("stdev"))


def msd_by_category(long: DataFrame, categories: DataFrame) -> DataFrame:
    return long.join(categories, "object_id").groupBy("tau", "category").agg(F.avg("msd").alias("mean"), F.stddev_samp("msd").alias("stdev"))


def max_msd(long: DataFrame) -> DataFrame:
    return long.groupBy("object_id").agg(F.max("msd").alias("maximum_msd"))


def loglog_points(long: DataFrame, categories: DataFrame) -> DataFrame:
    """log10 of lag and MSD, where both are over 0."""
    rows = long.join(categories, "object_id").where("tau > 0 and msd > 0")
    return rows.select("object_id", "category", "tau", "msd", F.log10("tau").alias("log_tau"), F.log10("msd").alias("log_msd"))


def category_curve(points: DataFrame, *keys: str) -> DataFrame:
    """Mean of the logarithms per category and lag."""
    keys = keys or ("category",)
    return points.groupBy(*keys, "tau", "log_tau").agg(F.avg("log_msd").alias("log_msd"))


def prefix_fit(curve: DataFrame, *keys: str, r2: float = 0.995, least: int = 4) -> DataFrame:
    """Line through the longest prefix, of at least ``least`` lags, each of whose prefixes is linear to ``r2``.

    Prefixes are running regressions; the first that fails ends the fit, and if the shortest fails it is the fit.
    """
    keys = keys or ("category",)
    w = Window.partitionBy(*keys).orderBy("log_tau")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    flat = F.max("log_msd").over(run) == F.min("log_msd").over(run)
    fits = curve.select(*keys, "tau", "log_tau", "log_msd", F.row_number().over(w).alias("pos"), F.when(flat, 0.0).otherwise(F.regr_r2("log_msd", "log_tau").over(run)).alias("run_r2"))
    failed = F.min(F.when((F.col("pos") >= least) & (F.coalesce("run_r2", F.lit(0.0)) < r2), F.col("pos"))).over(Window.partitionBy(*keys))
    end = fits.withColumn("last", F.greatest(F.lit(least), F.coalesce(failed - 1, F.lit(2**31 - 1)))).where("pos <= last")
    level = F.max("log_msd") == F.min("log_msd")
    return end.groupBy(*keys).agg(F.regr_slope("log_msd", "log_tau").alias("slope"), F.when(level, 0.0).otherwise(F.regr_r2("log_msd", "log_tau")).alias("r2"), F.max("tau").alias("max_tau"), F.count("*").alias("points"))


#: Objects whose curves are one matrix.
BLOCK = 4096
#: Tasks that draw, and those that multiply blocks.
DRAW_TASKS, BLOCK_TASKS = 256, 64


def _code(*parts: Column) -> Column:
    """A number from the first eight digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _block_draws(sizes: DataFrame, samples: int, seed: int, block: int) -> DataFrame:
    """For each block of a category's objects, how many of the draws of each sample fall into it: ``drawn``, an array of (boot, n).

    A sample of n objects is n draws of a place below n; a category of one block gets them all. Others draw in chunks,
    which are counted where they are drawn, so what is shuffled grows with samples and blocks. Chunks are small rows
    that make much work, so they go to a fixed number of tasks, which are not merged for their size.
    """
    boots = sizes.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    whole = boots.where(F.col("n") <= block).select("category", "boot", F.lit(0).cast("long").alias("block"), F.col("n").alias("count"))
    chunks = boots.where(F.col("n") > block).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 4096)))).repartition(DRAW_TASKS, "category", "boot", "chunk")
    each = chunks.withColumn("draw", F.explode(F.sequence(F.col("chunk") * 4096 + 1, F.least(F.col("n"), F.col("chunk") * 4096 + 4096))))
    dealt = each.select("category", "boot", F.floor((_code(F.lit(seed), F.col("category"), F.col("boot"), F.col("draw")) % F.col("n")) / block).alias("block"))
    counts = whole.unionByName(dealt.groupBy("category", "boot", "block").agg(F.count("*").alias("count")))
    return counts.groupBy("category", "block").agg(F.collect_list(F.struct("boot", F.col("count").alias("n"))).alias("drawn"))


def weights(base: int, n: int, size: int) -> np.ndarray:
    """How often each of ``size`` objects is drawn in ``n`` draws, hashes of their number by the finalizer of MurmurHash3."""
    x = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B9) + np.uint64(base)).astype(np.uint32)
    x = (x ^ (x >> 16)) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> 13)) * np.uint32(0xC2B2AE35)
    return np.bincount((x ^ (x >> 16)) % np.uint32(size), minlength=size)


def bootstrap_curves(points: DataFrame, samples: int, seed: int, block: int = BLOCK) -> DataFrame:
    """The mean curve of each sample of objects: a block's weights times the matrix of its objects' points, added up over blocks."""
    curves = points.groupBy("category", "object_id").agg(F.collect_list(F.struct("tau", "log_tau", "log_msd")).alias("points"))
    ranked = sums_before(curves, ["category"], F.shiftright(F.col("object_id"), 12), ["object_id"], F.lit(1), "place", "n")
    packed = ranked.withColumn("block", F.floor(F.col("place") / block)).repartition(BLOCK_TASKS, "category", "block").groupBy("category", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "points"))).alias("objects"))
    drawn = _block_draws(curves.groupBy("category").agg(F.count("*").alias("n")), samples, seed, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                taus = sorted({(p["tau"], p["log_tau"]) for o in row["objects"] for p in o["points"]})
                column = {t: i for i, (t, _) in enumerate(taus)}
                values, there = np.zeros((2, len(row["objects"]), len(taus)))
                for i, o in enumerate(row["objects"]):
                    for p in o["points"]:
                        values[i, column[p["tau"]]], there[i, column[p["tau"]]] = p["log_msd"], 1
                boots = [d["boot"] for d in row["drawn"]]
                base = lambda boot: int(hashlib.md5(f"{seed}:{row['category']}:{boot}:{row['block']}".encode()).hexdigest()[:8], 16)
                often = np.array([weights(base(d["boot"]), d["n"], len(row["objects"])) for d in row["drawn"]], float)
                sums, counts = often @ values, often @ there
                k = len(taus)
                columns = [[row["category"]] * len(boots) * k, np.repeat(boots, k), np.tile([t for t, _ in taus], len(boots)), np.tile([x for _, x in taus], len(boots)), sums.ravel(), counts.ravel()]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["category", "boot", "tau", "log_tau", "sum", "count"])

    each = packed.join(drawn, ["category", "block"]).mapInArrow(run, "category string, boot int, tau int, log_tau double, sum double, count double")
    total = each.groupBy("category", "boot", "tau", "log_tau").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    return total.where("count > 0").select("category", "boot", "tau", "log_tau", (F.col("sum") / F.col("count")).alias("log_msd"))


def bootstrap_slopes(points: DataFrame, samples: int = 1000, seed: int = 42, r2: float = 0.995) -> DataFrame:
    """The fitted slope of each sample of objects."""
    return prefix_fit(bootstrap_curves(points, samples, seed), "category", "boot", r2=r2).where("points >= 4")


def loglog_fits(points: DataFrame, samples: int = 1000, seed: int = 42, r2: float = 0.995, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Slope, its bootstrap interval, R squared and last lag per category."""
    fit = prefix_fit(category_curve(points), r2=r2)
    interval = bootstrap_slopes(points, samples, seed, r2).groupBy("category").agg(F.percentile("slope", F.array(F.lit(low), F.lit(high))).alias("ci"))
    return fit.join(interval, "category", "left").select("category", "slope", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "r2", "max_tau")
