"""Rank tests over a long table (feature, category, value); all features in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import sums_before
from ..functions.staging import staged
from ..functions.tails import chi2_sf, normal_two_sided


def ranked(long: DataFrame, buckets: int = 64) -> DataFrame:
    """Each distinct value of a feature, its rows (``tie``) and their average rank.

    Values are counted first; of each feature they are dealt into ranges of about equal size, which are added up and
    ordered by themselves. They are written once, by a job of its own, with their ranges, whose approximate edges may
    differ from one evaluation to the next.
    """
    rows = long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("tie"))
    edges = rows.groupBy("feature").agg(F.percentile_approx("value", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 1000).alias("edges"))
    dealt = rows.join(edges, "feature").withColumn("range", F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
    dealt = staged(dealt, "ranks")
    found = sums_before(dealt, ["feature"], F.col("range"), ["value"], F.col("tie"), "before", "total")
    return found.select("feature", "value", "tie", (F.col("before") + (F.col("tie") + 1) / 2.0).alias("rank"))


def _groups(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranks = ranked(long)
    counts = long.where("value is not null").groupBy("feature", "category", "value").agg(F.count("*").alias("n"))
    per = counts.join(ranks, ["feature", "value"]).groupBy("feature", "category").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = F.col("tie").cast("double")
    whole = ranks.groupBy("feature").agg(F.sum("tie").alias("total"), F.sum(ties * ties * ties - ties).alias("ties"))
    return per, whole


def kruskal_wallis(long: DataFrame) -> DataFrame:
    """feature, h (tie-corrected), groups and p."""
    per, whole = _groups(long)
    found = per.groupBy("feature").agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("groups")).join(whole, "feature")
    n = F.col("total").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.try_divide(F.col("ties"), n * n * n - n), F.lit(0.0))

    @F.pandas_udf("double")
    def tail(h: pd.Series, groups: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else chi2_sf(x, int(g) - 1) for x, g in zip(h, groups)], dtype="float64")

    return found.select("feature", h.alias("h"), "groups").withColumn("p", tail("h", "groups"))


def dunn(long: DataFrame) -> DataFrame:
    """feature, cat_a < cat_b, z, p and Holm's step-down p of all pairs of categories."""
    per, whole = _groups(long)
    a = per.select("feature", F.col("category").alias("cat_a"), F.col("n").alias("na"), (F.col("r") / F.col("n")).alias("ma"))
    b = per.select("feature", F.col("category").alias("cat_b"), F.col("n").alias("nb"), (F.col("r") / F.col("n")).alias("mb"))
    n = F.col("total").cast("double")
    variance = (n * (n + 1) / 12.0 - F.try_divide(F.col("ties"), 12.0 * (n - 1))) * (1.0 / F.col("na") + 1.0 / F.col("nb"))
    z = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(variance))
    found = a.join(b, "feature").where("cat_a < cat_b").join(whole, "feature").select("feature", "cat_a", "cat_b", z.alias("z"))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: None if pd.isna(x) else normal_two_sided(x)).astype("float64")

    w = Window.partitionBy("feature").orderBy("p", "cat_a", "cat_b")
    pairs = F.count("*").over(Window.partitionBy("feature"))
    stepped = found.withColumn("p", tail("z")).withColumn("step", F.least(F.lit(1.0), F.col("p") * (pairs - F.row_number().over(w) + 1)))
    return stepped.select("feature", "cat_a", "cat_b", "z", "p", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p_holm"))
