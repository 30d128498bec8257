"""Comparison of categories over the replicates of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from . import stats


def long_features(summary: DataFrame) -> DataFrame:
    """feature, category, replicate and value of every numeric feature."""
    names = [f.name for f in summary.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name != "object_id"]
    return summary.select("category", "replicate", *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["category", "replicate"], names, "feature", "value")


def replicate_medians(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", "category", "replicate").agg(F.median("value").alias("median"), F.count("value").alias("n"))


def category_medians(medians: DataFrame) -> DataFrame:
    return medians.groupBy("feature", "category").agg(F.median("median").alias("median"), F.count("*").alias("n"))


def replicate_stats(medians: DataFrame) -> DataFrame:
    """Rank tests between categories over replicate medians; features with one value only are marked as skipped.

    The medians are few and read by several tests, so they are written once and what they come from is evaluated once.
    """
    rows = staged(medians.select("feature", "category", F.col("median").alias("value")), "medians")
    spread = rows.groupBy("feature").agg(F.count_distinct("value").alias("values"), F.count("*").alias("n"))
    varied = rows.join(spread.where("values > 1"), "feature", "left_semi")
    none = F.lit(None).cast("double")
    skipped = spread.where("values <= 1").select("feature", F.lit("skipped").alias("test"), F.lit("all").alias("comparison"), none.alias("statistic"), none.alias("p_value"), "n")
    whole = stats.kruskal_wallis(varied).join(spread, "feature").select("feature", F.lit("kruskal").alias("test"), F.lit("all").alias("comparison"), F.col("h").alias("statistic"), F.col("p").alias("p_value"), "n")
    pairs = stats.dunn(varied).join(spread, "feature").select("feature", F.lit("dunn").alias("test"), F.concat_ws(" vs ", "cat_a", "cat_b").alias("comparison"), F.col("z").alias("statistic"), F.col("p_holm").alias("p_value"), "n")
    return skipped.unionByName(whole).unionByName(pairs)


def compare(summary: DataFrame) -> dict[str, DataFrame]:
    """All tables of a comparison of replicates, from summaries with a column ``replicate``."""
    medians = replicate_medians(long_features(summary))
    return {"replicate_medians": medians, "category_medians": category_medians(medians), "replicate_stats": replicate_stats(medians)}
