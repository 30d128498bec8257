"""Feature preparation, PCA, boosted trees and their reports."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MLConfig
from ..functions.ordering import sums_before
from ..functions.staging import staged
from .boosting import Engine, Job, Model, Params, blocks, cuts, predictions, train


#: Of the tables of pairs, whose size is that of the features squared and so independent of the rows.
CORRELATIONS = "feature_a string, feature_b string, correlation double"


def features_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("object_id", "category")]


def chosen_categories(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.where(F.col("category").isin(list(names))) if names else df


def enough_samples(df: DataFrame, least: int) -> DataFrame:
    """Objects of categories with at least ``least`` of them."""
    kept = df.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("category")
    return df.join(kept, "category", "left_semi")


def without_unused(df: DataFrame, arrest_limit: float) -> DataFrame:
    """Without an arrest coefficient that was not asked for, and a hull volume that is 0 throughout, as in two dimensions."""
    hull = "convex_hull_volume" in df.columns and df.where("convex_hull_volume <> 0").limit(1).count() == 0
    return df.drop(*(["arrest_coefficient"] if arrest_limit == 0 else []), *(["convex_hull_volume"] if hull else []))


def moving_only(df: DataFrame, on: bool) -> DataFrame:
    return df.where("mean_velocity <> 0 or median_velocity <> 0") if on else df


def _whole(df: DataFrame) -> DataFrame:
    """The rows without a null, their features as one array, so that the plan is as large for many features as for few."""
    rows = df.select("object_id", "category", F.array(*(F.col(f"`{c}`").cast("double") for c in features_of(df))).alias("features"))
    return rows.where(~F.exists("features", F.isnull))


def signed_log(df: DataFrame) -> DataFrame:
    """sign(x) ln(1 + |x|) of every feature; rows with a null go."""
    logs = F.transform("features", lambda x: F.signum(x) * F.log1p(F.abs(x)))
    # Taken out of a list of one: the optimizer doesn't move later filters below a generator, where they'd transform all features again for each one.
    logs = _whole(df).select("object_id", "category", F.explode(F.array(logs)).alias("features"))
    return logs.select("object_id", "category", *(F.col("features")[i].alias(c) for i, c in enumerate(features_of(df))))


def moments(df: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population variance of each feature over the rows without a null, in one aggregate; empty without rows."""
    found = _whole(df).select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features")).alias("s")).select("s.*").first()
    n = found["count"] if found["count"] else 0
    return (found["mean"].tolist(), [v * (n - 1) / n for v in found["variance"]]) if n else ([], [])


def standardized(df: DataFrame) -> DataFrame:
    """z-scores with the population deviation; 0 for a constant feature."""
    means, variances = moments(df)
    if not means:
        return df
    z = lambda c, m, v: (F.col(f"`{c}`") - F.lit(m)) / F.lit(math.sqrt(v) if v > 1e-24 else 1.0)
    return df.select("object_id", "category", *(z(*x).alias(x[0]) for x in zip(features_of(df), means, variances)))


def varying(df: DataFrame, least: float) -> DataFrame:
    """Features whose population variance exceeds ``least``."""
    return df.select("object_id", "category", *(F.col(f"`{c}`") for c, v in zip(features_of(df), moments(df)[1]) if v > least))


def correlations(df: DataFrame) -> DataFrame:
    """feature_a < feature_b and their Pearson correlation, null for a constant feature; rows with a null are left out.

    A row is one vector, and tasks sum up matrices of its products, so the plan is as large for many features as for few.
    """
    spark, names = df.sparkSession, sorted(features_of(df))
    rows = _whole(df.select("object_id", "category", *(F.col(f"`{c}`") for c in names))).select(array_to_vector("features").alias("features"))
    if len(names) < 2 or not rows.limit(2).count():
        return spark.createDataFrame([], CORRELATIONS)
    found = Correlation.corr(rows, "features").first()[0].toArray()
    return spark.createDataFrame([(names[i], names[j], None if math.isnan(found[i, j]) else float(found[i, j])) for i, j in combinations(range(len(names)), 2)], CORRELATIONS)


def correlated_groups(names: list[str], pairs: list[tuple[str, str, float]], threshold: float) -> list[list[str]]:
    """Features grouped greedily by falling correlation; groups never merge, members are sorted, and the rest stand alone in order."""
    group: dict[str, list[str]] = {}
    out: list[list[str]] = []
    for a, b, r in sorted(pairs, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if abs(r) < threshold:
            break
        if a in group and b not in group:
            group[a].append(b)
            group[b] = group[a]
        elif b in group and a not in group:
            group[b].append(a)
            group[a] = group[b]
        elif a not in group:
            group[a] = group[b] = [a, b]
            out.append(group[a])
    return [sorted(g) for g in out] + [[c] for c in names if c not in group]


def aggregated(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Each group's mean, named by its members."""
    mean = lambda g: reduce(lambda a, b: a + b, (F.col(f"`{c}`") for c in g)) / len(g)
    return df.select("object_id", "category", *(mean(g).alias(", ".join(g)) for g in groups))


def decisions(pairs: list[tuple[str, str, float]], groups: list[list[str]], threshold: float) -> list[tuple]:
    """Per pair: correlation, whether it meets the threshold, whether grouped, and the group's number."""
    number = {c: i for i, g in enumerate(groups) for c in g if len(g) > 1}
    return [(a, b, r, abs(r) >= threshold, a in number and number.get(a) == number.get(b), number.get(a), number.get(b)) for a, b, r in sorted(pairs, key=lambda p: -abs(p[2]))]


def prepared(summary: DataFrame, cfg: MLConfig, least: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The feature matrix, and the steps on the way to it. Logarithms are written once, as moments and correlations pass over them several times."""
    spark = summary.sparkSession
    chosen = moving_only(enough_samples(chosen_categories(summary, cfg.categories), least), cfg.drop_non_moving)
    logged = staged(signed_log(chosen), "logged")
    scaled = varying(standardized(logged), cfg.variance)
    pairs = [(r["feature_a"], r["feature_b"], r["correlation"] or 0.0) for r in correlations(scaled).collect()]
    groups = correlated_groups(features_of(scaled), pairs, cfg.correlation)
    matrix = aggregated(scaled, groups)
    table = spark.createDataFrame(decisions(pairs, groups, cfg.correlation), "feature_a string, feature_b string, correlation double, meets boolean, grouped boolean, group_a int, group_b int")
    return matrix, {"filtered_categories": chosen, "signed_log": logged, "standardized": scaled, "feature_correlations": table, "aggregated_features": matrix}


def assembled(df: DataFrame) -> DataFrame:
    names = features_of(df)
    safe = df.select("object_id", "category", *(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features").transform(safe).select("object_id", "category", "features")


def pca(df: DataFrame, explained: float = 0.95) -> dict[str, DataFrame]:
    """Scores, explained variance and loadings of the first components that explain the share, at least two.

    Scores are of centred features; a component's largest loading is positive.
    """
    names = features_of(df)
    if len(names) < 4 or df.limit(4).count() < 4:
        raise ValueError("PCA needs at least 4 objects and 4 features")
    spark = df.sparkSession
    means = df.agg(*(F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names))).first()
    rows = assembled(df.select("object_id", "category", *((F.col(f"`{c}`") - means[i]).alias(c) for i, c in enumerate(names))))
    model = PCA(k=len(names), inputCol="features", outputCol="pcs").fit(rows)
    share = model.explainedVariance.toArray()
    k = max(2, int(np.searchsorted(np.cumsum(share), explained - 1e-12) + 1))
    axes = model.pc.toArray()[:, :k]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    scores = model.transform(rows).withColumn("pcs", vector_to_array("pcs"))
    return {
        "pc_scores": scores.select("object_id", "category", *((F.col("pcs")[i] * float(signs[i])).alias(f"PC{i + 1}") for i in range(k))),
        "explained_variance": spark.createDataFrame([(f"PC{i + 1}", float(share[i])) for i in range(k)], "pc string, ratio double"),
        "loadings": spark.createDataFrame([(c, *map(float, axes[i] * signs)) for i, c in enumerate(names)], "feature string, " + ", ".join(f"PC{i + 1} double" for i in range(k))),
    }


def _numbered(df: DataFrame, seed: int) -> DataFrame:
    """``__before`` and ``__all``: rows of the category that come earlier by a hash of the object, and all of them."""
    code = F.md5(F.concat_ws(":", F.lit(seed), F.col("object_id")))
    return sums_before(df.withColumn("__code", code), ["category"], F.substring("__code", 1, 2), ["__code"], F.lit(1), "__before", "__all").drop("__code")


def split(df: DataFrame, test_share: float = 0.4, seed: int = 42) -> DataFrame:
    """``test`` per category by the order of a hash of the object."""
    return _numbered(df, seed).withColumn("test", F.col("__before") + 1 > F.col("__all") * F.lit(1 - test_share)).drop("__before", "__all")


def folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``fold`` 0 .. k - 1 per category by the order of a hash."""
    return _numbered(df, seed).withColumn("fold", F.col("__before") % k).drop("__before", "__all")


def report(predicted: DataFrame, *keys: str, rows: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per category, and accuracy, from (category, prediction), each standing for as many as column ``rows`` says; for each of ``keys`` by itself."""
    counts = predicted.groupBy(*keys, "category", "prediction").agg((F.sum(rows) if rows else F.count("*")).alias("n"))
    hits = counts.where("category = prediction").select(*keys, "category", F.col("n").alias("hit"))
    support = counts.groupBy(*keys, "category").agg(F.sum("n").alias("support"))
    called = counts.groupBy(*keys, F.col("prediction").alias("category")).agg(F.sum("n").alias("called"))
    joined = support.join(called, [*keys, "category"], "left").join(hits, [*keys, "category"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    zero = F.lit(0.0)
    shares = joined.select(*keys, "category", F.coalesce(F.try_divide("hit", "called"), zero).alias("precision"), F.coalesce(F.try_divide("hit", "support"), zero).alias("recall"), "support", "hit")
    shares = shares.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    return shares.select(*keys, "category", "precision", "recall", "f1", "support", (F.sum("hit").over(whole) / F.sum("support").over(whole)).alias("accuracy"))


#: The hyper-parameters searched, by whether two categories are compared and whether there are at least 50 objects, and how many points are drawn.
GRIDS = {
    (True, False): {"n_estimators": [50, 100], "learning_rate": [0.1, 0.2], "max_depth": [3, 4], "gamma": [0.0, 0.1], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 3], "reg_alpha": [0.0, 0.1], "reg_lambda": [0.0, 0.1]},
    (True, True): {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5, 7], "gamma": [0.0, 0.1], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 3], "reg_alpha": [0.0, 0.1], "reg_lambda": [0.0, 0.1]},
    (False, False): {"n_estimators": [50, 100, 200], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [2, 3, 4], "gamma": [0.0, 0.1], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 3], "reg_alpha": [0.0, 0.1], "reg_lambda": [0.0, 0.1]},
    (False, True): {"n_estimators": [100, 200, 300, 500], "learning_rate": [0.01, 0.05, 0.1, 0.2, 0.3], "max_depth": [3, 5, 7, 9], "gamma": [0.0, 0.05, 0.1, 0.2], "subsample": [0.6, 0.8, 1.0], "colsample_bytree": [0.6, 0.8, 1.0], "min_child_weight": [1, 3, 5], "reg_alpha": [0.0, 0.1, 0.5], "reg_lambda": [0.0, 0.1, 0.5]},
}
DRAWS = {(True, False): 25, (True, True): 50, (False, False): 50, (False, True): 100}


def drawn_grid(grid: dict[str, list], draws: int, seed: int) -> list[dict]:
    """``draws`` different points of the grid, at most all of them, by a seeded draw."""
    values, sizes = list(grid.values()), [len(v) for v in grid.values()]
    total = math.prod(sizes)
    chosen = np.random.default_rng(seed).choice(total, min(draws, total), replace=False)
    return [{n: v[i] for n, v, i in zip(grid, values, np.unravel_index(c, sizes))} for c in chosen.tolist()]


@dataclass
class Comparison:
    """Categories to tell apart: folds ``k`` where one of them is small, else 0 for a split; how many rows of each are for training."""

    labels: tuple[int, ...]
    k: int
    limits: tuple[int, ...]
    params: Params

    @property
    def method(self) -> str:
        return f"{self.k}-fold" if self.k else "split"


def _accuracies(packed: DataFrame, models: list[Model], features: int) -> dict[int, float]:
    """The share of right predictions of each model."""
    found = predictions(packed, models, features).groupBy("job").agg((F.sum(F.when(F.col("label") == F.col("said"), F.col("n"))) / F.sum("n")).alias("share"))
    return {r["job"]: r["share"] or 0.0 for r in found.collect()}


def searched(packed: DataFrame, comparisons: list[Comparison], features: int, cfg: MLConfig, pairwise: bool) -> None:
    """Gives each comparison the most accurate of the drawn points in cross-validation over its training rows; of equals the first.

    The candidates and folds of all comparisons are trained in the same passes.
    """
    jobs, points = [], []
    for i, x in enumerate(comparisons):
        kind = pairwise, sum(x.limits) >= 50
        for j, point in enumerate(drawn_grid(cfg.grid or GRIDS[kind], cfg.draws or DRAWS[kind], cfg.seed)):
            params = replace(x.params, **point)
            for fold in range(x.k or 3):
                jobs.append(Job(x.labels, params, x.limits, x.k or 3, fold, cfg.seed))
                points.append((i, j, params))
    shares = _accuracies(packed, train(packed, jobs, features), features)
    scores: dict[int, dict[int, list]] = {}
    for n, (i, j, params) in enumerate(points):
        scores.setdefault(i, {}).setdefault(j, [0.0, params])[0] += shares.get(n, 0.0) / (comparisons[i].k or 3)
    for i, found in scores.items():
        comparisons[i].params = max(found.items(), key=lambda x: (round(x[1][0], 12), -x[0]))[1][1]


def _compared(df: DataFrame, cfg: MLConfig, sets: Callable[[int], list[tuple[int, ...]]], pairwise: bool) -> dict[str, DataFrame]:
    """Importances, report and parameters of boosted trees for each set of categories, with the categories' names of pairs."""
    spark, names = df.sparkSession, features_of(df)
    counts = {r["category"]: r["n"] for r in df.groupBy("category").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    comparisons = []
    for chosen in sets(len(labels)):
        n = [counts[labels[i]] for i in chosen]
        k = min(5, max(2, min(n))) if min(n) < cfg.min_samples_trees else 0
        comparisons.append(Comparison(chosen, k, tuple(n if k else (int(x * (1 - cfg.test_share)) for x in n)), Params(n_estimators=cfg.trees, max_depth=cfg.depth, learning_rate=cfg.learning_rate)))
    if not comparisons:
        return {}
    # A category's name, number and place of rows in it are all that training needs beside the features.
    numbered = _numbered(_whole(df), cfg.seed)
    rows = numbered.select("object_id", (F.array_position(F.array(*map(F.lit, labels)), F.col("category")) - 1).cast("int").alias("label"), F.col("__before").alias("place"), "features").persist()
    how = Engine()
    packed = blocks(rows, cuts(rows, len(names), how), how).persist()
    if cfg.search:
        searched(packed, comparisons, len(names), cfg, pairwise)
    jobs = [(i, Job(x.labels, x.params, x.limits, x.k, fold, cfg.seed)) for i, x in enumerate(comparisons) for fold in (range(x.k) if x.k else (None,))]
    models = train(packed, [j for _, j in jobs], len(names), how)
    said = spark.createDataFrame(predictions(packed, models, len(names)).collect(), "job long, label long, said long, n long")
    packed.unpersist()
    rows.unpersist()
    cats = lambda x: [labels[i] for i in x.labels] if pairwise else []
    keys, kinds = (["cat_a", "cat_b"], "cat_a string, cat_b string, ") if pairwise else ([], "")
    ranked = []
    for i, x in enumerate(comparisons):
        gains = np.mean([m.gains(len(names)) for (c, _), m in zip(jobs, models) if c == i], axis=0)
        ranked += [(*cats(x), c, float(g)) for c, g in sorted(zip(names, gains), key=lambda e: -e[1])]
    of = spark.createDataFrame([(j, *cats(comparisons[i]), comparisons[i].method) for j, (i, _) in enumerate(jobs)], f"job long, {kinds}method string")
    name = lambda c: F.element_at(F.array(*map(F.lit, labels)), F.col(c).cast("int") + 1)
    told = said.join(of, "job").select(*keys, "method", name("label").alias("category"), name("said").alias("prediction"), "n")
    return {
        "tree_features": spark.createDataFrame(ranked, f"{kinds}feature string, importance double"),
        "tree_report": report(told, *keys, "method", rows="n").select(*keys, "category", "precision", "recall", "f1", "support", "accuracy", "method"),
        "tree_hyperparams": spark.createDataFrame([(*cats(x), "pair" if pairwise else "full", x.method, str(asdict(x.params))) for x in comparisons], f"{kinds}run string, method string, params string"),
    }


def boosted_trees(df: DataFrame, cfg: MLConfig) -> dict[str, DataFrame]:
    """Importances, report and parameters of boosted trees that tell all categories apart in one model.

    Unless ``cfg.search`` is off, hyper-parameters are searched, else they are those of ``cfg``. Where a category has
    few rows, models are trained on folds and the report is of the rows held out of each; rows with a null are left out.
    """
    return _compared(df, cfg, lambda n: [tuple(range(n))], False)


def pairwise_trees(df: DataFrame, cfg: MLConfig) -> dict[str, DataFrame]:
    """The same for each two categories, where there are more than two; all pairs are trained in the same passes."""
    return _compared(df, cfg, lambda n: list(combinations(range(n), 2)) if n > 2 else [], True)
