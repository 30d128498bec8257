"""Trees from shared histograms against boosting in plain Python, row by row."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.config import MLConfig
from trackspark.operators import boosting, ml
from trackspark.operators.boosting import Engine, Job, Params

NAMES = list("pqrs")


def table(n=90, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, len(NAMES))), 2)
    y = (np.abs(x[:, 0]) > 0.7).astype(int) + (x[:, 1] + 0.4 * rng.normal(size=n) > 0.3) * (classes - 2)
    return x, y


def packed(spark, x, y, how):
    rows = spark.createDataFrame([(i, int(c), i, [*map(float, r)]) for i, (r, c) in enumerate(zip(x, y))], "object_id long, label int, place long, features array<double>").repartition(3)
    edges = boosting.cuts(rows, x.shape[1], how)
    return boosting.blocks(rows, edges, how), edges


def plain(x, y, classes, p, edges):
    """Margins of all rows after each round, and (feature, gain) of each split."""
    cut_off = lambda g: math.copysign(max(abs(g) - p.reg_alpha, 0), g)
    worth = lambda g, h: cut_off(g) ** 2 / max(h + p.reg_lambda, 1e-16)
    n = len(x)
    margin, splits = [[0.0] * classes for _ in range(n)], []

    def grow(rows, g, h, depth):
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        leaf = ("leaf", -p.learning_rate * cut_off(total_g) / max(total_h + p.reg_lambda, 1e-16))
        best = None
        if depth < p.max_depth:
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    left = [i for i in rows if x[i][f] < cut]
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    if hl < p.min_child_weight or total_h - hl < p.min_child_weight:
                        continue
                    gain = worth(gl, hl) + worth(total_g - gl, total_h - hl) - worth(total_g, total_h)
                    if best is None or round(gain, 9) > round(best[0], 9):
                        best = gain, f, cut
        if best is None or best[0] <= 1e-6:
            return leaf, []
        gain, f, cut = best
        left, more = grow([i for i in rows if x[i][f] < cut], g, h, depth + 1)
        right, others = grow([i for i in rows if x[i][f] >= cut], g, h, depth + 1)
        if left[0] == right[0] == "leaf" and gain < p.gamma:
            return leaf, []
        return ("split", f, cut, left, right), [(f, gain), *more, *others]

    def value(tree, row):
        while tree[0] == "split":
            tree = tree[3] if row[tree[1]] < tree[2] else tree[4]
        return tree[1]

    for _ in range(p.n_estimators):
        shares = []
        for m in margin:
            e = [math.exp(v - max(m)) for v in m]
            shares.append([v / sum(e) for v in e])
        trees = []
        for c in range(classes):
            tree, made = grow(range(n), [s[c] - (y[i] == c) for i, s in enumerate(shares)], [max(2 * s[c] * (1 - s[c]), 1e-16) for s in shares], 0)
            trees.append(tree)
            splits += made
        for i in range(n):
            for c in range(classes):
                margin[i][c] += value(trees[c], x[i])
    return np.array(margin), splits


@pytest.mark.parametrize("params", [Params(4, 0.3, 3), Params(3, 0.2, 2, gamma=3.0, min_child_weight=3, reg_alpha=0.5, reg_lambda=0.1)])
def test_trees_are_plain_boosting(spark, params):
    x, y = table()
    how = Engine(bins=8, block_rows=16, refresh=2)
    rows, edges = packed(spark, x, y, how)
    (model,) = boosting.train(rows, [Job((0, 1, 2), params, (90, 90, 90))], len(NAMES), how)
    bins = np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)
    want, splits = plain(x.tolist(), y.tolist(), 3, params, edges)
    assert np.allclose(boosting.margins(model.rounds, bins, 3), want, atol=1e-9)
    gains = [[g for f, g in splits if f == k] for k in range(len(NAMES))]
    mean = np.array([np.mean(g) if g else 0.0 for g in gains])
    assert np.allclose(model.gains(len(NAMES)), mean / mean.sum())


def test_models_share_passes(spark):
    """Models of other rows, categories and parameters come out of shared passes as they do alone."""
    x, y = table()
    how = Engine(bins=8, block_rows=32, refresh=1)
    rows, _ = packed(spark, x, y, how)
    jobs = [Job((0, 1, 2), Params(2, 0.3, 2), (60, 60, 60), 3, 1), Job((0, 2), Params(3, 0.1, 3, subsample=0.7), (90, 50, 90)[:2]), Job((0, 1, 2), Params(1, 0.3, 1, colsample_bytree=0.5), (90,) * 3)]
    together = boosting.train(rows, jobs, len(NAMES), how)
    for job, model in zip(jobs, together):
        (alone,) = boosting.train(rows, [job], len(NAMES), replace(how, refresh=16))
        assert len(model.rounds) == job.params.n_estimators
        for a, b in zip((t for r in model.rounds for t in r), (t for r in alone.rounds for t in r)):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value)
    used = {int(f) for t in together[2].rounds[0] for f in t.feature if f >= 0}
    assert used <= {int(f) for c in range(3) for f in boosting.columns_of(jobs[2], 0, c, len(NAMES))}
    u = boosting.uniform(np.arange(10_000), 3)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02


def test_best_draw_wins(spark):
    x, y = table(120)
    df = spark.createDataFrame([(i, f"c{c}", *map(float, r)) for i, (r, c) in enumerate(zip(x, y))], "object_id long, category string, p double, q double, r double, s double")
    grid = {"n_estimators": [1, 6], "max_depth": [1, 3]}
    found = ml.boosted_trees(df, MLConfig(draws=4, grid=grid))
    chosen = found["tree_hyperparams"].first().params
    assert "'n_estimators': 6" in chosen and "'max_depth': 3" in chosen
    rows = found["tree_report"].collect()
    assert {r.category for r in rows} == {"c0", "c1", "c2"} and rows[0].accuracy > 0.6
    assert sum(r.support for r in rows) == sum(len(m) - int(len(m) * 0.6) for m in ([i for i in y if i == c] for c in range(3)))


def test_parts_of_a_pass_do_not_grow_with_the_rows(spark):
    """Each part of the blocks sends its histograms in each pass, so there are no more of them than tasks at once; no row is lost."""
    rows = spark.range(5000).select(F.col("id").alias("object_id"), (F.col("id") % 3).cast("int").alias("label"), F.floor(F.col("id") / 3).alias("place"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features")).repartition(97)
    how = boosting.Engine(block_rows=16)
    packed = boosting.blocks(rows, boosting.cuts(rows, 2, how), how)
    assert packed.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert packed.agg(F.sum("n")).first()[0] == 5000
