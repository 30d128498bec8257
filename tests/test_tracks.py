"""Hand-made tracks and independent references."""

import ast
import collections
import datetime
import hashlib
import math
import struct
import time
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.config import AttractorConfig, MLConfig, RunConfig, words
from trackspark.functions.selection import quantiles
from trackspark.functions.tails import chi2_sf, normal_two_sided
from trackspark.operators import attractors, boosting, contacts, figures, formatting, helicity, kinematics, ml, msd, replicates, shape, stats
from trackspark.operators import summary as features
from trackspark.plans import queries
from trackspark.plans import run as plan
from trackspark.sources import adapters, generator, tables

SCHEMA = "object_id long, time double, x double, y double, z double"


def track(spark, points, object_id=1):
    return spark.createDataFrame([(object_id, float(t), *map(float, p)) for t, p in points], SCHEMA)


def line(spark, n=10, step=4.0):
    return track(spark, [(t, (step * t, 0, 0)) for t in range(n)])


def only(df):
    (row,) = df.collect()
    return row


def test_line(spark):
    df = line(spark)
    g = only(features.geometry(kinematics.kinematics(df, 1.0, 3.0), 3.0))
    assert (g.duration, g.path_length, g.displacement_ratio) == (10, 36, 1)
    assert g.straightness == pytest.approx(math.sqrt(10))
    assert {r.tau: r.msd for r in msd.msd(df, 3).collect()} == {1: 16, 2: 64, 3: 144}
    # Only the second row has a filtered acceleration, so the nine statistics are 0; without a limit they aren't.
    assert only(features.statistics(kinematics.kinematics(df, 1.0, 3.0), 3.0, 4)).mean_velocity == 0
    assert only(features.statistics(kinematics.kinematics(df, 1.0, 0.0), 0.0, 4)).mean_velocity == 4
    assert only(shape.hull(df, 4)).convex_hull_volume == 0


def test_square_turns(spark):
    df = track(spark, enumerate([(0, 0, 0), (5, 0, 0), (5, 5, 0), (0, 5, 0), (0, 0, 0)]))
    medians = kinematics.angle_medians(kinematics.turning_angles(df, 2))
    assert {r.tau: round(r.median_angle) for r in medians.collect()} == {1: 90, 2: 180}
    assert only(kinematics.max_angle(medians)).median_turning_angle == pytest.approx(180)
    assert only(kinematics.max_angle(medians, True)).median_turning_angle == pytest.approx(135)


def test_still_and_jitter(spark):
    still = track(spark, [(t, (1, 1, 1)) for t in range(10)])
    assert only(features.geometry(kinematics.kinematics(still, 1.0, 3.0), 3.0)).arrest_coefficient == 0
    assert msd.msd(still, 3).count() == 0
    jitter = track(spark, [(t, (t % 2, 0, 0)) for t in range(10)])
    assert only(features.geometry(kinematics.kinematics(jitter, 1.0, 3.0), 3.0)).arrest_coefficient == pytest.approx(0.9)


def test_gaps(spark):
    gap = track(spark, [(t, (t, 0, 0)) for t in (0, 1, 3, 4)], 1)
    one = track(spark, [(7, (0, 0, 0))], 2)
    dup = track(spark, [(t, (t, 0, 0)) for t in (0, 1, 1, 2)], 3)
    df = gap.union(one).union(dup)
    kept = formatting.drop_gapped(df, 1.0)
    assert {r.object_id for r in kept.collect()} == {2}
    assert {r.object_id for r in formatting.removed_objects(df, kept).collect()} == {1, 3}
    assert {r.object_id for r in formatting.drop_gapped(formatting.average_duplicates(df), 1.0).collect()} == {2, 3}
    with pytest.raises(formatting.EmptyTracksError):
        formatting.require_tracks(formatting.drop_gapped(gap, 1.0))


def test_interpolation_is_numpys(spark):
    times, xs = [0, 0.9, 2.1, 3, 6.5], [0, 5, -1, 2, 9]
    found = formatting.interpolate(track(spark, [(t, (x, 2 * x, 0)) for t, x in zip(times, xs)]), 1.0).orderBy("time").collect()
    grid = np.arange(0, 7, 1.0)
    assert [r.time for r in found] == list(grid)
    assert np.allclose([r.x for r in found], np.interp(grid, times, xs))


def test_contacts(spark):
    a = track(spark, [(0, (0, 0, 0))], 9).union(track(spark, [(0, (0, 0, 0))], 10)).union(track(spark, [(0, (5, 5, 5))], 12))
    pairs = lambda df: {(r.object_id, r.object_compare) for r in df.collect()}
    box = contacts.contacts(a, 5.0)
    assert pairs(box) == {(9, 10), (9, 12), (10, 12)} == pairs(contacts.contacts(a, 5.0, cell=False))
    assert pairs(contacts.contacts(a, 5.0, euclidean=True)) == {(9, 10)}
    assert pairs(contacts.minus_dividing(box)) == {(9, 12), (10, 12)}


def test_daily_means_do_not_depend_on_files(spark, tmp_path):
    """Points are added in order of event, however they lie in files: who is just in reach is in reach in all of them."""
    day = datetime.datetime(2024, 1, 2, 3)
    values = {1: [0.1, 0.2, 0.3, 0.4, 0.7], 2: [5.0 + np.mean([0.1, 0.2, 0.3, 0.4, 0.7])], 3: [1e16, 1.0, -1e16, 1.0]}
    events = [(100 * (10 * u + k), day, u, float(v)) for u, row in values.items() for k, v in enumerate(row)]
    added = {u: float(np.cumsum(row)[-1]) / len(row) for u, row in values.items()}
    near = []
    for k, order in enumerate((events, events[::-1], events[1::2] + events[::2], events[2:] + events[:2])):
        folder = tmp_path / str(k)
        for i in range(0, len(order), 3):
            spark.createDataFrame(order[i : i + 3], "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        assert {r.object_id: (r.time, r.x, r.y, r.z) for r in adapters.day_tracks(spark, str(folder)).collect()} == {u: (1.0, x, 3.0, 0.0) for u, x in added.items()}
        near.append(sorted(map(tuple, queries.QUERIES["contacts_all"](spark, str(folder)).collect())))
    assert near == [near[0]] * 4 and near[0] == [(u, v, 1.0) for u, v in combinations(values, 2) if abs(added[u] - added[v]) <= 5.0]


@pytest.mark.parametrize("flat", [True, False])
@pytest.mark.parametrize("euclidean", [True, False])
def test_contacts_of_a_cluster(spark, flat, euclidean):
    """A crowd at one place and time: all pairs once, on cell edges and below 0 too, and the crowd is dealt into parts."""
    rng = np.random.default_rng(4)
    points = np.round(np.concatenate([rng.normal(0, 2, (400, 3)), rng.uniform(-40, 40, (200, 3))]) * 2) / 2
    points[:, 2] *= not flat
    rows = [(i, float(i % 3 == 0), *map(float, p)) for i, p in enumerate(points)] + [(900, 0.0, None, 1.0, 1.0), (901, 0.0, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "object_id long, time double, x double, y double, z double")
    far = lambda p, q: math.dist(p, q) if euclidean else max(map(abs, np.subtract(p, q)))
    want = sorted((a[0], b[0], a[1]) for a, b in combinations(rows[:600], 2) if a[1] == b[1] and far(a[2:], b[2:]) <= 2.5)
    for crowd in (50, 4096):
        assert sorted(map(tuple, contacts.contacts(df, 2.5, euclidean, crowd=crowd).collect())) == want
    other = df.withColumnRenamed("object_id", "object_compare")
    a, b = contacts.dealt(df, other, ["time"], 50)
    # 400 rows at the busier time in 8 parts; each part meets all rows of the other side.
    assert a.groupBy("time", "part").count().agg(F.max("count")).first()[0] < 100
    assert a.count() == df.count() and {r["count"] for r in b.where("time = 0").groupBy("part").count().collect()} == {402}


def test_quantiles_are_percentiles(spark):
    """Ties, a value of a third of the rows, null values, null keys, and groups without values."""
    rng = np.random.default_rng(6)
    rows = [("big", 1, float(v)) for v in np.concatenate([np.full(700, 0.25), rng.normal(0, 1, 1500)])]
    rows += [(None, 1, float(v)) for v in rng.integers(0, 5, 300)] + [("big", None, 3.0), ("none", 2, None), ("two", 2, 1.0), ("two", 2, 2.0), ("two", 2, None)]
    df = spark.createDataFrame(rows, "a string, b int, value double").repartition(5)
    steps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = {(r.a, r.b): (r.n, r.q) for r in df.groupBy("a", "b").agg(F.count("value").alias("n"), F.percentile("value", F.array(*map(F.lit, steps))).alias("q")).collect()}
    for buckets in (2, 64):
        found = {(r.a, r.b): (r.n, r.q) for r in quantiles(df, ["a", "b"], "value", steps, buckets).collect()}
        assert found.keys() == want.keys()
        for k, (n, q) in want.items():
            assert found[k][0] == n and (q is None) == (found[k][1] is None)
            assert q is None or found[k][1] == pytest.approx(q, abs=1e-12)
    assert quantiles(df.limit(0), ["a"], "value", [0.5]).count() == 0


def test_ranges_are_evaluated_once(spark):
    """Approximate edges are made before, so that sums and rows of ranges can't see different ones."""
    df = spark.range(3000).select(F.lit("f").alias("feature"), (F.col("id") % 3).cast("string").alias("category"), (F.col("id") % 1100).cast("double").alias("value"))
    for found in (quantiles(df, ["feature"], "value", [0.5]), stats.ranked(df)):
        assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert found.count()


def test_replicate_medians_are_evaluated_once(spark):
    """What the medians come from isn't evaluated again by each test over them."""
    medians = spark.range(12).select(F.lit("f").alias("feature"), (F.col("id") % 3).cast("string").alias("category"), F.col("id").cast("double").alias("median"))
    assert "Range (" not in replicates.replicate_stats(medians)._jdf.queryExecution().optimizedPlan().toString()


def fold(rows, cfg):
    """Attraction chains of one pair, row by row."""
    out, chain, gaps, last = [], [], 0, None

    def close():
        if len(chain) >= cfg.time_persistence and chain[-1][1] < chain[0][1] * cfg.approach_ratio and min(d for _, d in chain) <= cfg.min_proximity:
            out.extend(chain)

    for t, d in rows:
        if not 0 < d < cfg.distance_threshold:
            close()
            chain, gaps, last = [], 0, None
            continue
        if last is None or d < last:
            chain.append((t, d))
            gaps = 0
        elif gaps < cfg.max_gaps:
            chain.append((t, d))
            gaps += 1
        else:
            chain, gaps = [(t, d)], 0
        last = d
    close()
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 45), min_size=1, max_size=30), st.integers(0, 3))
def test_chains_are_the_folds(spark, distances, gaps):
    cfg = AttractorConfig(distance_threshold=40, approach_ratio=0.6, min_proximity=15, time_persistence=3, max_gaps=gaps)
    df = spark.createDataFrame([(1, "a", 2, "b", float(t), float(d)) for t, d in enumerate(distances)], "attractor_id long, attractor_type string, attracted_id long, attracted_type string, time double, distance double")
    found = sorted((r.time, r.distance) for r in attractors.events(df, cfg).collect())
    assert found == sorted(fold([(float(t), float(d)) for t, d in enumerate(distances)], cfg))


def test_attraction_in_blocks(spark):
    """Tracks compared by blocks give the chains of pairs joined row by row, and no pair's rows are shuffled."""
    rng = np.random.default_rng(11)
    rows = [(i, float(t), *map(float, p)) for i in range(24) for t, p in enumerate(np.cumsum(rng.normal(0, 6, (20, 3)), axis=0) + (100 * (i % 3), 0, 0)) if rng.random() < 0.9]
    rows += [(99, 1.0, None, 0.0, 0.0), (98, 2.0, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kinds = df.select("object_id", F.when(F.col("object_id") % 2 == 0, "a").otherwise("b").alias("category")).distinct()
    base = AttractorConfig(distance_threshold=30, approach_ratio=0.8, min_proximity=20, time_persistence=3, max_gaps=1)
    for cfg in (base, replace(base, broken_chains=True), replace(base, attractor_types=("a",), attracted_types=("b",))):
        want = sorted(map(tuple, attractors.events(attractors.pairs(df, kinds, cfg), cfg).collect()))
        assert want
        for objects, cells in ((512, 2_000_000), (2, 100)):
            found = attractors.found(df, kinds, cfg, objects, cells)
            assert found.columns == ["attractor_id", "attractor_type", "attracted_id", "attracted_type", "time", "distance"]
            assert sorted(map(tuple, found.collect())) == want
            assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("times,offset", [(20, 1e7), (64, 0.0), (90, 0.0)])
def test_attraction_of_long_and_distant_tracks(spark, times, offset):
    """More times than a number has bits, and places that short numbers can't tell apart, lose no chain."""
    rng = np.random.default_rng(12)
    rows = [(i, float(t), *map(float, p)) for i in range(12) for t, p in enumerate(np.round(np.cumsum(rng.normal(0, 6, (times, 3)), axis=0)) + offset) if rng.random() < 0.9]
    rows += [(50, float(t), float("inf"), 0.0, 0.0) for t in range(times)]
    df = spark.createDataFrame(rows, SCHEMA)
    kinds = df.select("object_id", F.lit("a").alias("category")).distinct()
    for cfg in (AttractorConfig(distance_threshold=30, approach_ratio=0.8, min_proximity=20, time_persistence=3, max_gaps=1, broken_chains=b) for b in (False, True)):
        want = sorted(map(tuple, attractors.events(attractors.pairs(df.where("object_id < 50"), kinds, cfg), cfg).collect()))
        assert want and sorted(map(tuple, attractors.found(df, kinds, cfg, cells=2000).collect())) == want


def test_pairs_that_make_no_chain_are_left_out_before_distances():
    """Of 300 x 300 pairs only those that meet keep times at which a distance is taken, and these are all that tell."""
    rng = np.random.default_rng(13)
    cfg = AttractorConfig(distance_threshold=40, approach_ratio=0.5, min_proximity=10, time_persistence=4, max_gaps=2)
    points, there = rng.uniform(0, 400, (2, 30, 300, 3)), rng.random((2, 30, 300)) < 0.8
    points[1, :, :5] = points[0, :, :5] + np.linspace(19, 1, 30)[:, None, None] / np.sqrt(3)
    p, q = (attractors._Tile(*np.nonzero(h)[::-1], x[h].T, 30, 300) for x, h in zip(points, there))
    i, j, bits = attractors._candidates(p, q, cfg)
    assert {(k, k) for k in range(5)} <= set(zip(i.tolist(), j.tolist())) and len(i) < 1000
    near = np.linalg.norm(points[0, :, :5] - points[1, :, :5], axis=-1) < 40
    at = np.unpackbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(bool)
    for k in range(5):
        assert not (near[:, k] & there[0, :, k] & there[1, :, k] & ~at[(i == k) & (j == k)][0][:30]).any()


def test_velocities_of_events_come_with_the_tracks(spark):
    """No rows of events are joined: a comparison's rows have both velocities, null where a track has none."""
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, float(t), *map(float, p)) for i in range(10) for t, p in enumerate(np.cumsum(rng.normal(0, 6, (12, 3)), axis=0))], SCHEMA)
    kinds = df.select("object_id", F.lit("a").alias("category")).distinct()
    cfg = AttractorConfig(distance_threshold=30, approach_ratio=0.8, min_proximity=20, time_persistence=3, max_gaps=1)
    speeds = kinematics.kinematics(df, 1.0, 3.0).where("time <> 3")
    found = attractors.enriched(df, kinds, speeds, cfg)
    of = {(r.object_id, r.time): r.velocity for r in speeds.collect()}
    rows = found.collect()
    assert len(rows) == attractors.found(df, kinds, cfg).count() and any(r.time == 3 for r in rows)
    for r in rows:
        a, b = of.get((r.attractor_id, r.time)), of.get((r.attracted_id, r.time))
        assert (r.attractor_velocity, r.attracted_velocity, r.velocity_difference) == (a, b, None if a is None else b - a)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Join")


@pytest.mark.parametrize("digits", [4, 6])
def test_rounded_is_rounded_by_decimals(spark, digits):
    """Ties, either side of them, large, small and negative numbers and those that are none: the same bits as Spark's round, mostly without it."""
    rng = np.random.default_rng(15)
    ties = (rng.integers(-(10**8), 10**8, 4000) * 2 + 1) / (2 * 10**digits)
    values = np.concatenate([ties, np.nextafter(ties, np.inf), np.nextafter(ties, -np.inf), rng.normal(0, 50, 4000), rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-9, 16, 2000), [0.0, -0.0, -1e-9, np.nan, np.inf, -np.inf, 1e6, -1e6]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    found = queries.rounded(df, digits).collect()
    wanted = df.select((F.round("v", digits) + 0.0).alias("v")).collect()
    assert [struct.pack("d", math.nan if r.v is None else r.v) for r in found] == [struct.pack("d", math.nan if r.v is None else r.v) for r in wanted]
    assert found[-1].v is None and "CASE WHEN" in queries.rounded(df, digits)._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_fit_is_a_loop(spark):
    rng = np.random.default_rng(1)
    x = np.log10(np.arange(1, 21))
    y = 1.3 * x + np.where(np.arange(20) > 9, rng.normal(0, 0.4, 20), rng.normal(0, 0.002, 20))
    curve = spark.createDataFrame([("c", i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "category string, tau int, log_tau double, log_msd double")
    end = 4
    for n in range(4, 21):
        if np.corrcoef(x[:n], y[:n])[0, 1] ** 2 < 0.995:
            break
        end = n
    found = only(msd.prefix_fit(curve))
    assert found.max_tau == end
    assert found.slope == pytest.approx(np.polyfit(x[:end], y[:end], 1)[0])


def test_hull(spark):
    cube = np.array([(x, y, z) for x in (0, 2) for y in (0, 2) for z in (0, 2)], float)
    assert shape.hull_volume(cube) == pytest.approx(8)
    assert shape.hull_volume(np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], float)) == pytest.approx(1 / 6)
    assert shape.hull_volume(cube[:, [0, 1, 1]]) == 0
    rng = np.random.default_rng(2)
    points, m = rng.normal(size=(200, 3)), rng.normal(size=(3, 3))
    assert shape.hull_volume(points @ m) == pytest.approx(abs(np.linalg.det(m)) * shape.hull_volume(points), rel=1e-6)


def test_bootstrap_is_a_loop(spark):
    """Samples of objects in several blocks: the same draws one by one, and each object as often as the others."""
    rng = np.random.default_rng(5)
    points = [(i, "ab"[i > 20], t, math.log10(t), float(rng.normal())) for i in range(29) for t in range(1, 6) if (i + t) % 7]
    df = spark.createDataFrame([(*p[:3], 0.0, *p[3:]) for p in points], "object_id long, category string, tau int, msd double, log_tau double, log_msd double").repartition(4)
    found = {(r.category, r.boot, r.tau): r.log_msd for r in msd.bootstrap_curves(df, 20, 7, block=8).collect()}
    code = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16)

    def mixed(x):
        x = (x ^ x >> 16) * 0x85EBCA6B % 2**32
        x = (x ^ x >> 13) * 0xC2B2AE35 % 2**32
        return x ^ x >> 16

    want, seen = {}, collections.Counter()
    for c, ids in (("a", range(21)), ("b", range(21, 29))):
        for boot in range(1, 21):
            blocks = collections.Counter(code(7, c, boot, d) % len(ids) // 8 if len(ids) > 8 else 0 for d in range(1, len(ids) + 1))
            chosen = [ids[8 * k + mixed((code(7, c, boot, k) + j * 0x9E3779B9) % 2**32) % len(ids[8 * k : 8 * k + 8])] for k, n in blocks.items() for j in range(n)]
            assert len(chosen) == len(ids)
            seen.update(chosen)
            for t in range(1, 6):
                values = [v for i in chosen for o, _, tau, _, v in points if o == i and tau == t]
                if values:
                    want[c, boot, t] = sum(values) / len(values)
    assert found == pytest.approx(want)
    assert max(seen.values()) < 3 * min(seen.values())


def test_draws_are_spread(spark):
    """Chunks of draws are few bytes but much work, so their tasks are not merged for their size."""
    sizes = spark.createDataFrame([("a", 20_000)], "category string, n long")
    draws = msd._block_draws(sizes, 4, 42, 4096)
    assert any("RepartitionByExpression" in line and f", {msd.DRAW_TASKS}" in line for line in draws._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert sum(d.n for r in draws.collect() for d in r.drawn) == 4 * 20_000


def test_hull_of_parts(spark):
    """A long track over many tasks, parts of it in a plane or a line, and points that are given again."""
    rng = np.random.default_rng(9)
    ball = rng.normal(size=(6000, 3))
    assert shape.convex_hull(ball)[1] == pytest.approx(shape.convex_hull(shape.convex_hull(ball)[0])[1])
    cube = np.array([(x, y, z) for z in range(4) for x in range(4) for y in range(4)], float)
    rows = [(1, t, *map(float, r)) for t, r in enumerate(ball)] + [(2, t, *map(float, r)) for t, r in enumerate(cube)] + [(3, t, float(t), 2.0 * t, 0.0) for t in range(20)] + [(4, t, 1.0, 1.0, 1.0) for t in range(5)]
    df = spark.createDataFrame([(i, float(t), x, y, z) for i, t, x, y, z in rows], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        found = {r.object_id: r.convex_hull_volume for r in shape.hull(df.repartition(3), 4).collect()}
        planes = shape.hull(df.where("object_id = 2").coalesce(1).sortWithinPartitions("z"), 4).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[1] == pytest.approx(shape.hull_volume(ball) / 6000**0.5)
    assert found[2] == planes.convex_hull_volume == pytest.approx(27 / 8) and found[3] == found[4] == 0
    corners, volume = shape.convex_hull(cube)
    assert volume == pytest.approx(27) and {tuple(c) for c in corners} >= {(x, y, z) for x in (0, 3) for y in (0, 3) for z in (0, 3)}
    for points in (cube[:16], cube[:4]):
        kept, volume = shape.convex_hull(points)
        assert volume == 0 and len(kept) == (4 if len(points) == 16 else 2)


def test_hull_of_tracks_is_all_facets(spark):
    """Every three points of which all others lie on one side are a facet; each makes a tetrahedron with the centre."""
    rng = np.random.default_rng(5)
    tracks = {i: rng.normal(size=(12, 3)) * (i + 1) for i in range(4)}
    df = spark.createDataFrame([(i, float(t), *map(float, p)) for i, ps in tracks.items() for t, p in enumerate(ps)], SCHEMA)
    for r in shape.hull(df, 4).collect():
        points, volume = tracks[r.object_id], 0.0
        centre = points.mean(axis=0)
        for i, j, k in combinations(range(len(points)), 3):
            normal = np.cross(points[j] - points[i], points[k] - points[i])
            side = np.delete((points - points[i]) @ normal, [i, j, k])
            if (side > 0).all() or (side < 0).all():
                volume += abs((centre - points[i]) @ normal) / 6
        assert r.convex_hull_volume == pytest.approx(volume / math.sqrt(12))  # by the root of the duration


def test_smoothing_meets_its_target(spark):
    """The squared residual is the target, unless a straight cubic is nearer; a smaller target is nearer to the points."""
    rng = np.random.default_rng(9)
    t = np.linspace(0, 6, 80)
    points = np.column_stack([np.cos(t), np.sin(t), t]) + rng.normal(0, 0.05, (80, 3))
    last = None
    for target in (1.0, 0.3, 0.1):
        residual = ((helicity.smoothed(points, target) - points) ** 2).sum()
        assert residual <= target * 1.001 and (last is None or residual < last)
        last = residual
    cubic = np.column_stack([t**3, t**2, 1 - t])
    assert np.allclose(helicity.smoothed(cubic, 1e-6), cubic, atol=1e-3)


def test_spline_is_the_dense_one():
    """The banded splines, their penalty and its solution against full matrices, over uneven knots."""
    rng = np.random.default_rng(4)
    u, points = np.linspace(0, 1, 40), rng.normal(size=(40, 3)).cumsum(axis=0)
    inner = u[[3, 5, 6, 14, 22, 30, 31]]
    spline = helicity.Spline(u, points, inner)
    t, n = spline.knots, spline.size

    def base(i, k, x):
        if k == 0:
            return float(t[i] <= x < t[i + 1] or (x == 1 and t[i] < 1 == t[i + 1]))
        left = (x - t[i]) / (t[i + k] - t[i]) * base(i, k - 1, x) if t[i + k] > t[i] else 0.0
        return left + ((t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * base(i + 1, k - 1, x) if t[i + k + 1] > t[i + 1] else 0.0)

    full = np.array([[base(i, 3, x) for i in range(n)] for x in u])
    assert np.allclose(spline.fit(), full @ np.linalg.lstsq(full, points, rcond=None)[0])
    # Third derivatives are constant between knots: four values in a span tell them.
    edges = [0.0, *inner, 1.0]
    third = np.array([[np.polyfit(x - a, [base(i, 3, v) for v in x], 3)[0] for i in range(n)] for a, b in zip(edges, edges[1:]) for x in [np.linspace(a, b, 6)[1:-1]]])
    jumps = np.diff(third, axis=0) / (len(inner) + 1) ** 3
    whole, bands = jumps.T @ jumps, spline.jumps()
    dense = sum(np.diag(b[: n - k], k) + (np.diag(b[: n - k], -k) if k else 0) for k, b in enumerate(bands))
    assert np.allclose(dense, whole, rtol=1e-4, atol=1e-6 * np.abs(whole).max())
    for weight in (1e-3, 10.0):
        want = full @ np.linalg.solve(full.T @ full + weight * dense, full.T @ points)
        assert np.allclose(spline.fit(weight, bands), want, atol=1e-7)
    line = helicity.spline_of(points, (1e9,))
    cubic = np.stack([np.polyval(np.polyfit(u, x, 3), u) for x in points.T], axis=1)
    assert np.allclose(line, cubic)
    assert np.isnan(helicity.spline_of(np.full((9, 3), np.nan))).all()


def test_long_track_is_smoothed_in_linear_time():
    rng = np.random.default_rng(4)
    took = []
    for n in (2000, 16000):
        points = np.column_stack([np.sin(np.linspace(0, n / 100, n)) * k for k in (1, 2, 3)]) + 0.1 * rng.normal(size=(n, 3))
        began = time.process_time()
        fit = helicity.smoothed(points, 0.03 * n)
        took.append(time.process_time() - began)
        assert ((fit - points) ** 2).sum() == pytest.approx(0.03 * n, rel=2e-3)
    assert took[1] < 30 * took[0]


def test_helix_curvature(spark):
    t, c = np.linspace(0, 20, 2001), 0.5
    df = track(spark, [(x, (math.cos(x), math.sin(x), c * x)) for x in t])
    assert only(helicity.helicity(df, 4, smoothing=False)).median_curvature == pytest.approx(1 / (1 + c * c), rel=1e-3)
    points = np.column_stack([np.cos(t), np.sin(t), c * t])[::20]
    assert np.abs(helicity.smoothed(points, 0.01) - points).max() < 0.1


def test_tails():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_sf(11.070497693516351, 5) == pytest.approx(0.05)
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_correlated_groups():
    pairs = [("a", "b", 0.99), ("b", "c", 0.97), ("c", "d", -0.96), ("a", "d", 0.1)]
    assert ml.correlated_groups(list("abcde"), pairs, 0.95) == [["a", "b", "c", "d"], ["e"]]
    # Members stand in order of name, whatever order they joined in; groups never merge.
    assert ml.correlated_groups(list("abc"), [("b", "c", 0.99), ("a", "b", 0.97), ("a", "c", 0.2)], 0.95) == [["a", "b", "c"]]
    assert ml.correlated_groups(list("dcba"), [("c", "d", 0.99), ("a", "b", 0.98), ("b", "c", 0.97)], 0.95) == [["c", "d"], ["a", "b"]]


def test_prepared_groups_features(spark):
    """Of five features two rise together and one falls with them: one mean of three, named by its members."""
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=(3, 80))
    rows = [(i, "xy"[i % 2], float(c[i]), float(b[i]), float(2 * a[i]), float(a[i]), float(-a[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "object_id long, category string, z double, y double, d double, c double, b double")
    matrix, steps = ml.prepared(df, MLConfig(correlation=0.9), 5)
    assert sorted(ml.features_of(matrix)) == ["b, c, d", "y", "z"]
    scaled = steps["standardized"].toPandas().set_index("object_id")
    ours = matrix.toPandas().set_index("object_id")
    assert np.allclose(ours["b, c, d"].sort_index(), scaled[["b", "c", "d"]].mean(axis=1).sort_index())
    told = steps["feature_correlations"].toPandas()
    corr = scaled[["b", "c", "d", "y", "z"]].corr()
    assert all(r.correlation == pytest.approx(corr.loc[r.feature_a, r.feature_b]) and r.meets == (abs(r.correlation) >= 0.9) for r in told.itertuples())
    assert set(told[told.grouped][["feature_a", "feature_b"]].itertuples(index=False, name=None)) == {("b", "c"), ("b", "d"), ("c", "d")}


def test_logarithms_are_taken_once(spark):
    """Neither filters of later steps nor the number of features multiply the logarithms in a plan; the steps read them written."""
    df = spark.createDataFrame([(i, "xy"[i % 2], *(float(i * k % 11) for k in range(1, 9))) for i in range(20)], "object_id long, category string, " + ", ".join(f"f{k} double" for k in range(8)))
    taken = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().count("log1p")
    assert taken(ml._whole(ml.standardized(ml.signed_log(df)))) == 1
    matrix, steps = ml.prepared(df, MLConfig(), 5)
    assert taken(matrix) == taken(steps["standardized"]) == 0


def test_pca_is_numpys(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, "c", *map(float, r)) for i, r in enumerate(x)], "object_id long, category string, a double, b double, c double, d double, e double")
    found = ml.pca(df, 0.999)
    ratios = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    ours = [r.ratio for r in found["explained_variance"].collect()]
    assert np.allclose(ours, (ratios / ratios.sum())[: len(ours)])
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-values)][:, : len(ours)]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(len(ours))])
    loadings = found["loadings"].toPandas().set_index("feature").loc[list("abcde")]
    assert np.allclose(loadings.to_numpy(), axes, atol=1e-6)
    scores = found["pc_scores"].toPandas().sort_values("object_id").filter(like="PC")
    assert np.allclose(scores.to_numpy(), (x - x.mean(axis=0)) @ axes, atol=1e-6)
    views = figures.pc_views(found["pc_scores"])
    k = min(4, len(ours))
    assert len(views) == sum(math.comb(k, j) for j in (1, 2, 3)) and views["PC1_PC2"].columns == ["object_id", "category", "PC1", "PC2"]


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Track ID,Time,X,Y\n1,0,1.5,2\n1,1,abc,3\n,2,1,1\n")
    rows = tables.segments(tables.read(spark, str(tmp_path / "s.csv"))).orderBy("time").collect()
    assert [(r.object_id, r.time, r.x, r.z) for r in rows] == [(1, 0.0, 1.5, 0.0), (1, 1.0, None, 0.0)]
    with pytest.raises(ValueError):
        tables.segments(spark.range(1))
    names = spark.createDataFrame([("/a/exp-r2_Results.parquet",), ("/a/bar3.parquet",)], "p string")
    assert [r[0] for r in names.select(tables.replicate_of(names.p)).collect()] == ["r2", "bar3"]
    assert words(" a  b ") == ("a", "b") and words(None) == ()


def test_column_names(spark):
    """Every name of every role is found, in any case and position."""
    for role, names in tables.ROLE_NAMES.items():
        for name in names:
            assert tables.roles(["other", name.title(), "more"], [role]) == {role: name.title()}
    assert sum(map(len, tables.ROLE_NAMES.values())) == 35
    df = spark.createDataFrame([("7", "1", "2", "3", "4")], ["ObjectID", "Frame", "Coordinate X", "Y Position", "coordinate z"])
    assert only(tables.segments(df)) == (7, 1.0, 2.0, 3.0, 4.0)


def test_categories(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), (None, "c"), ("2", None)], "Track string, Label string")
    assert sorted(map(tuple, tables.categories(df).collect())) == [(1, "a"), (2, None)]


def test_replicates(spark, tmp_path):
    """Runs under names of replicates, one of them broken, are found and compared."""
    rng = np.random.default_rng(1)
    want = {}
    for k in (1, 2, 3):
        rows = [(i, "ab"[i % 2], float(rng.normal(i % 2)), 1.0) for i in range(11)]
        df = spark.createDataFrame(rows, "object_id long, category string, speed double, same double")
        tables.write({"features": df}, tables.replicate_folder(str(tmp_path), "exp", k))
        for c in "ab":
            want[f"r{k}", c] = float(np.median([r[2] for r in rows if r[1] == c]))
    broken = tmp_path / "exp-r4_results" / "features"
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"no table")
    out = plan.compare_replicates(spark, f"{tmp_path}/exp-r*_results/features")
    found = {(r.replicate, r.category): r.median for r in out["replicate_medians"].where("feature = 'speed'").collect()}
    assert found == pytest.approx(want)
    assert {r.category: r.median for r in out["category_medians"].where("feature = 'speed'").collect()} == pytest.approx({c: float(np.median([v for (_, x), v in want.items() if x == c])) for c in "ab"})
    tests = {(r.feature, r.test) for r in out["replicate_stats"].collect()}
    assert tests == {("same", "skipped"), ("speed", "kruskal"), ("speed", "dunn")}


def test_generator(spark):
    """Each behaviour as described: lengths, turns, bursts, and back and forth."""
    how = generator.Generator(tracks=6)
    segments, kinds = generator.generated(spark, how)
    rows = segments.join(kinds, "object_id").toPandas().sort_values(["object_id", "time"])
    assert {c: str(i)[: len(str(p))] for c, i, p in ((c, i, generator.BEHAVIOURS[c]) for c, i in zip(rows.category, rows.object_id))} == {c: str(p) for c, p in generator.BEHAVIOURS.items()}
    figures_of: dict = {c: [] for c in generator.BEHAVIOURS}
    for (kind, _), track_rows in rows.groupby(["category", "object_id"]):
        points = track_rows[["x", "y", "z"]].to_numpy()
        steps = np.linalg.norm(np.diff(points, axis=0), axis=1)
        assert how.steps * 0.9 - 1 <= len(points) <= how.steps * 1.1 and np.allclose(points[0], 0)
        if kind != "Dead":
            assert how.length * 0.9 - 1e-6 <= steps.sum() <= how.length * 1.1 + 1e-6
        turn = np.degrees(np.abs(np.diff(np.unwrap(np.arctan2(np.diff(points[:, 1]), np.diff(points[:, 0]))))))
        figures_of[kind].append((np.linalg.norm(points[-1]) / steps.sum(), np.median(turn), steps.max() / np.median(steps), np.linalg.norm(points, axis=1).max()))
    mean = {k: np.mean(v, axis=0) for k, v in figures_of.items()}
    assert mean["MostlyStraight"][0] > 0.6 and mean["MostlyStraight"][0] > mean["Turns85deg"][0] > mean["Back-forth"][0]
    assert mean["Back-forth"][0] < 0.1 and mean["Dead"][3] < 2 < mean["Back-forth"][3]
    assert mean["Burst"][2] > 3 > mean["MostlyStraight"][2]
    again = generator.generated(spark, how)[0].toPandas().sort_values(["object_id", "time"])
    assert np.array_equal(again.x.to_numpy(), rows.x.to_numpy())


def test_guards(spark):
    """Helicity and hull of tracks too short for them, and slopes with their bars."""
    short = track(spark, [(0, (0, 0, 0)), (1, (1, 1, 1))])
    assert all(v is None for r in helicity.helicity(short, 4, smoothing=False).collect() for k, v in r.asDict().items() if k != "object_id")
    fits = spark.createDataFrame([("a", 1.0, 0.9, 1.3)], "category string, slope double, ci_low double, ci_high double")
    assert tuple(map(lambda v: round(v, 6), only(figures.slope_bars(fits))[1:])) == (1.0, 0.3, 0.1)
    moving = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 0.0, 1.0), (3, "a", 2.0, 0.0)], "object_id long, category string, mean_velocity double, median_velocity double")
    assert {r.object_id for r in ml.moving_only(moving, True).collect()} == {2, 3} and ml.moving_only(moving, False).count() == 3
    summary = spark.createDataFrame([(1, "a", 0.5, 0.0), (2, "a", 0.1, 0.0)], "object_id long, category string, arrest_coefficient double, convex_hull_volume double")
    assert ml.without_unused(summary, 0.0).columns == ["object_id", "category"]
    assert ml.without_unused(summary.withColumn("convex_hull_volume", summary.object_id * 1.0), 3.0).columns == summary.columns


@pytest.mark.parametrize("piece_rows", [0, 7])
def test_whole_run(spark, tmp_path, piece_rows):
    segments, kinds = generator.generated(spark, generator.Generator(tracks=3, steps=30))
    cfg = RunConfig(piece_rows=piece_rows, contacts=True, contact_div_filter=True, attractors=True, helicity=True, verbose=True, tau=5)
    out = plan.run(segments, kinds, cfg)
    assert out["summary_features"].count() == 21
    keep = ("settings", "summary_features", "contacts_summary", "attractors", "msd_category", "figure_violins")
    tables.write({k: out[k] for k in keep}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/settings").count() == len(cfg.__dataclass_fields__)
    wide, long = out["mean_squared_displacements_wide"].toPandas().set_index("object_id"), out["mean_squared_displacements"].toPandas()
    assert list(wide.columns) == [f"msd_{k}" for k in range(1, 6)]
    assert all(wide.loc[r.object_id, f"msd_{r.tau}"] == r.msd for r in long.itertuples())
    assert {"formatting", "dimensions", "attractors", "plan"} <= {r.step for r in out["runtime_log"].collect()}
    log = plan.RunLog()
    log.note("a", "begun")
    log.note("a", "done")
    assert [r.message for r in log.table(spark).collect()] == ["done"]


def test_report_and_trees(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], float(i % 2 + rng.normal(0, 0.1)), *map(float, rng.normal(size=3))) for i in range(40)]
    df = spark.createDataFrame(rows, "object_id long, category string, f double, g double, h double, i double")
    found = ml.boosted_trees(df, MLConfig(search=False))
    assert found["tree_features"].first().feature == "f"
    assert found["tree_report"].first().accuracy > 0.9
    grid = {"max_depth": [1, 2], "n_estimators": [1, 2], "learning_rate": [0.1, 0.3]}
    found = ml.boosted_trees(df, MLConfig(draws=2, grid=grid))
    assert found["tree_report"].first().accuracy > 0.9
    params = ast.literal_eval(found["tree_hyperparams"].first().params)
    assert all(params[k] in v for k, v in grid.items())


def test_grids():
    """Draws are points of the fixed grids, all different, and the same for a seed; all nine axes are there."""
    for kind, grid in ml.GRIDS.items():
        points = ml.drawn_grid(grid, ml.DRAWS[kind], 42)
        assert len(points) == ml.DRAWS[kind] == len({tuple(p.values()) for p in points})
        assert all(v in grid[k] for p in points for k, v in p.items())
        assert points == ml.drawn_grid(grid, ml.DRAWS[kind], 42)
        assert set(grid) == set(boosting.Params.__dataclass_fields__)


def test_tree_queries_see_all(spark, tmp_path):
    """All categories and all 64 dimensions: the last one tells category 2."""
    from trackspark.plans import queries as q

    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [*map(float, rng.normal(size=63)), 5.0 * (i % 3 == 2)]) for i in range(45)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = [r for r in q.QUERIES["boosted_trees"](spark, str(tmp_path)).collect()]
    ranked = {r["name"]: r.value for r in found if r.table == "features"}
    assert set(ranked) == {f"d{i:02d}" for i in range(64)} and max(ranked, key=ranked.get) == "d63"
    assert {r["name"] for r in found if r.table == "report"} == {"0", "1", "2"}


def test_pairwise_trees(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "abc"[i % 3], float((i % 3 == 2) + rng.normal(0, 0.1)), *map(float, rng.normal(size=2))) for i in range(45)]
    df = spark.createDataFrame(rows, "object_id long, category string, f double, g double, h double").coalesce(1)
    found = ml.pairwise_trees(df, MLConfig(trees=2, search=False))
    best = {(r.cat_a, r.cat_b): r.feature for r in found["tree_features"].orderBy("importance").collect()}
    assert set(best) == {("a", "b"), ("a", "c"), ("b", "c")} and best["a", "c"] == best["b", "c"] == "f"
    assert all(r.accuracy > 0.9 for r in found["tree_report"].where("cat_b = 'c'").collect())


def test_stream(spark, tmp_path):
    from trackspark.streaming.tracks import windowed_extent

    spark.sql("select 1L object_id, timestamp '2024-01-01 00:00:00' ts, 0D x, 0D y, 0D z union all select 1L, timestamp '2024-01-01 00:01:00', 3D, 4D, 0D union all select 1L, timestamp '2024-01-01 02:00:00', 0D, 0D, 0D").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("object_id long, ts timestamp, x double, y double, z double").parquet(f"{tmp_path}/in")
    q = windowed_extent(stream).writeStream.format("memory").queryName("extent").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.extent_x) for r in spark.table("extent").collect()) == [(1, 0.0), (2, 3.0)]


def test_learn(spark):
    segments, kinds = generator.generated(spark, generator.Generator(tracks=12, steps=25))
    cfg = RunConfig(tau=4, arrest_limit=0.5, ml=MLConfig(categories=("MostlyStraight", "Dead"), trees=3, draws=2, grid={"n_estimators": [1, 3], "max_depth": [1, 2]}))
    table = plan.run(segments, kinds, cfg)["features"]
    out = plan.learn(table, cfg)
    assert out["pc_scores"].count() == 24
    assert out["kruskal"].where("pc = 'PC1'").first().p < 0.01
    assert out["tree_report"].first().accuracy > 0.8
