"""Windows over pieces of tracks give the rows of windows over whole tracks, however the tracks are cut."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.config import RunConfig
from trackspark.functions import columns, pieces
from trackspark.functions.pieces import Pieces
from trackspark.operators import contacts, formatting, helicity, kinematics, msd
from trackspark.operators import summary as features

TRACKS = {1: 700, 2: 1, 3: 2, 4: 33, 5: 64, -6: 65}
#: Pieces shorter than what windows reach for, spans of many rows and of less than one, one piece for all.
CUTS = [Pieces(1, 0.3), Pieces(5, 40.0), Pieces(64, 64.0), Pieces(10_000, 1e9)]


@pytest.fixture(scope="module")
def tracks(spark):
    rng = np.random.default_rng(8)
    rows = []
    for key, n in TRACKS.items():
        # Uneven times, also below 0, with a gap in which spans are empty; some rows don't move.
        times = np.cumsum(rng.choice([0.5, 1.0, 3.0], n)) - 50 + 400 * (np.arange(n) > n // 2)
        points = np.cumsum(rng.normal(size=(n, 3)) * rng.integers(0, 2, (n, 1)) * 5, axis=0)
        rows += [(key, float(t), *map(float, p)) for t, p in zip(times, points)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows], "object_id long, time double, x double, y double, z double")
    return df.repartition(3).persist()


def same(found, wanted, keys):
    a, b = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (found, wanted))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        assert np.allclose(x.astype(float), y.astype(float), atol=1e-8, rtol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("how", CUTS, ids=str)
def test_pieces_are_whole_tracks(tracks, how):
    same(kinematics.kinematics(tracks, 0.5, 3.0, how), kinematics.kinematics(tracks, 0.5, 3.0), ["object_id", "seq"])
    same(kinematics.lagged(tracks, 7, how), kinematics.lagged(tracks, 7), ["object_id", "seq", "tau"])
    same(kinematics.turning_angles(tracks, 6, how), kinematics.turning_angles(tracks, 6), ["object_id", "seq", "tau"])
    same(helicity.helicity(tracks, 4, False, how), helicity.helicity(tracks, 4, False), ["object_id"])


@pytest.mark.parametrize("how", CUTS, ids=str)
def test_formatting_in_pieces(tracks, how):
    even = tracks.where("object_id in (2, 4)").unionByName(tracks.where("object_id = 5").withColumn("time", F.col("time") * 0 + F.row_number().over(columns.track())))
    same(formatting.drop_gapped(even, 1.0, how), formatting.drop_gapped(even, 1.0), ["object_id", "time"])
    assert {r.object_id for r in formatting.drop_gapped(even, 1.0, how).select("object_id").distinct().collect()} == {2, 5}
    same(formatting.intervals(tracks, how), formatting.intervals(tracks), ["object_id", "dt"])
    same(formatting.interpolate(tracks, 0.7, how), formatting.interpolate(tracks, 0.7), ["object_id", "time"])


def test_many_lags_in_pieces(tracks):
    short = tracks.where("object_id != 1")
    same(msd.msd(short, 25, CUTS[1]), msd.msd(short, 25), ["object_id", "tau"])
    same(kinematics.turning_angles(short, 21, CUTS[1]), kinematics.turning_angles(short, 21), ["object_id", "seq", "tau"])


def test_summary_in_pieces(spark, tracks):
    kinds = spark.createDataFrame([(k, "a") for k in TRACKS], "object_id long, category string")
    cfg = RunConfig(tau=4, arrest_limit=2.0)
    found, wanted = (features.summarize(tracks, kinds, c).drop("category") for c in (replace(cfg, piece_rows=20), cfg))
    same(found, wanted, ["object_id"])


def test_pieces_are_bounded(tracks):
    how = Pieces(50, 60.0)
    rows = pieces.dealt(pieces.numbered(tracks, how), how, before=3, after=2)
    sizes = rows.groupBy("object_id", "piece").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).toPandas()
    assert sizes.own.between(1, 50).all() and (sizes.n <= 55).all()
    assert sizes.own.sum() == sum(TRACKS.values())
    assert (sizes[sizes.object_id == 1].own == 50).all()


def whole_track_windows(df):
    """Windows by object alone over rows, not over the tables of spans and of pieces."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-|").startswith("Window ")]
    assert windows
    return [w for w in windows if not any(f"{c}#" in w for c in ("span", "piece"))]


def test_no_window_holds_a_whole_track(tracks):
    assert all(whole_track_windows(df) for df in (kinematics.kinematics(tracks, 1.0, 3.0), kinematics.lagged(tracks, 7), kinematics.turning_angles(tracks, 6), helicity.helicity(tracks, 4, False)))
    for df in (kinematics.kinematics(tracks, 1.0, 3.0, CUTS[2]), kinematics.lagged(tracks, 7, CUTS[2]), kinematics.turning_angles(tracks, 6, CUTS[2]), helicity.helicity(tracks, 4, False, CUTS[2])):
        # What is left are the counts and times of a track's spans.
        assert all("rows#" in w or "low#" in w for w in whole_track_windows(df))


def test_empty_and_null(spark):
    schema = "object_id long, time double, x double, y double, z double"
    assert kinematics.kinematics(spark.createDataFrame([], schema), 1.0, 3.0, CUTS[0]).count() == 0
    rows = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 1.0), (1, None, 2.0, 2.0, 2.0), (None, 1.0, 3.0, 3.0, 3.0), (1, 1.0, None, 0.0, 0.0), (1, 2.0, 4.0, 5.0, 1.0)], schema)
    found = kinematics.kinematics(rows, 1.0, 3.0, CUTS[0]).orderBy("seq").collect()
    assert [(r.seq, r.inst_displacement, r.total_displacement) for r in found] == [(1, 0, 0), (2, 0, None), (3, 0, 5)]
    with pytest.raises(ValueError):
        Pieces(0, 1.0)


def test_many_lags_shuffle_rows_once(tracks):
    """Rows are not copied for each lag before they are shuffled: there is no join."""
    for df in (kinematics.lagged(tracks, 40), kinematics.turning_angles(tracks, 40)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.object_id, r.seq, r.tau): r.sq for r in kinematics.lagged(tracks, 40).collect()}
    few = {(r.object_id, r.seq, r.tau): r.sq for r in kinematics.lagged(tracks, 20).collect()}
    assert {k: v for k, v in found.items() if k[2] <= 20} == few
    assert len(found) == sum(max(n - k, 0) for n in TRACKS.values() for k in range(1, 41))
    turned = {(r.object_id, r.seq, r.tau): r.angle for r in kinematics.turning_angles(tracks, 40).collect()}
    assert {k: v for k, v in turned.items() if k[2] <= 20} == {(r.object_id, r.seq, r.tau): r.angle for r in kinematics.turning_angles(tracks, 20).collect()}


def test_summary_of_whole_tracks_without_rows_of_lags(spark, capsys):
    """One pass gives what the operators on rows give, short, still and incomplete tracks included, and no row for a point and lag."""
    rng = np.random.default_rng(5)
    rows = [(o, float(t), *map(float, rng.integers(0, 6, 3))) for o, n in enumerate((1, 2, 3, 4, 5, 9, 23, 60)) for t in range(n)]
    rows += [(90, float(t), 1.0, 1.0, 1.0) for t in range(12)] + [(91, float(t), None if t == 4 else t * 1.5, 2.0, t % 3 * 1.0) for t in range(15)]
    segments = spark.createDataFrame(rows, "object_id long, time double, x double, y double, z double")
    kinds = segments.select("object_id", F.lit("a").alias("category")).distinct()
    for limit, middle in ((2.0, False), (0.0, True)):
        cfg = RunConfig(dt=1.0, tau=10, arrest_limit=limit, moving=4, median_of_angles=middle)
        whole = features.summarize(segments, kinds, cfg)
        capsys.readouterr()
        whole.explain()
        assert "Generate" not in capsys.readouterr().out
        pieces = features.summarize(segments, kinds, replace(cfg, piece_rows=8))
        a, b = ({r["object_id"]: r.asDict() for r in x.collect()} for x in (whole, pieces))
        assert a.keys() == b.keys() and len(a) == 10
        for k in a:
            assert a[k] == pytest.approx(b[k], abs=1e-9), k


@pytest.mark.parametrize("euclidean", [False, True])
def test_partners_are_counts_of_contacts(spark, euclidean, capsys):
    """Blocks count the pairs' distinct partners and contacts, copies of tracks, negative places and points just in reach included, without rows of pairs."""
    rng = np.random.default_rng(3)
    rows = [(int(o), float(t), *map(float, rng.integers(-9, 9, 3))) for o in range(-20, 40) for t in range(6) if rng.random() < 0.8]
    rows += [(o + 100, *r) for o, *r in rows] + [(300, 1.0, float("nan"), 0.0, 0.0), (301, 1.0, None, 0.0, 0.0)]
    segments = spark.createDataFrame(rows, "object_id long, time double, x double, y double, z double")
    wanted = contacts.contacts(segments, 3.0, euclidean).groupBy("object_id").agg(F.count_distinct("object_compare").alias("n_contacts"), F.count("*").alias("n"))
    for cut in ({}, {"blocks": 1, "pairs": 50}, {"blocks": 2, "block_rows": 100, "pairs": 300}):
        found = contacts.partners(segments, 3.0, euclidean, **cut)
        same(found, wanted, ["object_id"])
    capsys.readouterr()
    found.explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("euclidean", [False, True])
def test_durations_are_those_of_contacts(spark, euclidean):
    """Events of both sides counted by blocks, with gaps, uneven times, a time twice and objects without contacts, give the summary of joined contacts; no contact's row is shuffled."""
    rng = np.random.default_rng(8)
    near = {o: rng.integers(0, 3, 3) * (3.5, 4, 4) for o in range(-12, 24)}
    rows = [(o, float(t if t < 16 else 2 * t), *map(float, p + rng.integers(0, 2, 3) * 0.5)) for o, p in near.items() for t in range(18) if rng.random() < 0.95]
    rows += [(300, 1.0, float("nan"), 0.0, 0.0), (301, 1.0, None, 0.0, 0.0), (302, 1.0, 900.0, 0.0, 0.0), rows[0]]
    segments = spark.createDataFrame(rows, "object_id long, time double, x double, y double, z double")
    kinds = segments.select("object_id", F.lit("a").alias("category")).distinct()
    wanted = contacts.contacts_summary(contacts.contacts(segments, 3.0, euclidean), kinds, 1.0, both_sides=True)
    assert wanted.where("n_contacts > 0 and median_duration > 1").count() > 3
    for cut in ({}, {"blocks": 1, "candidates": 1, "counts": 1}, {"blocks": 2, "block_rows": 100, "candidates": 500}):
        found = contacts.summary_of_durations(contacts.durations(segments, 3.0, 1.0, euclidean, **cut), kinds, 1.0)
        same(found.drop("category"), wanted.drop("category"), ["object_id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapGroupsInArrow" in plan


def test_splines_side_by_side(spark, monkeypatch):
    """Tracks of all lengths smoothed together are those smoothed alone to the last bit, in far fewer eliminations; short and blank ones stay."""
    rng = np.random.default_rng(4)
    tracks = {o: np.cumsum(rng.normal(size=(int(n), 3)) * 4, axis=0) for o, n in enumerate(rng.integers(1, 90, 60))}
    wanted = {o: helicity.spline_of(p) if len(p) >= 4 else p for o, p in tracks.items()}
    calls = []
    real = helicity.all_solved
    monkeypatch.setattr(helicity, "all_solved", lambda x: calls.append(len(x)) or real(x))
    long = [p for p in tracks.values() if len(p) >= 4]
    together = helicity.side_by_side([helicity._spline_of(p, helicity.FACTORS) for p in long])
    assert all(np.array_equal(a, helicity.spline_of(p)) for a, p in zip(together, long))
    assert max(calls) > 30
    rows = [(o, float(t), *map(float, x)) for o, p in tracks.items() for t, x in enumerate(p)] + [(500, 0.0, None, 1.0, 2.0)]
    rng.shuffle(rows)
    rows = [(int(r[0]), float(r[1]), *(None if v is None else float(v) for v in r[2:])) for r in rows]
    found = helicity.smooth(spark.createDataFrame(rows, "object_id long, time double, x double, y double, z double")).orderBy("object_id", "time").collect()
    assert (found[-1]["x"], found[-1]["y"]) == (None, 1.0) and len(found) == len(rows)
    assert np.array_equal([[r["x"], r["y"], r["z"]] for r in found[:-1]], np.concatenate([wanted[o] for o in sorted(wanted)]))
