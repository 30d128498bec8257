"""Synthetic tracks of seven behaviours; each object's random numbers come from its own seed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Behaviours and the prefixes of their object ids.
BEHAVIOURS = {"MostlyStraight": 5987, "Turns45deg": 9221, "Turns85deg": 9229, "TurnsRandom": 7151, "Burst": 4659, "Back-forth": 2904, "Dead": 6015}
#: Degrees by which the turning behaviours turn.
TURNS = {"Turns45deg": (35, 55), "Turns85deg": (75, 95), "TurnsRandom": (10, 170)}


@dataclass(frozen=True)
class Generator:
    tracks: int = 40
    steps: int = 150
    length: float = 500.0
    spread: float = 0.1
    seed: int = 42


def _turned(rng: np.random.Generator, n: int, every: tuple[int, int], over: tuple[int, int], degrees: tuple[float, float]) -> np.ndarray:
    """Headings that turn by an angle from ``degrees`` over some steps, again and again."""
    change = rng.normal(0, 0.02, n)
    at = int(rng.integers(*every))
    while at < n:
        steps = int(rng.integers(over[0], over[1] + 1))
        change[at : at + steps] += np.radians(rng.uniform(*degrees)) * rng.choice([-1, 1]) / steps
        at += steps + int(rng.integers(*every))
    return rng.uniform(0, 2 * np.pi) + np.cumsum(change)


def path(behaviour: str, rng: np.random.Generator, how: Generator) -> np.ndarray:
    """Points (x, y, z) of one track from the origin."""
    n = int(how.steps * rng.uniform(1 - how.spread, 1 + how.spread))
    speed, jitter, climb = rng.uniform(8, 14), rng.uniform(0.2, 3), rng.uniform(0.1, 2)
    pace = np.ones(n)
    if behaviour in ("Back-forth", "Dead"):
        size = (15 if behaviour == "Back-forth" else 0.5) * rng.uniform(0.8, 1.2)
        axis = rng.normal(size=3)
        ends = np.array([np.zeros(3), axis / np.linalg.norm(axis) * size])
        side, points = 0, []
        while len(points) < n:
            side = 1 - side
            points += [ends[side]] * int(rng.integers(1, 3))
        points = np.array(points[:n]) + rng.normal(0, 0.05 * size, (n, 3))
    else:
        if behaviour == "Burst":
            heading = _turned(rng, n, (n, n + 1), (8, 12), (0, 1))
            pace *= rng.uniform(0.2, 0.3)
            at = int(rng.integers(n // 4, n // 2))
            pace[at : at + n // 5] = 1.75
            heading[at : at + 10] += np.linspace(0, np.radians(rng.uniform(45, 135)), len(heading[at : at + 10]))
        elif behaviour in TURNS:
            heading = _turned(rng, n, (35, 46), (8, 12), TURNS[behaviour])
        else:
            heading = _turned(rng, n, (max(n // 3, 2), max(n // 2, 3)), (20, 30), (5, 20))
        moves = np.column_stack([np.cos(heading) * speed * pace, np.sin(heading) * speed * pace, rng.normal(climb, 0.1, n) * pace])
        points = np.cumsum(moves + rng.normal(0, jitter * 0.1, (n, 3)), axis=0)
    points = points - points[0]
    walked = np.linalg.norm(np.diff(points, axis=0), axis=1).sum()
    if behaviour != "Dead" and walked:
        points *= how.length * rng.uniform(1 - how.spread, 1 + how.spread) / walked
    return points


def generated(spark: SparkSession, how: Generator = Generator()) -> tuple[DataFrame, DataFrame]:
    """Segments and categories."""
    kinds = [(name, prefix) for name, prefix in BEHAVIOURS.items()]
    objects = spark.range(how.tracks * len(kinds)).select((F.col("id") / how.tracks).cast("int").alias("kind"), (F.col("id") % how.tracks).alias("place"))
    names, prefixes = F.array(*(F.lit(k) for k, _ in kinds)), F.array(*(F.lit(p) for _, p in kinds))
    objects = objects.select((prefixes[F.col("kind")] * 1000 + F.col("place")).cast("long").alias("object_id"), names[F.col("kind")].alias("category"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        points = path(rows["category"].iloc[0], np.random.default_rng([how.seed, int(rows["object_id"].iloc[0])]), how)
        return pd.DataFrame({"object_id": rows["object_id"].iloc[0], "time": np.arange(len(points), dtype=float), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})

    return objects.groupBy("object_id").applyInPandas(one, "object_id long, time double, x double, y double, z double"), objects
