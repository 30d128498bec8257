"""Helicity and curvature of tracks in space, of the points or of a smoothing spline through them."""

from __future__ import annotations

import heapq
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AXES, track
from ..functions.pieces import Pieces, dealt, numbered, piece


#: The shares of the points' spread that the residual may reach, tried in this order, and the last resort.
FACTORS, LAST = (0.1, 0.5, 1.0, 2.0, 5.0), 10.0


#: Work that hands out systems (bands, right side), is sent their solutions and returns points.
Solving = Generator[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]
#: Systems of fewer are eliminated one by one; tracks that are smoothed side by side, and their rows together.
TOGETHER, SIDE_BY_SIDE, ROWS = 12, 512, 1 << 17


class Spline:
    """Cubic B-splines over ``inner`` knots at parameters ``u`` (ascending, from 0 to 1): everything in bands, as each parameter meets four of them."""

    def __init__(self, u: np.ndarray, points: np.ndarray, inner: np.ndarray):
        self.points, self.knots = points, np.concatenate([np.zeros(4), inner, np.ones(4)])
        self.size = len(inner) + 4
        self.span = np.minimum(np.searchsorted(self.knots, u, "right") - 1, self.size - 1)
        values = [np.ones(len(u))]
        for k in range(1, 4):
            saved, grown = np.zeros(len(u)), []
            for r in range(k):
                right, left = self.knots[self.span + r + 1] - u, u - self.knots[self.span + 1 - k + r]
                part = values[r] / (right + left)
                grown.append(saved + right * part)
                saved = left * part
            values = [*grown, saved]
        self.values = np.array(values)
        self.first = self.span - 3
        at = lambda k, w: np.bincount(self.first + k, w, self.size)
        self.normal = np.array([sum(at(i, self.values[i] * self.values[i + k]) for i in range(4 - k)) if k < 4 else np.zeros(self.size) for k in range(5)])
        self.right = np.stack([sum(at(k, self.values[k] * x) for k in range(4)) for x in points.T], axis=1)

    def jumps(self) -> np.ndarray:
        """Upper bands of the penalty: for each inner knot the squared jump of the third derivative, which five splines share, by uneven spacing."""
        t, n = self.knots, self.size - 4
        bands = np.zeros((5, self.size))
        if not n:
            return bands
        i = np.arange(4, 4 + n)
        rows = []
        for j in range(5):
            low = i - 4 + j
            gaps = np.prod([t[i] - t[low + m] for m in range(5) if m != 4 - j], axis=0)
            rows.append((t[low + 4] - t[low]) / gaps)
        # Scaled by the mean spacing, so that penalties of fine and coarse knots are numbers of one size.
        rows = np.array(rows) / (n + 1) ** 3
        for k in range(5):
            for j in range(5 - k):
                bands[k] += np.bincount(i - 4 + j, rows[j] * rows[j + k], self.size)
        return bands

    def fit(self, weight: float = 0.0, penalty: np.ndarray | None = None) -> np.ndarray:
        return side_by_side([self.fitting(weight, penalty)])[0]

    def fitting(self, weight: float = 0.0, penalty: np.ndarray | None = None) -> Solving:
        """The spline's points: least squares, and ``weight`` times the penalty."""
        bands = self.normal + weight * penalty if penalty is not None else self.normal
        coefficients = yield bands, self.right
        return sum(self.values[k][:, None] * coefficients[self.first + k] for k in range(4))

    def errors(self, fit: np.ndarray) -> np.ndarray:
        return ((self.points - fit) ** 2).sum(axis=1)


def solved(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of A x = ``right`` for a symmetric positive matrix, given by its diagonal and those above: eliminated band by band, in time and memory of its rows."""
    n, width = bands.shape[1], len(bands) - 1
    a, b = bands.T.tolist(), right.tolist()
    floor = 1e-14 * max(row[0] for row in a)
    for j in range(n):
        row = a[j]
        pivot = row[0] = max(row[0], floor)
        for k in range(1, min(width, n - 1 - j) + 1):
            if row[k]:
                share, below = row[k] / pivot, a[j + k]
                for m in range(k, width + 1):
                    below[m - k] -= share * row[m]
                b[j + k] = [x - share * y for x, y in zip(b[j + k], b[j])]
    for j in reversed(range(n)):
        row, x = a[j], b[j]
        for k in range(1, min(width, n - 1 - j) + 1):
            x = [v - row[k] * w for v, w in zip(x, b[j + k])]
        b[j] = [v / row[0] for v in x]
    return np.array(b)


def all_solved(systems: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``solved`` of each, the same steps for all at once; shorter ones end in rows of their own that meet no others."""
    if len(systems) < TOGETHER:
        return [solved(*x) for x in systems]
    sizes = [bands.shape[1] for bands, _ in systems]
    n, width, axes = max(sizes), len(systems[0][0]) - 1, systems[0][1].shape[1]
    a, b = np.zeros((n + width, width + 1, len(systems))), np.zeros((n + width, axes, len(systems)))
    a[:, 0] = 1
    for i, (bands, right) in enumerate(systems):
        a[: sizes[i], :, i], b[: sizes[i], :, i] = bands.T, right
    floor = np.array([1e-14 * bands[0].max() for bands, _ in systems])
    # Of a system that has ended only its own rows of 1 are left.
    inside = np.arange(n)[:, None] < np.array(sizes)
    for j in range(n):
        row = a[j]
        row[0] = np.where(inside[j], np.maximum(row[0], floor), 1.0)
        for k in range(1, width + 1):
            share = row[k] / row[0]
            a[j + k, : width + 1 - k] -= share * row[k:]
            b[j + k] -= share * b[j]
    for j in reversed(range(n)):
        x = b[j]
        for k in range(1, width + 1):
            x = x - a[j, k] * b[j + k]
        b[j] = x / a[j, 0]
    return [b[:size, :, i] for i, size in enumerate(sizes)]


def side_by_side(works: list[Solving]) -> list[np.ndarray]:
    """What each returns; in each round the systems that they wait for are solved together, those of similar sizes."""
    out: list[np.ndarray] = [np.zeros(0)] * len(works)
    waiting: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []

    def go(i: int, found: np.ndarray | None) -> None:
        try:
            waiting.append((i, works[i].send(found)))
        except StopIteration as end:
            out[i] = end.value

    with np.errstate(all="ignore"):
        for i in range(len(works)):
            go(i, None)
        while waiting:
            now = sorted(waiting, key=lambda x: x[1][0].shape[1])
            waiting = []
            while now:
                last = now[-1][1][0].shape[1]
                first = next(k for k, x in enumerate(now) if 2 * x[1][0].shape[1] >= last)
                for (i, _), found in zip(now[first:], all_solved([x for _, x in now[first:]])):
                    go(i, found)
                now = now[:first]
    return out


def _more_knots(u: np.ndarray, inner: np.ndarray, error: np.ndarray, count: int) -> np.ndarray:
    """``count`` knots more, one by one at the middle point of the span with the largest residual, whose halves share it by their points."""
    edges = np.concatenate([[0.0], inner, [1.0]])
    # A span's own points are those strictly inside it.
    starts, ends = np.searchsorted(u, edges[:-1], "right"), np.searchsorted(u, edges[1:], "left")
    sums = np.concatenate([[0.0], np.cumsum(error)])
    heap = [(-(sums[e] - sums[s]), int(s), int(e)) for s, e in zip(starts, ends) if e > s]
    heapq.heapify(heap)
    added = []
    while heap and len(added) < count:
        worth, s, e = heapq.heappop(heap)
        middle = (s + e) // 2
        added.append(u[middle])
        for x, y in ((s, middle), (middle + 1, e)):
            if y > x:
                heapq.heappush(heap, (worth * (y - x) / (e - s), x, y))
    return np.sort(np.concatenate([inner, added]))


def smoothing(points: np.ndarray, target: float, tolerance: float = 1e-3) -> Solving:
    """A cubic spline through ``points`` at even parameters whose squared residual is ``target``.

    If one polynomial is close enough, it is that. Else knots are added, as many at a time as the last ones' gain
    suggests, until the least-squares spline is close enough; then jumps of its third derivative are penalised up to
    the target. Time and memory grow with points and knots.
    """
    n = len(points)
    u = np.linspace(0, 1, n)
    inner, step, before = np.zeros(0), 1, None
    while True:
        spline = Spline(u, points, inner)
        fit = yield from spline.fitting()
        error = spline.errors(fit)
        total = float(error.sum())
        if total <= target * (1 + tolerance) or len(inner) >= n - 4:
            break
        if before is not None:
            gain = before - total
            step = min(2 * step, max(int(step * (total - target) / gain) if gain > 0 else 2 * step, step // 2, 1))
        before = total
        more = _more_knots(u, inner, error, min(step, n - 4 - len(inner)))
        if len(more) == len(inner):
            break
        inner = more
    if not len(inner) or total >= target * (1 - tolerance):
        return fit
    # The residual rises with the weight of the penalty, from that of least squares to that of one polynomial.
    penalty = spline.jumps()
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        fit = yield from spline.fitting(10**middle * np.max(spline.normal[0]) / np.max(penalty[0]), penalty)
        total = float(spline.errors(fit).sum())
        if abs(total - target) <= tolerance * target:
            break
        low, high = (middle, high) if total < target else (low, middle)
    return fit


def smoothed(points: np.ndarray, target: float, tolerance: float = 1e-3) -> np.ndarray:
    return side_by_side([smoothing(points, target, tolerance)])[0]


def _spline_of(points: np.ndarray, factors: tuple[float, ...]) -> Solving:
    n = len(points)
    spread = 1 + points.var(axis=0).mean()
    for target in (*(n * f * spread for f in factors), n * LAST):
        fit = yield from smoothing(points, target)
        if np.isfinite(fit).all():
            break
    return fit


def spline_of(points: np.ndarray, factors: tuple[float, ...] = FACTORS) -> np.ndarray:
    """The smoothed points: the residual is rows times a factor times one more than the mean variance of the axes, for the first factor whose spline is finite."""
    return side_by_side([_spline_of(points, factors)])[0]


def smooth(segments: DataFrame, factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """Tracks on their spline; those of fewer than four rows stay. Rows come sorted by track, and many tracks are smoothed side by side."""
    names = ("object_id", "time", *AXES)

    def on_splines(table: pa.Table) -> Iterator[pa.RecordBatch]:
        points = np.stack([table[c].to_numpy().astype(float) for c in AXES], axis=1)
        begin = _begins(table)
        tracks = [(s, e) for s, e in zip(begin, [*begin[1:], len(points)]) if e - s >= 4]
        for (s, e), fit in zip(tracks, side_by_side([_spline_of(points[s:e], factors) for s, e in tracks])):
            points[s:e] = fit
        columns = [table[c].combine_chunks() for c in names[:2]]
        # Of short tracks blanks stay blank.
        blank = np.ones(len(points), bool)
        for s, e in tracks:
            blank[s:e] = False
        columns += [pa.array(points[:, k], mask=blank & table[c].is_null().to_numpy()) for k, c in enumerate(AXES)]
        yield from pa.table(dict(zip(names, columns))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, due = 0, ROWS // 8
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < due:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            begin = _begins(table)
            # The last track may go on in the next batch.
            if len(begin) > 1 and (len(begin) > SIDE_BY_SIDE or rows >= ROWS):
                yield from on_splines(table.slice(0, begin[-1]))
                held = table.slice(begin[-1]).to_batches()
                rows = table.num_rows - begin[-1]
            due = max(ROWS // 8, 2 * rows)
        if rows:
            yield from on_splines(pa.Table.from_batches(held).combine_chunks())

    kind = "object_id long, time double, x double, y double, z double"
    rows = segments.select(F.col("object_id").cast("long").alias("object_id"), *(F.col(c).cast("double").alias(c) for c in names[1:]))
    return rows.repartition("object_id").sortWithinPartitions("object_id", "time").mapInArrow(run, kind)


def _begins(table: pa.Table) -> list[int]:
    """Where tracks begin in rows that are sorted by them; those without an object are one."""
    ids, none = table["object_id"].fill_null(0).to_numpy(), table["object_id"].is_null().to_numpy()
    return [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(none.astype(int)) != 0)) + 1).tolist()] if len(ids) else []


def _gradient(c: Column, seq: Column, n: Column, step: Column, w: Window) -> Column:
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(seq == 1, (after - c) / step).when(seq == n, (c - before) / step).otherwise((after - before) / (2 * step))


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def helicity(segments: DataFrame, moving: int, smoothing: bool = True, pieces: Pieces | None = None) -> DataFrame:
    """Mean and median helicity and curvature per object; null below ``moving`` rows.

    With ``pieces`` the gradients' windows hold a piece of a track, and the three rows on either side that they reach for.
    """
    rows = smooth(segments) if smoothing else segments
    if pieces is None:
        w, whole = track(), Window.partitionBy("object_id")
        rows = rows.select("object_id", "time", *AXES, F.row_number().over(w).alias("seq"), F.count("*").over(whole).alias("n"), F.min("time").over(whole).alias("begin"), F.max("time").over(whole).alias("end"), F.lit(True).alias("own"))
    else:
        rows, w = dealt(numbered(rows.select("object_id", "time", *AXES), pieces), pieces, before=3, after=3), piece()
    rows = rows.withColumn("step", (F.col("end") - F.col("begin")) / F.nullif(F.col("n") - 1, F.lit(0))).where((F.col("n") >= max(moving, 4)) & (F.col("step") > 0))
    seq, n, step = F.col("seq"), F.col("n"), F.col("step")
    rows = rows.withColumns({f"v{c}": _gradient(F.col(c), seq, n, step, w) for c in AXES})
    rows = rows.withColumns({f"a{c}": _gradient(F.col(f"v{c}"), seq, n, step, w) for c in AXES})
    v, a = [F.col(f"v{c}") for c in AXES], [F.col(f"a{c}") for c in AXES]
    # Row i holds the product of velocities i - 1 and i; the gradient runs over rows 2 .. n.
    turn = _cross([F.lag(c).over(w) for c in v], v)
    rows = rows.withColumns({f"c{c}": t for c, t in zip(AXES, turn)})
    rows = rows.withColumns({f"g{c}": F.when(seq >= 2, _gradient(F.col(f"c{c}"), seq - 1, n - 1, step, w)) for c in AXES})
    g = [F.col(f"g{c}") for c in AXES]
    twist = F.when(seq >= 2, _dot(v, g) / (_dot(v, v) + 1e-8))
    bend = _cross(v, a)
    curve = F.when(seq <= n - 2, F.sqrt(_dot(bend, bend)) / (F.pow(F.sqrt(_dot(v, v)), 3) + 1e-8))
    found = rows.select("object_id", "own", twist.alias("h"), curve.alias("k")).where("own").groupBy("object_id").agg(F.avg("h").alias("mean_helicity"), F.median("h").alias("median_helicity"), F.avg("k").alias("mean_curvature"), F.median("k").alias("median_curvature"))
    return segments.select("object_id").distinct().join(found, "object_id", "left")
