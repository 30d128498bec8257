"""Convex hull volume per object: hulls of parts of a track where its rows are, then the hull of their corners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import AXES

EPS = 1e-10


def _flat_corners(points: np.ndarray) -> np.ndarray:
    """Corners of points in a plane, by chains along the first axis, or the two ends of points in a line."""
    centred = points - points.mean(axis=0)
    _, size, axes = np.linalg.svd(centred, full_matrices=False)
    along = centred @ axes[:2].T
    if size[0] == 0 or size[1] <= 1e-9 * size[0]:
        return np.unique([along[:, 0].argmin(), along[:, 0].argmax()])
    order = np.lexsort((along[:, 1], along[:, 0]))

    def chain(indices: np.ndarray) -> list[int]:
        kept: list[int] = []
        for i in indices:
            while len(kept) > 1:
                u, v = along[kept[-1]] - along[kept[-2]], along[i] - along[kept[-2]]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(i)
        return kept

    return np.unique(chain(order) + chain(order[::-1]))


def convex_hull(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The points that are corners of the hull, and its volume, 0 where they lie in a plane.

    Facets stand in arrays, each with the points above it; the farthest point of one replaces all facets that it sees
    by a cone from their rim, and only the points above those are dealt out again.
    """
    points = np.unique(points[np.isfinite(points).all(axis=1)], axis=0)
    if len(points) < 2:
        return points, 0.0
    middle = points.mean(axis=0)
    scale = np.abs(points - middle).max()
    if len(points) < 4 or np.linalg.matrix_rank(points - middle, tol=scale * 1e-9) < 3:
        return points[_flat_corners(points)], 0.0
    p = (points - middle) / scale
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(axis=1).argmax())
    c = int((np.cross(p[b] - p[a], p - p[a]) ** 2).sum(axis=1).argmax())
    d = int(np.abs((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a])).argmax())
    centre = p[[a, b, c, d]].mean(axis=0)
    corners = np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)])

    def planes(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y, z = (p[corners[:, k]] for k in range(3))
        normals = np.cross(y - x, z - x)
        return normals, np.einsum("ij,ij->i", normals, x)

    normals, offsets = planes(corners)
    turned = normals @ centre > offsets
    corners[turned] = corners[turned][:, [0, 2, 1]]
    normals, offsets = planes(corners)
    alive = np.ones(4, bool)
    above: list[np.ndarray] = []

    def deal(indices: np.ndarray, first: int) -> None:
        """Each point to the one of the new facets that it is farthest above."""
        heights = p[indices] @ normals[first:].T - offsets[first:]
        best = heights.argmax(axis=1) if len(indices) else np.zeros(0, int)
        high = heights.max(axis=1, initial=-1) > EPS
        above.extend(indices[high & (best == k)] for k in range(len(normals) - first))

    deal(np.arange(len(p)), 0)
    waiting = [k for k in range(4) if len(above[k])]
    while waiting:
        f = waiting.pop()
        if not alive[f] or not len(above[f]):
            continue
        top = above[f][(p[above[f]] @ normals[f]).argmax()]
        seen = np.flatnonzero(alive & (normals @ p[top] - offsets > EPS))
        edges = {(int(t[k]), int(t[(k + 1) % 3])) for t in corners[seen] for k in range(3)}
        rim = np.array([(u, v, top) for u, v in edges if (v, u) not in edges])
        loose = np.concatenate([above[k] for k in seen])
        alive[seen] = False
        for k in seen:
            above[k] = loose[:0]
        first = len(corners)
        new_normals, new_offsets = planes(rim)
        corners, normals, offsets = np.vstack([corners, rim]), np.vstack([normals, new_normals]), np.append(offsets, new_offsets)
        alive = np.append(alive, np.ones(len(rim), bool))
        deal(loose[loose != top], first)
        waiting += [k for k in range(first, len(corners)) if len(above[k])]
    x, y, z = (p[corners[alive][:, k]] - centre for k in range(3))
    volume = abs(np.einsum("ij,ij->i", x, np.cross(y, z)).sum()) / 6 * scale**3
    return points[np.unique(corners[alive])], float(volume)


def hull_volume(points: np.ndarray) -> float:
    return convex_hull(points)[1]


PART = "object_id long, corners binary, n long, times array<double>"


def hull(segments: DataFrame, moving: int, times_duration: bool = False) -> DataFrame:
    """Volume over the root of the duration (or times it); null for objects of fewer than ``moving`` rows.

    Only corners of parts, their first two times and counts are shuffled, so a long track is spread over all tasks that
    have rows of it; one task holds the corners of its parts.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("object_id").to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("time", *AXES)], axis=1)
            order = np.argsort(ids, kind="stable")
            found = []
            for own in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(ids) else ():
                corners, _ = convex_hull(rows[own, 1:])
                found.append((int(ids[own[0]]), corners.tobytes(), len(own), np.sort(rows[own, 0])[:2].tolist()))
            if found:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [c.split()[0] for c in PART.split(", ")])

    def whole(table: pa.Table) -> pa.Table:
        n, value = sum(table.column("n").to_pylist()), None
        if n >= moving:
            times = sorted(t for part in table.column("times").to_pylist() for t in part)[:2]
            duration = n * abs(times[1] - times[0]) if len(times) > 1 else 0.0
            volume = hull_volume(np.concatenate([np.frombuffer(x, float).reshape(-1, 3) for x in table.column("corners").to_pylist()]))
            root = duration**0.5
            value = volume * root if times_duration else (volume / root if root else 0.0)
        return pa.table({"object_id": table.column("object_id")[:1], "convex_hull_volume": pa.array([value], pa.float64())})

    found = segments.select("object_id", "time", *AXES).where("object_id is not null").mapInArrow(parts, PART)
    return found.groupBy("object_id").applyInArrow(whole, "object_id long, convex_hull_volume double")
