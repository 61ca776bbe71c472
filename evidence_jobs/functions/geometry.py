"""Points and polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A point this near to a segment, as a cross product, is on it.
TOLERANCE = 1e-10
#: Horizontal slabs of a ring's edges, and pairs of points and edges that are tested at once.
MOST_SLABS, BLOCK = 1024, 1 << 18
RING = T.ArrayType(T.ArrayType(T.DoubleType()))
MULTIPOLYGON = T.ArrayType(T.ArrayType(RING))


def valid_coordinates(lng: Column, lat: Column) -> Column:
    return F.coalesce(lng.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def parse_ring(text: Column) -> Column:
    """`lng,lat[,alt] ...` as a closed ring of [lng, lat]; tokens that are no points are skipped."""
    parts = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: F.size(F.split(t, ",")) >= 2), lambda t: F.transform(F.slice(F.split(t, ","), 1, 2), lambda x: x.try_cast("double")))
    points = F.filter(parts, lambda p: p[0].isNotNull() & p[1].isNotNull())
    open_ = (F.size(points) > 0) & (F.try_element_at(points, F.lit(1)) != F.try_element_at(points, F.lit(-1)))
    return F.when(open_, F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def ring_states(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Per point 0 outside, 1 inside, 2 on the edge of a ring; a point meets the edges of its own horizontal slab only."""
    out = np.zeros(len(x), np.int8)
    if len(ring) < 4:
        return out
    a, b = ring[:-1], ring[1:]
    low, high = np.minimum(a, b) - TOLERANCE, np.maximum(a, b) + TOLERANCE
    (x0, y0), (x1, y1) = low.min(axis=0), high.max(axis=0)
    near = np.flatnonzero((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
    if not len(near):
        return out
    slabs = min(len(a), MOST_SLABS)
    slab = lambda v: np.minimum(((v - y0) / (y1 - y0) * slabs).astype(np.int64), slabs - 1)
    first, last, own = slab(low[:, 1]), slab(high[:, 1]), slab(y[near])
    order = np.argsort(own, kind="stable")
    for points in np.split(near[order], np.flatnonzero(np.diff(own[order])) + 1):
        at = slab(y[points[:1]])[0]
        edges = np.flatnonzero((first <= at) & (last >= at))
        step = max(1, BLOCK // max(1, len(edges)))
        for i in range(0, len(points), step):
            out[points[i : i + step]] = _against(x[points[i : i + step], None], y[points[i : i + step], None], a[edges], b[edges], low[edges], high[edges])
    return out


def _against(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """States of points (a column each of x and y) by edges from a to b."""
    (ax, ay), (bx, by) = a.T, b.T
    cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    box = (x >= low[:, 0]) & (x <= high[:, 0]) & (y >= low[:, 1]) & (y <= high[:, 1])
    edge = ((np.abs(cross) <= TOLERANCE) & box).any(axis=1)
    spans = (ay > y) != (by > y)
    rise = np.where(ay == by, 1.0, by - ay)
    inside = (spans & (x < (bx - ax) * (y - ay) / rise + ax)).sum(axis=1) % 2 == 1
    return np.where(edge, 2, inside.astype(np.int8)).astype(np.int8)


def shape_states(x: np.ndarray, y: np.ndarray, shape: list) -> np.ndarray:
    """Per point the state in a multipolygon: a hole is outside, its edge is an edge; inside wins over an edge."""
    best = np.zeros(len(x), np.int8)
    for polygon in shape:
        rings = [np.array([list(p) for p in r], dtype=float).reshape(-1, 2) for r in polygon]
        if not rings:
            continue
        state = ring_states(x, y, rings[0])
        for hole in rings[1:]:
            inner = ring_states(x, y, hole)
            state = np.where((state == 1) & (inner == 1), 0, np.where((state == 1) & (inner == 2), 2, state)).astype(np.int8)
        best = np.where((best == 1) | (state == 1), 1, np.maximum(best, state)).astype(np.int8)
    return best


def cell_states(shape: list, size: float, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Per grid cell (column by row) of the given range: the state that all its points share, or -1 where an edge's box meets the cell."""
    out = np.zeros((x1 - x0 + 1, y1 - y0 + 1), np.int8)
    for ring in (np.array([list(p) for p in r], dtype=float).reshape(-1, 2) for polygon in shape for r in polygon):
        low = np.floor((np.minimum(ring[:-1], ring[1:]) - TOLERANCE) / size).astype(np.int64) - (x0, y0)
        high = np.floor((np.maximum(ring[:-1], ring[1:]) + TOLERANCE) / size).astype(np.int64) - (x0, y0)
        for (i, j), (k, m) in np.unique(np.stack([low, high], axis=1), axis=0):
            out[max(i, 0) : max(k + 1, 0), max(j, 0) : max(m + 1, 0)] = -1
    free = np.argwhere(out == 0)
    out[free[:, 0], free[:, 1]] = shape_states((free[:, 0] + x0 + 0.5) * size, (free[:, 1] + y0 + 0.5) * size, shape)
    return out


@F.pandas_udf(T.StringType())
def point_state(lng: pd.Series, lat: pd.Series, shape_id: pd.Series, shape: pd.Series) -> pd.Series:
    """inside, edge or outside; rows of the same shape are tested together."""
    out = np.full(len(lng), "outside", dtype=object)
    names = np.array(["outside", "inside", "edge"], dtype=object)
    for at in shape_id.groupby(shape_id, dropna=False).indices.values():
        own = shape.iloc[at[0]]
        if own is not None:
            out[at] = names[shape_states(lng.to_numpy(float)[at], lat.to_numpy(float)[at], own)]
    return pd.Series(out)
