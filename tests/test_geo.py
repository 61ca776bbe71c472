import numpy as np
from pyspark.sql import functions as F

from evidence_jobs.functions.geometry import TOLERANCE, ring_states
from evidence_jobs.operators import geo


def one_by_one(x: float, y: float, ring: list) -> int:
    inside = False
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if abs(cross) <= TOLERANCE and min(ax, bx) - TOLERANCE <= x <= max(ax, bx) + TOLERANCE and min(ay, by) - TOLERANCE <= y <= max(ay, by) + TOLERANCE:
            return 2
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return int(inside)


def star(r, edges: int, size: float = 1.0) -> list:
    angle = np.sort(r.uniform(0, 2 * np.pi, edges))
    reach = r.uniform(0.3, 1.0, edges) * size
    points = [[float(a), float(b)] for a, b in zip(77 + reach * np.cos(angle), 12 + reach * np.sin(angle), strict=True)]
    return [*points, points[0]]


def test_rings_by_slabs_equal_every_edge():
    r = np.random.default_rng(3)
    for edges in (3, 4, 17, 2500):
        ring = star(r, edges)
        corners = np.array(ring)
        middles = (corners[:-1] + corners[1:]) / 2
        x = np.concatenate([r.uniform(75.5, 78.5, 60), corners[:20, 0], middles[:20, 0], [np.nan]])
        y = np.concatenate([r.uniform(10.5, 13.5, 60), corners[:20, 1], middles[:20, 1], [12.0]])
        assert ring_states(x, y, corners).tolist() == [one_by_one(a, b, ring) for a, b in zip(x, y, strict=True)]
    assert ring_states(np.array([0.0]), np.array([0.0]), np.array([[0, 0], [1, 1]])).tolist() == [0]


def test_cells_give_the_state_of_their_points(spark):
    r = np.random.default_rng(4)
    shapes = [[[star(r, 40), star(r, 9, 0.2)]], [[star(r, 5)], [star(r, 30, 0.5)]], [], [[star(r, 200, 0.01)]]]
    boundaries = spark.createDataFrame(list(enumerate(shapes)), "feature_idx int, shape array<array<array<array<double>>>>")
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(75.9, 78.1, 400), r.uniform(10.9, 13.1, 400), strict=True))]
    points = spark.createDataFrame([*places, (1000, *shapes[0][0][0][3]), (1001, None, None)], "case_id int, lng double, lat double")
    known = geo.boundary_cells(boundaries, 0.05).where("state IS NOT NULL").groupBy("feature_idx").pivot("state").count().where("feature_idx = 0").first()
    assert known["inside"] > 50 and known["outside"] > 50
    by_cell, by_edge = ({(r["case_id"], r["feature_idx"]): r["state"] for r in geo.point_states(points, boundaries, cell).collect()} for cell in (0.05, 1e-4))
    assert by_cell == by_edge and by_cell[1000, 0] == "edge" and set(by_cell.values()) == {"inside", "outside", "edge"}
    assert not any(case == 1001 for case, _ in by_cell)
    for (case, feature), state in by_cell.items():
        if feature == 0 and case < 400:
            outer, hole = (one_by_one(*places[case][1:], ring) for ring in shapes[0][0])
            assert state == ["outside", "inside", "edge"][2 if outer == 2 or outer == 1 and hole == 2 else int(outer == 1 and hole == 0)]
    assert geo.point_states(points.where(F.lit(False)), boundaries).count() == 0
