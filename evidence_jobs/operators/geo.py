"""Points against boundary polygons by a grid-cell join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_jobs.functions.geometry import cell_states, point_state
from evidence_jobs.operators.places import dictionary
from evidence_jobs.sources.stored import stored

#: Side of a grid cell in degrees, and cells of a shape beyond which its box is tested without the grid.
CELL, MOST_CELLS = 0.05, 10_000


def bounding_boxes(boundaries: DataFrame) -> DataFrame:
    """boundaries (feature_idx, shape) with the box of all outer rings."""
    points = F.flatten(F.transform("shape", lambda polygon: polygon[0]))
    pick = lambda i: F.transform(points, lambda p: p[i])
    return boundaries.withColumns({"x0": F.array_min(pick(0)), "x1": F.array_max(pick(0)), "y0": F.array_min(pick(1)), "y1": F.array_max(pick(1))})


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def boundary_cells(boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """(feature_idx, cx, cy, state): grid cells of each shape's box of at most MOST_CELLS; state is that of all points of the cell, null where an edge may be near."""
    kind = boundaries.schema["feature_idx"].dataType

    def classified(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                states = cell_states(row["shape"], cell, row["i0"], row["i1"], row["j0"], row["j1"])
                at = np.indices(states.shape).reshape(2, -1)
                name = np.array(["outside", "inside", None], dtype=object)[states.reshape(-1)]
                yield pd.DataFrame({"feature_idx": row["feature_idx"], "cx": at[0] + row["i0"], "cy": at[1] + row["j0"], "state": name})

    boxes = bounding_boxes(boundaries).where("x0 IS NOT NULL")
    ranges = {"i0": _cell(F.col("x0"), cell), "i1": _cell(F.col("x1"), cell), "j0": _cell(F.col("y0"), cell), "j1": _cell(F.col("y1"), cell)}
    few = boxes.withColumns(ranges).where("(i1 - i0 + 1) * (j1 - j0 + 1) <= " + str(MOST_CELLS))
    return few.select("feature_idx", "shape", *ranges).mapInPandas(classified, T.StructType([T.StructField("feature_idx", kind), *(T.StructField(c, T.LongType()) for c in ("cx", "cy")), T.StructField("state", T.StringType())]))


def point_states(points: DataFrame, boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """(case_id, feature_idx, state) of points and the shapes whose box holds them; state is inside, edge or outside.

    Points meet boxes by grid cell. A cell that no edge of a shape comes near has one
    state. Only points of other cells meet the shape itself, which is joined once a
    feature, so that a large shape isn't copied into each of its cells.
    """
    boxes = bounding_boxes(boundaries).where(F.col("x0").isNotNull()).select("feature_idx", "x0", "x1", "y0", "y1")
    spans = (_cell(F.col("x1"), cell) - _cell(F.col("x0"), cell) + 1) * (_cell(F.col("y1"), cell) - _cell(F.col("y0"), cell) + 1)
    cells = stored(boundary_cells(boundaries, cell).join(boxes, "feature_idx"))
    in_box = F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    placed = points.withColumn("cx", _cell(F.col("lng"), cell)).withColumn("cy", _cell(F.col("lat"), cell))
    near = stored(placed.join(dictionary(cells), ["cx", "cy"]).where(in_box).select("case_id", "lng", "lat", "feature_idx", "state"))
    huge = points.join(dictionary(boxes.where(spans > MOST_CELLS)), in_box).select("case_id", "lng", "lat", "feature_idx")
    shaped = near.where("state IS NULL").drop("state").unionByName(huge).join(dictionary(boundaries.select("feature_idx", "shape")), "feature_idx")
    tested = shaped.select("case_id", "feature_idx", point_state(F.col("lng"), F.col("lat"), F.col("feature_idx"), F.col("shape")).alias("state"))
    return near.where("state IS NOT NULL").select("case_id", "feature_idx", "state").unionByName(tested)


def resolve_points(points: DataFrame, boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """(case_id, feature_idx, source, confidence, others) of the points that a shape holds.

    points (case_id, lng, lat); boundaries (feature_idx, shape). Inside wins over an
    edge, then the first feature; 0.97, or 0.90 if several hold the point inside, or 0.88
    for an edge; others lists the further features.
    """
    tested = point_states(points, boundaries, cell).where("state <> 'outside'")
    rank = F.struct(F.when(F.col("state") == "inside", 0).otherwise(1).alias("s"), "feature_idx")
    best = tested.groupBy("case_id").agg(F.min(rank).alias("b"), F.count_if(F.col("state") == "inside").alias("inside"), F.array_sort(F.collect_list("feature_idx")).alias("all"))
    edge = F.col("b.s") == 1
    return best.select(
        "case_id", F.col("b.feature_idx").alias("feature_idx"), F.when(edge, "boundary_edge").otherwise("boundary_contains").alias("source"),
        F.when(edge, 0.88).when(F.col("inside") > 1, 0.90).otherwise(0.97).alias("confidence"), F.array_remove("all", F.col("b.feature_idx")).alias("others"),
    )


def best_boundary_file(files: DataFrame) -> DataFrame:
    """The boundary file to use of (run_id, status, raw_file, placemarks): 369 placemarks, then 368, then others of 300 or more; earliest run, then name."""
    usable = files.where("status = 'success' AND placemarks >= 300 AND lower(raw_file) LIKE '%.kml'")
    rank = F.when(F.col("placemarks") == 369, 0).when(F.col("placemarks") == 368, 1).otherwise(2)
    best = usable.agg(F.min_by(F.struct("run_id", "raw_file", "placemarks"), F.struct(rank.alias("r"), "run_id", "raw_file")).alias("f"))
    return best.where("f IS NOT NULL").select("f.*")
