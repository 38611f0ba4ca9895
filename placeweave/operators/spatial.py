"""Point in polygon and centroids over edge tables (area, polygon, ring, x1, y1, x2, y2).

A cover of an area is a table of grid cells, each with the edges that pass it and with whether its upper right
corner is inside. A point goes right to its cell's border and then up to that corner; every edge met on the way
changes sides, and the cell's own edges are all that can be met. Cells that too many edges pass are divided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.session import cut_lineage

#: A cell with more edges is divided by this in x and in y, so often at most.
CELL_EDGES, DIVIDE, LEVELS = 64, 4, 10
_ENDS = ("x1", "y1", "x2", "y2")


def _side(e: Column, px: Column, py: Column) -> Column:
    return (e["x2"] - e["x1"]) * (py - e["y1"]) - (px - e["x1"]) * (e["y2"] - e["y1"])


def _left(e: Column, px: Column, py: Column) -> Column:
    """Whether a point is left of an upward edge. A point on the line counts as a little to the right and, by far less,
    above, so that every point has a side and all tests agree about it."""
    side = _side(e, px, py)
    return (side > 0) | ((side == 0) & (e["y1"] == e["y2"]))


def _met(e: Column, px: Column, py: Column, right: Column, top: Column) -> Column:
    """How often an edge is met from a point to the corner ``(right, top)``, first along x, then along y."""
    turn, zero = _left(e, right, py), F.lit(0)
    along = F.when((e["y1"] > py) != (e["y2"] > py), (_left(e, px, py) != turn).cast("int")).otherwise(zero)
    up = F.when((e["x1"] > right) != (e["x2"] > right), (turn != _left(e, right, top)).cast("int")).otherwise(zero)
    return along + up


def _on_edge(edges: str, px: Column, py: Column) -> Column:
    return F.exists(edges, lambda e: (e["y1"] <= py) & (py <= e["y2"]) & (F.least(e["x1"], e["x2"]) <= px)
                    & (px <= F.greatest(e["x1"], e["x2"])) & (_side(e, px, py) == 0))


def _steps(low: Column, high: Column) -> Column:
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def _passed(edges: DataFrame, area: str, size: float, parent: bool = False) -> DataFrame:
    """A row per edge ``e`` and cell it passes or touches, inside the cell it comes from if ``parent``."""
    e, slack = F.col("e"), size * 1e-6

    def bounds(low, high, name):
        low, high = F.floor((low - slack) / size), F.floor((high + slack) / size)
        if not parent:
            return low, high
        return F.greatest(low, F.col(name) * DIVIDE), F.least(high, F.col(name) * DIVIDE + DIVIDE - 1)

    rows = edges.select(area, "e", *(["_bx"] if parent else []), _steps(*bounds(e["y1"], e["y2"], "_by")).alias("_row"))
    low = F.greatest(e["y1"], F.col("_row") * size - slack)
    high = F.least(e["y2"], (F.col("_row") + 1) * size + slack)
    least, most, rise = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]), e["y2"] - e["y1"]
    at = [F.when(rise == 0, x).otherwise(F.least(F.greatest(e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / rise, least), most))
          for y, x in ((low, e["x1"]), (high, e["x2"]))]
    column = _steps(*bounds(F.least(*at), F.greatest(*at), "_bx"))
    return rows.select(area, column.alias("_column"), F.col("_row").alias("_by"), "e").withColumnRenamed("_column", "_bx")


def _inside_corners(edges: DataFrame, area: str, size: float) -> DataFrame:
    """Cells whose upper right corner is inside: sides change, from the left on, where edges cross a row's upper border."""
    e, top = F.col("e"), (F.col("_by") + 1) * size
    rows = edges.select(area, "e", _steps(F.floor(e["y1"] / size) - 1, F.floor(e["y2"] / size)).alias("_by"))
    rows = rows.filter((e["y1"] > top) != (e["y2"] > top))
    guess = F.floor((e["x1"] + (top - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])) / size)
    first = (F.when(~_left(e, guess * size, top), guess - 1)
             .when(~_left(e, (guess + 1) * size, top), guess).otherwise(guess + 1))
    turns = rows.groupBy(area, "_by", first.alias("_bx")).count().filter(F.col("count") % 2 == 1)
    order = Window.partitionBy(area, "_by").orderBy("_bx")
    runs = turns.select(area, "_by", F.col("_bx").alias("_from"), (F.lead("_bx").over(order) - 1).alias("_to"),
                        F.row_number().over(order).alias("_n"))
    return runs.filter(F.col("_n") % 2 == 1).select(area, _steps(F.col("_from"), F.col("_to")).alias("_bx"), "_by")


def _inside_parts(heavy: DataFrame, area: str, size: float) -> DataFrame:
    """The same for the parts of cells (area, _bx, _by, _odd, e), from the corner of the whole cell; ``size`` of a part."""
    whole = size * DIVIDE
    step = F.sequence(F.lit(0), F.lit(DIVIDE - 1))
    parts = heavy.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    bx, by = F.col("_bx") * DIVIDE + F.col("_i"), F.col("_by") * DIVIDE + F.col("_j")
    met = _met(F.col("e"), (bx + 1) * size, (by + 1) * size, (F.col("_bx") + 1) * whole, (F.col("_by") + 1) * whole)
    odd = F.sum(met) + F.max(F.col("_odd").cast("int"))
    inside = parts.groupBy(area, bx.alias("_x"), by.alias("_y")).agg((odd % 2 == 1).alias("_in")).filter("_in")
    return inside.select(area, F.col("_x").alias("_bx"), F.col("_y").alias("_by"))


def area_cover(edges: DataFrame, area: str, cell: float, most: int = CELL_EDGES) -> tuple[DataFrame, int]:
    """Cells (area, _level, _bx, _by, _odd, _right, _top, _edges) of all areas and the number of levels; a cell of level n has the width
    ``cell / DIVIDE ** n``.

    An edge goes into the cells it passes only, a row each, so nothing grows with the edges of an area or of a band.
    ``_odd`` says whether the upper right corner, ``(_right, _top)``, is inside. Cells with more than ``most`` edges are divided until
    none is left, or until the last level (where very many edges share an end, no division parts them; such cells
    keep all of theirs). Cells no edge passes have an empty list and are kept if inside."""
    upward = (F.col("y1") < F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") <= F.col("x2")))
    ends = [F.col(n).cast("double").alias(n) for n in _ENDS]
    turned = [F.col(n).cast("double").alias(m) for n, m in zip(("x2", "y2", "x1", "y1"), _ENDS, strict=True)]
    whole = edges.dropna(subset=list(_ENDS)).select(area, F.when(upward, F.struct(*ends)).otherwise(F.struct(*turned)).alias("e"))
    rows, corners, done = _passed(whole, area, cell), _inside_corners(whole, area, cell), []
    at = [F.col(area).eqNullSafe(F.col("_a")), F.col("_bx") == F.col("_x"), F.col("_by") == F.col("_y")]
    for level in range(LEVELS):
        size = cell / DIVIDE ** level
        found = rows.withColumn("_odd", F.lit(False)).unionByName(
            corners.withColumn("_odd", F.lit(True)).withColumn("e", F.lit(None).cast(rows.schema["e"].dataType)))
        found = cut_lineage(found, "passed")
        keys = [F.col(area).alias("_a"), F.col("_bx").alias("_x"), F.col("_by").alias("_y")]
        heavy = found.groupBy(*keys).agg(F.count("e").alias("_n"), F.max("_odd").alias("_in")).filter(F.col("_n") > most)
        divide = level + 1 < LEVELS and not heavy.isEmpty()
        heavy = cut_lineage(heavy.drop("_n"), "heavy") if divide else heavy
        light = found.join(heavy, at, "left_anti") if divide else found
        cells = light.groupBy(area, "_bx", "_by").agg(F.max("_odd").alias("_odd"), F.collect_list("e").alias("_edges"))
        corner = [((F.col(n) + 1) * size).alias(m) for n, m in (("_bx", "_right"), ("_by", "_top"))]
        done.append(cells.select(area, F.lit(level).alias("_level"), "_bx", "_by", "_odd", *corner, "_edges"))
        if not divide:
            break
        hot = found.filter(F.col("e").isNotNull()).drop("_odd").join(heavy, at)
        hot = hot.select(area, "_bx", "_by", F.col("_in").alias("_odd"), "e")
        rows, corners = _passed(hot, area, size / DIVIDE, parent=True), _inside_parts(hot, area, size / DIVIDE)
    return reduce(DataFrame.unionByName, done), len(done)


def points_in_areas(points: DataFrame, edges: DataFrame, x: str, y: str, area: str, cell: float,
                    boundary: bool = False) -> DataFrame:
    """Each point with every area it lies in; points in none are dropped.

    An equi-join on the grid cell (``area_cover``); sides are counted inside the row over at most ``CELL_EDGES`` edges, so
    points are not regrouped. The cover is written first: with its size known it is broadcast if small and
    shuffled by cell if not. A point is looked up once per level, which is one unless ``cell`` is coarse against the
    edges. Points on an edge are outside unless ``boundary`` is set. Edges are straight in x and y; rings are closed,
    edges with a NULL end are left out, an area without edges holds nothing. ``cell`` should be a fraction of the size
    of the smaller areas."""
    cover, levels = area_cover(edges, area, cell)
    cover = cut_lineage(cover, "cells")
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    sizes = [cell / DIVIDE ** level for level in range(levels)]
    places = [F.struct(F.lit(n).alias("_level"), F.floor(px / s).alias("_bx"), F.floor(py / s).alias("_by")) for n, s in enumerate(sizes)]
    located = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if levels == 1:
        located = located.withColumn("_at", places[0]).select(*points.columns, "_at.*")
    else:
        located = located.select(*points.columns, F.inline(F.array(*places)))
    met = F.aggregate("_edges", F.lit(0), lambda n, e: n + _met(e, px, py, F.col("_right"), F.col("_top")))
    odd, touching = (met + F.col("_odd").cast("int")) % 2 == 1, _on_edge("_edges", px, py)
    inside = F.when(F.size("_edges") == 0, True).otherwise((odd | touching) if boundary else (odd & ~touching))
    return (located.join(cover, ["_level", "_bx", "_by"])
            .filter(inside).select(*points.columns, area))


def centroids(edges: DataFrame, area: str) -> DataFrame:
    """Planar centroid and size of each area. Ring 0 of a polygon counts as land and the
    others as holes, whichever way they wind."""
    turn = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges.groupBy(area, "polygon", "ring").agg(
        (F.sum(turn) / 2).alias("s"),
        (F.sum((F.col("x1") + F.col("x2")) * turn) / 6).alias("mx"),
        (F.sum((F.col("y1") + F.col("y2")) * turn) / 6).alias("my"))
    sign = F.signum("s") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    return rings.groupBy(area).agg(
        (F.sum(sign * F.col("mx")) / F.sum(sign * F.col("s"))).alias("cx"),
        (F.sum(sign * F.col("my")) / F.sum(sign * F.col("s"))).alias("cy"),
        F.sum(sign * F.col("s")).alias("size"))
