"""Points, areas and centroids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col

from placeweave.catalog.base import heavy, query, table
from placeweave.operators.spatial import centroids, points_in_areas
from placeweave.operators.stats import with_median
from placeweave.session import cut_lineage
from placeweave.sources.regions import ring_edges
from placeweave.sources.tables import small_table

# a square with a hole, an L, a triangle, and a square over two of them
PLANE = {
    1: [[(-.2, -.2), (0, -.2), (0, 0), (-.2, 0), (-.2, -.2)],
        [(-.12, -.12), (-.12, -.08), (-.08, -.08), (-.08, -.12), (-.12, -.12)]],
    2: [[(0, 0), (.3, 0), (.3, .1), (.1, .1), (.1, .3), (0, .3), (0, 0)]],
    3: [[(.05, -.25), (.3, -.25), (.05, 0), (.05, -.25)]],
    4: [[(-.1, -.1), (.1, -.1), (.1, .1), (-.1, .1), (-.1, -.1)]],
}
# whole-number corners, so that many grid points fall on an edge
GRID = {
    1: [[(1, 0), (20, 0), (20, 4), (1, 4), (1, 0)]],
    2: [[(20, 0), (40, 0), (40, 10), (20, 10), (20, 0)], [(25, 2), (25, 7), (35, 7), (35, 2), (25, 2)]],
    3: [[(1, 4), (11, 4), (1, 9), (1, 4)]],
    4: [[(30, 1), (50, 1), (50, 9), (30, 9), (30, 1)]],
}


def literal_edges(spark, areas: dict, name: str = "area"):
    rings = [[[list(map(float, p)) for p in ring] for ring in shape] for shape in areas.values()]
    return ring_edges(small_table(spark, **{name: list(areas), "rings": rings}), name, "rings")


@query("""
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
hit AS (
  SELECT vec_id, 1 AS area FROM p WHERE x > -.2 AND x < 0 AND y > -.2 AND y < 0
     AND NOT (x >= -.12 AND x <= -.08 AND y >= -.12 AND y <= -.08)
  UNION ALL SELECT vec_id, 2 FROM p WHERE (x > 0 AND x < .3 AND y > 0 AND y < .1) OR (x > 0 AND x < .1 AND y > 0 AND y < .3)
  UNION ALL SELECT vec_id, 3 FROM p WHERE x > .05 AND y > -.25 AND x + y < .05
  UNION ALL SELECT vec_id, 4 FROM p WHERE x > -.1 AND x < .1 AND y > -.1 AND y < .1)
SELECT vec_id, CAST(area AS BIGINT) AS area FROM hit
""")
def point_in_polygon(spark, sf):
    points = table(spark, sf, "embeddings").select(
        "vec_id", col("embedding")[0].cast("double").alias("x"), col("embedding")[1].cast("double").alias("y"))
    return points_in_areas(points, literal_edges(spark, PLANE), "x", "y", "area", cell=0.05).select("vec_id", "area")


@query("""
WITH p AS (SELECT l_quantity AS x, round(l_discount * 100) AS y, l_extendedprice AS price, l_tax FROM lineitem),
hit AS (
  SELECT 1 AS area, * FROM p WHERE x > 1 AND x < 20 AND y > 0 AND y < 4
  UNION ALL SELECT 2, * FROM p WHERE x > 20 AND x < 40 AND y > 0 AND y < 10 AND NOT (x BETWEEN 25 AND 35 AND y BETWEEN 2 AND 7)
  UNION ALL SELECT 3, * FROM p WHERE x > 1 AND y > 4 AND (x - 1) + 2 * (y - 4) < 10
  UNION ALL SELECT 4, * FROM p WHERE x > 30 AND x < 50 AND y > 1 AND y < 9)
SELECT CAST(area AS BIGINT) AS area, count(*) AS n, round(median(price), 4) AS median_price, round(avg(l_tax), 8) AS mean_tax
FROM hit GROUP BY 1
""")
def region_stats(spark, sf):
    lines = heavy(spark, sf, "lineitem", "l_orderkey").select(
        col("l_quantity").alias("x"), F.round(col("l_discount") * 100).alias("y"), "l_extendedprice", "l_tax")
    placed = points_in_areas(lines, literal_edges(spark, GRID), "x", "y", "area", cell=1.0).drop("x", "y")
    placed = cut_lineage(placed, "placed")
    stats = with_median(placed, ["area"], "l_extendedprice", "median_price", [
        F.count("*").alias("n"), F.round(F.avg("l_tax"), 8).alias("mean_tax")])
    return stats.withColumn("median_price", F.round("median_price", 4))


@query("""
WITH b AS (SELECT label, min(embedding[1]) AS x0, max(embedding[1]) AS x1, min(embedding[2]) AS y0, max(embedding[2]) AS y1
           FROM embeddings GROUP BY 1),
d AS (SELECT label, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1,
             CAST(x1 AS DOUBLE) - CAST(x0 AS DOUBLE) AS w, CAST(y1 AS DOUBLE) - CAST(y0 AS DOUBLE) AS h FROM b),
s AS (SELECT *, w * h AS a FROM d)
SELECT label,
  round(((x0 + w / 2) * a - (x1 - w / 6) * a / 8 - (x0 + 3 * w / 16) * a / 64) / (a - a / 8 - a / 64), 8) AS cx,
  round(((y0 + h / 2) * a - (y1 - h / 6) * a / 8 - (y0 + 3 * h / 16) * a / 64) / (a - a / 8 - a / 64), 8) AS cy,
  round(a - a / 8 - a / 64, 8) AS size FROM s
""")
def polygon_centroid(spark, sf):
    """Each label's bounding box without its upper right corner and with a square hole."""
    box = table(spark, sf, "embeddings").groupBy("label").agg(*[
        f(col("embedding")[i].cast("double")).alias(n)
        for f, i, n in [(F.min, 0, "x0"), (F.max, 0, "x1"), (F.min, 1, "y0"), (F.max, 1, "y1")]])
    x0, y0, x1, y1 = (col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = x1 - x0, y1 - y0

    def ring(*points):
        return F.array(*[F.array(*p) for p in points])

    shell = ring((x0, y0), (x1, y0), (x1, y0 + h / 2), (x0 + w / 2, y1), (x0, y1), (x0, y0))
    low, high = (x0 + w / 8, y0 + h / 8), (x0 + w / 4, y0 + h / 4)
    hole = ring(low, (high[0], low[1]), high, (low[0], high[1]), low)
    edges = ring_edges(box.select("label", F.array(shell, hole).alias("rings")), "label", "rings")
    return centroids(edges, "label").select("label", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "size")])
