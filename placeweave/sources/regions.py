"""Polygons from GeoJSON as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.cleaning import to_int
from placeweave.sources import schemas

_RINGS = "array<array<array<double>>>"


def ring_edges(df: DataFrame, area: str, rings: str, polygon: str | None = None) -> DataFrame:
    """Edges of polygons held as arrays of rings of points."""
    polygon = F.col(polygon) if polygon else F.lit(0)
    ring = df.select(area, polygon.alias("polygon"), F.posexplode(rings).alias("ring", "r"))
    edge = F.transform(F.slice("r", 1, F.size("r") - 1), lambda p, i: F.struct(
        p[0].alias("x1"), p[1].alias("y1"),
        F.get(F.get("r", i + 1), F.lit(0)).alias("x2"), F.get(F.get("r", i + 1), F.lit(1)).alias("y2")))
    return ring.filter(F.size("r") > 1).select(area, "polygon", "ring", F.inline(edge))


def read_regions(spark: SparkSession, path: str, area: str = "community_area_number") -> DataFrame:
    """Edge table (area, polygon, ring, x1, y1, x2, y2) of a feature collection. The area
    number may stand under either of two property names."""
    features = (spark.read.schema(schemas.REGIONS).option("multiLine", True).json(path)
                .select(F.inline("features")))
    number = F.coalesce(to_int("properties.area_numbe"), to_int("properties.community_area_number"))
    shape = F.col("geometry.coordinates")
    polygons = (F.when(F.col("geometry.type") == "MultiPolygon", F.from_json(shape, f"array<{_RINGS}>"))
                .when(F.col("geometry.type") == "Polygon", F.array(F.from_json(shape, _RINGS))))
    rows = features.select(number.alias(area), F.posexplode(polygons).alias("polygon", "rings"))
    return ring_edges(rows, area, "rings", "polygon")
