"""Named queries over the standard tables, each beside the SQL it must agree with."""

from placeweave.catalog import files, incremental, places, profiles, spatial, text
from placeweave.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "incremental", "places", "profiles", "spatial", "text"]
