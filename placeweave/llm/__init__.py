"""Operators for preparing training text, and their queries. Nothing else in the library imports this."""

from pyspark import cloudpickle

from placeweave.llm import bpe, packing, pivots, quality, simhash, spelling, substring_dedup, topk, whitening
from placeweave.llm.queries import ORACLES, QUERIES

# functions for executors travel with the job, so the package need not be installed there
for _module in (bpe, packing, pivots, quality, simhash, spelling, substring_dedup, topk, whitening):
    cloudpickle.register_pickle_by_value(_module)

__all__ = ["ORACLES", "QUERIES"]
