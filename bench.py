"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from placeweave import catalog  # noqa: E402
from placeweave.session import local_session  # noqa: E402

HEADLINE = [
    "category_diversity", "top3_categories", "classify_rules", "latest_per_key", "first_per_composite_key",
    "source_priority_dedup", "fallback_source", "group_stats", "join_variants", "clean_text", "word_counts",
    "sentiment_group", "two_lexicons", "ngram_counts", "tfidf", "distinctive_phrases", "point_in_polygon", "region_stats",
    "log_upsert", "key_sources", "business_profile", "forum_profile", "listing_profile", "master_profile",
]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _best(run, repeats: int = 2) -> float:
    """Best of a few runs: the first pays for class loading and compilation."""
    taken = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        taken.append(time.perf_counter() - start)
    return round(min(taken), 3)


def _oracle_seconds(sf_dir: str, names: list[str], cpus: str) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = {cpus}")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return {n: _best(lambda n=n: con.execute(catalog.ORACLES[n]).fetchall()) for n in names}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    seconds = {n: _best(lambda n=n: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
               for n in names}
    report = {"metric": "headline queries, total wall time, best of two", "value": round(sum(seconds.values()), 3),
              "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    if os.environ.get("BENCH_ORACLE"):
        spark.stop()
        report["oracle"] = _oracle_seconds(sf_dir, names, cpus)
    print(json.dumps(report))


if __name__ == "__main__":
    main()
