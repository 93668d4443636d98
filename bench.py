"""Headline timings: one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is computed in full and written to the no-op sink.  Tables that a
query reads as a stage (ratings for features, features for the dataset) are
built and timed by the query before it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fairline import catalog, fixtures  # noqa: E402
from fairline.catalog import base, dataset as ds  # noqa: E402
from fairline.operators import dataset, features, ratings  # noqa: E402
from fairline.session import local_session  # noqa: E402

#: registered queries that are timed as they are
REGISTERED = (
    "W5_recent_form", "W7_W9_W10_W11_conversion", "W24_W25_roster_stability", "W20_A4_champion_meta",
    "W22_W23_P7_series_context", "V1_temporal_split", "V2_rolling_folds", "B12_quote_engine", "B14_W29_compounding_ledger",
    "B15_W29_fixed_stake_ledger", "A16_edge_threshold_sweep", "F3_F4_F5_F6_parse_markets", "F9_book_snapshot",
    "F10_reward_scan", "J6_resolve_names", "J4_asof_features", "J11_matchup_rows", "B17_positions", "R3_move_alerts",
    "M11_ensemble",
)


def pipeline(spark, sf):
    """The three stages of the modelling pipeline, each from the stage before."""
    slices = base.match_slices(spark, sf)
    yield "ratings", lambda: ratings.elo_ratings(base.team_rows(spark, sf), slices)
    yield "features", lambda: features.build_features(base.rated_rows(spark, sf), slices)
    yield "mirror_dataset", lambda: dataset.mirror_dataset(ds.feature_rows(spark, sf))


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    run(fixtures.match_rows(spark, sf))  # start executors and warm the scan
    stages = {"features": base.rated_rows, "mirror_dataset": ds.feature_rows}
    times = {}
    for name, build in pipeline(spark, sf):
        if name in stages:
            stages[name](spark, sf)  # the input stage is not part of the timing
        t = time.time()
        run(build())
        times[name] = round(time.time() - t, 3)
    every = catalog.queries()
    for name in REGISTERED:
        t = time.time()
        run(every[name](spark, sf))
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
