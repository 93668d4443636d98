"""A reader of few columns gets the rows and values of the whole feature table, and only what it reads is stored and moved."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fairline import fixtures
from fairline.operators import features
from fairline.operators.ratings import elo_ratings
from fairline.plans.slices import plan_slices
from fairline.session import cut_lineage, shared_folder
from fairline.sources.match_log import pair_opponents

KEYS = ["gameid", "side"]


@pytest.fixture(scope="module")
def teams(spark, sf):
    return pair_opponents(fixtures.match_rows(spark, sf)).filter("gameid % 3 = 0").withColumn(
        "teamid", F.when(F.col("gameid") % 11 != 0, F.col("teamid"))).cache()


@pytest.fixture(scope="module")
def rated(teams):
    return cut_lineage(elo_ratings(teams, plan_slices(teams)))


def values(df, columns):
    return {tuple(r[:2]): [None if v is None else pytest.approx(v, abs=1e-7) for v in r[2:]] for r in df.select(*KEYS, *columns).collect()}


def test_asked_features_equal_the_whole_table(teams, rated):
    slices = plan_slices(teams, "date", 150)
    whole = features.build_features(rated, slices, source=rated)
    for asked in (["wr_L10", "elo_team", "ix_conv_x_gdiff15", "ix_gdiff15_x_dragon"],
                  ["h2h_wr", "patch_wr_shrunk", "elo_league_rel", "ix_side_x_elo", "ix_dec_elo_x_gdiff15", "matches_last_7d", "league_tier"]):
        narrow = cut_lineage(elo_ratings(teams, plan_slices(teams), columns=features.inputs(asked)))
        assert len(narrow.columns) < len(rated.columns)
        got = features.build_features(narrow, slices, source=narrow, columns=asked)
        assert values(got, asked) == values(whole, asked)


def test_inputs_are_enough(rated):
    """The columns that ``inputs`` names do for a feature of every group."""
    slices = plan_slices(rated)
    for c in ("wr_L5", "form_trend", "avg_opp_elo_L5", "overperf_L10", "pct_pos_xpdiff15_L10", "pct_gdiff10_gt1000_L10", "fbar_rate_L5",
              "tower_share_std_L10", "vision_mean_L10", "avg_gdiff15_when_loss", "is_blue", "side_wr_vs_patch", "h2h_n_games",
              "matches_last_14d", "is_playoffs", "game_number", "ix_opp_elo_x_wr10"):
        narrow = rated.select("_row", *features.inputs([c]) & set(rated.columns))
        assert c in features.build_features(narrow, slices, source=narrow, columns=[c]).columns, c


def test_asof_lookup_moves_no_wide_rows(spark, sf, tmp_path):
    source = f"{tmp_path}/tables"  # a source of its own, so no stage table of another test serves it
    os.symlink(sf, source)
    top = f"{shared_folder(spark)}/fairline/{spark.sparkContext.applicationId}"
    for query in ("J4_asof_features", "P10_interactions", "P2_feature_table_without_raw_columns"):
        before = set(os.listdir(top)) if os.path.isdir(top) else set()
        entry.queries()[query](spark, source).collect()
        stored = set(os.listdir(top)) - before
        assert query.startswith("P2") or not [x for x in stored if x.startswith("rosters")]
        assert all("pick1" not in spark.read.parquet(f"{top}/{x}").columns for x in stored)
