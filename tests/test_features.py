"""Properties of the feature table."""

import re

import pytest
from pyspark.sql import functions as F

from fairline import fixtures
from fairline.operators import dataset, draft, features, rosters
from fairline.operators.ratings import elo_ratings
from fairline.plans.slices import ONE_SLICE, plan_slices
from fairline.sources.match_log import pair_opponents


@pytest.fixture(scope="module")
def teams(spark, sf):
    return pair_opponents(fixtures.match_rows(spark, sf)).cache()


def values(df):
    cols = sorted(dataset.feature_columns(df))
    return {(r["gameid"], r["side"]): tuple(None if r[c] is None else round(float(r[c]), 7) for c in cols) for r in df.collect()}


def test_no_look_ahead(teams):
    """Changing a game changes no feature of that game or of an earlier one."""
    pivot = teams.approxQuantile("gameid", [0.6], 0.0)[0]
    changed = teams.withColumns(
        {
            "result": F.when(F.col("gameid") == pivot, 1 - F.col("result")).otherwise(F.col("result")),
            "golddiffat15": F.when(F.col("gameid") == pivot, 99_999.0).otherwise(F.col("golddiffat15")),
            "dragons": F.when(F.col("gameid") == pivot, 50.0).otherwise(F.col("dragons")),
        }
    )
    a, b = (values(features.build_features(t, ONE_SLICE)) for t in (teams, changed))
    assert all(a[k] == b[k] for k in a if k[0] <= pivot)
    assert any(a[k] != b[k] for k in a if k[0] > pivot)


def test_slices_and_runs_change_nothing(teams):
    whole = values(features.build_features(teams, ONE_SLICE))
    cut = values(features.build_features(teams, plan_slices(teams, "date", 150), run_rows=20))
    assert set(whole) == set(cut)
    for k in whole:
        assert whole[k] == pytest.approx(cut[k], abs=2e-6)


def test_mirror_is_antisymmetric(teams):
    ds = dataset.mirror_dataset(features.build_features(teams, ONE_SLICE))
    rows = {(r["gameid"], r["side"]): r for r in ds.select("gameid", "side", "diff_wr_L5", "wr_L5", "opp_wr_L5").collect()}
    for (g, side), r in rows.items():
        other = rows[g, "Red" if side == "Blue" else "Blue"]
        assert r["diff_wr_L5"] == pytest.approx(-other["diff_wr_L5"])
        assert r["opp_wr_L5"] == other["wr_L5"]


def test_first_games_get_neutral_values(teams):
    first = features.build_features(teams, ONE_SLICE).filter("n_games_played = 0").select(
        "wr_L5", "ewma_result", "days_since_last", "pct_pos_gdiff15_L10", "h2h_wr", "lead_conv_rate", "patch_wr_shrunk")
    assert first.count() > 0
    for r in first.collect():
        assert tuple(round(x, 6) for x in r) == (0.5, 0.5, -1.0, 0.0, 0.5, 0.7, 0.5)


def test_missing_team_has_no_history(spark, teams):
    lost = teams.withColumn("teamid", F.when(F.col("gameid") % 2 == 0, F.lit(None)).otherwise(F.col("teamid")))
    rows = features.build_features(lost, ONE_SLICE).filter("teamid is null").select("n_games_played", "wr_L10", "pct_pos_gdiff15_L10")
    assert {tuple(r) for r in rows.collect()} == {(0, 0.5, 0.5)}


def test_no_same_match_column_survives(teams):
    out = features.build_features(teams, ONE_SLICE)
    assert not {"golddiffat15", "dragons", "pick1", "firstPick", "gamelength", "ckpm"} & set(out.columns)
    num, cat = dataset.model_columns(out)
    assert "result" not in num and cat == ["league", "split", "side", "patch"]


def test_roster_change(spark):
    when = [(g, f"2024-01-{g:02d} 12:00:00") for g in range(1, 6)]
    teams = spark.createDataFrame([(g, d, s, t, o, 1) for g, d in when for s, t, o in (("Blue", "A", "B"), ("Red", "B", "A"))],
                                  "gameid int, date string, side string, teamid string, opp_teamid string, result int")
    teams = teams.withColumns({"date": F.col("date").cast("timestamp"), "patch": F.lit("1")})
    five, swap = list("abcde"), list("abcdx")
    rows = {1: five, 2: five, 3: [], 4: swap, 5: swap}
    players = spark.createDataFrame([(g, "A", p, p.upper()) for g, ps in rows.items() for p in ps],
                                    "gameid int, teamid string, playerid string, playername string")
    out = rosters.roster_features(teams, players).filter("teamid = 'A'").orderBy("gameid")
    assert [(r["roster_overlap"], r["games_since_roster_change"]) for r in out.collect()] == [
        (1.0, 1), (1.0, 2), (1.0, 3), (0.8, 0), (1.0, 1)]


def test_series_restart_on_game_one(spark):
    rows = []
    for g, (number, won) in enumerate([(1, 1), (2, 0), (3, 1), (1, 0), (2, 0)]):
        rows += [(g, g, "Blue", "A", "B", number, won), (g, g, "Red", "B", "A", number, 1 - won)]
    df = spark.createDataFrame(rows, "gameid int, sec long, side string, teamid string, opp_teamid string, game int, result int")
    df = df.withColumns({"date": F.timestamp_seconds("sec"), "league": F.lit("L"), "patch": F.lit("1")})
    out = draft.series_context(df, ONE_SLICE).filter("teamid = 'A'").orderBy("gameid")
    assert [(r["series_score_diff"], r["series_must_win"]) for r in out.collect()] == [(0, 0), (1, 0), (0, 0), (0, 0), (-1, 1)]


def test_junk_ids_are_limited_before_the_exchange(spark):
    rows = [(1, "Blue", "A"), (1, "Red", "B"), (2, "Blue", "A")] + [(9, f"s{i}", "X") for i in range(500)] + [(None, "Blue", "C")]
    df = spark.createDataFrame(rows, "gameid int, side string, teamid string")
    out = pair_opponents(df)
    assert {tuple(r) for r in out.select("gameid", "teamid", "opp_teamid").collect()} == {(1, "A", "B"), (1, "B", "A")}
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def _inputs(df, operator):
    """Input columns of every operator of this name in the physical plan."""
    spark = df.sparkSession
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = [b for b in text.split("\n\n") if re.match(rf"\(\d+\) {operator}\b", b.strip())]
    return [line for b in blocks for line in b.splitlines() if line.startswith("Input")]


def test_wide_rows_do_not_go_through_windows(teams):
    """Every group of features sorts what it reads; a column that none reads is not among it."""
    wide = teams.withColumn("memo", F.lit("x"))
    for out in (features.build_features(wide, ONE_SLICE), elo_ratings(wide, ONE_SLICE)):
        found = _inputs(out, "Window")
        assert found and not [x for x in found if "memo#" in x]
        assert "memo" in out.columns


def test_mirrored_rows_move_the_columns_that_are_read(teams):
    ds = dataset.mirror_dataset(features.build_features(teams, ONE_SLICE)).select("gameid", "opp_wr_L5")
    found = _inputs(ds, "Window")
    assert found and not [x for x in found if "fb_rate_L10#" in x]
