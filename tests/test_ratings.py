"""Ratings equal one sequential pass, however the games are cut."""

import random

import pytest
from pyspark.sql import functions as F

from fairline.operators.ratings import elo_ratings, rate_games
from fairline.sources.match_log import pair_opponents


def season(n, seed, teams=12, hole=0.0):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        a, b = rng.sample(range(teams), 2)
        a, b = (None if rng.random() < hole else f"T{x}" for x in (a, b))
        won = rng.randrange(2)
        rows += [(g, 1_700_000_000 + g * 3600, "Blue", a, won), (g, 1_700_000_000 + g * 3600, "Red", b, 1 - won)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "gameid long, sec long, side string, teamid string, result int")
    return df.withColumn("date", F.timestamp_seconds("sec")).withColumn("league", F.lit("L"))


def sequential(rows, start=None):
    r, out = dict(start or {}), {}
    games = {}
    for g, sec, side, team, result in rows:
        games.setdefault((sec, g), {})[side] = (team, result)
    for (_, g), sides in sorted(games.items()):
        (a, won), (b, _) = sides["Blue"], sides["Red"]
        ra, rb = r.get(a, 1500.0), r.get(b, 1500.0)
        out[g] = (ra, rb)
        step = 20.0 * (won - 1.0 / (1.0 + 10.0 ** ((rb - ra) / 400.0)))
        for team, new in ((a, ra + step), (b, rb - step)):
            if team is not None:
                r[team] = new
    return out, r


@pytest.mark.parametrize("chunk", [60, 400, 10_000])
@pytest.mark.parametrize("teams", [6, 150])
def test_chunked_equals_sequential(spark, chunk, teams):
    rows = season(800, 5, teams)
    games, final = rate_games(pair_opponents(frame(spark, rows)), chunk_games=chunk)
    want, last = sequential(rows)
    got = {r["gameid"]: (r["ra"], r["rb"]) for r in games.collect()}
    assert set(got) == set(want)
    assert max(abs(x - y) for g in want for x, y in zip(got[g], want[g])) < 1e-8
    ratings = {r["team"]: r["rating"] for r in final.collect()}
    assert all(ratings[t] == pytest.approx(v, abs=1e-8) for t, v in last.items())
    assert sum(v - 1500.0 for v in ratings.values()) == pytest.approx(0.0, abs=1e-6)


def test_teams_without_id_keep_no_rating(spark):
    rows = season(300, 9, 8, hole=0.1)
    games, _ = rate_games(pair_opponents(frame(spark, rows)), chunk_games=50)
    want, _ = sequential(rows)
    got = {r["gameid"]: (r["ra"], r["rb"]) for r in games.collect()}
    assert max(abs(x - y) for g in want for x, y in zip(got[g], want[g])) < 1e-8


def test_ratings_carry_over(spark):
    rows = season(400, 2)
    early, late = rows[:400], rows[400:]
    _, first = rate_games(pair_opponents(frame(spark, early)), chunk_games=60)
    games, final = rate_games(pair_opponents(frame(spark, late)), first, chunk_games=60)
    want, last = sequential(rows)
    got = {r["gameid"]: r["ra"] for r in games.collect()}
    assert all(v == pytest.approx(want[g][0], abs=1e-8) for g, v in got.items())
    assert {r["team"]: round(r["rating"], 6) for r in final.collect()} == {t: round(v, 6) for t, v in last.items()}


def test_one_sided_games_read_but_do_not_move(spark):
    rows = season(60, 4, 4)
    teams = pair_opponents(frame(spark, rows)).filter(~((F.col("gameid") == 30) & (F.col("side") == "Red")))
    out = {(r["gameid"], r["side"]): r for r in elo_ratings(teams).collect()}
    lone = out[30, "Blue"]
    assert lone["elo_decayed_team"] == lone["elo_team"]
    want, _ = sequential([r for r in rows if r[0] != 30])
    assert all(out[g, "Blue"]["elo_team"] == pytest.approx(v[0], abs=1e-8) for g, v in want.items())


def test_decay_halves_after_a_half_life(spark):
    day = 86_400
    rows = [(1, 0, "Blue", "A", 1), (1, 0, "Red", "B", 0), (2, 365 * day, "Blue", "A", 1), (2, 365 * day, "Red", "B", 0)]
    out = {(r["gameid"], r["side"]): r for r in elo_ratings(pair_opponents(frame(spark, rows))).collect()}
    assert out[2, "Blue"]["elo_team"] == pytest.approx(1510.0)
    assert out[2, "Blue"]["elo_decayed_team"] == pytest.approx(1505.0)
    assert out[2, "Blue"]["elo_decayed_opp"] == pytest.approx(1495.0)
