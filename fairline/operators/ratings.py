"""Pre-match ratings, computed in parallel along time.

Each game moves both teams' ratings by K times (result - expectation), and the
expectation depends on both ratings, so a rating is a recurrence through every
earlier game.  The games are cut into time chunks of bounded size.  All chunks
are folded at once, each from a guess of the ratings at its start; the ends of
the chunks then correct the starts of later chunks, and the fold repeats until
no start changes.  A chunk fold also returns how strongly each team's end
rating follows its start rating; with it the correction crosses all chunks in
one affine scan per team, so a handful of rounds is enough.  After round r the
first r chunks are exact in any case, so the loop always ends.

Shuffles per round are one small table (a row per chunk and team); the games
themselves stay partitioned by chunk.  No team is ever collected into one task.
"""

from __future__ import annotations

import math
from collections.abc import Collection

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.config import RATING_HALF_LIFE_DAYS, RATING_K, RATING_SCALE, RATING_START
from fairline.plans.affine import affine_scan
from fairline.plans.history import ROW, Agg, anonymous_key, beside, number_rows, with_history
from fairline.plans.slices import Slices, plan_slices
from fairline.session import cut_lineage

#: A team that plays much inside a chunk forgets its start rating there; below
#: this carry-over its end is taken as it is.  (The constant only steers the
#: iteration, and keeps running products inside double range.)
_MIN_CARRY = 0.5


def expectation(diff: Column | str) -> Column:
    """Chance to win for a rating lead of ``diff``."""
    diff = F.col(diff) if isinstance(diff, str) else diff
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -diff / RATING_SCALE))


def game_table(teams: DataFrame) -> DataFrame:
    """One row per game: gameid, date, its teams a and b, result of a, and whether both sides are there."""
    side = F.struct("side", "teamid", "opp_teamid", F.col("result").cast("double").alias("result"))
    per_game = teams.groupBy("gameid").agg(
        F.min("date").alias("date"), F.count(F.lit(1)).alias("rows"), F.min(side).alias("a"), F.max(side).alias("b")
    )
    two = F.col("rows") == 2
    return per_game.select(
        "gameid",
        "date",
        F.col("a.teamid").alias("a"),
        F.when(two, F.col("b.teamid")).otherwise(F.col("a.opp_teamid")).alias("b"),
        F.col("a.result").alias("result"),
        two.alias("rated"),
    )


def _fold(games: pd.DataFrame, starts: dict, on_game=None) -> dict:
    """Play the games in order; returns team -> [rating, carry-over].

    Ratings are kept as distance from the common start value.  A team without
    an id plays at the start value and keeps nothing.
    """
    state = {team: [dev, 1.0] for team, dev in starts.items()}
    slope = math.log(10.0) / RATING_SCALE
    columns = (games[c].tolist() for c in ("a", "b", "result", "rated"))
    for i, (a, b, result, rated) in enumerate(zip(*columns)):
        sa = state.get(a) or [0.0, 1.0]
        sb = state.get(b) or [0.0, 1.0]
        if on_game:
            on_game(i, sa[0], sb[0])
        if not rated:
            continue
        p = 1.0 / (1.0 + 10.0 ** ((sb[0] - sa[0]) / RATING_SCALE))
        step = RATING_K * (result - p)
        keep = 1.0 - RATING_K * slope * p * (1.0 - p)
        sa[0] += step
        sb[0] -= step
        sa[1] *= keep
        sb[1] *= keep
    return state


def _sorted(games: pd.DataFrame) -> pd.DataFrame:
    ordered = games.sort_values(["date", "gameid"], kind="stable")
    return ordered.assign(a=ordered["a"].where(ordered["a"].notna(), None), b=ordered["b"].where(ordered["b"].notna(), None))


def _starts(state: pd.DataFrame) -> dict:
    return dict(zip(state["team"].tolist(), state["start"].tolist()))


def _chunk_ends(key, games: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    starts = _starts(state)
    ends = _fold(_sorted(games), starts)
    teams = list(starts)
    return pd.DataFrame(
        {
            "chunk": [key[0]] * len(teams),
            "team": teams,
            "start": [starts[t] for t in teams],
            "end": [ends[t][0] for t in teams],
            "carry": [ends[t][1] if ends[t][1] >= _MIN_CARRY else 0.0 for t in teams],
            "base": state["base"].tolist(),
        }
    )


def _chunk_games(key, games: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    ordered = _sorted(games)
    a, b = [0.0] * len(ordered), [0.0] * len(ordered)

    def note(i, ra, rb):
        a[i], b[i] = ra, rb

    _fold(ordered, _starts(state), note)
    return pd.DataFrame({"gameid": ordered["gameid"], "ra": a, "rb": b})


def rate_games(
    teams: DataFrame, initial: DataFrame | None = None, chunk_games: int | None = None, tolerance: float = 1e-10
) -> tuple[DataFrame, DataFrame]:
    """(games, ratings): ratings before every game, and every team's rating after all.

    games: gameid, a, b, rated, ra, rb.  ratings: team, rating.  ``initial``
    (team, rating) continues an earlier run; other teams start at the common
    value.  ``chunk_games`` bounds the games one task folds per round; by
    default the games are spread over the cluster's task slots.
    """
    return rate_table(cut_lineage(game_table(teams), "games"), initial, chunk_games, tolerance)


def rate_table(
    table: DataFrame, initial: DataFrame | None = None, chunk_games: int | None = None, tolerance: float = 1e-10
) -> tuple[DataFrame, DataFrame]:
    """``rate_games`` for a stored table of games as ``game_table`` makes it."""
    spark = table.sparkSession
    if chunk_games is None:
        slots = max(8, spark.sparkContext.defaultParallelism)
        chunk_games = min(500_000, max(2_500, table.count() // slots))
    slices = plan_slices(table, "date", chunk_games + chunk_games // 4)
    games = table.withColumn("chunk", slices.column()).repartition("chunk").persist()
    fold = lambda out, schema, state: (
        games.groupBy("chunk")
        .cogroup(state.select("chunk", "team", "start", "base").groupBy("chunk"))
        .applyInPandas(out, schema)
    )
    ends_schema = "chunk long, team string, start double, end double, carry double, base double"
    try:
        members = games.select("chunk", F.explode(F.array("a", "b")).alias("team")).filter(F.col("team").isNotNull()).distinct()
        if initial is None:
            members = members.withColumn("base", F.lit(0.0))
        else:
            dev = initial.select("team", (F.col("rating") - RATING_START).alias("base"))
            members = members.join(dev, "team", "left").fillna({"base": 0.0})
        state = cut_lineage(members.withColumn("start", F.col("base")), "starts")
        chunks = games.select(F.count_distinct("chunk")).first()[0]
        for _ in range(chunks):
            solved = _corrected_starts(fold(_chunk_ends, ends_schema, state), chunks)
            state = cut_lineage(solved, "starts")
            if state.agg(F.max(F.abs(F.col("start") - F.col("old")))).first()[0] < tolerance:
                break
        per_game = fold(_chunk_games, f"gameid {dict(table.dtypes)['gameid']}, ra double, rb double", state)
        out = table.select("gameid", "a", "b", "rated").join(per_game, "gameid")
        out = cut_lineage(
            out.withColumns({"ra": F.col("ra") + RATING_START, "rb": F.col("rb") + RATING_START}), "ratings"
        )
        last = fold(_chunk_ends, ends_schema, state).groupBy("team").agg(
            (F.max_by("end", "chunk") + RATING_START).alias("rating")
        )
    finally:
        games.unpersist()
    if initial is not None:
        last = last.unionByName(initial.select("team", "rating").join(last, "team", "left_anti"))
    return out, last


def _corrected_starts(ends: DataFrame, chunks: int) -> DataFrame:
    """Next guess of every start: chunk, team, start, base, old.

    A chunk maps a start rating to ``end + carry * (start - old start)``.  A
    run of forgetful chunks restarts the recurrence, so the scan runs per
    stretch between them and its products stay far from zero.
    """
    by_chunk = Window.partitionBy("team").orderBy("chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    forgot = F.lag("carry", 1, 1.0).over(by_chunk) == 0.0
    marked = ends.withColumns(
        {
            "gain": F.col("end") - F.col("carry") * F.col("start"),
            "from_last": F.when(forgot, F.lag("end").over(by_chunk)),
            "stretch": F.coalesce(F.sum(F.when(F.col("carry") == 0.0, 1).otherwise(0)).over(before), F.lit(0)),
        }
    )
    in_stretch = Window.partitionBy("team", "stretch").orderBy("chunk")
    maps = marked.withColumns(
        {
            "seq": F.row_number().over(in_stretch) - 1,
            "first_start": F.coalesce(F.first("from_last").over(in_stretch), F.col("base")),
            "carry": F.when(F.col("carry") == 0.0, 1.0).otherwise(F.col("carry")),
        }
    )
    solved = affine_scan(maps, ["team", "stretch"], "seq", "carry", "gain", chunks, "first_start", "next")
    return solved.select("chunk", "team", F.col("next").alias("start"), "base", F.col("start").alias("old"))


def elo_ratings(
    teams: DataFrame, slices: Slices | None = None, chunk_games: int | None = None, half_life: float = RATING_HALF_LIFE_DAYS,
    columns: Collection[str] | None = None,
) -> DataFrame:
    """Team rows plus rating columns, all known before the game is played.

    ``elo_overperf`` uses the result and is only meant for rolling features.
    Rows come with the number that ``number_rows`` gave them.  For a reader of
    few ``columns``, only they and what ratings read are stored and moved.
    """
    slices = slices or plan_slices(teams)
    own = ["gameid", "date", "side", "teamid", "league", "result"]  # all that ratings read
    if columns is not None:
        teams = teams.select(*[c for c in teams.columns if c in (ROW, "opp_teamid", *own) or c in columns])
    base = number_rows(teams, "teams")
    games, _ = rate_games(base, chunk_games=chunk_games)
    mine = F.when(F.col("teamid").eqNullSafe(F.col("a")), F.col("ra")).otherwise(F.col("rb"))
    other = F.when(F.col("teamid").eqNullSafe(F.col("a")), F.col("rb")).otherwise(F.col("ra"))
    rows = (
        base.select(ROW, *(own if columns is None else [c for c in base.columns if c != ROW])).join(games, "gameid")
        .withColumns({"elo_team": mine, "elo_opp": other, "_team": anonymous_key("teamid", "gameid", "side")})
        .withColumn("elo_diff", F.col("elo_team") - F.col("elo_opp"))
        .withColumn("elo_expected", expectation("elo_diff"))
        .withColumn("elo_overperf", F.col("result") - F.col("elo_expected"))
        .drop("a", "b", "ra", "rb")
    )
    if columns is not None:  # narrow rows are complete, none is joined to its wide one
        rows = decayed_ratings(rows, slices, half_life) if any(c.startswith("elo_decayed_") for c in columns) else rows
        return (league_relative(rows, slices) if "elo_league_rel" in columns else rows).drop("_team", "rated")
    rated = league_relative(decayed_ratings(rows, slices, half_life), slices).drop("_team", "rated", *own)
    found = [c for c in rated.columns if c != ROW]
    return beside(base, rated, found).select("gameid", *[c for c in base.columns if c != "gameid"], *found)


def decayed_ratings(rows: DataFrame, slices: Slices, half_life: float = RATING_HALF_LIFE_DAYS) -> DataFrame:
    """Ratings pulled towards the start value by the time since the last game.

    After every game the decayed rating is set to the plain one, so it is a
    closed form of the plain rating and the gap to the last rated game.
    """
    seen = with_history(
        rows, ["_team"], ["date", "gameid"], [Agg("_last", "last", F.when(F.col("rated"), F.unix_micros("date")))], slices
    )
    days = (F.unix_micros("date") - F.col("_last")) / 86400e6
    kept = F.pow(F.lit(0.5), F.coalesce(days, F.lit(0.0)) / half_life)
    kept = F.when(F.col("rated") & (F.coalesce(days, F.lit(0.0)) > 0), kept).otherwise(1.0)
    mine = seen.withColumn("elo_decayed_team", RATING_START + (F.col("elo_team") - RATING_START) * kept)
    game = Window.partitionBy("gameid").orderBy("side")
    other = F.coalesce(F.lead("elo_decayed_team").over(game), F.lag("elo_decayed_team").over(game), F.col("elo_opp"))
    return (
        mine.withColumn("elo_decayed_opp", other)
        .withColumn("elo_decayed_diff", F.col("elo_decayed_team") - F.col("elo_decayed_opp"))
        .drop("_last")
    )


def league_relative(rows: DataFrame, slices: Slices) -> DataFrame:
    """Rating minus the mean rating of all earlier appearances in the league."""
    keyed = rows.withColumn("_league", anonymous_key("league", "gameid", "side"))
    seen = with_history(
        keyed,
        ["_league"],
        ["date", "gameid", "side"],
        [Agg("_sum", "sum", F.col("elo_team")), Agg("_n", "count")],
        slices,
    )
    mean = F.coalesce(F.try_divide(F.col("_sum"), F.col("_n")), F.lit(RATING_START))
    rel = F.when(F.col("league").isNull(), 0.0).otherwise(F.col("elo_team") - mean)
    return seen.withColumn("elo_league_rel", rel).drop("_league", "_sum", "_n")
