"""Roster stability: who played last time, and for how long unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.config import MIN_ID_COVERAGE, ROSTER_SIZE
from fairline.operators.features import ORDER, TEAM, with_keys
from fairline.plans.history import ROW, Agg, beside, number_rows, with_history
from fairline.plans.slices import Slices, plan_slices
from fairline.session import cut_lineage


def id_coverage(players: DataFrame) -> DataFrame:
    """One row: share of player rows with an id and the column to match by."""
    cover = F.avg(F.col("playerid").isNotNull().cast("double"))
    return players.agg(cover.alias("coverage")).withColumn(
        "id_column", F.when(F.col("coverage") >= MIN_ID_COVERAGE, "playerid").otherwise("playername")
    )


def roster_map(players: DataFrame) -> DataFrame:
    """(gameid, teamid) -> sorted distinct trimmed player ids."""
    if "playerid" in players.columns:
        by_id = id_coverage(players).select(F.col("id_column") == "playerid").scalar()
        who = F.when(by_id, F.col("playerid")).otherwise(F.col("playername"))
    else:
        who = F.col("playername")
    return (
        players.filter(F.col("teamid").isNotNull())
        .groupBy("gameid", "teamid")
        .agg(F.sort_array(F.collect_set(F.trim(who))).alias("roster"))
    )


def roster_features(teams: DataFrame, players: DataFrame, slices: Slices | None = None) -> DataFrame:
    """Overlap with the last known roster and games since it last changed.

    A first game and a game without player rows count as unchanged.  The count
    is 0 on a change and grows by one with every later game.
    """
    slices = slices or plan_slices(teams)
    base = number_rows(teams)
    own = with_keys(base.select(ROW, "gameid", "date", "side", "teamid", "opp_teamid", "patch"))
    rows = cut_lineage(own.join(roster_map(players), ["gameid", "teamid"], "left"), "rosters")
    size = F.coalesce(F.size("roster"), F.lit(0))
    present = F.when(F.col("roster").isNotNull() & (size > 0), F.col("roster"))
    rows = with_history(
        rows, TEAM, ORDER, [Agg("_before", "last", present), Agg("_seq", "count")], slices
    )
    overlap = F.when(
        present.isNotNull() & F.col("_before").isNotNull(),
        F.size(F.array_intersect("roster", "_before")) / ROSTER_SIZE,
    ).otherwise(1.0)
    rows = rows.withColumn("roster_overlap", overlap)
    changed = F.col("roster_overlap") < 1.0
    rows = with_history(rows, TEAM, ORDER, [Agg("_since", "max", F.when(changed, F.col("_seq") + 1))], slices)
    streak = F.col("_seq") + 1 - F.coalesce(F.col("_since"), F.lit(0))
    known = F.col("teamid").isNotNull()
    rows = rows.withColumn(
        "games_since_roster_change",
        F.when(~known, F.lit(1)).when(changed, F.lit(0)).otherwise(streak).cast("int"),
    )
    out = beside(base, rows, ["roster_overlap", "games_since_roster_change"])
    first = ["gameid", "teamid"]
    return out.select(*first, *[c for c in out.columns if c not in first and (c != ROW or ROW in teams.columns)])


def roster_change_report(rows: DataFrame) -> DataFrame:
    """Rows and share of rows per overlap value."""
    counts = rows.groupBy("roster_overlap").agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.select(F.count(F.lit(1))).scalar()
    return counts.withColumns(
        {"share": F.col("n_rows") / total, "changed": (F.col("roster_overlap") < 1.0)}
    )
