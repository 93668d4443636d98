"""Report tables over matches, scored rows and replayed bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.config import SHRINK_H2H
from fairline.functions.stats import right_closed_bin, shrunk_rate

#: fixed values: bins of the probability and of the edge report
PROB_EDGES = [0.0, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 1.0]
PROB_LABELS = ["<15%", "15-25%", "25-35%", "35-45%", "45-55%", "55-65%", "65-75%", "75-85%", ">85%"]
EDGE_EDGES = [0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 1.0]
EDGE_LABELS = ["0-2%", "2-5%", "5-10%", "10-15%", "15-20%", ">20%"]


def season_overview(teams: DataFrame) -> DataFrame:
    """Games, teams, leagues and date range per year.

    Distinct counts are made from one row per (year, game) and so on, so no
    group of the final step is large.
    """
    per_game = teams.groupBy("year", "gameid").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    games = per_game.groupBy("year").agg(
        F.sum("n").alias("team_rows"),
        F.count(F.lit(1)).alias("matches"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
    )
    def distinct(col: str) -> DataFrame:
        return teams.filter(F.col(col).isNotNull()).select("year", col).distinct().groupBy("year").agg(
            F.count(F.lit(1)).alias(f"n_{col}")
        )

    return games.join(distinct("teamid"), "year", "left").join(distinct("league"), "year", "left")


def team_directory(rows: DataFrame, league: str | None = None) -> DataFrame:
    """Games, last date and last league per team, most recent first."""
    teams = rows.groupBy("teamname").agg(
        F.count("result").alias("n_games"),
        F.max("date").alias("last_game"),
        F.max_by("league", F.struct("date", "gameid")).alias("league"),
    )
    if league:
        teams = teams.filter(F.lower("league") == league.lower())
    return teams.orderBy(F.col("last_game").desc(), "teamname")


def latest_by_team(rows: DataFrame, columns: list[str], key: str = "teamname") -> DataFrame:
    """Newest row per team, as one aggregate (no sort of a team's history)."""
    packed = F.struct(*columns)
    newest = rows.groupBy(key).agg(F.max_by(packed, F.struct("date", "gameid")).alias("_r"))
    return newest.select(key, "_r.*")


def top_teams(rows: DataFrame, n: int = 20) -> DataFrame:
    latest = latest_by_team(rows, ["elo_team"])
    return latest.orderBy(F.col("elo_team").desc(), "teamname").limit(n)


def search_team(teams: DataFrame, name: str, column: str = "teamname") -> DataFrame:
    """Rows of teams with this name, or else of teams whose name contains it."""
    low = F.lower(F.col(column))
    exact = teams.select(F.coalesce(F.max(low == name.lower()), F.lit(False))).scalar()
    return teams.filter(F.when(exact, low == name.lower()).otherwise(low.contains(name.lower())))


def h2h_totals(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Games and wins of (teamid, opp_teamid) in ``rows``; up to ``asof`` if ``asked`` has that column."""
    keys = ["teamid", "opp_teamid"]
    games = {"h2h_n": F.lit(1), "h2h_wins": F.col("result")}
    if "asof" in asked.columns:
        from fairline.plans.asof import asof_totals

        return asof_totals(asked, rows, keys, "asof", games)
    return asked.join(rows.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in games.items()]), keys, "left")


def h2h_lookup(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Record of (team, opp) in ``rows`` for every pair, shrunk to its prior.

    ``pairs`` has teamid, opp_teamid, prior and optionally ``asof``; with it
    only games up to that instant count, one count per (pair, asof).
    """
    n, w = F.coalesce("h2h_n", F.lit(0)), F.coalesce("h2h_wins", F.lit(0))
    joined = h2h_totals(rows, pairs)
    return joined.withColumns({"h2h_n": n, "h2h_wr": shrunk_rate(n, w, SHRINK_H2H, F.col("prior"))}).drop("h2h_wins")


def staleness(latest: DataFrame, asof: Column, min_games: int = 20, max_days: int = 14) -> DataFrame:
    """Flags for teams with a short or an old record at ``asof``."""
    days = F.floor((F.unix_micros(asof) - F.unix_micros("date")) / 86400e6)
    return latest.withColumns(
        {
            "days_ago": days,
            "few_games": F.col("n_games_played") < min_games,
            "stale": days > max_days,
        }
    )


# --- scored rows and bets -----------------------------------------------------

def calibration_uniform(df: DataFrame, by: list[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Mean probability and win share per uniform bin, closed on the right."""
    inner = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    number = F.size(F.filter(inner, lambda e: e < F.col(p)))
    return df.groupBy(*by, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("win_share")
    )


def calibration_report(bets: DataFrame) -> DataFrame:
    bucket = right_closed_bin(F.col("p_model"), PROB_EDGES, PROB_LABELS)
    out = bets.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count("result").alias("n"),
        F.avg("result").alias("actual_wr"),
        F.avg("p_model").alias("avg_p_model"),
        F.avg("p_market").alias("avg_p_market"),
    )
    return out.withColumns(
        {
            "model_err": F.col("avg_p_model") - F.col("actual_wr"),
            "market_err": F.col("avg_p_market") - F.col("actual_wr"),
        }
    )


def edge_report(bets: DataFrame) -> DataFrame:
    bucket = right_closed_bin(F.abs("edge"), EDGE_EDGES, EDGE_LABELS)
    return bets.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("bet_direction") != "PASS").alias("bets"),
        F.avg("model_correct").alias("model_acc"),
        F.sum("directional_pnl").alias("directional_pnl"),
    )


def year_report(bets: DataFrame) -> DataFrame:
    return bets.groupBy(F.year("date").alias("year")).agg(
        F.count("directional_pnl").alias("n"),
        F.sum("directional_pnl").alias("directional_pnl"),
        F.avg("model_correct").alias("model_acc"),
    )


def headline(bets: DataFrame, bankroll: float) -> DataFrame:
    placed = F.col("bet_direction") != "PASS"
    out = bets.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(placed).alias("bets"),
        F.coalesce(F.avg(F.when(placed, (F.col("directional_pnl") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(placed, F.col("stake"))), F.lit(0.0)).alias("avg_stake"),
        F.sum("directional_pnl").alias("total_pnl"),
        F.avg(F.abs("edge")).alias("mean_abs_edge"),
        F.stddev_samp("edge").alias("std_edge"),
        F.avg("model_correct").alias("model_acc"),
        F.avg("market_correct").alias("market_acc"),
    )
    return out.withColumns(
        {"roi": F.col("total_pnl") / bankroll, "lift": F.col("model_acc") - F.col("market_acc")}
    )


def best_and_worst(bets: DataFrame, n: int = 5, key: str = "match_id") -> DataFrame:
    """The n most and least profitable bets, if at least five were placed."""
    placed = bets.filter(F.col("bet_direction") != "PASS")
    enough = placed.select(F.count(F.lit(1)) >= 5).scalar()
    ends = []
    for name, order in (("best", F.col("directional_pnl").desc()), ("worst", F.col("directional_pnl").asc())):
        ends.append(placed.orderBy(order, key).limit(n).withColumn("end", F.lit(name)))
    return ends[0].unionByName(ends[1]).filter(enough)
