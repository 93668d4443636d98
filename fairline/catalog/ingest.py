"""Queries for reading and cleaning the match log, and for stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import MATCHES, Registry, register, sql, team_rows
from fairline.catalog.features import PLAYERS
from fairline.session import scratch_path
from fairline.sources import match_log as L
from fairline.sources.store import StageStore, read_report, write_report

REGISTRY: Registry = {}

RAW = PLAYERS + """,
raw AS (
  SELECT gameid, CASE WHEN gameid % 53 = 0 AND side = 'Red' THEN 'unknown' ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS date,
    side, 'team' AS position, teamid, CASE WHEN gameid % 59 <> 0 THEN CAST(result AS VARCHAR) END AS result,
    CASE WHEN gameid % 17 = 0 THEN 'n/a' ELSE CAST(golddiffat15 AS VARCHAR) END AS golddiffat15, team_kpm,
    CASE WHEN day(date) <= 15 THEN 2023 ELSE 2024 END AS year
  FROM m WHERE NOT (gameid % 101 = 0 AND side = 'Red')),
dated AS (SELECT * FROM raw WHERE TRY_CAST(date AS TIMESTAMP) IS NOT NULL),
paired AS (SELECT *, lead(teamid) OVER w AS nx, lag(teamid) OVER w AS pv FROM (
    SELECT *, count(*) OVER (PARTITION BY gameid) AS n FROM dated) WHERE n = 2 WINDOW w AS (PARTITION BY gameid ORDER BY side)),
tm AS (SELECT gameid, side, year, teamid, coalesce(nx, pv) AS opp_teamid, CAST(result AS INTEGER) AS result,
    TRY_CAST(golddiffat15 AS DOUBLE) AS golddiffat15, team_kpm, epoch_us(CAST(date AS TIMESTAMP)) AS us FROM paired WHERE result IS NOT NULL)"""


def raw_log(spark, sf):
    """The match log as text, with the faults real files have."""
    g = F.col("gameid")
    rows = fixtures.match_rows(spark, sf).filter(~((g % 101 == 0) & (F.col("side") == "Red")))
    when = F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    year = F.when(F.dayofmonth("date") <= 15, "2023").otherwise("2024")
    teams = rows.select(
        g, F.when((g % 53 == 0) & (F.col("side") == "Red"), "unknown").otherwise(when).alias("date"), "side",
        F.lit("team").alias("position"), "teamid", F.when(g % 59 != 0, F.col("result").cast("string")).alias("result"),
        F.when(g % 17 == 0, "n/a").otherwise(F.col("golddiffat15").cast("string")).alias("golddiffat15"),
        F.col("team_kpm").cast("string").alias("team kpm"), F.lit(None).cast("string").alias("playerid"), year.alias("_year"))
    players = fixtures.player_rows(spark, sf).select(
        "gameid", when.alias("date"), "side", F.lit("mid").alias("position"), "teamid", "playerid", year.alias("_year"))
    return teams.unionByName(players, allowMissingColumns=True)


TEAM = ["gameid", "side", "year", "teamid", "opp_teamid", "result", "us"]


@register(REGISTRY, "S1_S2_S3_S4_S5_S6_csv_match_log", sql(RAW, "SELECT * FROM tm", TEAM, ["golddiffat15", "team_kpm"]))
def csv_log(spark, sf):
    """Yearly CSV files written from the tables, read back through the whole ingest."""
    log, paths = raw_log(spark, sf), []
    for year in ("2023", "2024"):
        paths.append(f"{scratch_path(spark, 'csv')}/{year}_match_data")
        log.filter(F.col("_year") == year).drop("_year").write.option("header", True).csv(paths[-1])
    teams, _ = L.read_match_log(spark, [*paths, paths[0] + "-missing"])
    out = teams.withColumns({"us": F.unix_micros("date"), "gameid": F.col("gameid").cast("long")})
    return out.select(*TEAM, "golddiffat15", "team_kpm")


@register(REGISTRY, "S3_dates", sql(RAW, "SELECT side, count(*) AS n, count(TRY_CAST(date AS TIMESTAMP)) AS n_dated FROM raw GROUP BY side",
                                    ["side", "n", "n_dated"]))
def dates(spark, sf):
    log = raw_log(spark, sf).filter(F.col("position") == "team")
    total = log.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    dated = L.parse_dates(log).groupBy("side").agg(F.count(F.lit(1)).alias("n_dated"))
    return total.join(dated, "side")


@register(REGISTRY, "S4_numeric_cast",
          sql(RAW, "SELECT gameid, side, TRY_CAST(golddiffat15 AS DOUBLE) AS golddiffat15, CAST(result AS DOUBLE) AS result FROM raw",
              ["gameid", "side"], ["golddiffat15", "result"]))
def numerics(spark, sf):
    log = L.cast_numerics(raw_log(spark, sf)).filter(F.col("position") == "team")
    return log.select("gameid", "side", "golddiffat15", "result")


@register(REGISTRY, "S5_split_rows",
          sql(RAW, "SELECT 'team' AS kind, count(*) AS n FROM raw UNION ALL SELECT 'player', count(*) FROM pl", ["kind", "n"]))
def split_rows(spark, sf):
    parts = L.split_rows(raw_log(spark, sf).select("position"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(parts[0], "team").unionByName(count(parts[1], "player"))


@register(REGISTRY, "J1_opponents",
          sql(MATCHES, "SELECT * FROM m WHERE gameid % 101 <> 0", ["gameid", "side", "teamid", "opp_teamid"]))
def opponents(spark, sf):
    """Games that lost their Red row are dropped."""
    rows = fixtures.match_rows(spark, sf).filter(~((F.col("gameid") % 101 == 0) & (F.col("side") == "Red")))
    return L.pair_opponents(rows).select("gameid", "side", "teamid", "opp_teamid")


@register(REGISTRY, "S7_stage_tables",
          sql(MATCHES, "SELECT league, count(*) AS n FROM m GROUP BY league", ["league", "n"]))
def stage_tables(spark, sf):
    """Team rows stored by league; the second call reads the stored table."""
    store = StageStore(spark, scratch_path(spark, "store"))
    store.save("teams", team_rows(spark, sf).select("gameid", "side", "league"), ["league"])
    again = store.get_or_build("teams", lambda: team_rows(spark, sf))
    return again.groupBy("league").agg(F.count(F.lit(1)).alias("n"))


@register(REGISTRY, "S8_report_files",
          sql(MATCHES, "SELECT league, side, avg(result) AS win_rate FROM m GROUP BY ALL", ["league", "side"], ["win_rate"]))
def report_files(spark, sf):
    report = team_rows(spark, sf).groupBy("league", "side").agg(F.avg("result").alias("win_rate"))
    path = scratch_path(spark, "report")
    write_report(report, path)
    return read_report(spark, path, report.schema)
