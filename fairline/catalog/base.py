"""Shared parts of the registered queries and of their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame, SparkSession

from fairline import fixtures
from fairline.functions.stats import rounded
from fairline.operators.ratings import elo_ratings
from fairline.plans.slices import Slices, plan_slices
from fairline.session import scratch_path

Registry = dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]


def register(registry: Registry, name: str, sql: str | None = None, digits: int = 6):
    """Decorator: put a query and its SQL into a module's registry."""

    def add(build):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return rounded(build(spark, sf), digits)

        run.__name__ = name
        registry[name] = (run, sql)
        return build

    return add


def match_slices(spark: SparkSession, sf: str) -> Slices:
    """Slices for the match log, planned on the time column of the source."""
    return plan_slices(fixtures.events(spark, sf).select("ts"), "ts").rename("date")


_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table: built once per application and source, then read back."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STAGES[key] = spark.read.parquet(path)
    return _STAGES[key]


def once(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table for one reader: the stage table if there is one, else not stored, so that Spark leaves out what is not read."""
    known = _STAGES.get((spark.sparkContext.applicationId, sf, name))
    return build() if known is None else known


def _rated(spark: SparkSession, sf: str, columns: Collection[str] | None = None) -> DataFrame:
    return elo_ratings(team_rows(spark, sf), match_slices(spark, sf), columns=columns)


def rated_rows(spark: SparkSession, sf: str, columns: Collection[str] | None = None) -> DataFrame:
    """Match rows with opponents and ratings (a stage table; a narrow one for a reader of few ``columns``, if there is no whole one)."""
    if columns is None or (spark.sparkContext.applicationId, sf, "rated") in _STAGES:
        return stage(spark, sf, "rated", lambda: _rated(spark, sf))
    name = "rated-" + hashlib.sha256(",".join(sorted(columns)).encode()).hexdigest()[:12]
    return stage(spark, sf, name, lambda: _rated(spark, sf, columns))


def rated_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows for one reader."""
    return once(spark, sf, "rated", lambda: _rated(spark, sf))


def team_rows(spark: SparkSession, sf: str) -> DataFrame:
    from fairline.sources.match_log import pair_opponents

    return pair_opponents(fixtures.match_rows(spark, sf))


# --- SQL ---------------------------------------------------------------------

EVENTS = """
ev AS (
  SELECT event_id, event_id // 2 AS gameid, event_id % 2 AS red, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
g AS (
  SELECT b.gameid, least(b.ts, r.ts) AS date, b.user_id % 30 AS bu, r.user_id % 30 AS ru,
         b.value AS bv, r.value AS rv, b.k AS bk, r.k AS rk,
         CASE b.event_type WHEN 'click' THEN 'LCK' WHEN 'view' THEN 'LPL' WHEN 'purchase' THEN 'LEC'
              WHEN 'signup' THEN 'VCS' ELSE 'OTH' END AS league,
         'T' || (b.user_id % 30) AS bt, 'T' || (r.user_id % 30) AS rt,
         CASE WHEN b.value >= r.value THEN 1 ELSE 0 END AS bwon
  FROM ev b JOIN ev r ON b.gameid = r.gameid AND b.red = 0 AND r.red = 1
  WHERE b.user_id % 30 <> r.user_id % 30)"""


def _pick(i: int) -> str:
    value = f"'C' || ((7 * k + 13 * {i} + CASE WHEN side = 'Blue' THEN 0 ELSE 5 END) % 40)"
    return f"CASE WHEN k % 19 <> 0 THEN {value} END AS pick{i}" if i == 5 else f"{value} AS pick{i}"


MATCHES = (
    EVENTS
    + """,
s AS (
  SELECT gameid, date, league, bk, 'Blue' AS side, bt AS teamid, rt AS opp_teamid, bv AS value,
         rv AS other_value, bk AS k, rk AS other_k, bwon AS result FROM g
  UNION ALL
  SELECT gameid, date, league, bk, 'Red', rt, bt, rv, bv, rk, bk, 1 - bwon FROM g),
m AS (
  SELECT *, teamid AS teamname, CAST(year(date) AS INTEGER) AS year,
    CASE WHEN day(date) <= 15 THEN 'Spring' ELSE 'Summer' END AS split,
    'P' || ((day(date) - 1) // 7) AS patch,
    CASE WHEN day(date) >= 25 THEN 1 ELSE 0 END AS playoffs,
    CAST(gameid % 3 + 1 AS INTEGER) AS game,
    CASE WHEN gameid % 17 <> 0 THEN (value - other_value) * 50 END AS golddiffat15,
    CASE WHEN gameid % 17 <> 0 THEN (value - other_value) * 30 END AS golddiffat10,
    CASE WHEN gameid % 17 <> 0 THEN (value - other_value) * 40 END AS xpdiffat15,
    CASE WHEN gameid % 17 <> 0 THEN (value - other_value) * 25 END AS xpdiffat10,
    CAST((bk % 2 = 1) = (side = 'Blue') AS DOUBLE) AS firstblood,
    CAST((bk % 3 = 0) = (side = 'Blue') AS DOUBLE) AS firstdragon,
    CAST((bk % 5 = 0) = (side = 'Blue') AS DOUBLE) AS firstherald,
    CAST((bk % 7 < 3) = (side = 'Blue') AS DOUBLE) AS firsttower,
    CAST((bk % 11 < 5) = (side = 'Blue') AS DOUBLE) AS firstbaron,
    k % 5 AS dragons, other_k % 5 AS opp_dragons, k % 3 AS heralds, other_k % 3 AS opp_heralds,
    k % 2 AS barons, other_k % 2 AS opp_barons, k % 11 AS towers, other_k % 11 AS opp_towers,
    k % 4 AS turretplates, other_k % 4 AS opp_turretplates,
    value / 100.0 AS ckpm, value / 200.0 AS team_kpm, k / 10.0::DOUBLE AS vspm, 900 + value AS earned_gpm,
    CAST(1500 + 10 * k AS DOUBLE) AS gamelength,
    CASE WHEN gameid % 13 <> 0 THEN CASE WHEN side = 'Blue' THEN '1' ELSE '0' END END AS firstPick,
    """
    + ", ".join(_pick(i) for i in range(1, 6))
    + """
  FROM s)"""
)

# Ratings by one step per game: r holds the 30 teams' ratings.
RATINGS = (
    MATCHES.replace("\nev AS (", "RECURSIVE\nev AS (", 1)
    + """,
steps AS (
  SELECT row_number() OVER (ORDER BY date, gameid) AS n, gameid, CAST(bu AS INTEGER) + 1 AS bi,
         CAST(ru AS INTEGER) + 1 AS ri, bwon FROM g),
walk(n, r, gameid, rb, rr) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range(30), lambda x: 1500::DOUBLE), CAST(NULL AS BIGINT),
         1500::DOUBLE, 1500::DOUBLE
  UNION ALL
  SELECT t.n,
    list_transform(w.r, lambda x, i: CASE
      WHEN i = t.bi THEN x + 20 * (t.bwon - 1 / (1 + pow(10::DOUBLE, (w.r[t.ri] - w.r[t.bi]) / 400)))
      WHEN i = t.ri THEN x - 20 * (t.bwon - 1 / (1 + pow(10::DOUBLE, (w.r[t.ri] - w.r[t.bi]) / 400)))
      ELSE x END),
    t.gameid, w.r[t.bi], w.r[t.ri]
  FROM walk w JOIN steps t ON t.n = w.n + 1),
e0 AS (
  SELECT m.*, CASE WHEN side = 'Blue' THEN rb ELSE rr END AS elo_team,
         CASE WHEN side = 'Blue' THEN rr ELSE rb END AS elo_opp
  FROM m JOIN walk USING (gameid)),
e1 AS (
  SELECT *, elo_team - elo_opp AS elo_diff,
    1 / (1 + pow(10::DOUBLE, -(elo_team - elo_opp) / 400)) AS elo_expected,
    result - 1 / (1 + pow(10::DOUBLE, -(elo_team - elo_opp) / 400)) AS elo_overperf,
    1500 + (elo_team - 1500) * pow(0.5::DOUBLE, coalesce(epoch_us(date) - lag(epoch_us(date)) OVER w, 0) / 86400e6 / 365)
      AS elo_decayed_team,
    elo_team - coalesce(avg(elo_team) OVER (PARTITION BY league ORDER BY date, gameid, side
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1500) AS elo_league_rel
  FROM e0 WINDOW w AS (PARTITION BY teamid ORDER BY date, gameid)),
e AS (
  SELECT *, elo_decayed_team - elo_decayed_opp AS elo_decayed_diff FROM (
    SELECT *, sum(elo_decayed_team) OVER (PARTITION BY gameid) - elo_decayed_team AS elo_decayed_opp FROM e1))"""
)


def sql(
    ctes: str, body: str, plain: Sequence[str] = (), doubles: Sequence[str] = (), digits: int = 6
) -> str:
    """Full statement: CTEs, body, and the same rounding the queries use."""
    tiny = f"{0.5 * 10.0 ** -digits:.{digits + 1}f}"
    cols = [*plain] + [
        f"CASE WHEN abs({c}) < {tiny} THEN 0.0::DOUBLE ELSE round(CAST({c} AS DOUBLE), {digits}) END AS {c}"
        for c in doubles
    ]
    head = f"WITH {ctes.strip()}\n" if ctes.strip() else ""
    return f"{head}SELECT {', '.join(cols)} FROM (\n{body}\n) AS body_"


def prior(n: int | str, keys: str = "teamid", order: str = "date, gameid") -> str:
    lo = "UNBOUNDED" if n == "all" else n
    return f"(PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {lo} PRECEDING AND 1 PRECEDING)"
