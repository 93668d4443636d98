"""Queries for temporal splits, folds and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import MATCHES, Registry, match_slices, register, sql, stage, team_rows
from fairline.catalog.dataset import NUMBERS, feature_rows, known_mirrored, known_sql
from fairline.operators import dataset, validation
from fairline.plans.slices import plan_slices

REGISTRY: Registry = {}
#: the driver's tables span 30 days, so folds are days instead of months
FOLD = dict(train_days=10, val_days=2, stride_days=2)

GAMES = MATCHES + """,
go AS (SELECT gameid, date, row_number() OVER (ORDER BY date, gameid) - 1 AS pos, count(*) OVER () AS n
       FROM m WHERE side = 'Blue'),
sp AS (SELECT gameid, CASE WHEN pos < floor(n * 0.8) THEN 'dev' ELSE 'holdout' END AS part FROM go),
dev AS (SELECT m.* FROM m JOIN sp USING (gameid) WHERE part = 'dev')"""
FOLDS = GAMES + """,
cal AS (SELECT f, (SELECT min(date) FROM dev) + (10 + 2 * f) * INTERVAL 1 DAY AS v0 FROM range(100) t(f)
        WHERE (SELECT min(date) FROM dev) + (12 + 2 * f) * INTERVAL 1 DAY <= (SELECT max(date) FROM dev)),
lg AS (SELECT f, CASE WHEN date < v0 THEN 'train' ELSE 'val' END AS role, gameid, side, date FROM cal JOIN dev
       ON date >= v0 - INTERVAL 10 DAY AND date < v0 + INTERVAL 2 DAY),
ok AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS fold FROM (SELECT f FROM lg GROUP BY f
       HAVING count(*) FILTER (role = 'train') >= 40 AND count(*) FILTER (role = 'val') >= 10)),
fo AS (SELECT CAST(fold AS INTEGER) AS fold, role, gameid, side, date FROM lg JOIN ok USING (f))"""


def assignment(spark, sf):
    return validation.temporal_split(team_rows(spark, sf), slices=match_slices(spark, sf))


def dev_rows(spark, sf):
    rows = team_rows(spark, sf).select("gameid", "side", "date")
    return validation.split_rows(rows, assignment(spark, sf))[0]


def folds(spark, sf):
    """Fold assignment (a stage table)."""
    return stage(spark, sf, "folds", lambda: validation.rolling_folds(dev_rows(spark, sf), **FOLD))


@register(REGISTRY, "V1_temporal_split", sql(GAMES, "SELECT * FROM sp", ["gameid", "part"]))
def split(spark, sf):
    slices = plan_slices(fixtures.events(spark, sf).select("ts"), "ts", 1_000).rename("date")
    return validation.temporal_split(team_rows(spark, sf), slices=slices).select("gameid", "part")


@register(REGISTRY, "V2_rolling_folds", sql(FOLDS, "SELECT * FROM fo", ["fold", "role", "gameid", "side"]))
def rolling(spark, sf):
    return validation.rolling_folds(dev_rows(spark, sf), **FOLD).select("fold", "role", "gameid", "side")


@register(REGISTRY, "V3_fold_leaks",
          sql(FOLDS, """SELECT fold, count(*) FILTER (t > 0 AND v > 0) AS shared_games,
  count(*) FILTER (v = 1) AS single_sided_games FROM (SELECT fold, gameid, count(*) FILTER (role = 'train') AS t,
  count(*) FILTER (role = 'val') AS v FROM fo GROUP BY ALL) GROUP BY fold""",
              ["fold", "shared_games", "single_sided_games"]))
def leaks(spark, sf):
    return validation.fold_leaks(folds(spark, sf))


@register(REGISTRY, "V4_describe_folds",
          sql(FOLDS, "SELECT fold, " + ", ".join(
              f"CAST(CAST(min(date) FILTER (role = '{r}') AS DATE) AS VARCHAR) AS {r}_start, "
              f"CAST(CAST(max(date) FILTER (role = '{r}') AS DATE) AS VARCHAR) AS {r}_end, "
              f"count(*) FILTER (role = '{r}') AS {r}_rows, "
              f"count(DISTINCT gameid) FILTER (role = '{r}') AS {r}_games" for r in ("train", "val"))
              + " FROM fo GROUP BY fold",
              ["fold", *[f"{r}_{x}" for r in ("train", "val") for x in ("start", "end", "rows", "games")]]))
def describe(spark, sf):
    out = validation.describe_folds(folds(spark, sf))
    dates = [c for c in out.columns if c.endswith(("_start", "_end"))]
    return out.withColumns({c: F.col(c).cast("string") for c in dates})


@register(REGISTRY, "T7_last_folds",
          sql(FOLDS, "SELECT fold, count(*) AS n FROM fo WHERE fold > (SELECT max(fold) FROM fo) - 2 GROUP BY fold",
              ["fold", "n"]))
def last_two(spark, sf):
    return validation.last_folds(folds(spark, sf), 2).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@register(REGISTRY, "T9_split_intersection",
          sql(GAMES, """SELECT part, count(*) AS n_games, (SELECT count(*) FROM (SELECT gameid FROM sp WHERE part = 'dev'
  INTERSECT SELECT gameid FROM sp WHERE part = 'holdout')) AS n_shared FROM sp GROUP BY part""",
              ["part", "n_games", "n_shared"]))
def split_intersection(spark, sf):
    parts = assignment(spark, sf)
    shared = validation.split_overlap(parts).select(F.count(F.lit(1))).scalar()
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_games")).withColumn("n_shared", shared)


AUDIT = """SELECT *, broken_rule IS NULL AS passed FROM (SELECT column_name, known_rows, CASE
  WHEN regexp_matches(lower(column_name), 'champion|pick|ban') THEN 'draft column'
  WHEN regexp_matches(lower(column_name), '^(kills|deaths|assists|totalgold|damagetochamp|visionscore|wardsplaced)')
    THEN 'same-match statistic'
  WHEN regexp_matches(column_name, 'at(10|15|20|25)') AND NOT regexp_matches(column_name, 'mean|std|rate|pct|diff|share')
    THEN 'raw snapshot'
  WHEN column_name = 'gamelength' THEN 'direct game length'
  WHEN regexp_matches(column_name, '^(opp_)?(diff_)?elo_overperf$') THEN 'direct overperformance' END AS broken_rule FROM {known})"""


@register(REGISTRY, "V5_leak_audit",
          sql(known_sql(NUMBERS), AUDIT.format(known="kn"), ["column_name", "known_rows", "broken_rule", "passed"]))
def leak_audit(spark, sf):
    ds = known_mirrored(spark, sf)
    return validation.leak_audit(ds, dataset.model_columns(ds)[0])


#: columns that break a rule of the audit, each in a way of its own, and one that only looks like it
_BREAKERS = ["golddiffat15", "golddiffat10", "firstPick", "pick1", "pick5", "result"]


@register(REGISTRY, "V5_leak_audit_of_raw_columns",
          sql(MATCHES + ",\nkn AS (" + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, count({c}) AS known_rows FROM m" for c in _BREAKERS) + ")",
              AUDIT.format(known="kn"), ["column_name", "known_rows", "broken_rule", "passed"]))
def leak_audit_raw(spark, sf):
    """The audit on columns that must not be modelled: draft picks are caught."""
    return validation.leak_audit(team_rows(spark, sf), _BREAKERS)


@register(REGISTRY, "V6_spot_check",
          sql(MATCHES, """SELECT *, coalesce((SELECT avg(result) FROM (SELECT result FROM m o WHERE o.teamid = m.teamid
    AND (o.date, o.gameid) < (m.date, m.gameid) ORDER BY o.date DESC, o.gameid DESC LIMIT 5)), 0.5) AS wr_L5
  FROM m WHERE teamid = 'T1'""", ["gameid", "side"], ["wr_L5"]))
def spot_check(spark, sf):
    """One team's recent form, read from the finished feature table."""
    return feature_rows(spark, sf).filter(F.col("teamname") == "T1").select("gameid", "side", "wr_L5")
