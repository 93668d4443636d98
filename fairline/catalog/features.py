"""Queries for the rolling, rating, roster and draft features."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import (MATCHES, RATINGS, Registry, match_slices, prior, rated_once, rated_rows, register, sql,
                                   stage, team_rows)
from fairline.functions.stats import roll_cond_mean
from fairline.operators import draft, features, ratings, rosters
from fairline.plans.history import anonymous_key, with_history
from fairline.plans.slices import Slices, plan_slices

REGISTRY: Registry = {}
KEYS = ("gameid", "side", "teamid")


def _recent(spark, sf, groups, slices=None, run_rows=None):
    slices = slices or match_slices(spark, sf)
    rows = features.with_keys(team_rows(spark, sf))
    extra = {"run_rows": run_rows} if run_rows else {}
    return features.recent_features(rows, slices, groups, **extra)


def _avg(col, n, fill, name, keys="teamid"):
    return f"coalesce(avg({col}) OVER {prior(n, keys)}, {fill}) AS {name}"


def _std(col, n, name):
    return (f"CASE WHEN count({col}) OVER {prior(n)} >= 3 THEN stddev_samp({col}) OVER {prior(n)} "
            f"ELSE 0 END AS {name}")


def _rate(cond, n, name):
    return (f"coalesce(sum(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) OVER {prior(n)}, 0)::DOUBLE / "
            f"least(row_number() OVER (PARTITION BY teamid ORDER BY date, gameid), {n}) AS {name}")


# --- recent form ---------------------------------------------------------------

FORM = ["wr_L3", "wr_L5", "wr_L10", "form_trend", "ewma_result"]
_KEEP = "power(0.7::DOUBLE, (len(past) - i))"
FORM_SQL = f"""
SELECT *, wr_L5 - wr_L10 AS form_trend,
  CASE WHEN past IS NULL THEN 0.5 ELSE
    list_sum(list_transform(past, lambda x, i: x * {_KEEP})) / list_sum(list_transform(past, lambda x, i: {_KEEP}))
  END AS ewma_result
FROM (SELECT *, {_avg("result", 3, 0.5, "wr_L3")}, {_avg("result", 5, 0.5, "wr_L5")},
        {_avg("result", 10, 0.5, "wr_L10")},
        list(result) OVER {prior("all")} AS past FROM m)"""


@register(REGISTRY, "W5_recent_form", sql(MATCHES, FORM_SQL, KEYS, FORM))
def recent_form(spark, sf):
    return _recent(spark, sf, [features.form_columns]).select(*KEYS, *FORM)


@register(REGISTRY, "W1_W5_recent_form_in_runs", sql(MATCHES, FORM_SQL, KEYS, FORM))
def recent_form_runs(spark, sf):
    """The plan for long histories: slices of time, short runs with copied rows."""
    slices = plan_slices(fixtures.events(spark, sf).select("ts"), "ts", 2_000).rename("date")
    return _recent(spark, sf, [features.form_columns], slices, 150).select(*KEYS, *FORM)


STRENGTH = ["avg_opp_elo_L5", "avg_opp_elo_L10", "overperf_L5", "overperf_L10"]
STRENGTH_SQL = f"""SELECT *, {_avg("elo_opp", 5, 1500, "avg_opp_elo_L5")}, {_avg("elo_opp", 10, 1500, "avg_opp_elo_L10")},
  {_avg("elo_overperf", 5, 0, "overperf_L5")}, {_avg("elo_overperf", 10, 0, "overperf_L10")} FROM e"""


@register(REGISTRY, "W5_schedule_strength", sql(RATINGS, STRENGTH_SQL, KEYS, STRENGTH, 4), 4)
def schedule_strength(spark, sf):
    rows = features.with_keys(rated_rows(spark, sf))
    return features.recent_features(rows, match_slices(spark, sf), [features.form_columns]).select(*KEYS, *STRENGTH)


# --- early game, objectives, style ---------------------------------------------

_early = []
for _src, _stem, _leads in features.EARLY_GAME:
    _early += [(f"{_stem}_mean_L5", _avg(_src, 5, 0, f"{_stem}_mean_L5")),
               (f"{_stem}_mean_L10", _avg(_src, 10, 0, f"{_stem}_mean_L10")),
               (f"{_stem}_std_L10", _std(_src, 10, f"{_stem}_std_L10")),
               (f"pct_pos_{_stem}_L10", _rate(f"{_src} > 0", 10, f"pct_pos_{_stem}_L10"))]
    if _leads:
        for _name, _cond in (("gt1000", "> 1000"), ("gt2000", "> 2000"), ("lt1000", "< -1000")):
            _early.append((f"pct_{_stem}_{_name}_L10", _rate(f"{_src} {_cond}", 10, f"pct_{_stem}_{_name}_L10")))
for _src, _stem in features.FIRST_OBJECTIVES:
    _early += [(f"{_stem}_rate_L{n}", _avg(_src, n, 0.5, f"{_stem}_rate_L{n}")) for n in (5, 10)]
EARLY = [n for n, _ in _early]


@register(REGISTRY, "W1_W2_W3_W8_early_game",
          sql(MATCHES, f"SELECT *, {', '.join(x for _, x in _early)} FROM m", KEYS, EARLY))
def early_game(spark, sf):
    return _recent(spark, sf, [features.early_game_columns]).select(*KEYS, *EARLY)


@register(REGISTRY, "W4_conditional_mean",
          sql(MATCHES, f"SELECT *, coalesce(avg(CASE WHEN result = 1 THEN golddiffat15 END) OVER {prior(10)}, 0) "
                       "AS gold_when_won FROM m", KEYS, ["gold_when_won"]))
def conditional_mean(spark, sf):
    rows = features.with_keys(team_rows(spark, sf))
    from fairline.plans.history import cut_runs, drop_halo

    rows, parts = cut_runs(rows, features.TEAM, features.ORDER, match_slices(spark, sf), 10)
    last10 = features.Frames(parts).last(10)
    mean = roll_cond_mean("golddiffat15", F.col("result") == 1, last10)
    return drop_halo(rows.withColumn("gold_when_won", mean)).select(*KEYS, "gold_when_won")


_obj = []
for _src, _stem in features.OBJECTIVES:
    _part = f"coalesce({_src}::DOUBLE / nullif({_src} + opp_{_src}, 0), 0.5)"
    _obj += [(f"{_stem}_share_L10", _avg(_part, 10, 0.5, f"{_stem}_share_L10")),
             (f"{_stem}_share_std_L10", _std(_part, 10, f"{_stem}_share_std_L10"))]
OBJECTIVE = [n for n, _ in _obj]


@register(REGISTRY, "W12_objective_shares",
          sql(MATCHES, f"SELECT *, {', '.join(x for _, x in _obj)} FROM m", KEYS, OBJECTIVE))
def objective_shares(spark, sf):
    return _recent(spark, sf, [features.objective_columns]).select(*KEYS, *OBJECTIVE)


STYLE = [f"{stem}_mean_L10" for _, stem in features.STYLE]


@register(REGISTRY, "W13_style_means",
          sql(MATCHES, "SELECT *, " + ", ".join(_avg(s, 10, 0, f"{n}_mean_L10") for s, n in features.STYLE) + " FROM m",
              KEYS, STYLE, 8), 8)
def style_means(spark, sf):
    return _recent(spark, sf, [features.style_columns]).select(*KEYS, *STYLE)


# --- whole-career conversion -----------------------------------------------------

CAREER = ["lead_conv_rate", "strong_lead_conv", "comeback_rate", "avg_gdiff15_when_win", "avg_gdiff15_when_loss"]


def _conversion(cond, prior_rate, name):
    n = f"coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER {prior('all')}, 0)"
    w = f"coalesce(sum(CASE WHEN {cond} THEN result ELSE 0 END) OVER {prior('all')}, 0)"
    return (f"{n}::DOUBLE / ({n} + 10) * ({w}::DOUBLE / greatest({n}, 1)) + 10.0::DOUBLE / ({n} + 10) * {prior_rate} AS {name}")


def _gold(result, name):
    gap = "lag(golddiffat15) OVER (PARTITION BY teamid ORDER BY date, gameid) IS NULL"
    part = f"sum(CASE WHEN result = {result} THEN golddiffat15 ELSE 0 * golddiffat15 END) OVER {prior('all')}"
    rows = f"coalesce(sum(CASE WHEN result = {result} THEN 1 ELSE 0 END) OVER {prior('all')}, 0)"
    return f"CASE WHEN {gap} THEN 0 ELSE coalesce({part}, 0) / greatest({rows}, 1e-9) END AS {name}"


CAREER_SQL = f"""SELECT *, count(*) OVER {prior('all')} AS n_games_played,
  {_conversion("golddiffat15 > 0", 0.70, "lead_conv_rate")},
  {_conversion("golddiffat15 > 1000", 0.75, "strong_lead_conv")},
  {_conversion("golddiffat15 < 0", 0.30, "comeback_rate")},
  {_gold(1, "avg_gdiff15_when_win")}, {_gold(0, "avg_gdiff15_when_loss")} FROM m"""


@register(REGISTRY, "W7_W9_W10_W11_conversion", sql(MATCHES, CAREER_SQL, [*KEYS, "n_games_played"], CAREER))
def conversion(spark, sf):
    rows = features.with_keys(team_rows(spark, sf))
    return features.career_features(rows, match_slices(spark, sf)).select(*KEYS, "n_games_played", *CAREER)


@register(REGISTRY, "W11_conversion_in_slices", sql(MATCHES, CAREER_SQL, [*KEYS, "n_games_played"], CAREER))
def conversion_slices(spark, sf):
    """The same features through slice totals and carries."""
    slices = plan_slices(fixtures.events(spark, sf).select("ts"), "ts", 1_500).rename("date")
    rows = features.with_keys(team_rows(spark, sf))
    return features.career_features(rows, slices).select(*KEYS, "n_games_played", *CAREER)


@register(REGISTRY, "W9_prior_cumsum",
          sql(MATCHES, f"""SELECT *, CASE WHEN lag(golddiffat15) OVER (PARTITION BY teamid ORDER BY date, gameid) IS NULL
  THEN 0 ELSE coalesce(sum(golddiffat15) OVER {prior('all')}, 0) END AS gold_so_far FROM m""", KEYS, ["gold_so_far"]))
def prior_cumsum(spark, sf):
    rows = features.with_keys(team_rows(spark, sf))
    sums = {"gold_so_far": F.col("golddiffat15")}
    return features.prior_cumsum(rows, features.TEAM, features.ORDER, sums, match_slices(spark, sf)).select(
        *KEYS, "gold_so_far")


# --- sides, patches, schedule, head to head --------------------------------------

SIDE = ["blue_wr_hist", "red_wr_hist", "same_side_wr_hist", "patch_blue_wr", "side_wr_vs_patch"]
SIDE_SQL = f"""
SELECT *, same_side_wr_hist - patch_blue_wr AS side_wr_vs_patch,
  CASE WHEN side = 'Blue' THEN same_side_wr_hist ELSE 0.5 END AS blue_wr_hist,
  CASE WHEN side = 'Red' THEN same_side_wr_hist ELSE 0.5 END AS red_wr_hist
FROM (SELECT m.*, CAST(side = 'Blue' AS INTEGER) AS is_blue, p.patch_blue_wr,
        {_avg("result", "all", 0.5, "same_side_wr_hist", "teamid, side")}
      FROM m JOIN (SELECT gameid, {_avg("result", "all", 0.5, "patch_blue_wr", "patch")}
                   FROM m WHERE side = 'Blue') p USING (gameid))"""


@register(REGISTRY, "W14_W15_J10_side_history", sql(MATCHES, SIDE_SQL, [*KEYS, "is_blue"], SIDE))
def side_history(spark, sf):
    rows = features.with_keys(team_rows(spark, sf))
    return features.side_features(rows, match_slices(spark, sf)).select(*KEYS, "is_blue", *SIDE)


def _shrunk_sql(keys, k, name):
    w = prior("all", keys)
    n = f"count(*) OVER {w}"
    return (f"{n}::DOUBLE / ({n} + {k}) * (coalesce(sum(result) OVER {w}, 0)::DOUBLE / greatest({n}, 1)) "
            f"+ {k}::DOUBLE / ({n} + {k}) * wr_L10 AS {name}")


_WITH_WR = f"(SELECT *, {_avg('result', 10, 0.5, 'wr_L10')} FROM m)"


def _with_form(spark, sf):
    return _recent(spark, sf, [features.form_columns])


@register(REGISTRY, "W16_patch_adaptation",
          sql(MATCHES, f"SELECT *, {_shrunk_sql('teamid, patch', 5, 'patch_wr_shrunk')} FROM {_WITH_WR}", KEYS,
              ["patch_wr_shrunk"]))
def patch_adaptation(spark, sf):
    return features.patch_features(_with_form(spark, sf), match_slices(spark, sf)).select(*KEYS, "patch_wr_shrunk")


@register(REGISTRY, "W19_head_to_head",
          sql(MATCHES, f"SELECT *, count(*) OVER {prior('all', 'teamid, opp_teamid')} AS h2h_n_games, "
                       f"{_shrunk_sql('teamid, opp_teamid', 5, 'h2h_wr')} FROM {_WITH_WR}", [*KEYS, "h2h_n_games"],
              ["h2h_wr"]))
def head_to_head(spark, sf):
    return features.h2h_features(_with_form(spark, sf), match_slices(spark, sf)).select(*KEYS, "h2h_n_games", "h2h_wr")


def _recent_games(days):
    # rows of the same instant count when they come earlier in the order
    return f"""CAST((SELECT count(*) FROM m o WHERE o.teamid = m.teamid AND (o.date, o.gameid) < (m.date, m.gameid)
      AND o.date >= m.date - INTERVAL {days} DAY) AS INTEGER) AS matches_last_{days}d"""


WORKLOAD = ["matches_last_7d", "matches_last_14d", "is_playoffs", "game_number", "league_tier"]
WORKLOAD_SQL = f"""SELECT *, {_recent_games(7)}, {_recent_games(14)}, playoffs AS is_playoffs, game AS game_number,
  CASE league WHEN 'VCS' THEN 2 WHEN 'OTH' THEN 3 ELSE 1 END AS league_tier,
  coalesce((epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY teamid ORDER BY date, gameid)) / 86400e6, -1)
    AS days_since_last FROM m"""


@register(REGISTRY, "W17_W18_P4_P5_schedule", sql(MATCHES, WORKLOAD_SQL, [*KEYS, *WORKLOAD], ["days_since_last"]))
def schedule(spark, sf):
    rows = _recent(spark, sf, [features.rest_columns])
    return features.schedule_features(rows, match_slices(spark, sf)).select(*KEYS, *WORKLOAD, "days_since_last")


@register(REGISTRY, "W18_recent_games_in_slices", sql(MATCHES, WORKLOAD_SQL, [*KEYS, *WORKLOAD[:2]]))
def schedule_slices(spark, sf):
    """Day windows for long histories: counts asked by probe rows."""
    slices = plan_slices(fixtures.events(spark, sf).select("ts"), "ts", 1_500).rename("date")
    rows = features.with_keys(team_rows(spark, sf))
    days = {"matches_last_7d": 7, "matches_last_14d": 14}
    return features.prior_count_in_days(rows, days, slices).select(*KEYS, *days)


# --- ratings ----------------------------------------------------------------------

ELO = ["elo_team", "elo_opp", "elo_diff", "elo_expected", "elo_overperf"]


@register(REGISTRY, "W27_F1_ratings", sql(RATINGS, "SELECT * FROM e", KEYS, ELO, 4), 4)
def elo(spark, sf):
    return rated_once(spark, sf).select(*KEYS, *ELO)


def rated_part(spark, sf):
    """What decay and league mean read of the rated rows, several times (a stage table)."""
    return stage(spark, sf, "rated_part", lambda: rated_once(spark, sf).select(*KEYS, "date", "league", "elo_team", "elo_opp"))


DECAYED = ["elo_decayed_team", "elo_decayed_opp", "elo_decayed_diff"]


@register(REGISTRY, "W28_decayed_ratings", sql(RATINGS, "SELECT * FROM e", KEYS, DECAYED, 4), 4)
def decayed(spark, sf):
    rows = rated_part(spark, sf).withColumns(
        {"_team": anonymous_key("teamid", "gameid", "side"), "rated": F.lit(True)})
    return ratings.decayed_ratings(rows, match_slices(spark, sf)).select(*KEYS, *DECAYED)


@register(REGISTRY, "W26_league_relative", sql(RATINGS, "SELECT * FROM e", KEYS, ["elo_league_rel"], 4), 4)
def league_relative(spark, sf):
    rows = rated_part(spark, sf)
    slices = plan_slices(fixtures.events(spark, sf).select("ts"), "ts", 2_000).rename("date")
    return ratings.league_relative(rows, slices).select(*KEYS, "elo_league_rel")


# --- rosters ------------------------------------------------------------------------

PLAYERS = MATCHES + """,
pl AS (SELECT gameid, date, teamid, side, ' ' || teamid || '_p' || (i + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) || ' '
         AS playerid FROM m, range(5) t(i) WHERE k % 23 <> 0),
ros AS (SELECT gameid, teamid, list_sort(list(DISTINCT trim(playerid))) AS roster FROM pl GROUP BY ALL)"""
ROSTER = PLAYERS + f""",
r1 AS (SELECT m.*, roster, last_value(roster IGNORE NULLS) OVER {prior('all')} AS before_
       FROM m LEFT JOIN ros USING (gameid, teamid)),
r2 AS (SELECT *, CASE WHEN roster IS NULL OR before_ IS NULL THEN 1.0::DOUBLE
         ELSE len(list_intersect(roster, before_)) / 5.0::DOUBLE END AS roster_overlap FROM r1),
r3 AS (SELECT *, row_number() OVER w AS rn,
         max(CASE WHEN roster_overlap < 1 THEN row_number_ END) OVER w AS changed_at
       FROM (SELECT *, row_number() OVER (PARTITION BY teamid ORDER BY date, gameid) AS row_number_ FROM r2)
       WINDOW w AS (PARTITION BY teamid ORDER BY date, gameid)),
r AS (SELECT *, CAST(rn - coalesce(changed_at, 0) AS INTEGER) AS games_since_roster_change FROM r3)"""


@register(REGISTRY, "W24_W25_roster_stability",
          sql(ROSTER, "SELECT * FROM r", [*KEYS, "games_since_roster_change"], ["roster_overlap"]))
def roster_stability(spark, sf):
    out = rosters.roster_features(team_rows(spark, sf), fixtures.player_rows(spark, sf), match_slices(spark, sf))
    return out.select(*KEYS, "games_since_roster_change", "roster_overlap")


@register(REGISTRY, "A13_roster_map",
          sql(PLAYERS, "SELECT gameid, teamid, array_to_string(roster, ',') AS roster FROM ros", ["gameid", "teamid", "roster"]))
def roster_map(spark, sf):
    out = rosters.roster_map(fixtures.player_rows(spark, sf))
    return out.withColumn("roster", F.array_join("roster", ","))


@register(REGISTRY, "A12_id_coverage",
          sql(PLAYERS, "SELECT avg(CASE WHEN playerid IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage, "
                       "CASE WHEN avg(CASE WHEN playerid IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'playerid' "
                       "ELSE 'playername' END AS id_column FROM pl", ["id_column"], ["coverage"]))
def id_coverage(spark, sf):
    return rosters.id_coverage(fixtures.player_rows(spark, sf))


@register(REGISTRY, "A11_roster_change_report",
          sql(ROSTER, "SELECT roster_overlap, count(*) AS n_rows, count(*)::DOUBLE / sum(count(*)) OVER () AS share, "
                      "roster_overlap < 1 AS changed FROM r GROUP BY 1", ["n_rows", "changed"],
              ["roster_overlap", "share"]))
def roster_change_report(spark, sf):
    rows = rosters.roster_features(team_rows(spark, sf), fixtures.player_rows(spark, sf), match_slices(spark, sf))
    return rosters.roster_change_report(rows)


# --- draft -----------------------------------------------------------------------------

PICKS = MATCHES + """,
pk AS (SELECT gameid, teamid, date, side, patch, result, slot, trim(champion) AS champion
       FROM (SELECT gameid, teamid, date, side, patch, result, pick1, pick2, pick3, pick4, pick5 FROM m)
       UNPIVOT (champion FOR slot IN (pick1, pick2, pick3, pick4, pick5)) WHERE trim(champion) <> '')"""


def _pick_rate(keys, k):
    w = prior("all", keys, "date, gameid, side, slot")
    n = f"count(*) OVER {w}"
    return (f"SELECT *, {n}::DOUBLE / ({n} + {k}) * (coalesce(sum(result) OVER {w}, 0)::DOUBLE / greatest({n}, 1)) "
            f"+ {k}::DOUBLE / ({n} + {k}) * 0.5 AS rate FROM pk")


@register(REGISTRY, "W20_A4_champion_meta",
          sql(PICKS, f"""SELECT gameid, teamid, avg(rate) AS champ_meta_mean, min(rate) AS champ_meta_min,
  coalesce(stddev_samp(rate), 0) AS champ_meta_std FROM ({_pick_rate('champion, patch', 10)}) GROUP BY ALL""",
              ["gameid", "teamid"], ["champ_meta_mean", "champ_meta_min", "champ_meta_std"]))
def champion_meta(spark, sf):
    return draft.champion_meta(team_rows(spark, sf), match_slices(spark, sf))


@register(REGISTRY, "W21_champion_comfort",
          sql(PICKS, f"""SELECT gameid, teamid, avg(rate) AS champ_comfort_mean, min(rate) AS champ_comfort_min
  FROM ({_pick_rate('teamid, champion', 15)}) GROUP BY ALL""",
              ["gameid", "teamid"], ["champ_comfort_mean", "champ_comfort_min"]))
def champion_comfort(spark, sf):
    return draft.champion_comfort(team_rows(spark, sf), match_slices(spark, sf))


SERIES = """
SELECT *, CAST(coalesce(sum(2 * result - 1) OVER w, 0) AS DOUBLE) AS series_score_diff,
  CAST(coalesce(sum(2 * result - 1) OVER w, 0) < 0 AS INTEGER) AS series_must_win, game AS series_game_num
FROM (SELECT m.*, u.pair, u.series FROM m JOIN (
        SELECT gameid, pair, sum(CASE WHEN game = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY date, gameid) AS series
        FROM (SELECT DISTINCT gameid, date, game, least(teamid, opp_teamid) || '__' || greatest(teamid, opp_teamid)
                || '__' || league AS pair FROM m)) u USING (gameid))
WINDOW w AS (PARTITION BY pair, series, teamid ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register(REGISTRY, "W22_W23_P7_series_context",
          sql(MATCHES, SERIES, [*KEYS, "series_game_num", "series_must_win"], ["series_score_diff"]))
def series_context(spark, sf):
    out = draft.series_context(team_rows(spark, sf), match_slices(spark, sf))
    return out.select(*KEYS, "series_game_num", "series_must_win", "series_score_diff")


@register(REGISTRY, "P11_first_pick",
          sql(MATCHES, "SELECT *, coalesce(TRY_CAST(firstPick AS DOUBLE), 0.5) AS has_first_pick FROM m", KEYS,
              ["has_first_pick"]))
def first_pick(spark, sf):
    rows = team_rows(spark, sf)
    return rows.withColumn("has_first_pick", draft.first_pick(rows)).select(*KEYS, "has_first_pick")


DRAFT = ["champ_meta_mean", "champ_meta_min", "champ_meta_std", "champ_comfort_mean", "champ_comfort_min",
         "series_score_diff", "has_first_pick"]


@register(REGISTRY, "J9_draft_features",
          sql(PICKS, f"""SELECT z.*, coalesce(TRY_CAST(z.firstPick AS DOUBLE), 0.5) AS has_first_pick,
    coalesce(a.m1, 0.5) AS champ_meta_mean, coalesce(a.m2, 0.5) AS champ_meta_min, coalesce(a.m3, 0) AS champ_meta_std,
    coalesce(b.m1, 0.5) AS champ_comfort_mean, coalesce(b.m2, 0.5) AS champ_comfort_min
  FROM ({SERIES}) z
  LEFT JOIN (SELECT gameid, teamid, avg(rate) m1, min(rate) m2, stddev_samp(rate) m3
             FROM ({_pick_rate('champion, patch', 10)}) GROUP BY ALL) a USING (gameid, teamid)
  LEFT JOIN (SELECT gameid, teamid, avg(rate) m1, min(rate) m2
             FROM ({_pick_rate('teamid, champion', 15)}) GROUP BY ALL) b USING (gameid, teamid)""",
              [*KEYS, "series_game_num", "series_must_win"], DRAFT))
def draft_features(spark, sf):
    return draft.draft_features(team_rows(spark, sf), match_slices(spark, sf)).select(
        *KEYS, "series_game_num", "series_must_win", *DRAFT)
