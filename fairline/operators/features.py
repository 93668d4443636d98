"""Leakage-safe rolling features: every value only uses a team's earlier games."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline import config as C
from fairline.functions.stats import ewma, roll_mean, roll_rate, roll_std, share, shrunk_rate
from fairline.plans.history import ROW, RUN_ROWS, Agg, anonymous_key, beside, cut_runs, drop_halo, number_rows, with_history
from fairline.plans.slices import Slices, plan_slices

ORDER = ["date", "gameid"]
TEAM = ["team_key"]

#: source column -> feature stem, with a rate of large leads or not
EARLY_GAME = (("golddiffat15", "gdiff15", True), ("golddiffat10", "gdiff10", True),
              ("xpdiffat15", "xpdiff15", False), ("xpdiffat10", "xpdiff10", False))
FIRST_OBJECTIVES = (("firstblood", "fb"), ("firstdragon", "fd"), ("firstherald", "fh"),
                    ("firsttower", "ft"), ("firstbaron", "fbar"))
OBJECTIVES = (("dragons", "dragon"), ("heralds", "herald"), ("barons", "baron"),
              ("towers", "tower"), ("turretplates", "plate"))
STYLE = (("ckpm", "pace"), ("vspm", "vision"), ("earned_gpm", "economy"),
         ("team_kpm", "aggression"), ("gamelength", "gamelength"))


def with_keys(df: DataFrame) -> DataFrame:
    """Window keys; rows without a team, opponent or patch get one of their own."""
    own = ("gameid", "side")
    return df.withColumns(
        {
            "team_key": anonymous_key("teamid", *own),
            "opp_key": anonymous_key("opp_teamid", *own),
            "patch_key": anonymous_key("patch", *own),
        }
    )


class Frames:
    """Windows over a team's last rows, built on the parts ``cut_runs`` returned."""

    def __init__(self, parts: list[str]):
        self.spec = Window.partitionBy(*parts).orderBy(*ORDER)

    def last(self, n: int):
        return self.spec.rowsBetween(-n, -1)


# Expression groups.  Each returns {column: expression} so that one projection,
# and with it one sort, serves all of them.

def form_columns(df: DataFrame, f: Frames) -> dict[str, Column]:
    s, l = C.SHORT_WINDOW, C.LONG_WINDOW
    out = {f"wr_L{n}": roll_mean("result", f.last(n), 0.5) for n in (3, s, l)}
    out["ewma_result"] = ewma("result", f.last(C.EWMA_ROWS), C.EWMA_ALPHA, 0.5)
    for n in (s, l):
        if "elo_opp" in df.columns:
            out[f"avg_opp_elo_L{n}"] = roll_mean("elo_opp", f.last(n), C.RATING_START)
        if "elo_overperf" in df.columns:
            out[f"overperf_L{n}"] = roll_mean("elo_overperf", f.last(n), 0.0)
    return out


def early_game_columns(df: DataFrame, f: Frames) -> dict[str, Column]:
    s, l = C.SHORT_WINDOW, C.LONG_WINDOW
    known = F.col("teamid").isNotNull()
    out: dict[str, Column] = {}

    def rate(cond: Column) -> Column:
        return F.when(known, roll_rate(cond, f.last(l), l)).otherwise(0.5)

    for src, stem, leads in EARLY_GAME:
        if src not in df.columns:
            continue
        for n in (s, l):
            out[f"{stem}_mean_L{n}"] = roll_mean(src, f.last(n))
        out[f"{stem}_std_L{l}"] = roll_std(src, f.last(l))
        out[f"pct_pos_{stem}_L{l}"] = rate(F.col(src) > 0)
        if leads:
            for t in (1000, 2000):
                out[f"pct_{stem}_gt{t}_L{l}"] = rate(F.col(src) > t)
            out[f"pct_{stem}_lt1000_L{l}"] = rate(F.col(src) < -1000)
    for src, stem in FIRST_OBJECTIVES:
        if src in df.columns:
            for n in (s, l):
                out[f"{stem}_rate_L{n}"] = roll_mean(src, f.last(n), 0.5)
    return out


def objective_columns(df: DataFrame, f: Frames) -> dict[str, Column]:
    l = C.LONG_WINDOW
    out: dict[str, Column] = {}
    for src, stem in OBJECTIVES:
        if src in df.columns and f"opp_{src}" in df.columns:
            part = share(src, f"opp_{src}")
            out[f"{stem}_share_L{l}"] = roll_mean(part, f.last(l), 0.5)
            out[f"{stem}_share_std_L{l}"] = roll_std(part, f.last(l))
    return out


def style_columns(df: DataFrame, f: Frames) -> dict[str, Column]:
    l = C.LONG_WINDOW
    return {f"{stem}_mean_L{l}": roll_mean(src, f.last(l)) for src, stem in STYLE if src in df.columns}


def rest_columns(df: DataFrame, f: Frames) -> dict[str, Column]:
    gap = (F.unix_micros("date") - F.lag(F.unix_micros("date")).over(f.spec)) / 86400e6
    return {"days_since_last": F.coalesce(gap, F.lit(-1.0))}


RECENT = (form_columns, early_game_columns, objective_columns, style_columns, rest_columns)


def recent_features(
    df: DataFrame, slices: Slices, groups=RECENT, run_rows: int = RUN_ROWS, source: DataFrame | None = None,
    asked: set[str] | None = None,
) -> DataFrame:
    """All features that look back a bounded number of games, in one pass; those ``asked`` for if that is given."""
    numbered = source is not None and ROW in df.columns and ROW in source.columns
    rows, parts = cut_runs(source if numbered else df, TEAM, ORDER, slices, C.EWMA_ROWS, run_rows, None if numbered else source)
    frames = Frames(parts)
    columns: dict[str, Column] = {}
    for group in groups:
        columns.update(group(df, frames))
    if asked is not None:
        columns = {c: e for c, e in columns.items() if c in asked}
        if not columns:
            return df
    out = drop_halo(rows.withColumns(columns))
    out = beside(df, out, list(columns)) if numbered else out
    if "wr_L5" in columns and "wr_L10" in columns:
        out = out.withColumn("form_trend", F.col("wr_L5") - F.col("wr_L10"))
    return out


def prior_cumsum(df: DataFrame, keys, order, sums: dict[str, Column], slices: Slices) -> DataFrame:
    """Running sums of the earlier rows; 0 where the previous value is missing."""
    aggs = []
    for name, expr in sums.items():
        aggs += [Agg(name, "sum", expr), Agg(f"_gap_{name}", "last", expr.isNull())]
    seen = with_history(df, keys, order, aggs, slices)
    gap = {n: F.when(F.col(f"_gap_{n}"), 0.0).otherwise(F.col(n)) for n in sums}
    return seen.withColumns(gap).drop(*[f"_gap_{n}" for n in sums])


def career_features(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Games played and conversion of leads, over a team's whole past."""
    k = C.SHRINK_CONVERSION
    gold, won = F.col("golddiffat15"), F.col("result")
    ahead, strong, behind = (F.coalesce(c, F.lit(False)) for c in (gold > 0, gold > 1000, gold < 0))
    aggs = [Agg("n_games_played", "count"), Agg("_wins", "sum", won)]
    situations = {"lead_conv_rate": (ahead, 0.70), "strong_lead_conv": (strong, 0.75), "comeback_rate": (behind, 0.30)}
    for name, (cond, _) in situations.items():
        aggs.append(Agg(f"_n_{name}", "sum", cond.cast("long")))
        aggs.append(Agg(f"_w_{name}", "sum", (cond & (won == 1)).cast("long")))
    aggs.append(Agg("_gap", "last", gold.isNull()))
    aggs.append(Agg("_gold_win", "sum", gold * won))
    aggs.append(Agg("_gold_loss", "sum", gold * (1 - won)))
    seen = with_history(df, TEAM, ORDER, aggs, slices, source)
    losses = F.col("n_games_played") - F.col("_wins")
    known = ~F.coalesce(F.col("_gap"), F.lit(True))

    def mean_gold(total: str, n: Column) -> Column:
        return F.when(known, F.col(total) / F.greatest(n.cast("double"), F.lit(1e-9))).otherwise(0.0)

    out = {
        name: shrunk_rate(f"_n_{name}", f"_w_{name}", k, prior) for name, (_, prior) in situations.items()
    }
    out["avg_gdiff15_when_win"] = mean_gold("_gold_win", F.col("_wins"))
    out["avg_gdiff15_when_loss"] = mean_gold("_gold_loss", losses)
    return seen.withColumns(out).drop(*[a.name for a in aggs if a.name.startswith("_")])


def side_history(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Win rate on this side so far; the other side's column stays neutral."""
    mine = with_history(
        df, TEAM + ["side"], ORDER, [Agg("_n", "count"), Agg("_w", "sum", F.col("result"))], slices, source
    )
    rate = F.coalesce(F.try_divide(F.col("_w"), F.col("_n")), F.lit(0.5))
    blue = F.col("side") == "Blue"
    return mine.withColumns(
        {
            "is_blue": blue.cast("int"),
            "blue_wr_hist": F.when(blue, rate).otherwise(0.5),
            "red_wr_hist": F.when(blue, 0.5).otherwise(rate),
            "same_side_wr_hist": rate,
        }
    ).drop("_n", "_w")


def patch_blue_rate(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Share of the patch's earlier games that Blue won, on both rows of a game.

    A patch has few values and very many games, so only its Blue rows and four
    columns go through the patch's order; the rate then joins by game, the same
    exchange the mirrored dataset needs.
    """
    blue = (source or df).filter((F.col("side") == "Blue") & F.col("patch").isNotNull()).select("gameid", "date", "patch", "result")
    seen = with_history(blue, ["patch"], ORDER, [Agg("_n", "count"), Agg("_w", "sum", F.col("result"))], slices)
    rate = seen.select("gameid", F.coalesce(F.try_divide(F.col("_w"), F.col("_n")), F.lit(0.5)).alias("patch_blue_wr"))
    if source is not None and ROW in df.columns and ROW in source.columns:
        joined = beside(df, source.select(ROW, "gameid").join(rate, "gameid", "left"), ["patch_blue_wr"])
    else:
        joined = df.join(rate, "gameid", "left")
    joined = joined.fillna({"patch_blue_wr": 0.5})
    return joined.withColumn("side_wr_vs_patch", F.col("same_side_wr_hist") - F.col("patch_blue_wr"))


def side_features(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Side history next to Blue's record on the patch."""
    return patch_blue_rate(side_history(df, slices, source), slices, source)


def patch_features(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Win rate on the current patch, shrunk to the recent win rate."""
    seen = with_history(
        df, TEAM + ["patch_key"], ORDER, [Agg("_n", "count"), Agg("_w", "sum", F.col("result"))], slices, source
    )
    rate = shrunk_rate("_n", "_w", C.SHRINK_PATCH, F.col("wr_L10"))
    known = F.col("patch").isNotNull() & F.col("teamid").isNotNull()
    return seen.withColumn("patch_wr_shrunk", F.when(known, rate).otherwise(0.5)).drop("_n", "_w")


def h2h_features(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Record against this opponent so far, shrunk to the recent win rate."""
    seen = with_history(
        df, TEAM + ["opp_key"], ORDER, [Agg("h2h_n_games", "count"), Agg("_w", "sum", F.col("result"))], slices, source
    )
    rate = shrunk_rate("h2h_n_games", "_w", C.SHRINK_H2H, F.col("wr_L10"))
    return seen.withColumn("h2h_wr", rate).drop("_w")


def prior_count_in_days(
    df: DataFrame, days: dict[str, int], slices: Slices, source: DataFrame | None = None
) -> DataFrame:
    """Earlier games of the team no older than N days, for each name in ``days``.

    Counted as (earlier games) minus (games older than N days); the second count
    is asked by probe rows at ``date - N days``.
    """
    us = 86_400_000_000
    spots = F.array(
        F.struct(F.lit("").alias("name"), F.col("date").alias("t"), F.lit(1).alias("real")),
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.timestamp_micros(F.unix_micros("date") - n * us).alias("t"),
                F.lit(0).alias("real"),
            )
            for name, n in days.items()
        ],
    )
    marks = (source or df).select("gameid", "team_key", F.explode(spots).alias("m")).select("gameid", "team_key", "m.*")
    # a probe stands before the games of its own instant, which still count as recent
    seen = with_history(
        marks, TEAM, ["t", "real", "gameid"], [Agg("c", "sum", F.col("real").cast("long"))], slices.rename("t")
    )
    wide = seen.groupBy("gameid", "team_key").agg(
        F.max(F.when(F.col("real") == 1, F.col("c"))).alias("_all"),
        *[F.max(F.when(F.col("name") == name, F.col("c"))).alias(f"_o_{name}") for name in days],
    )
    if source is not None and ROW in df.columns and ROW in source.columns:
        counts = source.select(ROW, "gameid", "team_key").join(wide, ["gameid", "team_key"])
        joined = beside(df, counts, [c for c in wide.columns if c.startswith("_")])
    else:
        joined = df.join(wide, ["gameid", "team_key"])
    out = {name: (F.col("_all") - F.col(f"_o_{name}")).cast("int") for name in days}
    return joined.withColumns(out).drop("_all", *[f"_o_{n}" for n in days])


def league_tier(league: str = "league") -> Column:
    pairs = [F.lit(x) for kv in C.LEAGUE_TIER.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(league)), F.lit(C.DEFAULT_TIER))


def schedule_features(df: DataFrame, slices: Slices, source: DataFrame | None = None) -> DataFrame:
    """Workload and context known before the game."""
    out = prior_count_in_days(df, {"matches_last_7d": 7, "matches_last_14d": 14}, slices, source)
    return out.withColumns(context_columns(df))


def context_columns(df: DataFrame) -> dict[str, Column]:
    number = lambda c, d: F.coalesce(F.expr(f"cast(try_cast({c} as double) as int)"), F.lit(d))
    cols = {}
    if "playoffs" in df.columns:
        cols["is_playoffs"] = number("playoffs", 0)
    if "game" in df.columns:
        cols["game_number"] = number("game", 1)
    if "league" in df.columns:
        cols["league_tier"] = league_tier()
    return cols


#: name -> factors of each product feature
INTERACTIONS = {
    "ix_elo_x_gdiff15": ("elo_diff", "gdiff15_mean_L10"),
    "ix_elo_x_wr5": ("elo_diff", "wr_L5"),
    "ix_gdiff15_x_dragon": ("gdiff15_mean_L10", "dragon_share_L10"),
    "ix_conv_x_gdiff15": ("lead_conv_rate", "gdiff15_mean_L10"),
    "ix_elo_x_overperf5": ("elo_diff", "overperf_L5"),
    "ix_side_x_elo": ("side_wr_vs_patch", "elo_diff"),
    "ix_elo_x_ewma": ("elo_diff", "ewma_result"),
    "ix_opp_elo_x_wr10": ("avg_opp_elo_L10", "wr_L10"),
    "ix_strong_conv_x_gd15": ("strong_lead_conv", "gdiff15_mean_L10"),
    "ix_dec_elo_x_gdiff15": ("elo_decayed_diff", "gdiff15_mean_L10"),
    "ix_patch_wr_x_elo": ("patch_wr_shrunk", "elo_diff"),
}


def interaction_features(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    cols = {
        name: F.coalesce(F.col(a), zero) * F.coalesce(F.col(b), zero)
        for name, (a, b) in INTERACTIONS.items()
        if a in df.columns and b in df.columns
    }
    return df.withColumns(cols)


#: features that a feature is worked out from
_FROM = {"form_trend": ("wr_L5", "wr_L10"), "patch_wr_shrunk": ("wr_L10",), "h2h_wr": ("wr_L10",), "h2h_n_games": ("wr_L10",),
         "side_wr_vs_patch": ("same_side_wr_hist", "patch_blue_wr"), **INTERACTIONS}
#: what every group but the recent features adds
CAREER = ("n_games_played", "lead_conv_rate", "strong_lead_conv", "comeback_rate", "avg_gdiff15_when_win", "avg_gdiff15_when_loss")
SIDE = ("is_blue", "blue_wr_hist", "red_wr_hist", "same_side_wr_hist")
H2H = ("h2h_n_games", "h2h_wr")
PATCH_BLUE = ("patch_blue_wr", "side_wr_vs_patch")
WORKLOAD = ("matches_last_7d", "matches_last_14d")


def needed(columns: Iterable[str]) -> set[str]:
    """``columns`` and the features they are worked out from."""
    out, left = set(), list(columns)
    while left:
        c = left.pop()
        if c not in out:
            out.add(c)
            left += _FROM.get(c, ())
    return out


def inputs(columns: Iterable[str]) -> set[str]:
    """Columns of the rated rows that ``build_features`` reads for ``columns``, and those of them that are no features."""
    asked = needed(columns)
    any_of = lambda *starts: any(c.startswith(starts) for c in asked)
    out = {*asked, "gameid", "date", "side", "teamid", "opp_teamid", "patch", "result"}
    sources = {
        "elo_opp": ("avg_opp_elo_",), "elo_overperf": ("overperf_",), "playoffs": ("is_playoffs",), "game": ("game_number",),
        "league": ("league_tier",), **{src: (f"{stem}_", f"pct_pos_{stem}_", f"pct_{stem}_") for src, stem, _ in EARLY_GAME},
        **{src: (f"{stem}_rate_",) for src, stem in FIRST_OBJECTIVES}, **{src: (f"{stem}_mean_L",) for src, stem in STYLE},
        **{f"{p}{src}": (f"{stem}_share_",) for src, stem in OBJECTIVES for p in ("", "opp_")},
    }
    out |= {src for src, starts in sources.items() if any_of(*starts)}
    return out | ({"golddiffat15"} if any_of(*CAREER) else set())


def drop_same_match(df: DataFrame) -> DataFrame:
    """Remove columns that describe the game itself, and helper columns."""
    gone = [c for c in df.columns if c in C.SAME_MATCH_COLUMNS or c.startswith("_")]
    return df.drop(*gone, "team_key", "opp_key", "patch_key")


def build_features(
    teams: DataFrame,
    slices: Slices | None = None,
    style: bool = True,
    patch: bool = True,
    interactions: bool = True,
    run_rows: int = RUN_ROWS,
    source: DataFrame | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Team rows with ratings in, team rows with all rolling features out.

    Rows are stored with a number each.  Every group sorts only the columns it
    reads, and all groups are joined to the rows by that number, so the wide
    rows are moved once.  ``source`` may name the stored table, with the same
    numbers, that ``teams`` was derived from.

    ``columns`` names the features a reader wants: Spark cannot leave out a
    group whose join it has to make, so groups that give none of them are
    not asked for.  Rows and values are the same.
    """
    asked = None if columns is None else needed(columns)
    wanted = lambda names: asked is None or not asked.isdisjoint(names)
    slices = slices or plan_slices(teams)
    groups = [g for g in RECENT if style or g is not style_columns]
    teams = teams if source is not None else number_rows(teams, "base")
    base = with_keys(teams if source is None else source)
    df = with_keys(teams).select("gameid", *[c for c in teams.columns if c != "gameid"], "team_key", "opp_key", "patch_key")
    df = recent_features(df, slices, groups, run_rows, base, asked)
    if wanted(CAREER):
        df = career_features(df, slices, base)
    if wanted((*SIDE, *PATCH_BLUE)):
        df = side_history(df, slices, base)
    if patch and wanted(["patch_wr_shrunk"]):
        df = patch_features(df, slices, base)
    if wanted(H2H):
        df = h2h_features(df, slices, base)
    if wanted(PATCH_BLUE):
        df = patch_blue_rate(df, slices, base)
    if wanted(WORKLOAD):
        df = schedule_features(df, slices, base)
    else:  # counts of recent games are found by game, and a row without one has none
        df = df.filter(F.col("gameid").isNotNull()).withColumns(context_columns(df))
    if interactions:
        df = interaction_features(df)
    return drop_same_match(df)
