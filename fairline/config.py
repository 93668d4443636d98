"""Fixed values of the match-analytics domain.

Numbers and names in this file are part of the data contract: results only
agree with the published definitions when they are kept as they are.
"""

# Ratings
RATING_START = 1500.0
RATING_K = 20.0
RATING_SCALE = 400.0
RATING_HALF_LIFE_DAYS = 365.0

# Rolling windows
SHORT_WINDOW = 5
LONG_WINDOW = 10
EWMA_ALPHA = 0.3
# All older rows together weigh 0.7 ** 128 = 1.5e-20, far below the resolution of a
# double (2.2e-16), so the mean over all history is the mean over 128 rows.
EWMA_ROWS = 128

# Shrinkage strengths
SHRINK_CONVERSION = 10
SHRINK_PATCH = 5
SHRINK_H2H = 5
SHRINK_CHAMPION_META = 10
SHRINK_CHAMPION_COMFORT = 15

# Temporal validation
HOLDOUT_FRACTION = 0.20
TRAIN_DAYS = 180
VAL_DAYS = 14
STRIDE_DAYS = 14
TUNE_LAST_FOLDS = 30
TUNE_ITERATIONS = 100
SEED = 42

# Market prices, fees and rewards
TICK = 0.01
MIN_PRICE = 0.01
MAX_PRICE = 0.99
TAKER_RATE = 0.03
REBATE_SHARE = 0.25
REWARD_POOL = {"AB": 1550.0, "C": 150.0}
MAX_REWARD_SPREAD = 0.03

# Rosters
ROSTER_SIZE = 5.0
MIN_ID_COVERAGE = 0.80

# League -> competitive tier (every other league is tier 3)
LEAGUE_TIER = {
    "LCK": 1, "LPL": 1, "LEC": 1, "LCS": 1, "Worlds": 1, "MSI": 1,
    "LCK CL": 2, "LCKC": 2, "LDL": 2, "LCS A": 2, "LCSA": 2, "NACL": 2,
    "VCS": 2, "PCS": 2, "CBLOL": 2, "CBLOL A": 2, "LFL": 2, "NLC": 2,
    "PRM": 2, "LLA": 2, "LAS": 2, "TCL": 2, "LJL": 2, "LCO": 2, "EBL": 2,
    "EMEA Masters": 2,
}
DEFAULT_TIER = 3

# Source columns with blanks in their names
RENAMES = {"team kpm": "team_kpm", "earned gpm": "earned_gpm", "total cs": "total_cs"}

# Columns that must hold numbers whatever the file said
NUMERIC_COLUMNS = (
    "result", "playoffs", "game",
    "golddiffat10", "xpdiffat10", "csdiffat10",
    "golddiffat15", "xpdiffat15", "csdiffat15",
    "firstblood", "firstdragon", "firstherald", "firstbaron", "firsttower",
    "firsttothreetowers", "firstmidtower",
    "dragons", "opp_dragons", "heralds", "opp_heralds", "barons", "opp_barons",
    "towers", "opp_towers", "turretplates", "opp_turretplates",
    "void_grubs", "opp_void_grubs",
    "team_kpm", "ckpm", "earned_gpm", "gspd", "gpr", "vspm", "visionscore",
    "controlwardsbought", "dpm", "damageshare", "damagetakenperminute", "gamelength",
)

CATEGORICAL = ("league", "split", "side", "patch")
TARGET = "result"

# Same-match columns, which are inputs of rolling features and never features themselves.
SAME_MATCH_COLUMNS = frozenset([
    "url", "participantid", "position", "playername", "playerid", "firstPick", "champion", "elo_overperf",
    "firstblood", "firstdragon", "firstherald", "firstbaron", "firsttower", "firstmidtower",
    "firsttothreetowers", "ckpm", "team_kpm", "vspm", "earned_gpm", "gspd", "gpr", "dpm", "damageshare",
    "damagetakenperminute", "visionscore", "controlwardsbought", "gamelength", "kills", "deaths", "assists",
    "teamkills", "teamdeaths", "doublekills", "triplekills", "quadrakills", "pentakills", "firstbloodkill",
    "firstbloodassist", "firstbloodvictim", "totalgold", "earnedgold", "earnedgoldshare", "goldspent",
    "total_cs", "minionkills", "monsterkills", "monsterkillsownjungle", "monsterkillsenemyjungle", "cspm",
    "wardsplaced", "wpm", "wardskilled", "wcpm", "damagetochampions", "damagemitigatedperminute",
    "damagetotowers", "infernals", "mountains", "clouds", "oceans", "chemtechs", "hextechs",
    "dragons (type unknown)", "ban1", "ban2", "ban3", "ban4", "ban5", "pick1", "pick2", "pick3", "pick4",
    "pick5", "golddiffat10", "golddiffat15", "golddiffat20", "golddiffat25", "xpdiffat10", "xpdiffat15",
    "xpdiffat20", "xpdiffat25", "csdiffat10", "csdiffat15", "csdiffat20", "csdiffat25", "goldat10",
    "xpat10", "csat10", "killsat10", "assistsat10", "deathsat10", "goldat15", "xpat15", "csat15",
    "killsat15", "assistsat15", "deathsat15", "goldat20", "xpat20", "csat20", "killsat20", "assistsat20",
    "deathsat20", "goldat25", "xpat25", "csat25", "killsat25", "assistsat25", "deathsat25", "opp_goldat10",
    "opp_xpat10", "opp_csat10", "opp_killsat10", "opp_assistsat10", "opp_deathsat10", "opp_goldat15",
    "opp_xpat15", "opp_csat15", "opp_killsat15", "opp_assistsat15", "opp_deathsat15", "opp_goldat20",
    "opp_xpat20", "opp_csat20", "opp_killsat20", "opp_assistsat20", "opp_deathsat20", "opp_goldat25",
    "opp_xpat25", "opp_csat25", "opp_killsat25", "opp_assistsat25", "opp_deathsat25", "dragons", "heralds",
    "barons", "towers", "turretplates", "void_grubs", "atakhans", "inhibitors", "elementaldrakes", "elders",
    "opp_dragons", "opp_heralds", "opp_barons", "opp_towers", "opp_turretplates", "opp_void_grubs",
    "opp_atakhans", "opp_inhibitors", "opp_elementaldrakes", "opp_elders",
])

# Name prefixes that mark an engineered feature column
FEATURE_PREFIXES = (
    "elo_",
    "wr_", "ewma_", "avg_opp_elo_", "overperf_", "form_trend", "n_games_played",
    "gdiff", "xpdiff", "csdiff", "pct_pos_", "pct_gdiff15_", "pct_gdiff10_",
    "fb_rate", "fd_rate", "fh_rate", "ft_rate", "fbar_rate",
    "lead_conv_rate", "comeback_rate", "strong_lead_conv", "avg_gdiff15_when_",
    "dragon_share", "herald_share", "baron_share", "tower_share", "plate_share",
    "vgrubs_diff", "atakhan_diff",
    "pace_mean", "vision_mean", "economy_mean", "aggression_mean", "gamelength_mean",
    "is_blue", "blue_wr_hist", "red_wr_hist", "same_side_wr_hist", "patch_blue_wr",
    "side_wr_vs_patch",
    "patch_wr_shrunk", "patch_gdiff15_shrunk", "patch_dragon_share_shrunk",
    "days_since_last", "matches_last_", "is_playoffs", "game_number", "league_tier",
    "ix_", "h2h_wr", "h2h_n_games", "roster_overlap", "games_since_roster_change",
    "champ_meta_", "champ_comfort_",
    "series_game_num", "series_score_diff", "series_must_win", "has_first_pick",
)

# Features whose difference between the two teams says nothing new
NO_DIFF = frozenset((
    "elo_diff", "elo_expected", "elo_decayed_diff", "elo_team", "elo_opp",
    "elo_decayed_team", "elo_decayed_opp", "is_playoffs", "game_number", "patch_blue_wr",
    "is_blue", "series_score_diff", "h2h_n_games", "league_tier",
))

# Features whose opponent copy equals (or negates) the team's own value
NO_OPPONENT = frozenset((
    "is_playoffs", "game_number", "patch_blue_wr", "series_game_num", "league_tier",
    "elo_diff", "elo_decayed_diff",
))
