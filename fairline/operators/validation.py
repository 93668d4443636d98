"""Temporal splits and folds as assignment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline import config as C
from fairline.plans.history import Agg, with_history
from fairline.plans.slices import Slices, plan_slices
from fairline.session import cut_lineage

DAY_US = 86_400_000_000


def temporal_split(df: DataFrame, frac: float = C.HOLDOUT_FRACTION, slices: Slices | None = None) -> DataFrame:
    """Game assignment (gameid, date, part): the last ``frac`` of games is holdout.

    The games are written as a narrow table first, which count, order and
    assignment then share.  Only the game at the cutoff position is looked up;
    every other game is compared with it, so nothing is sorted as a whole.
    """
    games = cut_lineage(df.groupBy("gameid").agg(F.min("date").alias("date")), "games")
    slices = slices or plan_slices(games)
    ordered = with_history(games, [], ["date", "gameid"], [Agg("position", "count")], slices)
    n = games.select(F.count(F.lit(1))).scalar()
    at = F.struct("date", "gameid")
    cut = ordered.filter(F.col("position") == F.floor(n * (1.0 - F.lit(frac)))).select(F.max(at)).scalar()
    # no game stands at the cutoff when nothing is held out
    return games.withColumn("part", F.when(cut.isNull() | (at < cut), "dev").otherwise("holdout"))


def split_rows(df: DataFrame, assignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = lambda p: df.join(assignment.filter(F.col("part") == p).select("gameid"), "gameid", "left_semi")
    return part("dev"), part("holdout")


def split_overlap(assignment: DataFrame) -> DataFrame:
    """Games assigned to both parts (there must be none)."""
    dev = assignment.filter(F.col("part") == "dev").select("gameid")
    return dev.intersect(assignment.filter(F.col("part") == "holdout").select("gameid"))


def rolling_folds(
    df: DataFrame,
    train_days: int = C.TRAIN_DAYS,
    val_days: int = C.VAL_DAYS,
    stride_days: int = C.STRIDE_DAYS,
    min_train_rows: int = 40,
    min_val_rows: int = 10,
) -> DataFrame:
    """Long table (fold, role, gameid, side, date): which rows train and validate.

    Fold f validates on [first + T + S*f, + V) and trains on the T days before.
    Which folds a row belongs to follows from its date alone, so rows are
    exploded into their folds without a range join.  The three columns needed
    are written once and shared by the span, the counts and the result.
    """
    rows = cut_lineage(df.select("gameid", "side", "date"), "fold-rows")
    span = rows.agg(F.min(F.unix_micros("date")).alias("lo"), F.max(F.unix_micros("date")).alias("hi"))
    first, last = span.select("lo").scalar(), span.select("hi").scalar()
    train, val, stride = train_days * DAY_US, val_days * DAY_US, stride_days * DAY_US
    t = F.unix_micros("date") - first
    top = F.floor((last - first - train - val) / F.lit(stride))

    def reach(role: str, older, newer):
        """First and last fold a row serves in, given the open and closed end."""
        lo = F.greatest(F.floor(older / F.lit(stride)) + 1, F.lit(0).cast("long"))
        hi = F.least(F.floor(newer / F.lit(stride)), top)
        return F.struct(F.lit(role).alias("role"), lo.alias("lo"), hi.alias("hi"))

    roles = F.array(reach("train", t - train, t), reach("val", t - train - val, t - train))
    long = (
        rows.withColumn("r", F.explode(roles))
        .filter(F.col("r.lo") <= F.col("r.hi"))
        .select(F.explode(F.sequence("r.lo", "r.hi")).alias("fold"), "r.role", "gameid", "side", "date")
    )
    sizes = long.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val")
    )
    kept = sizes.filter((F.col("n_train") >= min_train_rows) & (F.col("n_val") >= min_val_rows))
    # one row per fold: the calendar bounds this table, not the data
    renumbered = kept.select(
        "fold", (F.row_number().over(Window.orderBy("fold")) - 1).cast("int").alias("new_fold")
    )
    return long.join(renumbered, "fold").select(
        F.col("new_fold").alias("fold"), "role", "gameid", "side", "date"
    )


def last_folds(folds: DataFrame, n: int = C.TUNE_LAST_FOLDS) -> DataFrame:
    top = folds.select(F.max("fold")).scalar()
    return folds.filter(F.col("fold") > top - n)


def fold_leaks(folds: DataFrame) -> DataFrame:
    """Per fold: games on both sides of the split, and games with one row only."""
    per_game = folds.groupBy("fold", "gameid").agg(
        F.count_if(F.col("role") == "train").alias("t"), F.count_if(F.col("role") == "val").alias("v")
    )
    return per_game.groupBy("fold").agg(
        F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("shared_games"),
        F.count_if(F.col("v") == 1).alias("single_sided_games"),
    )


def describe_folds(folds: DataFrame) -> DataFrame:
    """Date range and size of each fold's two roles."""
    # every (fold, role, game) becomes one row first, so that counting games
    # needs no distinct over all rows of a fold
    per_game = folds.groupBy("fold", "role", "gameid").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    out = []
    for role in ("train", "val"):
        here = F.col("role") == role
        out += [
            F.min(F.when(here, F.to_date("lo"))).alias(f"{role}_start"),
            F.max(F.when(here, F.to_date("hi"))).alias(f"{role}_end"),
            F.sum(F.when(here, F.col("n")).otherwise(0)).alias(f"{role}_rows"),
            F.count_if(here).alias(f"{role}_games"),
        ]
    return per_game.groupBy("fold").agg(*out)


def fold_calendar(folds: DataFrame) -> DataFrame:
    """First validation date of each fold."""
    return folds.filter(F.col("role") == "val").groupBy("fold").agg(F.min("date").alias("val_start"))


#: audit rules: label -> (scope, name test)
_DRAFT_WORDS = ("champion", "pick", "ban", "firstpick")
_STAT_STEMS = ("kills", "deaths", "assists", "totalgold", "damagetochamp", "visionscore", "wardsplaced")
_SNAPSHOT_MARKS = ("at10", "at15", "at20", "at25")
_LAGGED_WORDS = ("mean", "std", "rate", "pct", "diff", "share")


def leak_audit(df: DataFrame, numeric_columns: list[str]) -> DataFrame:
    """Per numeric column: the rule its name breaks (or null) and its known rows."""
    def broken(c: str) -> str | None:
        low = c.lower()
        if any(w in low for w in _DRAFT_WORDS):
            return "draft column"
        if low.startswith(_STAT_STEMS):
            return "same-match statistic"
        if any(m in c for m in _SNAPSHOT_MARKS) and not any(w in c for w in _LAGGED_WORDS):
            return "raw snapshot"
        if c == "gamelength":
            return "direct game length"
        if c.removeprefix("opp_").removeprefix("diff_") == "elo_overperf":
            return "direct overperformance"
        return None

    known = df.agg(*[F.count(c).alias(c) for c in numeric_columns]).withColumn("_all", F.lit(1))
    long = known.unpivot(["_all"], numeric_columns, "column_name", "known_rows").drop("_all")
    rules = [x for c in numeric_columns if broken(c) for x in (F.lit(c), F.lit(broken(c)))]
    rule = F.try_element_at(F.create_map(*rules), F.col("column_name")) if rules else F.lit(None).cast("string")
    return long.withColumn("broken_rule", rule).withColumn("passed", F.col("broken_rule").isNull())
