"""Modelling dataset: a team's features next to its opponent's and their gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline import config as C


def _base(name: str) -> str:
    return name.removeprefix("opp_").removeprefix("diff_")


def feature_columns(df: DataFrame) -> list[str]:
    """Engineered columns by name prefix, opponent and difference copies included."""
    return [
        c for c in df.columns
        if not c.startswith("_") and (_base(c).startswith(C.FEATURE_PREFIXES) or c.startswith(C.FEATURE_PREFIXES))
    ]


def numeric(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}


def model_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric feature columns, categorical columns) of a modelling dataset."""
    numbers = numeric(df)
    num = [c for c in feature_columns(df) if c not in C.CATEGORICAL and c in numbers]
    return num, [c for c in C.CATEGORICAL if c in df.columns]


def team_features(df: DataFrame) -> list[str]:
    return [c for c in feature_columns(df) if not c.startswith(("opp_", "diff_"))]


def known_marks(df: DataFrame) -> DataFrame:
    """``df`` with a zero in place of every known number of a feature.

    For readers that count known values: rows of marks take next to no room in
    shuffles and spills, and what is known of a copy or a difference stays the same.
    """
    numbers = numeric(df)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(0).cast("byte")) for c in team_features(df) if c in numbers})


def mirror_dataset(df: DataFrame) -> DataFrame:
    """Add ``opp_*`` and ``diff_*`` columns.

    The opponent's row is the other row of the same game, so windows over the
    game hand its values across: one exchange, and the features are computed
    once, which a self-join would do twice.  Every column is handed across by
    itself, so a reader of few columns moves few.  Rows whose opponent is
    unknown keep null.
    """
    feats = team_features(df)
    numbers = numeric(df)
    game = Window.partitionBy("gameid").orderBy("side")
    asked = [c for c in feats if c not in C.NO_OPPONENT or (c not in C.NO_DIFF and c in numbers)]
    next_, last = (lambda c: F.lead(c).over(game)), (lambda c: F.lag(c).over(game))
    handed = {f"_n_{c}": next_(c) for c in ["teamid", *asked]} | {f"_l_{c}": last(c) for c in ["teamid", *asked]}
    rows = df.withColumns({**handed, "_next": next_(F.lit(True))})
    other = lambda c: F.when(F.col("_next"), F.col(f"_n_{c}")).otherwise(F.col(f"_l_{c}"))
    rows = rows.withColumn("_match", other("teamid") == F.col("opp_teamid"))
    rows = rows.withColumns({f"_o_{c}": F.when(F.col("_match"), other(c)) for c in asked})
    opp = {f"opp_{c}": F.col(f"_o_{c}") for c in feats if c not in C.NO_OPPONENT}
    diff = {f"diff_{c}": F.col(c) - F.col(f"_o_{c}") for c in feats if c not in C.NO_DIFF and c in numbers}
    out = rows.withColumns({**opp, **diff})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of known values per column; sparse below one half."""
    columns = columns or feature_columns(df)
    ones = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return (
        ones.withColumn("_all", F.lit(1))
        .unpivot(["_all"], columns, "column_name", "known_share")
        .drop("_all")
        .withColumn("sparse", F.col("known_share") < 0.5)
    )


def one_row_per_game(df: DataFrame, mode: str = "blue") -> DataFrame:
    """The Blue row of each game, or the winner's row (``mode='winner'``).

    Winner rows all have the outcome 1 and bias any profit computed on them.
    """
    return df.filter(F.col("result") == 1 if mode == "winner" else F.col("side") == "Blue")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``, as one aggregate with map-side part."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_row"))
    return best.select("_row.*")
