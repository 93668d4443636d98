"""Match log: yearly files with team rows and player rows mixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.config import NUMERIC_COLUMNS, RENAMES

#: ``.../2019_name.csv`` or, for a folder of part files, ``.../2019_name/part-0``
_YEAR = r"/(\d{4})_[^/]*(?:/part-[^/]*)?$"


def scan_years(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read yearly CSV files; ``year`` comes from the file name.

    Paths that do not exist are skipped with a warning; columns that only some
    years have are null elsewhere.  All values stay text: types are settled by
    the operators below, not by sampling the files.
    """
    found, missing = [], []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        (found if fs.globStatus(p) else missing).append(path)
    for path in missing:
        print(f"warning: no match log at {path}")
    if not found:
        raise FileNotFoundError(f"none of the match logs exist: {list(paths)}")
    log = None
    for path in found:
        year = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
        year = year.withColumn(
            "year", F.regexp_extract(F.col("_metadata.file_path"), _YEAR, 1).cast("int")
        )
        log = year if log is None else log.unionByName(year, allowMissingColumns=True)
    return log


def rename_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})


def parse_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """Timestamps in UTC; rows whose date cannot be read are dropped."""
    return df.withColumn(col, F.expr(f"try_to_timestamp(cast(`{col}` as string))")).filter(
        F.col(col).isNotNull()
    )


def cast_numerics(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Numbers where the text is a number, null (never NaN) elsewhere."""
    present = [c for c in columns if c in df.columns]
    casts = {c: F.expr(f"nullif(try_cast(`{c}` as double), double('NaN'))") for c in present}
    return df.withColumns(casts)


def split_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(team rows, player rows); rows without a position are player rows."""
    is_team = F.col("position").eqNullSafe("team")
    return df.filter(is_team), df.filter(~is_team)


def pair_opponents(teams: DataFrame) -> DataFrame:
    """Keep games with exactly two team rows and add the other row's team.

    A junk id may sit on very many rows.  Three rows are enough to know that a
    game is not a pair, and a row-number limit is applied before the exchange
    too, so such an id sends at most three rows per input partition.
    """
    game = Window.partitionBy("gameid")
    ordered = game.orderBy("side")
    few = teams.filter(F.col("gameid").isNotNull()).withColumn("_rank", F.row_number().over(ordered)).filter(F.col("_rank") <= 3)
    other = F.when(F.col("_rank") == 1, F.lead("teamid").over(ordered)).otherwise(F.lag("teamid").over(ordered))
    paired = few.withColumns({"_rows": F.count(F.lit(1)).over(game), "opp_teamid": other})
    return paired.filter(F.col("_rows") == 2).drop("_rows", "_rank")


def known_results(teams: DataFrame) -> DataFrame:
    """Drop rows without a result; the rest hold 0 or 1."""
    return teams.filter(F.col("result").isNotNull()).withColumn("result", F.col("result").cast("int"))


def read_match_log(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Yearly files to (team rows with opponents, player rows)."""
    log = cast_numerics(parse_dates(rename_columns(scan_years(spark, paths))))
    teams, players = split_rows(log)
    return known_results(pair_opponents(teams)), players
