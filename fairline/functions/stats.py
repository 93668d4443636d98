"""Column helpers shared by the feature groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def roll_mean(col: str | Column, window, fill: float = 0.0) -> Column:
    """Mean over the frame, nulls skipped; ``fill`` when the frame has no value."""
    return F.coalesce(F.avg(col).over(window), F.lit(fill))


def roll_std(col: str | Column, window, fill: float = 0.0) -> Column:
    """Sample deviation over the frame when it has at least three values."""
    return F.when(F.count(col).over(window) >= 3, F.stddev_samp(col).over(window)).otherwise(F.lit(fill))


def roll_rate(condition: Column, window, size: int) -> Column:
    """Share of the last ``size`` rows where ``condition`` holds; null does not hold.

    The slot before a team's first game counts as one more row that does not
    hold until it leaves the frame, so a first game reads 0.
    """
    held = F.coalesce(F.sum(F.when(condition, 1.0).otherwise(0.0)).over(window), F.lit(0.0))
    return held / F.least(F.count(F.lit(1)).over(window) + 1, F.lit(size))


def roll_cond_mean(col: str, condition: Column, window, fill: float = 0.0) -> Column:
    """Mean of ``col`` over frame rows where ``condition`` holds."""
    return F.coalesce(F.avg(F.when(condition, F.col(col))).over(window), F.lit(fill))


def ewma(col: str, window, alpha: float, fill: float) -> Column:
    """Exponentially weighted mean over the frame, newest row weighted most."""
    keep = F.lit(1.0 - alpha)
    values = F.collect_list(F.col(col).cast("double")).over(window)
    start = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    folded = F.aggregate(
        values,
        start,
        lambda s, x: F.struct((s["num"] * keep + x).alias("num"), (s["den"] * keep + 1.0).alias("den")),
        lambda s: F.try_divide(s["num"], s["den"]),
    )
    return F.coalesce(folded, F.lit(fill))


def shrunk_rate(n: str | Column, wins: str | Column, k: float, prior: float | Column) -> Column:
    """n/(n+k) of the observed rate plus k/(n+k) of the prior."""
    n = F.col(n) if isinstance(n, str) else n
    wins = F.col(wins) if isinstance(wins, str) else wins
    prior = F.lit(prior) if not isinstance(prior, Column) else prior
    raw = wins / F.greatest(n.cast("double"), F.lit(1e-9))
    return n / (n + k) * raw + F.lit(float(k)) / (n + k) * prior


def share(mine: str, other: str) -> Column:
    """mine / (mine + other); one half when both are zero or one is missing."""
    total = F.col(mine) + F.col(other)
    return F.coalesce(F.try_divide(F.col(mine).cast("double"), total), F.lit(0.5))


def half_even(col: Column, digits: int) -> Column:
    """Round half to even, as Python's ``round`` does."""
    return F.bround(col, digits)


def right_closed_bin(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval (edge, next edge] holding ``value``; null outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (value > lo) & (value <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for display; tiny values become plain zero."""
    tiny = 0.5 * 10.0 ** -digits
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(F.abs(c) < tiny, F.lit(0.0)).otherwise(F.round(c, digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)
