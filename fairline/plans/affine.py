"""Running affine recurrences  x' = a * x + b  as a distributed scan.

Rows of a key are numbered and cut into short segments.  Inside a segment the
maps of neighbouring rows are put together, then those of two, four, eight ...
rows.  Nothing is divided by a running product, which leaves the range of
doubles on long histories.  Each segment is itself one affine map, so the maps
of the segments form the same problem on a table ``SEGMENT`` times smaller; it
is solved the same way and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256


def affine_scan(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    a: str,
    b: str,
    longest: int,
    start: str,
    out: str,
    segment: int = SEGMENT,
) -> DataFrame:
    """Add ``out``: the state before each row, given ``start`` before row 0.

    ``seq`` numbers the rows of a key from 0 without gaps and ``longest`` is
    the greatest row count of any key; it only decides how often to recurse.
    ``a`` must be positive.  A row without ``a`` has no state; later rows take
    its factor as one and its ``b`` (none before the first ``a`` of a segment).
    """
    keys = list(keys)
    if longest <= segment:
        return _scan_inside(df, keys, seq, a, b, start, out, min(longest, segment))

    seg = f"{seq}_seg"  # a new name per level, as the next level numbers segments by it
    cut = df.withColumn(seg, F.floor(F.col(seq) / segment))
    maps = _put_together(cut, [*keys, seg], seq, a, b, segment).groupBy(*keys, seg).agg(
        F.max_by("_a", seq).alias(f"{seg}_a"), F.max_by("_b", seq).alias(f"{seg}_b"), F.max(start).alias(f"{seg}_start")
    )
    solved = affine_scan(
        maps, keys, seg, f"{seg}_a", f"{seg}_b", (longest + segment - 1) // segment, f"{seg}_start", f"{seg}_in", segment
    ).select(*keys, seg, f"{seg}_in")
    joined = cut.join(solved, keys + [seg])
    return _scan_inside(joined, keys + [seg], seq, a, b, f"{seg}_in", out, segment).drop(seg, f"{seg}_in")


def _grown(a: Column, x: Column) -> Column:
    """``a * x`` as row after row gives it: an ``x`` that left the range of doubles stays there."""
    return F.when((x == 0.0) | (F.abs(x) == float("inf")), x).otherwise(a * x)


def _put_together(df: DataFrame, parts: Sequence[str], seq: str, a: str, b: str, rows: int) -> DataFrame:
    """Add ``_a`` and ``_b``: the map of all rows of the part up to and with each row, for parts of at most ``rows`` rows."""
    ordered = Window.partitionBy(*parts).orderBy(seq)
    known = F.count(a).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) > 0
    own = {"_a": F.coalesce(F.col(a), F.lit(1.0)), "_b": F.when(known, F.coalesce(F.col(b), F.lit(0.0))).otherwise(0.0)}
    out, step = df.withColumns(own), 1
    while step < rows:
        far = {"_far_a": F.lag("_a", step, 1.0).over(ordered), "_far_b": F.lag("_b", step, 0.0).over(ordered)}
        out = out.withColumns(far).withColumns(
            {"_a": _grown(F.col("_a"), F.col("_far_a")), "_b": _grown(F.col("_a"), F.col("_far_b")) + F.col("_b")}
        )
        step *= 2
    return out.drop("_far_a", "_far_b")


def _scan_inside(df, parts, seq, a, b, start, out, rows):
    """The map of the earlier rows, applied to the start."""
    ordered = Window.partitionBy(*parts).orderBy(seq)
    before = {"_a": F.lag("_a", 1, 1.0).over(ordered), "_b": F.lag("_b", 1, 0.0).over(ordered)}
    put = _put_together(df, parts, seq, a, b, rows).withColumns(before)
    state = _grown(F.col("_a"), F.col(start)) + F.col("_b")
    return put.withColumn(out, F.when(F.col(a).isNotNull(), state)).drop("_a", "_b")
