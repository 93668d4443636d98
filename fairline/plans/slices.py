"""Time slices: how long histories are cut so that no task holds a whole key.

A window over ``partitionBy(key)`` puts all rows of a key into one task, which
is fatal when one key holds a third of a huge table.
Slices cut the time axis into pieces of bounded row count; prefix operators
then work per (key, slice) and add what the earlier slices contribute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows one slice should hold, summed over all keys
SLICE_ROWS = 2_000_000
#: how far slices are narrowed for a crowded time
NARROWING = 16
#: slice of rows without a time, which are ordered before all others
UNTIMED = -(1 << 62)


@dataclass(frozen=True)
class Slices:
    """Cut of the time axis; ``width_us`` of None means one single slice."""

    ts: str = "date"
    origin_us: int = 0
    width_us: int | None = None

    @property
    def single(self) -> bool:
        return self.width_us is None

    def column(self) -> Column:
        if self.single:
            return F.lit(0).cast("long")
        at = F.floor((F.unix_micros(F.col(self.ts)) - F.lit(self.origin_us)) / F.lit(self.width_us))
        return F.coalesce(at, F.lit(UNTIMED))

    def rename(self, ts: str) -> "Slices":
        return Slices(ts, self.origin_us, self.width_us)


ONE_SLICE = Slices()


def plan_slices(df: DataFrame, ts: str = "date", rows: int = SLICE_ROWS) -> Slices:
    """Choose a slice width so that slices hold about ``rows`` rows.

    One aggregate over the time column finds count and span, a second one the
    fullest slice of the width that even times would need.  The width is then
    narrowed once, by at most ``NARROWING``: two passes, whatever the data.
    Rows of one instant stay in one slice.
    """
    micros = F.unix_micros(F.col(ts))
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(micros), F.max(micros)).first()
    if n <= rows or lo is None or lo == hi:
        return Slices(ts)
    width = max(1, (hi - lo + 1) * rows // n)
    fullest = df.groupBy(Slices(ts, lo, width).column().alias("s")).count().agg(F.max("count")).first()[0]
    if fullest > rows:
        width = max(1, width // NARROWING, int(width * 0.9 * rows / fullest))
    return Slices(ts, lo, width)
