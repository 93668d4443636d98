"""Prefix aggregates over the earlier rows of a key, safe against hot keys.

``with_history`` adds, for every row, aggregates over the rows of the same key
that come before it, in three steps: (1) one small aggregate per (key, slice), whose
map-side part runs before the shuffle; (2) a running window over those
aggregates, one row per slice; (3) a running window inside (key, slice), joined
with the carry of (2).  No task ever sees more than one slice of a key.

Key columns must not be null; use ``anonymous_key`` to give rows with a missing
key an identity of their own, so they have no history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.plans.slices import Slices
from fairline.session import cut_lineage


@dataclass(frozen=True)
class Agg:
    """One prefix aggregate: ``kind`` is sum, count, max, first or last."""

    name: str
    kind: str
    expr: Column | None = None

    def value(self) -> Column:
        return F.lit(1) if self.expr is None else self.expr

    def over(self, window) -> Column:
        v = self.value()
        if self.kind == "sum":
            return F.coalesce(F.sum(v).over(window), F.lit(0))
        if self.kind == "count":
            return F.count(v).over(window)
        if self.kind == "max":
            return F.max(v).over(window)
        if self.kind == "first":
            return F.first(v, ignorenulls=True).over(window)
        return F.last(v, ignorenulls=True).over(window)

    def partial(self, order: Sequence[str]) -> Column:
        v = self.value()
        if self.kind == "sum":
            return F.sum(v)
        if self.kind == "count":
            return F.count(v)
        if self.kind == "max":
            return F.max(v)
        pick = F.min_by if self.kind == "first" else F.max_by
        return pick(v, F.when(v.isNotNull(), F.struct(*order)))

    def carry(self, column: str, window) -> Column:
        c = F.col(column)
        if self.kind in ("sum", "count"):
            return F.sum(c).over(window)
        if self.kind == "max":
            return F.max(c).over(window)
        if self.kind == "first":
            return F.first(c, ignorenulls=True).over(window)
        return F.last(c, ignorenulls=True).over(window)

    def merge(self, inside: str, carried: str) -> Column:
        a, b = F.col(inside), F.col(carried)
        if self.kind in ("sum", "count"):
            return a + F.coalesce(b, F.lit(0))
        if self.kind == "max":
            return F.greatest(a, b)
        return F.coalesce(b, a) if self.kind == "first" else F.coalesce(a, b)


def anonymous_key(key: str, *identity: str) -> Column:
    """``key``, or a value unique to the row where it is null."""
    return F.coalesce(F.col(key).cast("string"), F.concat_ws("|", F.lit("?"), *identity))


#: column that tells the rows of a stored table apart
ROW = "_row"


def number_rows(df: DataFrame, name: str = "rows") -> DataFrame:
    """Stored copy of ``df`` with a number of its own for every row; ``df`` itself if it has numbers."""
    return df if ROW in df.columns else cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def beside(df: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``columns`` of the rows of the same number; a chain of such joins moves wide rows once."""
    return df.join(found.select(ROW, *columns), ROW)


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Sequence[Agg],
    slices: Slices,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add every aggregate in ``aggs`` over the strictly earlier rows of the key.

    ``source`` may name a cheaper frame with the same rows to take the slice
    totals from: the stored table ``df`` was derived from.  Then a chain of
    calls stays a chain, instead of evaluating all earlier steps once more per
    call.  A ``_slice`` column that ``df`` already has is kept, so that calls
    whose keys start alike share one exchange.

    If both have the row number ``number_rows`` gives, only the columns that the
    aggregates read go through the key's order; they are joined by the number.
    """
    keys, order = list(keys), list(order)
    if source is not None and ROW in df.columns and ROW in source.columns:
        return beside(df, with_history(source, keys, order, aggs, slices), [a.name for a in aggs])
    keep = "_slice" in df.columns
    sliced = df if keep else df.withColumn("_slice", slices.column())
    part = [F.col(k) for k in keys] + [F.col("_slice")]
    base = sliced if source is None else source.withColumn("_slice", slices.column())
    totals = base.groupBy(*part).agg(*[a.partial(order).alias(f"_p_{a.name}") for a in aggs])
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*part, *[a.carry(f"_p_{a.name}", across).alias(f"_c_{a.name}") for a in aggs])
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = sliced.withColumns({a.name: a.over(inside) for a in aggs})
    joined = rows.join(carried, keys + ["_slice"], "left")
    merged = joined.withColumns({a.name: a.merge(a.name, f"_c_{a.name}") for a in aggs})
    return merged.drop(*([] if keep else ["_slice"]), *[f"_c_{a.name}" for a in aggs])


#: rows a run may hold, and rows copied into the next run
RUN_ROWS = 200_000


def cut_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slices: Slices,
    halo: int,
    run_rows: int = RUN_ROWS,
    source: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Prepare ``df`` for windows that look back at most ``halo`` rows.

    Returns the frame and the columns to partition such windows by.  Long
    histories are cut into runs of ``run_rows`` rows and the last ``halo`` rows
    of a run are copied in front of the next one; ``drop_halo`` removes the
    copies afterwards.
    """
    keys = list(keys)
    run_rows = max(run_rows, halo)  # a run must hold all rows the next one looks back at
    numbered = with_history(df, keys, order, [Agg("_seq", "count")], slices, source)
    run = F.floor(F.col("_seq") / run_rows)
    own = F.struct(run.alias("run"), F.lit(False).alias("halo"))
    copy = F.struct((run + 1).alias("run"), F.lit(True).alias("halo"))
    copies = F.when(F.col("_seq") % run_rows >= run_rows - halo, F.array(own, copy)).otherwise(F.array(own))
    spread = numbered.withColumn("_cut", F.explode(copies)).withColumns(
        {"_run": F.col("_cut.run"), "_halo": F.col("_cut.halo")}
    )
    return spread.drop("_cut"), keys + ["_run"]


def drop_halo(df: DataFrame) -> DataFrame:
    """Remove the copies and helper columns that ``cut_runs`` added."""
    if "_halo" not in df.columns:
        return df
    return df.filter(~F.col("_halo")).drop("_halo", "_run", "_seq")
