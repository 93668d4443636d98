"""Watching resting quotes: fills, hedges, adverse moves.

The input is one row per market and look: snap_ts, mid, and whether the YES
and the NO order are still open.  ``watch_batch`` derives everything with
prefix aggregates; ``watch_stream`` keeps the same few values as state per
market in a stream.  Both emit intents and alerts, never orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairline.functions.stats import half_even
from fairline.plans.history import Agg, with_history
from fairline.plans.slices import Slices, plan_slices

TIGHTER = 0.005
DRIFT = 0.015
ADVERSE = 0.02

OUT = (
    "market long, snap_ts timestamp, mid double, yes_filled boolean, no_filled boolean, hedge_side string, "
    "hedge_price double, adverse boolean, drift boolean"
)
#: groups of markets whose state is kept together, so that one call handles many markets
GROUPS = 1024
#: what a group keeps: the values of each of its markets, in the markets' order
_STATE = (
    "market array<bigint>, yes_alive array<boolean>, no_alive array<boolean>, original array<double>, "
    "anchor array<double>, hedge_side array<string>"
)


def watch_batch(snaps: DataFrame, slices: Slices | None = None) -> DataFrame:
    """All looks with fills, hedge intents and alerts."""
    slices = slices or plan_slices(snaps, "snap_ts")
    keys, order = ["market"], ["snap_ts"]
    gone = lambda c: F.when(~F.col(c), 1)
    seen = with_history(
        snaps,
        keys,
        order,
        [Agg("_yes_gone", "max", gone("yes_open")), Agg("_no_gone", "max", gone("no_open")),
         Agg("_original", "first", F.col("mid"))],
        slices,
    )
    yes = ~F.col("yes_open") & F.col("_yes_gone").isNull()
    no = ~F.col("no_open") & F.col("_no_gone").isNull()
    untouched = F.col("_yes_gone").isNull() & F.col("_no_gone").isNull()
    one = untouched & (yes != no)
    rows = seen.withColumns({"yes_filled": yes, "no_filled": no, "_one": one})
    rows = rows.withColumn(
        "hedge_side", F.when(F.col("_one") & F.col("yes_filled"), "NO").when(F.col("_one"), "YES")
    )
    rows = with_history(
        rows, keys, order,
        [Agg("_anchor", "first", F.when(F.col("_one"), F.col("mid"))), Agg("_held", "first", F.col("hedge_side"))],
        slices,
    )
    move = F.col("mid") - F.col("_anchor")
    adverse = ((F.col("_held") == "NO") & (move < -ADVERSE)) | ((F.col("_held") == "YES") & (move > ADVERSE))
    price = F.when(F.col("hedge_side") == "NO", half_even(F.least(1.0 - F.col("mid") + TIGHTER, F.lit(0.99)), 2)).when(
        F.col("hedge_side") == "YES", half_even(F.greatest(F.col("mid") - TIGHTER, F.lit(0.01)), 2)
    )
    resting = F.col("_yes_gone").isNull() & F.col("_no_gone").isNull() & F.col("yes_open") & F.col("no_open")
    drift = resting & (F.abs(F.col("mid") - F.coalesce("_original", "mid")) > DRIFT)
    return rows.select(
        "market", "snap_ts", "mid", "yes_filled", "no_filled", "hedge_side", price.alias("hedge_price"),
        F.coalesce(adverse, F.lit(False)).alias("adverse"), drift.alias("drift"),
    )


def _before(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether an earlier row of the market is hit; ``first`` is the position of the market's first row."""
    earlier = np.cumsum(hit) - hit
    return earlier > earlier[first]


def _watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New looks of a group's markets; markets without a number are a group of their own, and one market."""
    looks = pd.concat(list(batches), ignore_index=True)
    if unknown := key[0] < 0:
        looks["market"] = 0
    looks = looks.sort_values(["market", "snap_ts"], kind="stable", ignore_index=True)
    market = looks["market"].to_numpy(np.int64)
    new, starts, code = np.unique(market, return_index=True, return_inverse=True)
    first, ends, at = starts[code], np.append(starts[1:], len(market)) - 1, np.arange(len(market))
    mid = looks["mid"].to_numpy(np.float64)
    yes_open, no_open = ((looks[c] == True).to_numpy(bool) for c in ("yes_open", "no_open"))  # noqa: E712 - unknown is not open

    kept = pd.DataFrame(dict(zip(("market", "yes", "no", "original", "anchor", "held"), state.get if state.exists else [[]] * 6)))
    kept = kept.astype({"market": "int64", "original": "float64", "anchor": "float64", "held": "object"}).set_index("market")
    mine = kept.reindex(new)
    known = np.isin(new, kept.index.to_numpy())
    yes_then, no_then = (np.where(known, mine[c] == True, True) for c in ("yes", "no"))  # noqa: E712
    original = np.where(known, mine["original"], mid[starts])
    anchor, held = mine["anchor"].to_numpy(np.float64), np.where(mine["held"].isna(), "", mine["held"]).astype(object)

    yes_alive = yes_then[code] & ~_before(~yes_open, first)
    no_alive = no_then[code] & ~_before(~no_open, first)
    yes, no = yes_alive & ~yes_open, no_alive & ~no_open
    one = yes_alive & no_alive & (yes != no)  # at most one look of a market
    hedge = np.where(one, np.where(yes, "NO", "YES"), "").astype(object)
    price = np.full(len(market), np.nan)
    price[one] = [round(min(1.0 - m + TIGHTER, 0.99), 2) if y else round(max(m - TIGHTER, 0.01), 2) for m, y in zip(mid[one].tolist(), yes[one])]
    hedged = np.full(len(new), len(market))
    hedged[code[one]] = at[one]
    has = hedged < len(market)
    later = at > hedged[code]
    spot = np.minimum(hedged, len(market) - 1)
    anchor_now, held_now = np.where(has, mid[spot], anchor), np.where(has, hedge[spot], held)
    move = mid - np.where(later, anchor_now[code], anchor[code])
    side = np.where(later, held_now[code], held[code])
    adverse = ((side == "NO") & (move < -ADVERSE)) | ((side == "YES") & (move > ADVERSE))
    yes_alive, no_alive = yes_alive & ~yes, no_alive & ~no
    drift = yes_alive & no_alive & (np.abs(mid - original[code]) > DRIFT)

    now = pd.DataFrame({"yes": yes_alive[ends], "no": no_alive[ends], "original": original, "anchor": anchor_now, "held": held_now}, index=new)
    others = kept[~kept.index.isin(new)]
    now = pd.concat([others, now]) if len(others) else now
    sides = [h or None for h in now["held"].where(now["held"].notna(), "")]
    state.update((now.index.tolist(), now["yes"].astype(bool).tolist(), now["no"].astype(bool).tolist(),
                  now["original"].tolist(), now["anchor"].tolist(), sides))
    yield pd.DataFrame({
        "market": pd.Series(market, dtype="Int64").mask(np.full(len(market), unknown)), "snap_ts": looks["snap_ts"], "mid": mid,
        "yes_filled": yes, "no_filled": no, "hedge_side": [h or None for h in hedge], "hedge_price": price, "adverse": adverse, "drift": drift})


def watch_stream(snaps: DataFrame, groups: int = GROUPS) -> DataFrame:
    """The same rows from a stream of looks, with five values of state per market.

    The state of a group of markets is one row and one call handles the group's
    new looks, so the number of calls does not grow with the markets.  ``groups``
    is a part of a stream's checkpoint and must not change.
    """
    group = F.when(F.col("market").isNull(), -1).otherwise(F.pmod(F.xxhash64("market"), F.lit(groups)))
    return snaps.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        _watch, OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def fill_events(watched: DataFrame) -> DataFrame:
    """One row per fill: market, side, when."""
    side = F.explode(
        F.array_compact(F.array(F.when(F.col("yes_filled"), "YES"), F.when(F.col("no_filled"), "NO")))
    )
    return watched.filter(F.col("yes_filled") | F.col("no_filled")).select("market", "snap_ts", "mid", side.alias("side"))


def hedge_intents(watched: DataFrame) -> DataFrame:
    return watched.filter(F.col("hedge_side").isNotNull()).select("market", "snap_ts", "mid", "hedge_side", "hedge_price")


def move_alerts(watched: DataFrame) -> DataFrame:
    kind = F.when(F.col("adverse"), "adverse").otherwise("drift")
    return watched.filter(F.col("adverse") | F.col("drift")).select("market", "snap_ts", "mid", kind.alias("alert"))
