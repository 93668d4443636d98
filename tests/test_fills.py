"""The quote watcher's stream: state of many markets in one call, any cut into batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairline.streaming import fills


def looks(seed, markets=40):
    """(market, second, mid, yes_open, no_open); orders may come back, prices and flags may be unknown."""
    rng, out = random.Random(seed), []
    for m in [*range(markets), None]:
        at = 0
        for _ in range(rng.randint(1, 9)):
            at += rng.randint(1, 50)
            flag = lambda: None if rng.random() < 0.05 else rng.random() < 0.75
            out.append((m, at, None if rng.random() < 0.1 else round(rng.uniform(0.3, 0.7), 3), flag(), flag()))
    return out


def fold(rows):
    """One market after the other, look by look."""
    want, state = set(), {}
    for m, at, mid, yes_open, no_open in sorted(rows, key=lambda r: r[1]):
        ya, na, first, anchor, held = state.get(m, (True, True, mid, None, None))
        x = float("nan") if mid is None else mid
        base = float("nan") if first is None else first
        yes, no = ya and not yes_open, na and not no_open
        adverse = (held == "NO" and x - anchor < -fills.ADVERSE) or (held == "YES" and x - anchor > fills.ADVERSE)
        hedge = price = None
        if ya and na and yes != no:
            hedge = "NO" if yes else "YES"
            if mid is not None:
                price = round(min(1.0 - mid + fills.TIGHTER, 0.99), 2) if yes else round(max(mid - fills.TIGHTER, 0.01), 2)
            anchor, held = x, hedge
        ya, na = ya and not yes, na and not no
        want.add((m, at, mid, yes, no, hedge, price, adverse, ya and na and abs(x - base) > fills.DRIFT))
        state[m] = (ya, na, first, anchor, held)
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_batches_equals_a_fold(spark, tmp_path, seed):
    rows = looks(seed)
    schema = "market long, at long, mid double, yes_open boolean, no_open boolean"
    for k, (lo, hi) in enumerate([(0, 60), (60, 140), (140, 10_000)]):
        part = spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).withColumn("snap_ts", F.timestamp_seconds("at"))
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        query = (
            fills.watch_stream(spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), 3)
            .writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").withColumn("snap_ts", F.unix_seconds("snap_ts"))
    assert {tuple(r) for r in out.collect()} == fold(rows)


def test_one_call_for_many_markets():
    class Kept:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    frame = pd.DataFrame([(m, pd.Timestamp(s, unit="s"), 0.5, s < 2, True) for m in range(500) for s in range(4)],
                         columns=["market", "snap_ts", "mid", "yes_open", "no_open"])
    state = Kept()
    (out,) = fills._watch((0,), iter([frame]), state)
    assert out.groupby("market").yes_filled.sum().tolist() == [1] * 500
    assert len(state.get[0]) == 500 and not any(state.get[1]) and set(state.get[5]) == {"NO"}
