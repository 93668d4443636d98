"""Queries for the quote watcher and the incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairline import fixtures
from fairline.catalog.base import EVENTS, RATINGS, Registry, register, sql
from fairline.plans.slices import plan_slices
from fairline.session import scratch_path
from fairline.streaming import fills, ingest

REGISTRY: Registry = {}

SNAPS = EVENTS + """,
sn AS (SELECT gameid AS market, epoch_us(date) + look * 30000000 AS us, look,
    greatest(0.02::DOUBLE, least(0.98::DOUBLE, 0.05::DOUBLE + 0.9::DOUBLE * (bk / 99.0::DOUBLE) + ((rk % 7) - 3) / 100.0::DOUBLE * look)) AS mid,
    NOT (bk % 4 = 0 AND look >= 2) AS yes_open, NOT (rk % 4 = 1 AND look >= 3) AS no_open,
    bk % 4 = 0 AS yes_goes, rk % 4 = 1 AS no_goes FROM g, (SELECT unnest(range(5)) AS look)),
s1 AS (SELECT *, NOT yes_open AND look = 2 AS yes_filled, NOT no_open AND look = 3 AS no_filled,
    first_value(mid) OVER (PARTITION BY market ORDER BY us) AS original FROM sn),
s2 AS (SELECT *, CASE WHEN yes_filled THEN 'NO' WHEN no_filled AND NOT yes_goes THEN 'YES' END AS hedge_side FROM s1),
s3 AS (SELECT *, max(CASE WHEN hedge_side IS NOT NULL THEN mid END) OVER w AS anchor, max(hedge_side) OVER w AS held FROM s2
  WINDOW w AS (PARTITION BY market ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, CASE hedge_side WHEN 'NO' THEN round_even(least(1 - mid + 0.005::DOUBLE, 0.99), 2)
      WHEN 'YES' THEN round_even(greatest(mid - 0.005::DOUBLE, 0.01), 2) END AS hedge_price,
    coalesce((held = 'NO' AND mid - anchor < -0.02) OR (held = 'YES' AND mid - anchor > 0.02), false) AS adverse,
    yes_open AND no_open AND abs(mid - original) > 0.015 AS drift FROM s3)"""


def watched(spark, sf):
    snaps = fixtures.order_snapshots(spark, sf)
    return fills.watch_batch(snaps, plan_slices(snaps, "snap_ts", 5_000)).withColumn("us", F.unix_micros("snap_ts"))


@register(REGISTRY, "R1_fill_events",
          sql(SNAPS, "SELECT market, us, 'YES' AS side FROM st WHERE yes_filled UNION ALL SELECT market, us, 'NO' FROM st WHERE no_filled",
              ["market", "us", "side"]))
def fill_events(spark, sf):
    return fills.fill_events(watched(spark, sf)).select("market", F.unix_micros("snap_ts").alias("us"), "side")


@register(REGISTRY, "R2_hedge_intents",
          sql(SNAPS, "SELECT * FROM st WHERE hedge_side IS NOT NULL", ["market", "us", "hedge_side"], ["mid"]))
def hedge_intents(spark, sf):
    return fills.hedge_intents(watched(spark, sf)).select("market", F.unix_micros("snap_ts").alias("us"), "hedge_side", "mid")


@register(REGISTRY, "R3_move_alerts",
          sql(SNAPS, "SELECT market, us, CASE WHEN adverse THEN 'adverse' ELSE 'drift' END AS alert FROM st WHERE adverse OR drift",
              ["market", "us", "alert"]))
def move_alerts(spark, sf):
    return fills.move_alerts(watched(spark, sf)).select("market", F.unix_micros("snap_ts").alias("us"), "alert")


@register(REGISTRY, "R1_R2_R3_quote_watch_stream",
          sql(SNAPS, "SELECT * FROM st", ["market", "us", "yes_filled", "no_filled", "hedge_side", "adverse", "drift"]))
def watch_stream(spark, sf):
    """The stateful stream over the same looks, run to its end."""
    path, out = scratch_path(spark, "looks"), scratch_path(spark, "watched")
    fixtures.order_snapshots(spark, sf).write.parquet(path)
    looks = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = (
        fills.watch_stream(looks).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "watch-log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out).withColumn("us", F.unix_micros("snap_ts"))
    return rows.select("market", "us", "yes_filled", "no_filled", "hedge_side", "adverse", "drift")


@register(REGISTRY, "R4_incremental_ratings", sql(RATINGS, "SELECT * FROM e", ("gameid", "side"), ["elo_team", "elo_opp"], 4), 4)
def incremental(spark, sf):
    """Match rows arriving in two parts, with repeats and late games; the ratings are those of one pass."""
    path, root = scratch_path(spark, "arrivals"), scratch_path(spark, "rated")
    rows = fixtures.match_rows(spark, sf).select("gameid", "date", "side", "teamid", "result")
    late = (F.col("date") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("gameid") % 7 == 0)
    early = (F.col("date") < F.lit("2024-01-16").cast("timestamp")) & ~late
    for part in (rows.filter(early), rows.filter(~early)):
        part.unionByName(part.filter(F.col("gameid") % 5 == 0)).write.mode("append").parquet(path)
        arrivals = spark.readStream.schema(rows.schema).parquet(path)
        ingest.run_incremental(arrivals, root, f"{root}/log", chunk_days=4).awaitTermination()
    sides = F.array(
        F.struct(F.lit("Blue").alias("side"), F.col("ra").alias("elo_team"), F.col("rb").alias("elo_opp")),
        F.struct(F.lit("Red").alias("side"), F.col("rb").alias("elo_team"), F.col("ra").alias("elo_opp")),
    )
    return ingest.RatingSink(root).games(spark).select("gameid", F.inline(sides))
