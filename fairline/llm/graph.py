"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of every node in ``edges`` (columns a, b).

    Large star: every node points its larger neighbours at its smallest one.
    Small star: every node points its smaller neighbours, and itself, at the
    smallest.  Minima are aggregated before the shuffle and joined back, so a
    node with very many neighbours is split like any skewed join key.  Each
    round is a written table; rounds end when a round changes nothing.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = cut_lineage(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
