"""Incremental match ingest: deduplicated rows in, ratings carried between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.config import RATING_K
from fairline.operators.ratings import expectation, game_table, rate_table
from fairline.session import cut_lineage
from fairline.sources.match_log import known_results, pair_opponents


def deduplicated(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (gameid, teamid) once, as long as repeats arrive within ``delay``."""
    return rows.withWatermark("date", delay).dropDuplicatesWithinWatermark(["gameid", "teamid"])


class RatingSink:
    """``foreachBatch`` target that rates each batch, and late games at their place in time.

    Time is cut into chunks of ``chunk_days``.  A batch starts at the chunk of
    its earliest new game: from the ratings that teams had at the end of the
    chunks before, the stored games from there on are played again together
    with the new ones.  Games, and every team's rating at the end of each chunk,
    are published as a version that replaces all older ones from that chunk on,
    so the ratings are those of one pass over all games, in whatever order they
    arrive.  Batches that arrive in order replay the games of one chunk at most.

    Every batch writes below ``root`` under its batch id, the commit last.  A
    batch that runs again after a failure reads only what earlier batches
    committed and overwrites what it wrote, so results do not depend on retries.
    A game whose second row has not arrived waits below ``root`` and is rated
    with the batch that completes it.  A game that was rated before is not rated
    twice.  Rows without a date do not take part; ``parse_dates`` drops them.
    """

    def __init__(self, root: str, chunk_days: int = 30):
        self.root = root
        self.chunk_days = chunk_days

    def _versions(self, spark: SparkSession, kind: str = "ratings") -> list[int]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def ratings(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """Newest ratings, or the newest from before a batch: team, rating."""
        ends = self._current(spark, "ends", before)
        return None if ends is None else _last(ends)

    def pending(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """Rows of games that wait for their other side."""
        found = [v for v in self._versions(spark, "pending") if before is None or v < before]
        return spark.read.parquet(f"{self.root}/pending/batch={found[-1]}") if found else None

    def _live(self, spark: SparkSession, before: int | None) -> list[tuple[int, int, int | None]]:
        """Committed batches that are not wholly replaced: batch, its first chunk, the first chunk that a later one holds."""
        done = [v for v in self._versions(spark, "commits") if before is None or v < before]
        if not done:
            return []
        commits = spark.read.option("basePath", f"{self.root}/commits").parquet(*[f"{self.root}/commits/batch={v}" for v in done])
        out: list[tuple[int, int, int | None]] = []
        until = None
        for batch, first in sorted(map(tuple, commits.select("batch", "first").collect()), reverse=True):  # one row per batch
            if until is None or first < until:
                out.append((batch, first, until))
                until = first
        return out

    def _current(self, spark: SparkSession, kind: str, before: int | None = None) -> DataFrame | None:
        live = self._live(spark, before)
        if not live:
            return None
        rows = spark.read.option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/batch={b}" for b, _, _ in live])
        kept = F.lit(False)
        for batch, first, until in live:
            mine = (F.col("batch") == batch) & (F.col("chunk") >= first)
            kept = kept | (mine if until is None else mine & (F.col("chunk") < until))
        return rows.filter(kept).withColumn("chunk", F.col("chunk").cast("long"))

    def games(self, spark: SparkSession) -> DataFrame | None:
        """Every game once, with both ratings before it, the batch it arrived in and the one that rated it last."""
        return self._current(spark, "games")

    def late_games(self, spark: SparkSession) -> DataFrame:
        """Games that arrived after a later one had been rated; they made earlier ratings be worked out again."""
        games = self.games(spark)
        earlier = Window.orderBy("arrived").rowsBetween(Window.unboundedPreceding, -1)  # one row per batch
        newest = games.groupBy("arrived").agg(F.max("date").alias("_newest")).withColumn("_newest", F.max("_newest").over(earlier))
        return games.join(newest, "arrived").filter(F.col("date") < F.col("_newest")).drop("_newest")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = self.pending(spark, batch_id)
        rows = batch if waiting is None else batch.unionByName(waiting)
        rows = cut_lineage(rows.dropDuplicates(["gameid", "side", "teamid"]), "ingest")  # a repeat of a waiting row
        alone = rows.groupBy("gameid").count().filter("count = 1").select("gameid")
        rows.join(alone, "gameid", "left_semi").write.mode("overwrite").parquet(f"{self.root}/pending/batch={batch_id}")
        chunk = F.floor(F.unix_seconds("date") / (86_400 * self.chunk_days)).cast("long")
        new = game_table(known_results(pair_opponents(rows))).filter("date is not null")
        new = cut_lineage(new.withColumns({"chunk": chunk, "arrived": F.lit(batch_id).cast("long")}), "arrived")
        stored = self._current(spark, "games", batch_id)
        if stored is not None:
            stored = stored.select(new.columns)
            from_chunk = new.agg(F.min("chunk")).first()[0]
            seen = stored.filter(F.lit(from_chunk) <= F.col("chunk"))  # a repeat lies in the chunk of its game
            new = new.join(seen.select("gameid"), "gameid", "left_anti").select(new.columns)
        first = new.agg(F.min("chunk")).first()[0]
        if first is None:
            return
        initial, replay = None, new
        if stored is not None:
            replay = cut_lineage(new.unionByName(stored.filter(F.col("chunk") >= first)), "replay")
            before = self._current(spark, "ends", batch_id).filter(F.col("chunk") < first)
            initial = cut_lineage(_last(before), "initial")
        games, _ = rate_table(replay, initial)
        rated = replay.join(games.select("gameid", "ra", "rb"), "gameid")
        path = f"{self.root}/games/batch={batch_id}"
        rated.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(path)
        ends = _chunk_ratings(spark.read.parquet(path))  # of teams that played; older chunks hold the others
        ends.write.mode("overwrite").parquet(f"{self.root}/ends/batch={batch_id}")
        spark.range(1).select(F.lit(first).alias("first")).write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch_id}")


def _chunk_ratings(games: DataFrame) -> DataFrame:
    """Rating of every team after its last game of each chunk: chunk, team, rating."""
    step = F.when(F.col("rated"), RATING_K * (F.col("result") - expectation(F.col("ra") - F.col("rb")))).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("a").alias("team"), (F.col("ra") + step).alias("rating")),
        F.struct(F.col("b").alias("team"), (F.col("rb") - step).alias("rating")),
    )
    after = games.select(F.col("chunk").cast("long"), "date", "gameid", F.inline(sides)).filter("team is not null")
    return after.groupBy("chunk", "team").agg(F.max_by("rating", F.struct("date", "gameid")).alias("rating"))


def _last(ends: DataFrame) -> DataFrame:
    return ends.groupBy("team").agg(F.max_by("rating", "chunk").alias("rating"))


def run_incremental(rows: DataFrame, root: str, checkpoint: str, chunk_days: int = 30):
    """Start the stream with one batch per trigger of available data."""
    return (
        deduplicated(rows)
        .writeStream.foreachBatch(RatingSink(root, chunk_days))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
