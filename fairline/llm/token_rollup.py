"""Token counts as rollups that signed batches maintain.

Totals by source, language and tokenizer version are sums, so a change is a few
signed rows: an insert adds a document and its tokens, a delete takes them away,
a revised count takes the old tokens away and adds the new ones, under the old
and the new group.  A batch is summed by group (before the shuffle, so a hot
source costs one row per task) and written to a folder named after the batch.
A batch whose folder is complete is not written again, which makes commits
idempotent; one that broke off is overwritten.  Totals are the sum of all
folders; ``compact`` folds them into one without touching what is committed.

Nulls: a null group value is a group of its own, null counts and texts count as
zero tokens.  Repeated rows count as often as they occur.  An empty batch commits
nothing but its id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pyarrow as pa

from fairline.llm.bpe import loaded
from fairline.llm.common import in_pieces, path_exists, texts

GROUP = ("source", "lang", "tokenizer")
#: what each kind of change does: sign and side (old or new) of the rows it stands for
SIGNS = {"insert": ((1, "new"),), "delete": ((-1, "old"),), "revise": ((-1, "old"), (1, "new"))}
WORDS = "words"


def count_tokens(docs: DataFrame, tokenizers: Mapping[str, str | None]) -> DataFrame:
    """doc_id, source, lang, n_chars and n_tokens of every whole text under every tokenizer version.

    ``tokenizers`` maps a version's name to its file, or to None for words
    between ASCII white space.
    """

    def run(batches):
        for batch in batches:
            for part in in_pieces(batch, 1024):
                rows = list(texts(part.column(4)))
                for name, path in tokenizers.items():
                    counts = [loaded(path).count(t) for t in rows] if path else [len(t.encode().split()) for t in rows]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:4], pa.array([name] * len(rows)), pa.array(counts, pa.int64())],
                        names=["doc_id", "source", "lang", "n_chars", "tokenizer", "n_tokens"],
                    )

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source", "lang", "n_chars")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", tokenizer string, n_tokens long"
    return docs.select("doc_id", "source", "lang", "n_chars", "text").mapInArrow(run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Group, d_docs and d_tokens of every change.

    ``changes`` has ``kind`` (insert, delete, revise) and the structs ``old``
    and ``new``, each with the group's columns and ``tokens``.
    """
    def rows(kind):
        return F.array(*[
            F.struct(*[F.col(f"{side}.{c}").alias(c) for c in GROUP], F.lit(sign).cast("long").alias("d_docs"),
                     (sign * F.coalesce(F.col(f"{side}.tokens"), F.lit(0))).cast("long").alias("d_tokens"))
            for sign, side in SIGNS[kind]
        ])

    what = F.when(F.col("kind") == "insert", rows("insert")).when(F.col("kind") == "delete", rows("delete"))
    return changes.select(F.inline(what.when(F.col("kind") == "revise", rows("revise"))))


class TokenRollup:
    """Totals below the folder ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def committed(self, batch_id: str) -> bool:
        return path_exists(self.spark, f"{self.root}/batch={batch_id}/_SUCCESS")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it had been added before."""
        if self.committed(batch_id):
            return False
        sums = signed(changes).groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens and the number of batches that touched the group."""
        deltas = self.spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*")
        out = deltas.groupBy(*GROUP).agg(
            F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"), F.countDistinct("batch").alias("n_batches")
        )
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self, path: str) -> None:
        """Write the totals as one table for readers."""
        self.totals().coalesce(1).write.mode("overwrite").parquet(path)


def side(tokens: str) -> Column:
    """One side of a change: the row's group and the count in column ``tokens``."""
    return F.struct(*[F.col(c).alias(c) for c in GROUP], F.col(tokens).cast("long").alias("tokens"))


def corpus_rollup(docs: DataFrame, tokenizers: Mapping[str, str | None], root: str, counted: DataFrame, min_tokens: int = 0) -> TokenRollup:
    """Rollup of a corpus: load with estimates, revise to real counts, delete what should not be there.

    The load knows only n_chars (a token per four characters); the second batch
    revises every count.  The third loads about an eighth of the documents once
    more, under a null language, and the fourth deletes those again, so the
    totals are the counts of all documents.  The second batch is sent twice, as
    after a lost answer, and changes nothing the second time.  Only a caller that
    sets ``min_tokens`` has documents under it deleted in a further batch.
    """
    rows = counted.withColumn("guess", F.coalesce(F.ceil(F.col("n_chars") / 4), F.lit(0)).cast("long"))
    guess, real = side("guess"), side("n_tokens")
    none = F.lit(None).cast(_struct(rows))
    rollup = TokenRollup(docs.sparkSession, root)
    kind = lambda name: F.lit(name).alias("kind")
    revised = rows.select(kind("revise"), guess.alias("old"), real.alias("new"))
    stray = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).withColumn("lang", F.lit(None).cast(rows.schema["lang"].dataType))
    rollup.commit("1-load", rows.select(kind("insert"), none.alias("old"), guess.alias("new")))
    rollup.commit("2-counts", revised)
    rollup.commit("3-stray", stray.select(kind("insert"), none.alias("old"), real.alias("new")))
    rollup.commit("4-stray-out", stray.select(kind("delete"), real.alias("old"), none.alias("new")))
    if min_tokens:
        rollup.commit("5-short", rows.filter(F.col("n_tokens") < min_tokens).select(kind("delete"), real.alias("old"), none.alias("new")))
    rollup.commit("2-counts", revised)
    return rollup


def _struct(rows: DataFrame) -> str:
    return "struct<" + ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in GROUP) + ",tokens:bigint>"
