"""Exact duplicates with heavy hitters split off.

Texts are equal when they are after each run of ASCII white space is one space.
A digest stands for a text.  Misra-Gries counters, kept per partition and then
added up, name every digest that more than one k-th of the rows may have.  Their
counts and winners are then verified, and at most k of them are broadcast, so
that their rows are settled where they are read.  All other digests go through an
ordinary shuffle, where no group is large any more.

Null texts count as empty.  The row with the smallest doc_id stays; null ids come
after all others, and of rows equal in id and text one stays.  Empty tables give
empty results.  Other columns are not read, and stay as they are in
``drop_exact_copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.common import drop_keys, fresh, text_or_empty
from fairline.session import cut_lineage

#: counters of Misra-Gries: at most so many digests are broadcast
COUNTERS = 1024


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text") -> Column:
    return F.sha2(normalised(text), 256)


def misra_gries(rows: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """``column`` and a lower bound of its count: all values in more than one (k+1)-th of the rows are among them.

    Each partition keeps k counters: counts of a batch are added, then the
    (k+1)-th largest counter is taken off all, and those at zero go.
    """

    def run(batches):
        kept: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            if len(kept) > k:
                off = int(-np.partition(-np.fromiter(kept.values(), np.int64, len(kept)), k)[k])
                kept = {v: n - off for v, n in kept.items() if n > off}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=[column, "least"])

    merged = rows.select(column).mapInArrow(run, f"{column} string, least long").groupBy(column).agg(F.sum("least").alias("least"))
    return merged.orderBy(F.desc("least"), column).limit(k)


def exact_groups(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = cut_lineage(docs.select("doc_id", digest().alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()), "digests")
    n = rows.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    suspects = F.broadcast(misra_gries(rows, "text_sha256", k).select("text_sha256"))
    heavy = rows.join(suspects, "text_sha256", "left_semi").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    heavy = cut_lineage(heavy.filter(F.col("group_size") > n // k), "heavy")
    winners = F.broadcast(heavy)  # at most k rows
    w = Window.partitionBy("text_sha256")
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti").select(
        "doc_id", "row", "text_sha256", F.count(F.lit(1)).over(w).alias("group_size"), first.over(w).alias("first")
    )
    hot = rows.join(winners, "text_sha256").select(*rest.columns)
    return hot.unionByName(rest).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    groups = cut_lineage(exact_groups(docs, k), "groups")
    key = F.concat_ws("|", "text_sha256", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    own = F.concat_ws("|", digest(), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    away = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    left = drop_keys(docs, groups.filter(~away).select(key), own)
    again = groups.filter(away & ~F.col("kept")).select(key.alias("key")).distinct()
    if again.isEmpty():
        return left
    # rows equal in id and text: one of each such pair stays
    name = fresh(left, "_row_key")
    tied = left.withColumn(name, own).join(again.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name])
    return drop_keys(left, again, own).unionByName(tied.drop(name))
