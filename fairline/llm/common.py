"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows that a Python worker hands back at once
OUT_ROWS = 256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row by id and text; rows equal in both share it, and no null comes out."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("?")), F.sha2(text_or_empty(text), 256))


def constant_array(values: Iterable[int]) -> Column:
    """A literal array of longs, folded once by the optimiser."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def in_pieces(batch: pa.RecordBatch, rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Small slices of a batch, so that what is made of them stays small too."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(column: pa.Array) -> Iterable[str]:
    """Strings of a column; null counts as the empty text."""
    return (x or "" for x in column.to_pylist())


def drop_keys(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` stands in the one column of ``keys``.

    Both sides are dealt by the key; Spark broadcasts ``keys`` only below its
    own size threshold.  All columns of ``docs`` stay as they are.
    """
    name = fresh(docs, "_row_key")
    gone = keys.select(F.col(keys.columns[0]).alias(name)).distinct()
    return docs.withColumn(name, key).join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
