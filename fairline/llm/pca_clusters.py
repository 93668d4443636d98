"""Exact centroid clustering, filtered in PCA-rotated coordinates.

Vectors are integers: floor(64 x) of every component.  Principal components of
all vectors give a rotation; a vector is stored with its leading rotated
coordinates and the norm of the rest.  For a vector and a centroid, the squared
distance of the leading coordinates plus the squared difference of the two
residual norms is never above their squared distance.  Centroids whose bound lies
above a verified distance are passed over; all others are verified in integers, so
results do not depend on the rotation or on rounding.

A round is one pass: tasks hand back sums per centroid, which Spark adds up; the
driver holds centroids only.

Vectors that are null, have another number of components, or null or non-finite
ones are not kept.  Components are compared as integers up to 2^27; a vector with
a larger one is returned without a cluster.  Fewer vectors than centroids give as
many centroids as vectors.  Equal hashes of repeated ids are ordered by the
vector; null ids come last.  Sums that no long holds are null.  Empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.session import cut_lineage

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64.0
#: rotated coordinates that are stored; the rest is its norm
LEADING = 12
#: largest component whose squared distances fit a long
LARGEST = 1 << 27
#: rows that are looked at together
ROWS = 4096
#: share of the squared norms by which rounding may move a bound
SLACK = 1e-9


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (array<bigint>) of every kept vector; v is null where a component is too large."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = (F.size(x) == DIMENSIONS) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(F.when(F.abs(c) <= LARGEST / SCALE, c * SCALE)))
    fits = F.forall(x, lambda c: F.abs(c) <= LARGEST / SCALE)
    return table.filter(whole).select(F.col(f"`{vec_id}`").alias("vec_id"), F.when(fits, scaled).alias("v"))


@dataclass(frozen=True)
class Rotation:
    """Orthonormal columns by falling variance, and the point that is rotated to the origin."""

    mean: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame) -> Rotation:
        """Principal components of all rows of ``vectors`` (v); plain axes if there are fewer than two."""
        if len(vectors.take(2)) < 2:
            return cls(np.zeros(DIMENSIONS), np.eye(DIMENSIONS))
        rows = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("x"))
        mean = rows.select(Summarizer.mean(F.col("x"))).first()[0]
        return cls(mean.toArray(), PCA(k=DIMENSIONS, inputCol="x", outputCol="y").fit(rows).pc.toArray())

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading coordinates, norm of the others, and squared norm of all, per row."""
        y = (v - self.mean) @ self.axes
        rest = y[:, LEADING:]
        return y[:, :LEADING], np.sqrt(np.einsum("ij,ij->i", rest, rest)), np.einsum("ij,ij->i", y, y)


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, norm: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every row (ties: smaller number), and how many distances were verified."""
    n, k = len(v), len(centroids)
    c_lead, c_rest, c_norm = rotation(centroids)
    gap = lead[:, None, :] - c_lead[None]
    bound = np.einsum("ikj,ikj->ik", gap, gap) + (rest[:, None] - c_rest) ** 2 - SLACK * (norm[:, None] + c_norm + 1)
    distance = np.full((n, k), np.iinfo(np.int64).max)

    def verify(rows, which):
        d = v[rows] - centroids[which]
        distance[rows, which] = np.einsum("ij,ij->i", d, d)

    rows, first = np.arange(n), bound.argmin(axis=1)
    verify(rows, first)
    open_ = bound <= distance[rows, first][:, None]
    open_[rows, first] = False
    more = np.nonzero(open_)
    verify(*more)
    best = distance.argmin(axis=1)
    return best, distance[rows, best], n + len(more[0])


def _rows(batch: pa.RecordBatch):
    """Vectors and their stored coordinates in small slices, with the slice they came from."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)
        lead = part.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEADING)
        yield part, v, lead, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "norm"))


def rotated(vectors: DataFrame, rotation: Rotation) -> DataFrame:
    """``vectors`` (vec_id, v) with leading coordinates, residual norm and squared norm."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = part.column(1).flatten()
                lead, rest, norm = rotation(flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS))
                ends = lambda width: pa.array(np.arange(part.num_rows + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends(DIMENSIONS), flat.cast(pa.int32())),
                     pa.ListArray.from_arrays(ends(LEADING), pa.array(lead.ravel())), pa.array(rest), pa.array(norm)],
                    names=["vec_id", "v", "lead", "rest", "norm"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<int>, lead array<double>, rest double, norm double")


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMENSIONS)


def moved(stored: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Centroids after one round: the floor of each component's mean; one without vectors stays."""

    def run(batches):
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, lead, rest, norm in _rows(batch):
                best, _, _ = nearest(v, lead, rest, norm, centroids, rotation)
                counts += np.bincount(best, minlength=len(centroids))
                for c in np.unique(best):
                    sums[c] += v[best == c].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = stored.select("v", "lead", "rest", "norm").mapInArrow(run, "cluster int, n long, sums array<bigint>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    added = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("sums")[j]) for j in range(DIMENSIONS)]).alias("sums"))
    out = centroids.copy()
    for r in added.collect():  # a row per centroid
        out[r["cluster"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every row of ``vectors`` (vec_id, v), and the final centroids."""
    fitting = vectors.filter("v is not null")
    rotation = Rotation.fit(fitting)
    stored = cut_lineage(rotated(fitting, rotation), "rotated")
    centroids = first_centroids(stored, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(stored, centroids, rotation)

    def run(batches):
        for batch in batches:
            for part, v, lead, rest, norm in _rows(batch):
                best, distance, _ = nearest(v, lead, rest, norm, centroids, rotation)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    beyond = vectors.filter("v is null").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return found.unionByName(beyond), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with sums of distances per cluster and over all, and each final centroid's digest."""
    rows = cut_lineage(assigned, "assigned")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per centroid
    held = lambda x: None if x is None or abs(x) >= 1 << 63 else int(x)
    total = held(sum(r["s"] for r in per if r["s"] is not None))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(r["cluster"], held(r["s"]), total, digest[r["cluster"]]) for r in per if r["cluster"] is not None]
    table = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid at most
    return rows.join(F.broadcast(table), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
