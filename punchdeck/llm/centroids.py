"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers ``floor(scale * x)``. The vectors are written once in blocks, each with the sorted values
that occur in it per dimension and, per component, the number of its value in that list. A round tabulates, for each
dimension, occurring value and centroid, the squared difference; the distances of a block are then gathers from these
tables and sums over the dimensions. Blocks and tables are bounded whatever the values, so nothing is collected but
``k`` centroids and, for each round, ``k`` sums.

Everything is in integers and exact: centroids are floors of quotients of sums, ties go to the smaller number, so the
result doesn't depend on how rows lie in partitions, and a task that is repeated gives the same rows.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out, and so are those
with an integer of 2^27 or more in magnitude, whose distances need not fit a long; repeated rows and ids each take
part; rows of one id are ordered by their components where seeds are chosen, rows without an id come last there;
with fewer vectors than ``k`` each is a seed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punchdeck.llm.common import lean, small_batches, written

#: Vectors of a block; its tables hold at most so many values a dimension.
BLOCK = 4096
#: Components lie below it in magnitude, so that a distance fits a long.
REACH = 1 << 27


def integers(vectors: DataFrame, dim: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``(id, v)``: the vectors that take part, with their components as integers."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.transform(F.col(vector_column), lambda x: x.cast("double") * scale).alias("v"))
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(x) < REACH) & (F.floor(x) > -REACH))
    return rows.filter(F.coalesce(fine, F.lit(False))).select("id", F.transform(v, lambda x: F.floor(x).cast("int")).alias("v"))


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """``(ids, known, n_values, values, codes)``: up to ``BLOCK`` vectors as numbers of the values of their dimension."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.asarray(part.column("v").flatten(), np.int32).reshape(-1, dim)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(dim)]
                ids = part.column("id")
                row = {
                    "ids": np.asarray(ids.fill_null(0), np.int64).tobytes(), "known": np.asarray(ids.is_valid()).tobytes(),
                    "n_values": np.array([len(u) for u, _ in found], np.int32).tobytes(), "values": np.concatenate([u for u, _ in found]).astype(np.int32).tobytes(),
                    "codes": np.stack([c for _, c in found]).astype(np.uint16).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.binary()) for n in row]))

    return rows.mapInArrow(lean(encode), "ids binary, known binary, n_values binary, values binary, codes binary")


def decoded(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """For each block its ids, which of them are known, the values of each dimension and the codes (dim x vectors)."""
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.cumsum(np.frombuffer(row["n_values"], np.int32))
            values = np.split(np.frombuffer(row["values"], np.int32).astype(np.int64), ends[:-1])
            yield np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), values, np.frombuffer(row["codes"], np.uint16).reshape(dim, -1)


def nearest(values: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector and its squared distance."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for d, (occurring, code) in enumerate(zip(values, codes, strict=True)):
        square = (occurring[:, None] - centroids[None, :, d]) ** 2
        total += square[code]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each vector that takes part.

    Seeds are the ``k`` vectors whose ``<seed>:<id>`` have the smallest SHA-256, in that order. Each of ``rounds``
    rounds assigns all vectors and moves the centroids that have some; then they are assigned once more.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, dim, scale, id_column, vector_column)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    schema = f"`{id_column}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.v for r in seeds], np.int64)
    small_batches(spark, BLOCK)
    held = written(blocks(rows, dim), "vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for _, _, values, codes in decoded(batches, dim):
            best, _ = nearest(values, codes, centroids)
            count += np.bincount(best, minlength=len(count))
            for d in range(dim):
                # sums of a block are below 2^39, so exact in double precision
                total[:, d] += np.bincount(best, values[d][codes[d]], len(count)).astype(np.int64)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"]
        )

    for _ in range(rounds):
        parts = held.mapInArrow(lean(sums), "cluster int, n long, total array<long>")
        # a row for each cluster: at most k come to the driver
        moved = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(dim))).collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r.cluster] = [r[f"s{d}"] // r.n for d in range(dim)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, known, values, codes in decoded(batches, dim):
            best, distance = nearest(values, codes, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(best.astype(np.int32)), pa.array(distance)], names=[id_column, "cluster", "distance"])

    assigned = written(held.mapInArrow(lean(assign), f"`{id_column}` long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("inertia")).collect()}
    whole = sum(inertia.values(), Decimal(0))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # as literals in the row: k entries need no join
    of = F.create_map(*(F.lit(x) for c, s in sorted(inertia.items()) for x in (c, int(s))))
    sha = F.create_map(*(F.lit(x) for c in sorted(inertia) for x in (c, digest[c])))
    return assigned.select(
        id_column, "cluster", "distance", of[F.col("cluster")].cast("long").alias("cluster_inertia"), F.lit(int(whole)).cast("long").alias("inertia"), sha[F.col("cluster")].alias("centroid_sha256")
    )
