"""Centroid clustering: plain Lloyd over integer vectors.

Centroids are broadcast (k x d integers); every partition computes the squared differences to each of them in NumPy, takes the
lowest index of the least one, and gives one row of integer sums for each centroid that it used, which meet in a groupBy.
Nothing else leaves the partitions: the driver sees k rows a round.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part and have no row. Rows with
one vec_id are vectors of their own; of start candidates with one vec_id the least vector comes first. A null vec_id is kept as
null and starts a centroid last of all. Fewer vectors than k give as many centroids; an empty table gives no rows. A component
beyond 2^27 after scaling is an error: distances would not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, scratch, stored

#: Centroids, rounds, components, and what the hashes of the start centroids begin with.
K, ROUNDS, SIZE, SEED = 40, 5, 64, 2
#: Largest component: 64 squared differences of twice as much still fit a long.
MOST = 1 << 27


def quantized(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, v: floor(256 x) of those that take part."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double")) <= MOST / 256)
    rows = vectors.select("vec_id", "embedding").where((F.size("embedding") == size) & finite)
    return rows.select("vec_id", F.when(small, v).otherwise(F.raise_error(F.lit("a component is too large for integer distances"))).cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors whose vec_id has the smallest hashes: k rows at most come to the driver."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row; of several the lowest number."""
    out = np.empty((len(centroids), len(x)), np.int64)
    for i, c in enumerate(centroids):
        d = x - c
        out[i] = np.einsum("ij,ij->i", d, d)
    best = out.argmin(0)
    return best, out[best, np.arange(len(x))]


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.int64)


def summed(centroids) -> Callable:
    """Of a partition: count and componentwise sums of each centroid's vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = centroids.value.shape
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                best, _ = nearest(x, centroids.value)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=k)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], **{f"s{i}": total[used, i] for i in range(d)}})

    return run


def assigned(centroids) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best, distance = nearest(_matrix(b["v"]), centroids.value)
                yield pd.DataFrame({"named": b["named"], "vec_id": b["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return run


def centroids_of(rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> np.ndarray:
    """rows(vec_id, v) -> the centroids after all rounds; an empty one stays where it was."""
    sc = rows.sparkSession.sparkContext
    at = first_centroids(rows, k, seed)
    schema = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(size))
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *(f"s{i}" for i in range(size)))]
    for _ in range(rounds if len(at) else 0):
        sent = sc.broadcast(at)
        parts = rows.select("v").mapInPandas(summed(sent), schema)
        at = at.copy()
        for r in parts.groupBy("cluster").agg(*exact).collect():
            at[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(size)]
        sent.destroy()
    return at


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """A row for each vector that takes part: vec_id, cluster, distance (squared), and of its cluster cluster_inertia and
    centroid_sha256; inertia is of all."""
    spark = vectors.sparkSession
    prepare(spark, 10_000)
    with scratch() as keep:
        rows = stored(quantized(vectors, size), "lloyd")
        at = centroids_of(rows, k, rounds, size, seed)
        sent = spark.sparkContext.broadcast(at)
        id_type = dict(rows.dtypes)["vec_id"]
        # nulls would turn a column of integers into floats on its way through pandas
        plain = rows.select(F.col("vec_id").isNotNull().alias("named"), F.coalesce(F.col("vec_id"), F.lit(0).cast(id_type)).alias("vec_id"), "v")
        found = plain.mapInPandas(assigned(sent), f"named boolean, vec_id {id_type}, cluster int, distance long")
        found = stored(found.select(F.when(F.col("named"), F.col("vec_id")).alias("vec_id"), "cluster", "distance"), "lloyd-found")
        keep(found)
        sent.destroy()
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(i, d, sum(inertia.values()), digest(at[i])) for i, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
