"""Near-duplicate vectors by randomised-rotation binary codes.

A vector's code is the signs of its coordinates under ``ROTATIONS`` fixed random rotations; the stored correction
factor of a rotation is the inner product of the unit vector and its sign vector. For a unit query q the
quotient <q, signs> / factor estimates the cosine without bias, with an error of the order of
sqrt(1 / factor^2 - 1) / sqrt(d - 1). Pairs whose estimate plus ``SURE`` such errors stays below the threshold
are dropped; all others are computed again exactly, in double precision.

Candidates share the bits of a band: the sides of hyperplanes that are drawn afresh, by normal coordinates, for every
bit of every band, so that bits and bands are independent whatever the length of the vectors. The number of bits follows
the size of the table, that of bands from the bits, such that a pair at the threshold is missed in all bands with a
probability of at most ``MISS``, for tables and vectors of any size. Buckets see the codes first: members without another one whose
code differs in so few bits as a pair at the threshold may (``SCREEN`` standard deviations) are out, before vectors are sent. A bucket is
compared in pairs of blocks of ``BLOCK`` vectors; a pair is counted in the first band that it shares. Blocks
give each vector's number of links, and as many links as join its components: no list of all pairs exists.

Cases: null, empty, zero vectors and such with null or non-finite components link with nothing; equal vectors
are one class, that counts as many times as it has rows; each vector of a vec_id that has several counts; vectors of different lengths are not compared;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, prepare, scratch, stored

ROTATIONS, BLOCK, MISS, SURE, SCREEN = 4, 512, 0.003, 4.0, 5.0


@lru_cache(8)
def rotations(d: int) -> np.ndarray:
    r = np.random.default_rng(64)
    return np.stack([np.linalg.qr(r.standard_normal((d, d)))[0] for _ in range(ROTATIONS)])


@lru_cache(8)
def directions(d: int, bits: int, bands: int) -> np.ndarray:
    # few coordinates have few places, and a draw that misses one misses a good part of all pairs: twice the bands
    return np.random.default_rng(65).standard_normal((d, bands * (2 if d < 8 else 1) * bits))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits and bands for n vectors."""
    bits = min(40, max(10, math.ceil(math.log2(max(2, n))) - 6))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, ROTATIONS * d) bits and (n, ROTATIONS) correction factors of unit vectors."""
    y = np.einsum("rij,nj->nri", rotations(x.shape[1]), x)
    return (y > 0).reshape(len(x), -1), np.abs(y).sum(2) / math.sqrt(x.shape[1])


def band_values(x: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """(n, bands) integers of the bits of each band."""
    side = (x @ directions(x.shape[1], bits, bands) > 0).reshape(len(x), -1, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def by_key(f: Callable[[pa.Table], list[np.ndarray]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over the rows of each key (the first column, sorted) that has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rest)
            k = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
            got = [f(t.slice(p, q - p)) for p, q in zip(cuts, cuts[1:]) if q - p > 1]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[c] for g in got])) for c in range(len(names))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            cut = int(other[-1]) + 1 if len(other := np.flatnonzero(k != k[-1])) else 0
            if cut or rest and rest[-1].column(0)[0].as_py() != k[0]:
                rest.append(batch.slice(0, cut))
                yield from flush()
                rest.clear()
            rest.append(batch.slice(cut))
        if rest:
            yield from flush()

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    good = F.size("embedding") > 0
    good &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good &= F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    v = vectors.select("vec_id", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    keys = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(3), "embedding").alias("h2"), F.size("embedding").alias("d")]
    some = v.where("good").select("vec_id", "embedding", *keys)
    with scratch() as keep:
        of_class = _linked(some, threshold)
        keep(of_class)
    out = some.drop("embedding").join(of_class, ["h1", "h2", "d"]).select("vec_id", "n_links", "component_id")
    out = out.unionAll(v.where("not good").select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("component_id")))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(some: DataFrame, threshold: float) -> DataFrame:
    """n_links and component_id of each class (h1, h2, d) of equal vectors."""
    spark = some.sparkSession
    classes = some.groupBy("h1", "h2", "d").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # a vec_id may have several vectors
    reps, classes = classes.select("id", "d", "copies", "embedding"), classes.drop("embedding")
    bits, bands = plan(classes.count(), threshold)
    small = np.dtype("<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x = unit(matrix(part.column("embedding"), int(d)))
                code, factor = encode(x)
                values = band_values(x, bits, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("d"), part.column("copies"), part.column("embedding").cast(pa.list_(pa.float64())),
                        pa.array([x.tobytes() for x in np.packbits(code, 1)], pa.binary()), pa.array(list(factor), pa.list_(pa.float64())),
                        pa.array(list(values), pa.list_(pa.int64())), pa.array([x.tobytes() for x in values.astype(small)], pa.binary()),
                    ],
                    ["id", "d", "copies", "vector", "code", "factor", "values", "bands"],
                )

    coded = stored(reps.mapInArrow(codes, "id long, d int, copies long, vector array<double>, code binary, factor array<double>, values array<long>, bands binary"), "codes")
    member = coded.select("id", "d", "code", F.posexplode("values").alias("band", "value"))
    buckets = stored(member.groupBy("d", "band", "value").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    member = member.join(buckets, ["d", "band", "value"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks")).cast("int"))
    member = member.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = F.xxhash64("d", "band", "value", F.least("own", "other"), F.greatest("own", "other"))
    member = member.select(key.alias("key"), "id", "d", "band", (F.col("own") > F.col("other")).alias("right"), (F.col("own") == F.col("other")).alias("alone"), "code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = lambda rows: rows.repartition(parts, "key").sortWithinPartitions("key")

    def screen(t: pa.Table) -> list[np.ndarray]:
        """Members with another one whose code may be that of a vector within the threshold; vectors are fetched for them only."""
        d, alone, right = t.column("d")[0].as_py(), t.column("alone")[0].as_py(), t.column("right").to_numpy()
        n = ROTATIONS * d
        code = np.unpackbits(np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1), axis=1, count=n).astype(np.float32) * 2 - 1
        same = 1 - math.acos(threshold) / math.pi
        near = 2 * (same - SCREEN * math.sqrt(same * (1 - same) / n)) - 1
        left, other = (np.arange(t.num_rows),) * 2 if alone else (np.flatnonzero(~right), np.flatnonzero(right))
        close = code[left] @ code[other].T >= near * n
        if alone:
            np.fill_diagonal(close, False)
            stay = close.any(1)
        else:
            stay = np.zeros(t.num_rows, bool)
            stay[left], stay[other] = close.any(1), close.any(0)
        return [t.column(c).to_numpy()[stay] for c in ("key", "id", "band", "right", "alone")]

    likely = together(member).mapInArrow(by_key(screen, ["key", "id", "band", "right", "alone"]), "key long, id long, band int, right boolean, alone boolean")
    rows = stored(likely, "likely").join(coded.drop("values"), "id").select("key", "id", "band", "right", "alone", "d", "copies", "vector", "code", "factor", "bands")

    def of(t: pa.Table) -> list[np.ndarray]:
        d, band = t.column("d")[0].as_py(), t.column("band")[0].as_py()
        ids, copies, right = (t.column(c).to_numpy() for c in ("id", "copies", "right"))
        alone = t.column("alone")[0].as_py()
        x = unit(matrix(t.column("vector"), d))
        code = np.unpackbits(np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1, count=ROTATIONS * d)
        factor = matrix(t.column("factor"), ROTATIONS)
        left = np.arange(len(ids)) if alone else np.flatnonzero(~right)
        other = left if alone else np.flatnonzero(right)
        if not len(left) or not len(other):
            return [ids[:0]] * 3
        y = np.einsum("rij,nj->nri", rotations(d), x[left])
        signs = (code[other].astype(np.float64) * 2 - 1).reshape(len(other), ROTATIONS, d) / math.sqrt(d)
        signs /= factor[other][:, :, None]
        estimate = y.reshape(len(left), -1) @ signs.reshape(len(other), -1).T / ROTATIONS
        f = factor[other].mean(1)
        error = np.sqrt(np.maximum(0, 1 / f**2 - 1)) / math.sqrt(max(1, d - 1) * ROTATIONS)
        i, j = np.nonzero(estimate + SURE * error[None] >= threshold)
        if alone:
            i, j = i[i < j], j[i < j]
        a, b = left[i], other[j]
        exact = np.concatenate([(x[a[k : k + 65536]] * x[b[k : k + 65536]]).sum(1) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
        a, b = a[exact >= threshold], b[exact >= threshold]
        if band and len(a):  # counted in an earlier band?
            values = np.frombuffer(b"".join(t.column("bands").to_pylist()), small).reshape(len(ids), -1)[:, :band]
            fresh = np.concatenate([~(values[a[k : k + 65536]] == values[b[k : k + 65536]]).any(1) for k in range(0, len(a), 65536)])
            a, b = a[fresh], b[fresh]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = np.arange(len(ids))
        while len(a):  # least label of neighbours, again and again: short paths
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = np.flatnonzero(links)
        return [ids[out], links[out], ids[root[out]]]

    found = together(rows).mapInArrow(by_key(of, ["id", "links", "other"]), "id long, links long, other long")
    found = stored(found, "links")
    label = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    of_class = stored(of_class.select("h1", "h2", "d", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("label")), "classes")
    least = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    return stored(of_class.drop("least").join(least, "label").drop("label"), "components")
