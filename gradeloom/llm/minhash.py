"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles (A-Z lower-cased; fewer words: the whole sequence as
one; no words: empty, linked with nothing). Sets are sets of 64-bit hashes. The sketch has ``T`` coordinates,
filled in rounds: in round i < T every element falls into a hashed bin, in round T + j into bin j; a coordinate
keeps the least (round, hash). All coordinates are filled after 2 T rounds, mostly after very few, and the
number of equal coordinates of two sets is concentrated about their similarity as with T independent samples.

Equal sets are one class. Classes that agree in a band of ``ROWS`` coordinates share a bucket and are candidates:
1. every class is compared with the least one of its bucket;
2. in buckets that are not in one component yet, all classes of a block of ``BLOCK`` classes of the bucket;
3. in what is left, every class outside its bucket's largest component with all the others of the bucket.
After 3 every candidate pair is compared on the full sets or lies in one component anyway (only components are
asked for). 2 and 3 compare the classes of a block in one task, by the product of their incidence matrices, and
give one link for each two components that meet. No task ever holds a whole bucket.

Cases: null and empty texts are kept, alone; texts of any length are read whole; rows with one doc_id are one
node of the graph, whose texts link it (empty ones never do: their rows stay alone); ties go to the smaller doc_id; an empty table gives an empty result; other columns of
the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, maybe_in, prepare, scratch, stored

SHINGLE, ROWS, BANDS = 5, 6, 24
T = ROWS * BANDS
BLOCK = 256
#: Enough for rounds 0 to 2 T - 1; the last value of all stays free for empty coordinates.
ROUND_BITS = (2 * T).bit_length()
ODD = regex.compile(r"[\x1c-\x1f\x85\xa0  -     　]")
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
U = np.uint64
MEMO = 300_000


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct shingle hashes of texts; remembers the hashes of words it has met."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        text = text.translate(LOWER) if not text.isascii() else text.lower()
        words = WORD.findall(text) if ODD.search(text) else text.split()
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), U, len(words))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), U, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text or "")
        n = len(w)
        if not n:
            return w
        k = min(n, SHINGLE)
        h = np.zeros(n - k + 1, U)
        for j in range(k):
            h = mix64(h * U(0x9E3779B97F4A7C15) + w[j : n - k + 1 + j])
        if n < SHINGLE:
            h ^= U(n)
        return np.unique(h)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), T) uint64: the coordinates of non-empty sets."""
    out = np.full((len(sets), T), np.iinfo(U).max, U)
    todo = [i for i, s in enumerate(sets) if len(s)]
    flat = out.reshape(-1)
    for r in range(2 * T):
        if not todo:
            break
        x = np.concatenate([sets[i] for i in todo])
        row = np.repeat(np.asarray(todo), [len(sets[i]) for i in todo])
        h = mix64(x + U((r + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        bin_ = ((h >> U(32)) * U(T) >> U(32)).astype(np.int64) if r < T else np.full(len(x), r - T)
        value = (U(r) << U(64 - ROUND_BITS)) | (mix64(h) >> U(ROUND_BITS))
        np.minimum.at(flat, row * T + bin_, value)
        todo = [i for i in todo if (out[i] == np.iinfo(U).max).any()]
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        sets = [shingle(t) for t in batch.column(1).to_pylist()]
        s = sketches(sets)
        n = np.asarray([len(x) for x in sets], np.int64)
        with np.errstate(over="ignore"):
            k1 = np.asarray([mix64(x).sum(dtype=U) for x in sets], U)
            k2 = np.asarray([mix64(x ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for x in sets], U)
            band = np.zeros((len(sets), BANDS), U)
            for j in range(ROWS):
                band = mix64(band * U(0x9E3779B97F4A7C15) + s[:, j::ROWS][:, :BANDS] + U(j))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n), signed(k1), signed(k2),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), signed(band.reshape(-1))),
            ],
            ["doc_id", "n", "k1", "k2", "bands"],
        )


def _links(percent: int, outer_only: bool):
    """Rows (key, id, label, items, outer), together by key -> links (a, b) between different labels of a key."""

    def of(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(outer) if outer_only else np.arange(len(ids))
        cols = np.flatnonzero(~outer)
        if not len(rows) or not len(cols):
            return ids[:0], ids[:0]
        n = np.asarray([len(x) for x in sets])
        _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1
        own, at = np.repeat(np.arange(len(sets)), n)[count[inv] > 1], number[inv[count[inv] > 1]]
        common = np.zeros((len(rows), len(cols)), np.float32)
        order = np.argsort(at, kind="stable")
        own, at = own[order], at[order]
        for lo in range(0, int(number[-1]) + 1, 4096):
            x, y = np.searchsorted(at, (lo, lo + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[own[x:y], at[x:y] - lo] = 1
            common += m[rows] @ m[cols].T
        linked = (common * 100 >= (n[rows][:, None] + n[cols][None] - common) * percent) & (labels[rows][:, None] != labels[cols][None])
        i, j = np.nonzero(linked)
        two = np.sort(np.stack([labels[rows[i]], labels[cols[j]]], 1), 1)
        _, first = np.unique(two, axis=0, return_index=True)
        return ids[rows[i[first]]], ids[cols[j[first]]]

    def flush(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, ids, labels, outer = (t.column(c).to_numpy() for c in ("key", "id", "label", "outer"))
        items = t.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        values, at = items.values.to_numpy(), items.offsets.to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        got = [of(ids[x:y], labels[x:y], [values[at[k] : at[k + 1]] for k in range(x, y)], outer[x:y].astype(bool)) for x, y in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got]), pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if rest and (cut or rest[-1].column(0)[0].as_py() != key[0]):
                yield flush(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            elif cut:
                yield flush(pa.Table.from_batches([batch.slice(0, cut)]))
            rest.append(batch.slice(cut))
        if rest:
            yield flush(pa.Table.from_batches(rest))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        sets = [shingle(t) for t in batch.column(1).to_pylist()]
        offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, signed(np.concatenate(sets)))], ["id", "items"])


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept: a row for each input row."""
    with scratch() as keep:
        sign, of = _grouped(docs, percent)
        keep(sign, of)
    some = sign.where("n > 0 and doc_id is not null")
    out = some.join(of, ["n", "k1", "k2"]).select("doc_id", "n", "component_id")
    out = out.unionAll(sign.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _of_one_doc(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the representatives of the classes that a doc_id with several texts is in."""
    key = F.struct("n", "k1", "k2")
    several = stored(some.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x <> y").select("doc_id"), "several")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    reps = some.join(several, "doc_id", "left_semi").select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).select("doc_id", "rep")
    reps = stored(reps, "several-reps")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return reps.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signature of each row, and the component of each class (n, k1, k2) of equal sets."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    sign = stored(docs.mapInArrow(_signatures, "doc_id long, n long, k1 long, k2 long, bands array<long>"), "signatures")
    some = sign.where("n > 0 and doc_id is not null")
    classes = stored(some.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    member = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "value"))
    buckets = stored(member.groupBy("band", "value").agg(F.count("*").alias("m"), F.min("id").alias("low")).where("m > 1"), "buckets")
    member = stored(member.join(buckets, ["band", "value"]), "members")
    ids = stored(member.select("id").distinct(), "candidates")
    sets = maybe_in(docs, "id", ids).join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, items array<long>")
    sets = stored(sets, "sets")
    a_set, b_set = (sets.select(F.col("id").alias(c), F.col("items").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))

    pairs = stored(member.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    linked = pairs.join(a_set, "a").join(b_set, "b").where(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
    links = stored(linked.select("a", "b").unionAll(_of_one_doc(some, classes)), "links")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = stored(components(links), "labels")
    for outer_only in (False, True):
        now = member.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        by_label = now.groupBy("band", "value", "label").agg(F.count("*").alias("c"))
        split = by_label.groupBy("band", "value").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label"))["label"].alias("most")).where("labels > 1")
        split = stored(split, "split")
        if not split.take(1):
            break
        now = now.join(split, ["band", "value"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK))
        own = F.pmod(F.xxhash64(F.lit(9), "id"), F.col("blocks"))
        rows = now.select("band", "value", "id", "label", own.alias("block"), F.lit(False).alias("outer"))
        if outer_only:
            outer = now.where("label <> most").select("band", "value", "id", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("outer"))
            rows = rows.unionAll(outer)
        rows = rows.join(sets, "id").select(F.xxhash64("band", "value", "block").alias("key"), "id", "label", "items", "outer")
        more = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links(percent, outer_only), "a long, b long")
        links = stored(links.unionAll(stored(more, "more").distinct()), "links")
        label = stored(components(links), "labels")
    of = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    return sign, stored(of, "class-labels")
