"""What the operators share: tables in the shared folder, worker imports, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from zipfile import ZIP_DEFLATED, ZipFile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import delete as _delete
from ..functions.tables import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])
SPACE = r"\x20\x09-\x0D"
BATCH_BYTES = 32 << 20


#: The archive of this package, by the application that it was sent to.
_sent: dict[str, Path] = {}


def prepare(spark: SparkSession, rows_per_batch: int = 1000) -> None:
    """Bound the rows and the bytes of an Arrow batch (texts can be long) and send this package to the executors, which need no copy of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if _sent.get(sc.applicationId) is None:
        _sent[sc.applicationId] = archive = Path(tempfile.mkdtemp(prefix="gradeloom-"), "gradeloom.zip")
        with ZipFile(archive, "w", ZIP_DEFLATED) as z:
            for file in sorted(Path(ROOT, "gradeloom").rglob("*.py")):
                z.write(file, file.relative_to(ROOT))
        sc.addPyFile(str(archive))


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, executors may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for scope in _scopes.get():
        scope[path] = spark
    return out


#: Tables written in each open scratch() of this call: threads that run queries at once have scopes of their own.
_scopes: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables of stored() that are written inside are deleted at the end, but for those that the given function is called with."""
    scope: dict[str, SparkSession] = {}
    before = _scopes.set((*_scopes.get(), scope))
    try:
        yield lambda *tables: [scope.pop(df.stored_at, None) for df in tables]
    finally:
        _scopes.reset(before)
        for path, spark in scope.items():
            _delete(spark, path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


#: Bits of maybe_in(); its bitmaps are BITS / 8 bytes whatever the data, so they can be broadcast.
BITS = 1 << 25


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column may be among ids (one column): drops what a bitmap of hashes rules out, before a
    shuffle. Rows that stay by chance are for the join that follows; if the bitmap fills up, all stay.
    """
    return with_maybe(df, column, ids).where("__maybe").select(*df.columns)


def with_maybe(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with a boolean column __maybe: false where the column is surely not among ids."""
    place = lambda c: F.pmod(F.xxhash64(F.lit(23), c), F.lit(BITS))
    spots = ids.select(place(F.col(ids.columns[0])).alias("p"))
    maps = spots.groupBy(F.expr("p div 32768").alias("__chunk")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("__map"))
    p = place(F.col(column))
    byte = F.conv(F.hex(F.expr("substring(__map, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    out = df.withColumns({"__chunk": F.floor(p / 32768).cast("long"), "__bit": (p % 32768).cast("int")}).join(F.broadcast(maps), "__chunk", "left")
    bit = F.floor(byte / F.pow(F.lit(2), F.expr("__bit % 8"))).cast("int") % 2 == 1
    return out.withColumn("__maybe", F.coalesce(bit, F.lit(False))).drop("__chunk", "__map", "__bit")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges(a, b): label is the smallest node it reaches.

    Alternating large-star and small-star steps; each round is a written table, nothing is collected
    but one row count and one checksum. A node of high degree is never gathered: the minimum of its
    neighbours is an aggregate with a map-side part.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stored(e, "edges"), None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: both sides of the join are then plain shuffles, whose hot keys AQE can split
        low = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    low = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return low.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
