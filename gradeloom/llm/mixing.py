"""Mixing sources to target weights by a time-varying curriculum (built-in expressions only).

Every source has a weight and a schedule, a density ``1 + tilt * (2 t - 1)`` over the training time t in
[0, 1]. Its integral, ``tilt * t^2 + (1 - tilt) * t``, is the share of the source's tokens that is wanted by
time t; inverting it at a document's cumulative tokens gives the time at which the document is due.

Cases: a null text counts 0 words; a null source is a source of its own and comes last; documents without
words are taken 0 times; repeated rows are mixed as rows of their own; an empty table gives an empty result;
columns of other names in the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, prepare, stored

WEIGHTS = (1, 2, 3)
TILTS = (-0.5, 0.0, 0.5)
#: Hash ranges of a source are told by so many hexadecimal digits: no window ever holds a whole source.
PREFIX = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, cap: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with weight, tilt, target: shares by weight of all words, none above
    cap times its source. In the order of cap / weight the capped sources are a prefix, so running sums
    find the level at which the others share what is left; no iteration.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(by_name) - 1) % len(weights) + 1
    w = sizes.withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(x)) for x in weights]), i),
        "tilt": F.element_at(F.array(*[F.lit(float(x)) for x in tilts]), i),
    })
    ceiling = F.col("source_size") * F.lit(cap)
    order = Window.orderBy(ceiling / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumns({
        "total": F.sum("source_size").over(every),
        "fixed": F.coalesce(F.sum(ceiling).over(before), F.lit(0)),
        "open": F.sum("weight").over(after),
        "at": F.row_number().over(order),
    }).withColumn("level", (F.col("total") - F.col("fixed")) / F.col("open"))
    w = w.withColumn("capped", F.col("level") * F.col("weight") >= ceiling)
    level = F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(every)["level"]
    return w.withColumn("shared", level).select(
        "source", "source_size", "weight", "tilt",
        F.when(F.col("capped"), ceiling.cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, cap: int = 3, whole: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: size, source_size, target, taken, copies, position; sorted by position.

    A source is read in the order of the MD5 of its documents, again from the start when it is through, until its target is
    met. ``taken`` counts words, repeats included; the copy that meets the target is cut there, or with
    ``whole`` taken if the greater part of it fits. ``copies`` counts whole and cut copies. ``position`` is the
    time of the first copy in [0, 1]; documents that are not taken follow after 1. Columns of ``keep`` stay.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))), 1, 16).alias("mark"), *keep,
    ).withColumn("bucket", F.substring("mark", 1, PREFIX))
    rows = stored(rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix")

    parts = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("part"))
    sizes = parts.groupBy("key", "source").agg(F.sum("part").alias("source_size"))
    goal = targets(sizes, weights, tilts, cap).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    start = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "bucket", F.coalesce(F.sum("part").over(start), F.lit(0)).alias("part_start"))
    parts = stored(parts.join(goal.drop("source"), "key"), "mix-parts")

    inside = Window.partitionBy("key", "bucket").orderBy("mark", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(parts, ["key", "bucket"]).withColumn(
        "begin", F.col("part_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    quota = F.round("target").cast("long")
    out = out.withColumn("quota", quota).withColumn(
        "passes", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)
    ).withColumn("left", F.col("quota") - F.col("passes") * F.col("source_size"))
    if whole:
        last = F.when(F.col("begin") + F.col("size") / 2 <= F.col("left"), F.col("size")).otherwise(0)
        last = F.when(F.col("passes") >= cap, 0).otherwise(last)
    else:
        last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("begin")))
    out = out.withColumn("last", last.cast("long")).withColumns({
        "taken": F.col("passes") * F.col("size") + F.col("last"),
        "copies": F.when(F.col("size") > 0, F.col("passes") + (F.col("last") > 0).cast("long")).otherwise(0),
    }).withColumn("position", F.when(F.col("copies") > 0, due(F.col("begin"))).otherwise(
        1 + F.coalesce(F.try_divide("begin", "source_size"), F.lit(0.0))
    ))
    return in_order(out, "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position", "begin", "quota", "tilt", "mark", *keep
    )


def due(tokens: Column) -> Column:
    """The time by which the schedule asks for so many of the quota's tokens."""
    a, x = F.col("tilt"), F.least(F.lit(1.0), tokens / F.col("quota"))
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / (2 * a)
    return F.when((a == 0) | (x == 0), x).otherwise(root)


def schedule(mixed: DataFrame, keep: tuple[str, ...] = ("doc_id", "mark")) -> DataFrame:
    """A row for each copy of mix() that training sees: the columns of keep, copy (from 0), and position, when it is due."""
    each = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    return each.select(*keep, "copy", due(F.col("begin") + F.col("copy") * F.col("source_size")).alias("position"))


def in_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows sorted by position over all partitions."""
    return rows.repartitionByRange("position", *ties).sortWithinPartitions("position", *ties)
