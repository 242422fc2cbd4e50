"""Scores: exam coercion, the order-exact running score, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written


def exam_score(score: Column, corrections: Column) -> Column:
    """Clamped to 0..4; any correction bounds it by 3."""
    s = F.least(F.lit(4), F.greatest(F.lit(0), score))
    return F.when(F.size(F.coalesce(corrections, F.array())) > 0, F.least(s, F.lit(3))).otherwise(s)


def exam_passed(passed: Column, score: Column) -> Column:
    return F.coalesce(passed, score >= 3) & (score >= 3)


def bound_updates(updates: Column, score: Column) -> Column:
    clamp = lambda k, v: F.least(F.least(F.lit(4), F.greatest(F.lit(0), v)), score)
    return F.transform_values(F.map_filter(updates, lambda k, v: v.isNotNull()), clamp)


def observations(exams: DataFrame) -> DataFrame:
    """exams(identity_id, seq, score, capability_updates, capability_ids, known_ids) -> a row for each observation:
    explicit updates of known ids, then task ids without one (as often as listed) with the exam's score."""
    x = exams.select(
        "identity_id", "seq",
        F.concat(
            F.transform(F.filter(F.map_entries("capability_updates"), lambda e: F.array_contains("known_ids", e["key"]) & e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("cap_id"), F.least(F.lit(4), F.greatest(F.lit(0), e["value"])).alias("score"))),
            F.transform(F.filter("capability_ids", lambda c: F.array_contains("known_ids", c) & F.element_at("capability_updates", c).isNull()), lambda c: F.struct(c.alias("cap_id"), F.col("score").alias("score"))),
        ).alias("o"),
    )
    return x.select("identity_id", "seq", F.posexplode("o").alias("sub", "x")).select("identity_id", "seq", "sub", "x.cap_id", "x.score")


def _next(s: Column, n: Column, x: Column) -> Column:
    """The mean of n steps after one more, rounded half to even."""
    return F.when(n == 0, x.cast("double")).otherwise(F.bround((s * n + x) / (n + 1)))


def merge_scores(state: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """state(keys, score, observations, ...) after rows(keys, order, score), which all come after what the state has seen. Keys without
    new rows stay as they are; rows of other keys go. Only the new rows are read."""
    new = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("score").alias("x")))).alias("__x"))
    x = state.join(new, keys, "left")
    start = F.struct(F.col("score").cast("double").alias("s"), F.col("observations").cast("int").alias("n"))
    step = lambda acc, r: F.struct(_next(acc["s"], acc["n"], r["x"]).alias("s"), (acc["n"] + 1).alias("n"))
    x = x.withColumn("__r", F.when(F.col("__x").isNull(), start).otherwise(F.aggregate("__x", start, step)))
    return x.withColumns({"score": F.col("__r.s").cast("int"), "observations": F.col("__r.n")}).select(*state.columns)


#: Scores are whole numbers from 0 to this; rows of a key that are folded together.
MOST_SCORE, CHUNK = 4, 256


def score_scan(rows: DataFrame, keys: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows(keys, order, score: 0 to 4) with running and observations after every row, for keys of any number of rows.

    The n-th step of a key takes a running score to another one, and n is known from the row's place alone; so a step is a map of five numbers, and
    maps compose. Rows are sorted over all partitions and numbered by key; ``chunk`` rows of a key compose to one map, as many such maps to one, and so
    on; then every chunk gets the score that it begins with from the level above it and is folded by itself. No task sees a whole key.
    Rows of a key with the same order are taken by ascending score; scores beyond the range are moved into it, null ones are 0.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    bounded = F.least(F.lit(MOST_SCORE), F.greatest(F.lit(0), F.coalesce("score", F.lit(0)))).cast("int")
    by = ("__key", *order, "__x", "__salt")
    placed = rows.withColumns({"__key": key, "__x": bounded, "__salt": F.xxhash64(F.monotonically_increasing_id())}).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(placed.drop("__salt").withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "scan")
    sums = placed.groupBy("__key", "__part").agg(F.count("*").alias("__c"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__key", "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__at")) - 1
    x = placed.withColumn("__n", inside).join(sums, ["__key", "__part"]).withColumn("__n", F.col("__n") + F.col("__before"))
    item = F.struct(F.col("__n").alias("n"), F.col("__x").alias("x"), F.struct(*rows.columns).alias("row"))
    x = x.groupBy("__key", F.floor(F.col("__n") / chunk).cast("long").alias("__i")).agg(F.array_sort(F.collect_list(item), lambda a, b: (a["n"] - b["n"]).cast("int")).alias("__rows"))
    x = written(x, "scan-chunks")
    after = lambda s: F.aggregate("__rows", s.cast("double"), lambda acc, r: _next(acc, r["n"], r["x"]))
    maps = x.select("__key", "__i", F.transform(F.sequence(F.lit(0), F.lit(MOST_SCORE)), lambda s: after(s).cast("int")).alias("__map"))
    begins = _before(maps, chunk)
    step = lambda acc, r: F.struct(
        _next(acc["s"], r["n"], r["x"]).alias("s"), F.concat(acc["out"], F.array(F.struct(_next(acc["s"], r["n"], r["x"]).cast("int").alias("running"), (r["n"] + 1).alias("observations")))).alias("out"),
    )
    start = F.struct(F.col("__begin").cast("double").alias("s"), F.array().cast("array<struct<running:int,observations:bigint>>").alias("out"))
    out = x.join(begins, ["__key", "__i"]).select("__rows", F.aggregate("__rows", start, step, lambda acc: acc["out"]).alias("__out"))
    return out.select(F.inline(F.arrays_zip(F.col("__rows.row").alias("row"), F.col("__out").alias("out")))).select("row.*", "out.running", "out.observations")


def _before(maps: DataFrame, chunk: int) -> DataFrame:
    """maps(__key, __i, __map) -> __key, __i, __begin: the score before chunk i, by composing the maps before it (0 before the first)."""
    maps = written(maps, "scan-maps")
    x = maps.groupBy("__key", F.floor(F.col("__i") / chunk).cast("long").alias("__j")).agg(F.array_sort(F.collect_list(F.struct("__i", "__map"))).alias("__maps"))
    if maps.where(F.col("__i") >= chunk).isEmpty():
        x = x.withColumn("__start", F.lit(0))
    else:
        x = written(x, "scan-level")
        whole = F.transform(F.sequence(F.lit(0), F.lit(MOST_SCORE)), lambda s: F.aggregate("__maps", s, lambda acc, m: F.get(m["__map"], acc)))
        above = _before(x.select("__key", F.col("__j").alias("__i"), whole.alias("__map")), chunk)
        x = x.join(above.select("__key", F.col("__i").alias("__j"), F.col("__begin").alias("__start")), ["__key", "__j"])
    start = F.struct(F.col("__start").alias("s"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, m: F.struct(F.get(m["__map"], acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    begins = F.aggregate("__maps", start, step, lambda acc: acc["out"])
    return x.select("__key", F.inline(F.arrays_zip(F.col("__maps.__i").alias("__i"), begins.alias("__begin"))))


def running_score(rows: DataFrame, keys: list[str], order: list[str], score: str = "score") -> DataFrame:
    """keys, score, observations: the mean rounded half to even after every step, in order. Groups are small by
    nature (the exams of one capability), and sorted whatever the partitions were."""
    step = lambda acc, x: F.struct(
        F.when(acc["n"] == 0, x[score].cast("double")).otherwise(F.bround((acc["s"] * acc["n"] + x[score]) / (acc["n"] + 1))).alias("s"), (acc["n"] + 1).alias("n")
    )
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("int").alias("n"))
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, score))).alias("__x"))
    got = got.select(*keys, F.aggregate("__x", start, step).alias("__r"))
    return got.select(*keys, F.col("__r.s").cast("int").alias("score"), F.col("__r.n").alias("observations"))


def score_history(rows: DataFrame, keys: list[str], order: str, score: str = "score") -> DataFrame:
    """keys, order, score, observations after every row. Groups are small, as for running_score()."""
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: F.concat(acc, F.array(F.struct(
        x[order].alias("at"), F.bround((last(acc)["s"] * last(acc)["n"] + x[score]) / (last(acc)["n"] + 1)).alias("s"), (last(acc)["n"] + 1).alias("n")
    )))
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("__x"))
    first = F.array(F.struct(F.col("__x")[0][order].alias("at"), F.col("__x")[0][score].cast("double").alias("s"), F.lit(1).cast("int").alias("n")))
    got = got.select(*keys, F.explode(F.aggregate(F.slice("__x", 2, F.size("__x")), first, step)).alias("__r"))
    return got.select(*keys, F.col("__r.at").alias(order), F.col("__r.s").cast("int").alias("score"), F.col("__r.n").alias("observations"))


def status(score: Column, n: Column) -> Column:
    score, n = F.coalesce(score, F.lit(0)), F.coalesce(n, F.lit(0))
    return (
        F.when((score >= 3) & (n >= 2), "PROXY_EVIDENCED").when((score >= 3) & (n == 1), "PROVISIONAL_SINGLE_OBSERVATION")
        .when(n == 0, "UNTESTED").otherwise("WEAK_OR_FAILED")
    )
