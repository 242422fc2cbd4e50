"""Chat formatting in budgeted windows (built-in expressions only).

A conversation becomes one text, or several where it is over the budget. Prefix sums of turn tokens choose spans of whole turns; every
span but a conversation's first repeats its system turn and as much of what came before as ``history`` tokens hold. Repeated turns,
and all turns but the assistant's, are outside the loss mask, so each assistant text is learned once.

A turn is written as ``### role``, a line break, the text, a line break, ``</turn>`` and a line break. In texts and roles a backslash becomes
``\\-``, ``##`` becomes ``#\\#`` and ``</turn>`` becomes ``<\\/turn>``, and in roles a line break ``\\+``: no text can hold a mark, and all of it can be read back.

Conversations may hold a third of all rows: rows are sorted over all partitions (rows with one key too), sums of partitions give every turn its
place and its prefix sum, and stretches of ``CELL`` tokens are formatted on their own (a window never goes over the end of one; the
history does). A cell holds CELL tokens at most, and what its last turn has beyond them.

Cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns are in the order of their numbers, null first, rows with one
number in the order of the MD5 of role and text; repeated rows are turns of their own. The system turn is a conversation's first turn, if its
role is ``system``; later ones are turns like others. A window has more tokens than the budget only if a turn, or the system turn, is too long for it:
turns are never cut. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import prepare, scratch, stored

#: Tokens of a window, of the history that it repeats, of the marks of a turn, and of a stretch that is formatted on its own.
BUDGET, HISTORY, MARKS, CELL = 2048, 256, 4, 16_384
OPEN, END = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    for a, b in (("\\", "\\-"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescaped(text: Column) -> Column:
    """What was escaped, roles too: every backslash is the begin of one of four pairs."""
    for a, b in (("\n", "\\+"), ("#", "\\#"), ("/", "\\/"), ("\\", "\\-")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def placed(turns: DataFrame, tokens: Column | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> key, conv_id, role, text, tokens, pos (from 0) and begin, the tokens before it; written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("-")).alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.md5(F.concat(role, F.lit("\n"), text)).alias("mark"), ((word_count(F.col("text")) if tokens is None else tokens) + MARKS).alias("tokens"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = ("key", F.col("turn").asc_nulls_first(), "mark", "salt")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    rows = stored(rows.drop("turn", "mark", "salt"), "chat")
    sums = rows.groupBy("key", "part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy("key", "part").orderBy("at")
    rows = rows.withColumns({"begin": F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "pos": F.row_number().over(inside) - 1})
    rows = rows.join(sums, ["key", "part"]).select(
        "key", "conv_id", "role", "text", "tokens", (F.col("pos") + F.col("n_before")).alias("pos"), (F.col("begin") + F.col("tokens_before")).alias("begin"),
    )
    return stored(rows, "chat-placed")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, first (the place of the window's first new turn), formatted, loss (begin and end of each
    part that is learned, in code points), repeated (turns at the front that are not new), tokens. ``tokens`` counts a text's tokens: words, if not given.
    """
    prepare(turns.sparkSession)
    cell_size = max(CELL, 4 * budget)
    rows = placed(turns, tokens).withColumn("cell", F.floor(F.col("begin") / cell_size).cast("long"))
    system = (F.col("pos") == 0) & (F.col("role") == "system")
    own = rows.withColumns({"kind": F.lit(1), "is_system": system})
    late = own.where((F.col("begin") >= (F.col("cell") + 1) * cell_size - history) & ~F.col("is_system"))
    late = late.withColumns({"cell": F.col("cell") + 1, "kind": F.lit(0)})
    later = rows.where("cell > 0").select("key", "cell").distinct()
    told = own.where("is_system").drop("cell").join(later, "key").withColumn("kind", F.lit(0))
    all_rows = own.unionByName(late).unionByName(told.select(own.columns))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\+")), F.lit("\n"))
    body = escaped(F.col("text"))
    turn = F.struct(
        "pos", "begin", "tokens", "kind", "is_system", (F.col("role") == "assistant").alias("learned"), F.length(head).alias("head"), F.length(body).alias("body"),
        F.concat(head, body, F.lit("\n" + END)).alias("said"),
    )
    cells = all_rows.groupBy("key", "conv_id", "cell").agg(F.array_sort(F.collect_list(turn)).alias("turns")).where(F.exists("turns", lambda t: t["kind"] == 1))
    of_system = F.coalesce(F.get(F.filter("turns", lambda t: t["is_system"]), F.lit(0))["tokens"], F.lit(0))
    cells = cells.withColumn("room", F.greatest(F.lit(budget // 4), budget - history - of_system))

    def step(at: Column, t: Column) -> Column:
        """A turn that ends beyond the room since the window's first turn begins a window."""
        new = t["begin"] + t["tokens"] > at["limit"]
        return F.when(~new, at).otherwise(F.struct((t["begin"] + F.col("room")).alias("limit"), F.concat(at["starts"], F.array(t["pos"])).alias("starts")))

    none = F.struct(F.lit(-1).cast("long").alias("limit"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(F.filter("turns", lambda t: t["kind"] == 1), none, step, lambda at: at["starts"])
    each = cells.withColumn("starts", starts).select("conv_id", "turns", F.posexplode("starts").alias("k", "first"), F.get("starts", F.col("k") + 1).alias("next"))
    base = F.get(F.filter("turns", lambda t: (t["pos"] == F.col("first")) & (t["kind"] == 1)), F.lit(0))["begin"]
    each = each.withColumn("base", base)

    def taken(t: Column) -> Column:
        new = (t["kind"] == 1) & (t["pos"] >= F.col("first")) & F.coalesce(t["pos"] < F.col("next"), F.lit(True))
        return new | ((t["pos"] < F.col("first")) & (t["is_system"] | (t["begin"] >= F.col("base") - history)))

    each = each.select("conv_id", "first", F.filter("turns", taken).alias("turns"))
    is_new = lambda t: t["pos"] >= F.col("first")

    def mask(at: Column, t: Column) -> Column:
        begin = at["at"] + t["head"]
        span = F.struct(begin.alias("begin"), (begin + t["body"]).alias("end"))
        return F.struct((at["at"] + F.length(t["said"])).alias("at"), F.when(is_new(t) & t["learned"], F.concat(at["loss"], F.array(span))).otherwise(at["loss"]).alias("loss"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("loss"))
    return each.select(
        "conv_id", "first", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"), F.aggregate("turns", empty, mask, lambda at: at["loss"]).alias("loss"),
        F.size(F.filter("turns", lambda t: ~is_new(t))).alias("repeated"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() -> conv_id, first, turns (role and text of those that are new) and learned, the text under the mask."""

    def turn(said: Column) -> Column:
        head = F.instr(said, F.lit("\n"))
        role = F.substring(said, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(said, head + 1, F.length(said) - head - 1)).alias("text"))

    said = F.split("formatted", END)
    new = F.slice(said, F.col("repeated") + 1, F.size(said) - F.col("repeated") - 1)
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"]))), "")
    return formatted.select("conv_id", "first", F.transform(new, turn).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("chars"))


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows of each conversation, read back from its windows. A
    digest is of a conversation's whole text, which is one value here; the windows themselves need no such step."""
    with scratch() as keep:
        said = stored(windows(turns), "chat-windows")
        keep(said)
    back = read_back(said)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("first", told.alias("told"), "learned").alias("part"))
    each = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    whole = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return each.select(
        "conv_id", "n_turns", F.sha2(whole("told"), 256).alias("turns_sha256"), F.length(whole("learned")).cast("long").alias("loss_chars"), F.sha2(whole("learned"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
