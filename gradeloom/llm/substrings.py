"""Removal of repeated byte strings with suffix arrays (see gsaca for their construction).

Every byte covered by a string of ``WINDOW`` bytes that starts anywhere else too is removed. The corpus can't be
one suffix array; it is cut as follows, which loses no repeat:
1. In each window the ``GRAM``-byte string of least hash is its anchor (all of them in a tie). Equal windows have equal
   anchors at equal offsets. An anchor's context is what windows with this anchor can cover.
2. Windows that start up to ``HALF`` - 1 bytes before their anchor share the ``WINDOW - HALF + 1`` bytes from the anchor on; the
   others share ``HALF`` bytes before it and the anchor. Contexts that share neither string with any other are out.
   Contexts that are equal as a whole are removed as a whole, one of them stays as a partner.
3. What is left is cut into cells: for each ``TOGETHER`` starts, the core that all their windows cover (as a hash) and
   the bytes on both sides that some cover. Cells that are equal as a whole are removed as a whole, cells with a core
   of their own are out.
4. The different cells of a core are one group. Groups of more than ``BOUND`` cells are split: each cell into a
   cell for every few of its starts, with longer cores, until they fit; a single start's cells are equal or apart. So a
   group's size is bounded however often a passage occurs, and a row is cut at most three times.
5. The cells of a group are aligned at the core. On each side of it, the bytes of a cell between two columns at which it
   parts from others are one symbol, the cells are concatenated with unique separators, and the suffix array with its common prefixes tells
   for each start how far any other cell goes along: from a window on, it repeats.

Cases: null text counts as empty; texts under 400 bytes can't repeat; any length is read whole; equal rows repeat each
other; runs of one byte have an anchor at every byte; rows are told apart by doc_id and text, so a doc_id may be null or
have several texts; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gsaca import common_prefixes, suffix_array
from .minhash import mix64
from .shared import dropped, maybe_in, prepare, scratch, stored, with_maybe

WINDOW, GRAM = 400, 32
REACH = WINDOW - GRAM  # bytes before an anchor that its windows can cover
#: Starts of a cell, and of the cells that it is split into where its group is too large.
TOGETHER, NARROWER = 92, (23, 6, 1)
HALF = 2 * TOGETHER
#: Cells that are sorted together at most.
BOUND = 4_000
CHUNK = 1 << 19
U = np.uint64
TABLE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def running(x: np.ndarray, f: np.ufunc, width: int) -> np.ndarray:
    """f over each run of so many elements."""
    w = 1
    while 2 * w <= width:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors of a text of at least WINDOW bytes, and their hashes."""
    h = TABLE[data]
    for k, c in zip((1, 2, 4, 8, 16), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        h = h[:-k] * U(c) + h[k:]
    h = mix64(h)
    key = (h >> U(32)).astype(np.uint32)
    least = running(key, np.minimum, REACH + 1)
    pad = np.zeros(REACH, np.uint32)
    at = np.flatnonzero(running(np.concatenate([pad, least, pad]), np.maximum, REACH + 1) == key)
    return at, h[at]


ANCHOR = "doc long, mark long, pos int, l int, r int, h long, c long, after long, before long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text) -> a row for each anchor: bytes of its context on both sides, hashes of the gram, of the whole
    context, and of what the windows of step 2 share (null where there is no such window)."""
    names, digest = [x.split()[0] for x in ANCHOR.split(", ")], xxhash.xxh3_64_intdigest

    def flush(docs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = b"".join(t for *_, t in docs)
        size = np.asarray([len(t) for *_, t in docs])
        ends = np.cumsum(size)
        at, h = anchors(np.frombuffer(data, np.uint8))
        own = np.searchsorted(ends, at, side="right")
        inside = at + GRAM <= ends[own]  # else the string lies in two texts
        at, h, own = at[inside], h[inside], own[inside]
        start, end = ends[own] - size[own], ends[own]
        left, right = np.minimum(at - start, REACH), np.minimum(end - at, WINDOW)
        view = memoryview(data)
        places = list(zip(at.tolist(), left.tolist(), right.tolist()))
        c = [digest(view[a - l : a + r], l) for a, l, r in places]
        after = [digest(view[a : a + WINDOW - HALF + 1], 1) if r > WINDOW - HALF else 0 for a, _, r in places]
        before = [digest(view[a - HALF : a + GRAM], 2) if l >= HALF else 0 for a, l, _ in places]
        signed = lambda x: np.asarray(x, U).view(np.int64)
        ids = [np.asarray(x, np.int64)[own] for x in zip(*(d[:2] for d in docs))]
        cols = [pa.array(x) for x in ids] + [pa.array(x.astype(np.int32)) for x in (at - start, left, right)] + [pa.array(signed(h)), pa.array(signed(c))]
        cols += [pa.array(signed(x), mask=m) for x, m in ((after, right <= WINDOW - HALF), (before, left < HALF))]
        return pa.RecordBatch.from_arrays(cols, names)

    docs, size = [], 0
    for batch in batches:
        for d, m, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
            t = (t or "").encode()
            if len(t) >= WINDOW:
                docs.append((d, m, t))
                size += len(t)
            if size > CHUNK:
                yield flush(docs)
                docs, size = [], 0
    if docs:
        yield flush(docs)


CELL = "j int, w int, h long, core long, left binary, right binary, doc long, mark long, pos int"
CELL_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text, at: list of structs h, pos, l, r, late) -> cells: the windows that start j to j + w bytes before the
    anchor. late tells the half of the starts."""
    names, digest = [x.split()[0] for x in CELL.split(", ")], xxhash.xxh3_64_intdigest
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), CELL_KINDS)], names)
    for batch in batches:
        rows: list[tuple] = []
        for doc, mark, text, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
            text = text.encode()
            for x in at:
                h, pos, l, r = x["h"], x["pos"], x["l"], x["r"]
                for j in range(HALF, REACH + 1, TOGETHER) if x["late"] else range(0, HALF, TOGETHER):
                    last = min(REACH, j + TOGETHER - 1)
                    if l >= j and r >= WINDOW - last:
                        core = digest(text[pos - j : pos + WINDOW - last], j) - (1 << 63)
                        rows.append((j, last - j, h, core, text[pos - min(last, l) : pos - j], text[pos + WINDOW - last : pos + min(r, WINDOW - j)], doc, mark, pos))
            if len(rows) > 5000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def narrower(cells: DataFrame, starts: int) -> DataFrame:
    """Cells for at most so many starts each, in place of cells for more."""
    x = cells.withColumn("a", F.explode(F.expr(f"sequence(0, w, {starts})"))).withColumn("v", F.least(F.lit(starts - 1), F.expr("w - a")))
    x = x.where("length(left) >= a and length(right) >= w - a - v").withColumn("skip", F.expr("w - a - v"))
    part = lambda c, first, n: F.expr(f"substring({c}, {first}, {n})")
    return x.select(
        (F.col("j") + F.col("a")).alias("j"), F.col("v").alias("w"), "h",
        F.xxhash64("core", part("left", "length(left) - a + 1", "a"), F.lit(1), part("right", "1", "skip")).alias("core"),
        part("left", "greatest(1, length(left) - a - v + 1)", "least(v, length(left) - a)").alias("left"), part("right", "skip + 1", "v").alias("right"),
        "doc", "mark", "pos",
    )


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Sides:
    """Sides of cells, sorted: far, how many bytes each shares with any other one at most; tree() has them by what they share."""

    def __init__(self, sides: list[bytes]):
        self.order = sorted(range(len(sides)), key=sides.__getitem__)
        ordered = [sides[k] for k in self.order]
        self.shared = [shared_prefix(a, b) for a, b in zip(ordered, ordered[1:])]  # by neighbours
        self.far = [0] * len(sides)
        for k, x, y in zip(self.order, [0, *self.shared], [*self.shared, 0]):
            self.far[k] = x if x > y else y

    def tree(self) -> tuple[list[int], list[int], list[int]]:
        """A node for each string at whose end sides part or end (0 is the empty one): its length, the next shorter one
        above it, and each side's longest."""
        length, above, node, stack, before = [0], [0], [0] * len(self.order), [0], 0
        for k, n in zip(self.order, [*self.shared, 0]):
            if n > before:
                length.append(n)
                above.append(stack[-1])
                stack.append(len(length) - 1)
            node[k] = stack[-1]
            while length[stack[-1]] > n:
                last = stack.pop()
                if length[stack[-1]] < n:
                    length.append(n)
                    above.append(stack[-1])
                    stack.append(len(length) - 1)
                    above[last] = stack[-1]
            before = n
        return length, above, node


def ways(length: list[int], above: list[int], first: int, step: int) -> list[tuple[list[int], list[int]]]:
    """For each node of a tree the names (first, then by steps, by length) and the lengths, from it up to the shortest
    that isn't empty."""
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(length)
    for name, k in enumerate(sorted(range(1, len(length)), key=length.__getitem__)):
        names, lengths = out[above[k]]
        out[k] = [first + step * name, *names], [length[k], *lengths]
    return out


Owner = tuple[int, int, int]  # doc, mark, and the position in the text of a start at the core


class Batch:
    """Aligned cells of many groups in one text of symbols. A cell's core is one column, so a window has w + 1 columns."""

    def __init__(self):
        self.text: list[int] = []
        self.at: list[int] = []  # where a symbol starts, relative to the core
        self.who: list[tuple[Owner, int] | None] = []  # owner of a symbol and w; None: behind the core, a separator, or settled
        self.symbols = self.lines = 0
        self.known: list[tuple[int, int, int, int]] = []  # ranges that need no sorting

    def add(self, w: int, group: list[tuple[Owner | None, bytes, bytes]]) -> None:
        """Cells (owner, or None where it is settled and only a partner; bytes on the left, on the right) of one core.

        First what no other cell goes along with falls off, and rests that are equal repeat as they are. A symbol is a
        node of a side's tree: cells that have it in common agree from there up to the core.
        """
        lines: list[tuple[list[Owner | None], bytes, bytes]] = [([owner], left, right) for owner, left, right in group]
        for k in range(5):
            before, after = Sides([a[::-1] for _, a, _ in lines]), Sides([b for _, _, b in lines])
            if k == 4:
                break
            same: dict[tuple[bytes, bytes], list[Owner | None]] = defaultdict(list)
            for (owners, a, b), l, r in zip(lines, before.far, after.far):
                if len(owners) > 1:
                    same[a, b] += owners
                elif l + r >= w:
                    same[a[len(a) - l :], b[:r]] += owners
            old, lines = lines, [(owners, a, b) for (a, b), owners in same.items()]
            if [x[1:] for x in lines] == [x[1:] for x in old]:
                break
        for owners, a, b in lines:
            if len(owners) > 1:
                self.known += [(doc, mark, pos - len(a), pos + len(b) - w + WINDOW) for doc, mark, pos in filter(None, owners)]
        if not any(len(owners) == 1 and owners[0] for owners, _, _ in lines):
            return
        # names fall along a line and separators along the text: hardly anything moves in the grouping then
        lengths, above, goals = after.tree()
        core = self.symbols + len(lengths)
        rights = [(names[::-1], [n + 1 for n in some[::-1]]) for names, some in ways(lengths, above, core - 1, -1)]
        lengths, above, ends = before.tree()
        lefts = [(names, [-n for n in some]) for names, some in ways(lengths, above, core + 1, 1)]
        self.symbols = core + len(lengths)
        for (owners, _, _), x, y in zip(lines, ends, goals):
            (left, starts), (right, stops) = lefts[x], rights[y]
            self.lines += 1
            self.text += [*left, core, *right, -self.lines]
            self.at += [*starts, 0, 1, *stops]
            mine = (owners[0], w) if len(owners) == 1 and owners[0] else None
            self.who += [mine] * (len(left) + 1) + [None] * (len(right) + 1)

    def repeats(self) -> Iterator[tuple[int, int, int, int]]:
        """(doc, mark, start, end) of bytes that repeated windows cover."""
        yield from self.known
        text, at = self.text, self.at
        sa = suffix_array(text)
        lcp = [*common_prefixes(text, sa), 0]
        for r, i in enumerate(sa):
            if self.who[i] and (n := max(lcp[r], lcp[r + 1])):
                (doc, mark, pos), w = self.who[i]
                if (goes := at[i + n] - at[i]) > w:
                    last = min(at[i + 1] - 1, at[i] + goes - w - 1)
                    yield doc, mark, pos + at[i], pos + last + WINDOW


SPAN = "doc long, mark long, a int, b int"
SPAN_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def merged(spans: list[tuple]) -> list[tuple]:
    """Ranges (..., start, end), sorted, those that touch as one."""
    out: list[tuple] = []
    for x in sorted(spans):
        if out and out[-1][:-2] == x[:-2] and x[-2] <= out[-1][-1]:
            out[-1] = (*out[-1][:-1], max(x[-1], out[-1][-1]))
        else:
            out.append(x)
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different cells (and how often each occurs), together by group -> spans."""
    todo, last, group = Batch(), None, []

    def out() -> pa.RecordBatch:
        cols = list(zip(*merged(list(todo.repeats())))) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, SPAN_KINDS)], [x.split()[0] for x in SPAN.split(", ")])

    for b in batches:
        for j, w, h, core, left, right, n, doc, mark, pos in zip(*(b.column(c).to_pylist() for c in ("j", "w", "h", "core", "left", "right", "n", "doc", "mark", "pos"))):
            if (j, w, h, core) != last and group:
                todo.add(last[1], group)
                group = []
                if len(todo.text) > 40_000 or len(todo.known) > 40_000:
                    yield out()
                    todo = Batch()
            last = (j, w, h, core)
            group.append((None if n > 1 else (doc, mark, pos - j), left, right))
    if group:
        todo.add(last[1], group)
    yield out()


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, sorted by document and start -> a row for each document, with its merged spans."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    rows: list[tuple[int, int, list]] = []

    def out(some: list) -> pa.RecordBatch:
        cols = list(zip(*some)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), kind))], ["doc", "mark", "spans"])

    for batch in batches:
        for doc, mark, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not rows or rows[-1][:2] != (doc, mark):
                if len(rows) > 5000:
                    yield out(rows)
                    rows = []
                rows.append((doc, mark, [{"a": a, "b": b}]))
            elif a <= (top := rows[-1][2][-1])["b"]:
                top["b"] = max(b, top["b"])
            else:
                rows[-1][2].append({"a": a, "b": b})
    yield out(rows)


def one(*columns: str) -> list[Column]:
    """The columns of any one row of a group. (A least struct would be the same to us, but is aggregated by sorting.)"""
    return [F.first(c).alias(c) for c in columns]


def settle(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of cells that are equal as a whole; and a row for each different cell of a core that has several, with n,
    how often it occurs, and m, how many its core has."""
    key = ["j", "w", "h", "core"]
    kinds = stored(cells.groupBy(*key, "left", "right").agg(F.count("*").alias("n"), *one("doc", "mark", "pos")), "cell-kinds")
    equal = kinds.where("n > 1").select(*key, "left", "right")
    hit = cells.join(equal.hint("merge"), [*key, "left", "right"]).select(
        "doc", "mark", F.expr("pos - j - length(left)").alias("a"), F.expr(f"pos - j + length(right) - w + {WINDOW}").alias("b")
    )
    open_ = kinds.groupBy(*key).agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").drop("least")
    return hit, kinds.join(stored(open_, "cores").hint("merge"), key).select(*key, "left", "right", "n", "m", "doc", "mark", "pos")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(doc, mark, text) -> doc, mark, spans: array of (a, b), the byte ranges to remove, sorted and apart."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(docs.mapInArrow(_anchor_rows, ANCHOR), "anchors")
    halves = F.explode(F.array_compact(F.array("after", "before"))).alias("key")
    often = stored(rows.select(halves).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
    # stays in the order of the documents: a key that many rows have is then in all parts of the table, and can be split
    every, rows = rows, stored(_either(rows, often), "repeated")
    dropped(every, often)
    kinds = stored(rows.groupBy("h", "c").agg(F.count("*").alias("n"), *one("doc", "mark", "pos", "l", "r", "after", "before")), "kinds")
    many = kinds.where("n > 1").select("h", "c")
    whole = rows.join(many.hint("merge"), ["h", "c"]).select("doc", "mark", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))
    sides = kinds.select("h", "doc", "mark", "pos", "l", "r", F.posexplode(F.array("after", "before")).alias("side", "key")).where("key is not null")
    several = stored(sides.groupBy("side", "key").agg(F.count("*").alias("m")).where("m > 1").select("side", "key"), "several")
    reps = sides.join(several.hint("merge"), ["side", "key"]).select("doc", "mark", F.struct("h", "pos", "l", "r", (F.col("side") == 1).alias("late")).alias("x"))
    reps = stored(reps.groupBy("doc", "mark").agg(F.collect_list("x").alias("at")), "places")
    cells = maybe_in(docs, "mark", reps.select("mark")).join(reps.hint("merge"), ["doc", "mark"]).select("doc", "mark", "text", "at")
    cells = stored(cells.mapInArrow(_cells, CELL), "cells")
    found = whole
    for starts in (*NARROWER, 0):
        hit, kinds = settle(cells)
        found = found.unionAll(hit)
        kinds = stored(kinds, "groups")
        small = kinds.where(F.col("m") <= BOUND).drop("m").repartition(parts, "j", "w", "h", "core").sortWithinPartitions("j", "w", "h", "core", "left", "right")
        found = found.unionAll(small.mapInArrow(_repeats, SPAN))
        large = kinds.where(F.col("m") > BOUND)
        if not starts or not large.take(1):
            break
        cells = stored(narrower(large, starts), "cells")
    found = found.repartition(parts, "doc", "mark").sortWithinPartitions("doc", "mark", "a")
    return stored(found.mapInArrow(_merged_rows, "doc long, mark long, spans array<struct<a: int, b: int>>"), "spans")


def _either(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of which one of both halves may be among keys."""
    first = with_maybe(rows, "after", keys).withColumnRenamed("__maybe", "__one")
    return with_maybe(first, "before", keys).where("__one or __maybe").select(*rows.columns)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, t, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            t = (t or "").encode()
            rest, at, n = hashlib.sha256(), 0, 0
            for s in spans or ():
                rest.update(t[at : s["a"]])
                at, n = s["b"], n + s["b"] - s["a"]
            rest.update(t[at:])
            rows.append((i, len(t), n, len(spans or ()), rest.hexdigest()))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    mark = F.xxhash64(F.col("doc_id").isNull(), "text")
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("doc"), mark.alias("mark"))
    with scratch() as keep:
        spans = repeated_spans(docs.select("doc", "mark", "text"))
        keep(spans)
    marked = with_maybe(docs, "mark", spans.select("mark"))
    clean = marked.where("not __maybe").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
    rest = marked.where("__maybe").join(spans.hint("merge"), ["doc", "mark"], "left").select("doc_id", "text", "spans")
    return clean.unionAll(rest.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
