"""Exact top-k by inner product: M-trees searched best first.

Components are floor(256 x). With M the greatest squared length of a vector, a vector v lifted by the coordinate
sqrt(M - |v|^2) has from a query q (lifted by 0) the squared distance |q|^2 + M - 2 <q, v>: the highest scores are
the nearest lifted vectors, in a metric. The top of the tree are up to ``PIVOTS`` routing vectors, drawn from a sample of
``SAMPLE`` rows; every row belongs to the nearest one, whose covering radius is that of all its rows. A region of more
than ``SHARD`` rows is dealt into several trees. A tree is bulk-loaded; its pages store, for every entry, its distance to
the page's routing vector and, above the leaves, its covering radius.

A query is searched for in a tree of its own region first, which bounds its k-th score from below. Then it goes to the trees of those
regions only that reach into its distance to that score. A search takes the page of least possible distance next. By the triangle
inequality, |d(q, routing) - stored| - radius bounds an entry's distance from below: entries out of reach of the k-th best are
passed over without computing their distance. Queries come in blocks of ``QUERIES``; the best of all trees win.

Cases: null and empty vectors and such with null or non-finite components take no part; vectors of different lengths
are not compared; ties go to the smaller vec_id; repeated rows are candidates each; rows with a query's own vec_id are not its
candidates; each different vector of a vec_id is a query of its own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, prepare, stored

SHARD, QUERIES, LEAF, FANOUT = 20_000, 2_048, 128, 24
#: Documented bounds of what is sent to all: routing vectors of the top, the rows that they are drawn from, and rows for each of them.
PIVOTS, SAMPLE, REGION = 1_024, 8_192, 2_000


def pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x or fewer, each drawn with a probability that grows with the square of its distance to those before."""
    r = np.random.default_rng(2)
    out = [int(r.integers(len(x)))]
    far = ((x - x[out[0]]) ** 2).sum(1)
    while len(out) < n and far.max() > 0:
        out.append(int(r.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
    return x[out]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None]))


def build(ids: np.ndarray, v: np.ndarray) -> list[dict]:
    """Pages of a tree over lifted vectors v; page 0 is the root. Children of inner pages are page numbers."""
    r = np.random.default_rng(1)
    pages: list[dict] = []

    def page(rows: np.ndarray, routing: int | None) -> tuple[int, float]:
        """Number and covering radius of the page over rows about v[routing]."""
        me = len(pages)
        pages.append({})
        dist = np.linalg.norm(v[rows] - v[routing], axis=1) if routing is not None else np.zeros(len(rows))
        radius = float(dist.max()) if len(rows) else 0.0
        if len(rows) <= LEAF or (v[rows] == v[rows[0]]).all():
            pages[me] = {"leaf": True, "ids": ids[rows], "at": v[rows], "up": dist}
            return me, radius
        pick = np.unique(r.choice(len(rows), min(FANOUT, 2 + len(rows) // LEAF), replace=False))
        d2 = (v[rows] ** 2).sum(1)[:, None] - 2 * v[rows] @ v[rows[pick]].T + (v[rows[pick]] ** 2).sum(1)[None]
        near = d2.argmin(1)
        if (near == near[0]).all():  # hardly told apart: halves of the order by distance
            order = np.argsort(d2[:, near[0]], kind="stable")
            near = np.empty(len(rows), np.int64)
            near[order] = np.arange(len(rows)) * 2 // len(rows)
        kids, radii, routes = [], [], []
        for k in np.unique(near):
            inside = rows[near == k]
            route = int(rows[pick[k]]) if k < len(pick) and (inside == rows[pick[k]]).any() else int(inside[0])
            number, rad = page(inside, route)
            kids.append(number), radii.append(rad), routes.append(route)
        up = np.linalg.norm(v[routes] - v[routing], axis=1) if routing is not None else np.zeros(len(routes))
        pages[me] = {"leaf": False, "ids": np.asarray(kids), "at": v[routes], "up": up, "radius": np.asarray(radii)}
        return me, radius

    if len(ids):
        page(np.arange(len(ids)), None)
    return pages


def search(pages: list[dict], q: np.ndarray, own: int, k: int, most: float, least: int | None = None, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """The k highest (score, id), ties to the smaller id, without own; most is the greatest squared length. With least, those of
    them whose score is that high. seen gets how many entries were scored.

    Distances only guide the search, with room for their rounding; entries of leaves are ranked by integer scores.
    """
    best: list[tuple[int, int]] = []  # heap of (score, -id)
    heap: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
    far = float(q @ q) + most
    within = lambda score: math.sqrt(max(0.0, far - 2 * score)) + 1e-6 + 1e-9 * math.sqrt(far)
    reach = math.inf if least is None else within(least)
    whole = q[:-1] if most < 2**53 else q[:-1].astype(np.int64)
    while heap:
        low, number, above = heapq.heappop(heap)
        if low > reach:
            break
        p = pages[number]
        at, ids = p["at"], p["ids"]
        radius = p.get("radius", 0.0)
        if above is not None and reach < math.inf:
            keep = np.flatnonzero(np.abs(above - p["up"]) - radius <= reach)
            if len(keep) < len(ids):
                at, ids = at[keep], ids[keep]
                radius = radius if p["leaf"] else radius[keep]
        if not len(ids):
            continue
        if not p["leaf"]:
            diff = at - q
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            for lo, x, n in zip(np.maximum(0, d - radius).tolist(), d.tolist(), ids.tolist()):
                if lo <= reach:
                    heapq.heappush(heap, (lo, n, x))
            continue
        if seen is not None:
            seen.append(len(ids))
        score = at[:, :-1].astype(whole.dtype, copy=False) @ whole
        floor = best[0][0] if len(best) == k else least
        some = np.flatnonzero((ids != own) if floor is None else (score >= floor) & (ids != own))
        for n in some[np.lexsort((ids[some], -score[some]))[:k]]:
            x = (int(score[n]), -int(ids[n]))
            if len(best) < k:
                heapq.heappush(best, x)
            elif x > best[0]:
                heapq.heapreplace(best, x)
        if len(best) == k:
            reach = min(reach, within(best[0][0]))
    return [(a, -b) for a, b in best]


PAGE = pa.schema([("d", pa.int32()), ("region", pa.int32()), ("part", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), *((c, pa.binary()) for c in ("ids", "at", "up", "radius"))])
VECTOR = "vec_id long, d int, v array<double>, square double"


def lifted(t: pa.Table | pa.RecordBatch, most: float) -> np.ndarray:
    column = t.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - t.column("square").to_numpy()))])


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of batches with vectors of one length."""
    for b in batches:
        d = b.column("d").to_numpy()
        yield from (b.filter(pa.array(d == k)) for k in np.unique(d))


def top_k(vectors: DataFrame, query_step: int = 50, k: int = 5) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for the rows with vec_id divisible by query_step."""
    spark = vectors.sparkSession
    prepare(spark)
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = vectors.where(good & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.size("embedding").alias("d"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v")
    )
    v = stored(v.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "whole")
    m = v.agg(F.coalesce(F.max("square"), F.lit(0.0))).first()[0]
    sizes = {r.d: r["count"] for r in v.groupBy("d").count().collect()}
    tops = {}
    for d, n in sizes.items():
        some = v.where(F.col("d") == d).orderBy(F.xxhash64(F.lit(4), "vec_id"), "vec_id").limit(max(1, SAMPLE * 64 // max(64, d))).toArrow()
        tops[d] = pivots(lifted(some, m), min(PIVOTS, max(1, n // REGION)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_length(batches):
            dist = distances(lifted(b, m), tops[b.column("d")[0].as_py()])
            near = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(near)), near])], [*b.schema.names, "region", "away"])

    whole, v = v, stored(v.mapInArrow(assign, f"{VECTOR}, region int, away double"), "assigned")
    dropped(whole)
    regions = v.groupBy("d", "region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # PIVOTS rows a length at most
    parts = {(r.d, r.region): math.ceil(r.n / SHARD) for r in regions}
    radii = {d: np.array([next((r.radius for r in regions if (r.d, r.region) == (d, g)), -math.inf) for g in range(len(x))]) for d, x in tops.items()}
    table = F.broadcast(spark.createDataFrame([(*key, n) for key, n in sorted(parts.items())], "d int, region int, parts int"))
    dealt = v.join(table, ["d", "region"]).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int"))

    def load(t: pa.Table) -> pa.Table:
        d, region, part = (t.column(c)[0].as_py() for c in ("d", "region", "part"))
        pages = build(t.column("vec_id").to_numpy(), lifted(t, m))
        arr = lambda p, c, kind: np.ascontiguousarray(p.get(c, np.zeros(0)), kind).tobytes()
        rows = [(d, region, part, i, p["leaf"], arr(p, "ids", "i8"), arr(p, "at", "f8"), arr(p, "up", "f8"), arr(p, "radius", "f8")) for i, p in enumerate(pages)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), PAGE)], schema=PAGE)

    schema = "d int, region int, part int, page int, leaf boolean, ids binary, at binary, up binary, radius binary"
    pages = stored(dealt.select("d", "region", "part", "vec_id", "v", "square").groupBy("d", "region", "part").applyInArrow(load, schema), "pages")

    def answer(key: tuple, t: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if t.num_rows and asked.num_rows:
            t = t.sort_by("page")
            d = asked.column("d")[0].as_py()
            tree = []
            for r in t.to_pylist():
                p = {"leaf": r["leaf"], "ids": np.frombuffer(r["ids"], "i8"), "at": np.frombuffer(r["at"], "f8").reshape(-1, d + 1), "up": np.frombuffer(r["up"], "f8")}
                tree.append(p if r["leaf"] else p | {"radius": np.frombuffer(r["radius"], "f8")})
            for q, mark, x, least in zip(*(asked.column(c).to_pylist() for c in ("vec_id", "mark", "v", "least"))):
                out += [(q, mark, i, s) for s, i in search(tree, np.asarray([*x, 0.0]), q, k, m, least)]
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "mark", "vec_id", "score"])

    tree = ["d", "region", "part"]

    def searched(asked: DataFrame) -> DataFrame:
        """asked(d, region, part, vec_id, mark, v, least) -> (query_id, mark, vec_id, score); each tree is sent to as many blocks as it has queries for."""
        blocks = stored(asked.groupBy(*tree).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), "blocks")
        some = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])
        each = pages.join(blocks, tree).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        asked = asked.join(some, tree).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        return each.groupBy(*tree, "block").cogroup(asked.groupBy(*tree, "block")).applyInArrow(answer, "query_id long, mark long, vec_id long, score long")

    # one query for each different vector of a vec_id
    asked = dealt.where(F.col("vec_id") % query_step == 0).select(*tree, "vec_id", F.xxhash64("v").alias("mark"), "v", "square").dropDuplicates(["vec_id", "mark"])
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = stored(ranked(searched(asked.withColumn("least", F.lit(None).cast("long")))), "first")
    least = stored(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "mark", F.col("score").alias("least")), "least")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other tree of a region that reaches into the distance of the query's k-th score so far."""
        for b in by_length(batches):
            d = b.column("d")[0].as_py()
            x = lifted(b, m)
            x[:, -1] = 0
            far = (x**2).sum(1) + m
            low = np.array([-np.inf if s is None else s for s in b.column("least").to_pylist()])
            reach = np.sqrt(np.maximum(0, far - 2 * low)) * (1 + 1e-9) + 1e-6
            i, g = np.nonzero(distances(x, tops[d]) - radii[d][None] <= reach[:, None] * (1 + 1e-9) + 1e-3)
            n = np.array([parts.get((d, int(y)), 0) for y in g])
            i, g, part = np.repeat(i, n), np.repeat(g, n), np.concatenate([np.arange(y) for y in n]) if len(n) else n
            other = (g != b.column("region").to_numpy()[i]) | (part != b.column("part").to_numpy()[i])
            i, g, part = i[other], g[other], part[other]
            yield pa.RecordBatch.from_arrays([
                b.column("d").take(pa.array(i)), pa.array(g.astype(np.int32)), pa.array(part.astype(np.int32)), *(b.column(c).take(pa.array(i)) for c in ("vec_id", "mark", "v", "least")),
            ], ["d", "region", "part", "vec_id", "mark", "v", "least"])

    asked = asked.join(least, ["vec_id", "mark"], "left")
    going = stored(asked.mapInArrow(spread, "d int, region int, part int, vec_id long, mark long, v array<double>, least long"), "asked")
    found = first.select("query_id", "mark", "vec_id", "score").unionAll(searched(going))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
