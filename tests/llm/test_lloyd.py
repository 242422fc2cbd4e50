import hashlib
import random
from collections import Counter

import duckdb
import numpy as np

from gradeloom.llm import lloyd
from gradeloom.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, cluster string, n long"


def plain(rows, k=40, rounds=5, size=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    at = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, of) if o == j] for j in range(len(at))]
        at = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, at)]
    last = [near(v) for _, v in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last))


def vectors(n, size=64, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.choice((-1, 1)) * r.random() * (i % 7 + 1) for _ in range(size)], "x", 1) for i in range(n)]
    rows += [(n, None, "x", 1), (n + 1, [], "x", 1), (n + 2, [0.1] * (size - 1), "x", 1), (n + 3, [None] + [0.1] * (size - 1), "x", 1), (n + 4, [float("nan")] + [0.1] * (size - 1), "x", 1)]
    rows += [(n + 5, [float("-inf")] + [0.1] * (size - 1), "x", 1), (None, [0.5] * size, "x", 1), (None, [0.25] * size, "x", 1), (0, [0.5] * size, "x", 1), rows[1], rows[1], ((1 << 60) + 1, [-3.0] * size, "x", 1)]
    return rows


def test_lloyd(spark):
    for n in (130, 3):  # fewer vectors than centroids, too
        rows = vectors(n)
        got = lloyd.lloyd(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert Counter(map(tuple, got.collect())) == plain(spark.createDataFrame(rows, SCHEMA).collect())


def test_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 2)] * 4, "x", 1) for i in range(30)]
    got = lloyd.lloyd(spark.createDataFrame(rows, SCHEMA), k=6, rounds=3, size=4)
    assert Counter(map(tuple, got.collect())) == plain(rows, 6, 3, 4)


def test_lloyd_empty(spark):
    assert lloyd.lloyd(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lloyd.lloyd(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).count() == 0


def test_lloyd_matches_sql(spark, tmp_path):
    spark.createDataFrame(vectors(200, seed=4), SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = Q.Q["op11_lloyd"](spark, str(tmp_path))
    want = db.sql(f"select {', '.join(found.columns)} from ({Q.SQL['op11_lloyd']})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)
