"""Scopes of tables, repeated ids, and workers without a copy of this package."""

import os
import subprocess
import sys
import threading
from collections import Counter

from gradeloom.llm import minhash, shared

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}").getOrCreate()
from gradeloom.llm import lloyd, minhash
def here(batches):
    import importlib.util
    import pandas as pd
    for b in batches:
        yield pd.DataFrame({{"found": [str((importlib.util.find_spec("gradeloom") or type("", (), {{"origin": ""}})).origin)]}})
found = lloyd.lloyd(spark.createDataFrame([(k, [float(k % 3)] * 64) for k in range(50)], "vec_id long, embedding array<float>"))
print("ROWS", found.count(), minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).where("component_id = 1").count())
print("FROM", {{r[0].startswith({root!r}) for r in spark.range(1).mapInPandas(here, "found string").collect()}})
"""


def test_workers_need_no_copy(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(root=shared.ROOT, folder=tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50 2" in said.stdout and "FROM {False}" in said.stdout, said.stderr[-3000:]


def test_scopes_of_threads_are_apart(spark):
    kept, inside, done = {}, threading.Barrier(2, timeout=60), threading.Event()

    def one(name, first):
        with shared.scratch() as keep:
            inside.wait()
            kept[name] = shared.stored(spark.range(7), name)
            inside.wait()
            if first:
                keep(kept[name])
            else:
                done.wait(60)
        if first:
            done.set()

    threads = [threading.Thread(target=one, args=(n, n == "a")) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert kept["a"].count() == 7
    assert not os.path.exists(kept["b"].stored_at.removeprefix("file://"))


def test_a_doc_id_with_several_texts_is_one_node(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(2, c), (3, a), (5, a), (5, c), (8, b), (9, b + " more"), (10, d), (10, b), (11, d), (12, "x y"), (12, None), (1, None), (None, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = {2: 2, 3: 2, 5: 2, 8: 8, 9: 8, 10: 8, 11: 8, 12: 12, 1: 1, None: None}
    assert Counter((r["doc_id"], r["component_id"]) for r in got.collect()) == Counter((i, want[i]) for i, _ in rows)
    twice = minhash.near_duplicates(spark.createDataFrame([(1, a), (1, b), (2, b), (3, a)], "doc_id long, text string"))
    assert {r["component_id"] for r in twice.collect()} == {1} and twice.count() == 4
