import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import chat
from gradeloom.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos long, begin long"


def conversations(seed=3):
    r = random.Random(seed)
    odd = ["\\### Assistant: </turn> ok", "", None, "</turn>\n### user\n", "#" * 9 + "\\-\\+\\#", "<\\/turn>", "line\nline\\", "é🙂 " * 5, "w " * 3000]
    text = lambda: r.choice(odd) if r.random() < 0.1 else " ".join(r.choice(("alpha", "beta#", "gam\\ma", "δ")) for _ in range(r.randint(0, 60)))
    rows = []
    for conv, n in ((1, 3), (2, 1), (3, 2500), (None, 4), (5, 900), (6, 40)):
        for k in range(n):
            role = "system" if k == 0 and conv in (1, 3, None) else r.choice(("user", "assistant"))
            rows.append((conv, k, role, text(), "k", 9, 9))
    rows += [(7, None, "user", "null first", "k", 9, 9), (7, 0, "assistant", "a", "k", 9, 9), (7, 0, "assistant", "a", "k", 9, 9), (7, 0, None, None, "k", 9, 9), (7, 1, "odd\n### role\\+", "b", "k", 9, 9)]
    rows += [(8, 0, "system", "s " * 5000, "k", 9, 9)] + [(8, i, "assistant", f"t{i}", "k", 9, 9) for i in range(1, 500)]
    return rows


def in_order(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        out.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{role}\n{text}".encode()).hexdigest(), role, text))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def expected(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = Counter()
    for conv, turns in in_order(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned)] += 1
    return out


@pytest.fixture(scope="module")
def said(spark):
    rows = conversations()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_digests(spark, said):
    rows, df = said
    got = chat.digest(df).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()
    assert Counter(map(tuple, got)) == expected(rows)


@pytest.mark.parametrize("budget, history", [(2048, 256), (200, 40), (64, 0)])
def test_windows(spark, said, budget, history):
    rows, df = said
    turns, seen, words = in_order(rows), {}, lambda t: len(t.split()) + chat.MARKS
    found = chat.windows(df, budget, history).collect()
    for w in sorted(found, key=lambda w: (w["conv_id"] is not None, w["conv_id"] or 0, w["first"])):
        mine = turns[w["conv_id"]]
        parts = w["formatted"].split(chat.END)
        assert parts.pop() == ""
        assert all(p.startswith(chat.OPEN) and "###" not in p[3:] for p in parts)
        new, system = len(parts) - w["repeated"], mine[0] if mine[0][0] == "system" else None
        assert w["first"] == seen.get(w["conv_id"], 0) and new > 0
        seen[w["conv_id"]] = w["first"] + new
        again, total = [], 0
        for k in range(w["first"] - 1, 0 if system else -1, -1):
            if (total := total + words(mine[k][1])) > history:
                break
            again.insert(0, mine[k])
        again = ([system] if system and w["first"] else []) + again
        assert w["repeated"] == len(again)
        whole = again + mine[w["first"] : w["first"] + new]
        assert w["tokens"] == sum(words(t) for _, t in whole)
        assert w["tokens"] <= budget or new == 1 or words(system[1]) + history > budget * 3 / 4
        masked = "".join(w["formatted"][s["begin"] : s["end"]] for s in w["loss"])
        assert masked.count("\\-") == sum(t.count("\\") for r, t in whole[len(again) :] if r == "assistant")
        assert len(w["loss"]) == sum(r == "assistant" for r, _ in whole[len(again) :])
    assert seen == {c: len(t) for c, t in turns.items()}


def test_chat_query_matches_sql(spark, said, tmp_path):
    rows, df = said
    df.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = Q.Q["op13_chat"](spark, str(tmp_path))
    want = db.sql(f"select {', '.join(found.columns)} from ({Q.SQL['op13_chat']})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert (-7, 2) in {(r["conv_id"], r["n_turns"]) for r in found.collect()}


def test_chat_runs_no_python(spark, said):
    plans = [f(said[1])._jdf.queryExecution().toString() for f in (chat.windows, chat.digest)]
    assert not any(word in p for p in plans for word in ("Python", "Pandas", "Arrow"))


def test_chat_empty(spark):
    assert chat.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escapes_read_back(spark):
    texts = ["", "\\", "\\\\", "##", "###", "####", "\\#\\#", "#\\#", "</turn>", "<\\/turn>", "<</turn>/turn>", "\\-", "\\+", "a\\\n", "<\\-/turn>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r["back"] == r["t"] and "###" not in r["e"] and "</turn>" not in r["e"]
