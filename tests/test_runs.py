"""Ledgers, calls in flight, fetching, sets of artifacts, scans of scores and of specifications."""

import json
import random
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import urls
from gradeloom.operators import grounding, scoring
from gradeloom.plans import live, prompts, render, responder, sink
from gradeloom.sources import fetch, html, specs
from gradeloom.functions.workers import sent_by_value
from test_engine import TEXT, knowing

for module in (__name__, "test_engine"):
    sent_by_value(module)

REQUEST = "identity_id string, role string, system string, user string, temperature double, max_tokens int"


def requests(spark, n):
    return responder.requests(spark.createDataFrame([(f"i{k}", "student", "s", f"u{k % (n - 2)}", 0.1, 9) for k in range(n)], REQUEST))


def logged(folder):
    return [x.name.split("-")[0] for x in folder.iterdir()]


def counting(folder, model, fails=lambda r: False):
    """model, with a file for each call."""

    def answer(r):
        if fails(r):
            raise RuntimeError("killed")
        (folder / f"{r['request_hash']}-{time.time_ns()}-{threading.get_ident()}").touch()
        return model(r)

    return answer


def test_ledger_asks_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = requests(spark, 12)
    down = counting(calls, lambda r: ("a " + r["user"], None) if r["user"] != "u3" or len(logged(calls)) > 10 else (None, "down"))
    for again in range(3):
        got = responder.Ledger(spark, str(tmp_path / "ledger")).through(responder.answering(down))(asked).collect()
        assert len(got) == 12 and all(r["content"] == ("a " + r["user"]) for r in got if r["user"] != "u3")
        assert {(r["content"], r["error"]) for r in got if r["user"] == "u3"} == {("a u3", None) if again else (None, "down")}
    n = Counter(logged(calls))
    assert len(n) == 10 and sorted(n.values()) == [1] * 9 + [2]  # only what failed was asked for again


def given(spark, profile="audit", names=("good", "also")):
    asked = specs.check(spark.createDataFrame([(i, i, "core" if profile == "core" else "grounded", 6, None, True, [f"https://{i}.org/x"]) for i in names], specs.ROW))
    pages = [(i, 0, f"https://{i}.org/x", f"<html><body><p>{TEXT}</p></body></html>") for i in names]
    return asked, spark.createDataFrame(pages, "identity_id string, source_ord int, url string, html string")


def test_a_killed_run_goes_on_without_asking_again(spark, tmp_path):
    calls, asked, profile = tmp_path / "calls", given(spark, names=("good",)), "audit"
    calls.mkdir()
    ledger = lambda answer: responder.Ledger(spark, str(tmp_path / "ledger"), chunks=1).through(responder.answering(answer))
    with pytest.raises(Exception, match="killed"):
        live.run_live(*asked, ledger(counting(calls, knowing(), lambda r: r["role"] == "student" and "round 3/" in r["user"])), profile)
    before = len(logged(calls))
    assert before > 5
    got = live.run_live(*asked, ledger(counting(calls, knowing())), profile)
    whole = live.run_live(*asked, responder.answering(knowing()), profile)
    n = Counter(logged(calls))
    assert len(n) > before and set(n.values()) == {1}
    for name in ("artifacts", "qualification", "capabilities"):
        key = lambda r: repr(r)
        assert sorted(map(key, got[name].collect())) == sorted(map(key, whole[name].collect()))


def test_a_round_reads_its_own_responses_only(spark, tmp_path, monkeypatch):
    asked, seen = given(spark, names=("good",)), []
    after = live.Held.after

    def watched(self, tasks, responses, profile):
        seen.append(responses.select("round_no").distinct().collect())
        return after(self, tasks, responses, profile)

    monkeypatch.setattr(live.Held, "after", watched)
    got = live.run_live(*asked, responder.answering(knowing()))
    assert [[r["round_no"] for r in x] for x in seen] == [[n] for n in range(1, 7)]
    folded = {(r["identity_id"], r["cap_id"]): (r["score"], r["observations"]) for r in got["capabilities"].collect()}
    last = got["history"].groupBy("identity_id", "cap_id").agg(F.max_by("score", "observations").alias("s"), F.max("observations").alias("n")).collect()
    assert {(r["identity_id"], r["cap_id"]): (r["s"], r["n"]) for r in last} == {k: v for k, v in folded.items() if v[1]}


def test_merged_scores_are_the_fold(spark):
    r = random.Random(4)
    rows = [(k % 7, i, r.randint(0, 4)) for i, k in enumerate(r.choices(range(7), k=200))]
    state = spark.createDataFrame([(k, 0, 0) for k in range(8)], "k int, score int, observations int")
    for part in (rows[:50], rows[50:51], rows[51:]):
        state = scoring.merge_scores(state, spark.createDataFrame(part, "k int, i int, score int"), ["k"], ["i"])
    want = {x.k: (x.score, x.observations) for x in scoring.running_score(spark.createDataFrame(rows, "k int, i int, score int"), ["k"], ["i"]).collect()}
    assert {x.k: (x.score, x.observations) for x in state.collect()} == {**want, 7: (0, 0)}


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_scan_is_the_fold(spark, chunk):
    r = random.Random(8)
    rows = [(r.choice(("a", "b", None)) if i % 3 else "hot", i, r.choice((0, 1, 2, 3, 4, 9, -1, None)), {"n": i}) for i in range(150)]
    rows += [("tie", 1, 4, {}), ("tie", 1, 0, {}), ("tie", 1, 0, {})]
    df = spark.createDataFrame(rows, "k string, i int, score int, other map<string,int>").repartition(5)
    got = scoring.score_scan(df, ["k"], ["i"], chunk)
    assert got.columns == ["k", "i", "score", "other", "running", "observations"]
    seen = sorted((repr(x.k), x.observations, x.running, x.score) for x in got.collect())
    want = []
    for k in ("a", "b", None, "hot", "tie"):
        s = 0
        mine = sorted((i, min(4, max(0, x or 0)), x) for key, i, x, _ in rows if key == k)
        for n, (_, x, raw) in enumerate(mine):
            s = x if n == 0 else round((s * n + x) / (n + 1))
            want.append((repr(k), n + 1, s, raw))
    assert [x[:3] for x in seen] == [x[:3] for x in sorted(want, key=lambda x: x[:2])]
    assert Counter((x[0], x[3]) for x in seen) == Counter((x[0], x[3]) for x in want)
    assert scoring.score_scan(df.limit(0), ["k"], ["i"]).count() == 0


def test_scan_of_one_key(spark):
    """A million rows of one key: no task holds them, and the result is the fold."""
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), "id", (F.xxhash64("id") % 5).cast("int").alias("score")).withColumn("score", F.abs("score"))
    got = scoring.score_scan(df.repartition(8), ["k"], ["id"]).agg(F.max("observations").alias("n"), F.max_by("running", "observations").alias("last"), F.sum("running").alias("sum")).first()
    s, total = 0.0, 0
    for n, x in enumerate(df.select("score").toPandas()["score"]):
        s = float(x) if n == 0 else float(round((s * n + x) / (n + 1)))
        total += int(s)
    assert (got["n"], got["last"], got["sum"]) == (1_000_000, int(s), total)


def test_calls_in_flight(spark):
    def slow(r):
        began = time.time()
        time.sleep(0.2 if r["user"] != "u0" else 1.0)
        return f"{began} {time.time()} {r['user']}", None

    asked = requests(spark, 42)
    began = time.time()
    got = responder.answering(slow, tasks=2, in_flight=5)(asked).collect()
    assert time.time() - began < 6  # one after another: 8 and more
    assert all(r["content"].split()[2] == r["user"] for r in got)
    spans = [tuple(map(float, r["content"].split()[:2])) for r in got]
    most = max(sum(b <= x < e for b, e in spans) for x, _ in spans)
    assert 5 < most <= 10


def test_pace(spark):
    def quick(r):
        return str(time.time()), None

    got = responder.answering(quick, tasks=1, in_flight=8, per_second=20)(requests(spark, 22)).collect()
    at = sorted(float(r["content"]) for r in got)
    assert at[-1] - at[0] > 0.9 * 21 / 20


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        where = {"/to": "/page", "/away": "http://localhost.localdomain/x", "/loop": "/loop"}.get(self.path)
        if where or self.path == "/gone":
            self.send_response(302 if where else 404)
            if where:
                self.send_header("Location", where)
            self.end_headers()
            return
        body = {"/page": b"<p>by type</p><script>x</script>", "/begin": b"<!doctype html><HTML><p>by begin</p>", "/plain": "plain <p> é".encode(), "/long": b"x" * 400_000, "/bad": b"a\xffb"}[self.path]
        self.send_response(200)
        self.send_header("Content-Type", "text/HTML; charset=utf-8" if self.path == "/page" else "text/plain")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetched(spark, server):
    paths = ["page", "to", "away", "loop", "gone", "begin", "plain", "long", "bad"]
    here = lambda u: u.startswith(server)
    rows = spark.createDataFrame([("i", k, f"{server}/{p}") for k, p in enumerate(paths)] + [("i", 9, None)], "identity_id string, source_ord int, url string")
    got = {r["source_ord"]: r for r in fetch.fetched(rows, most=100_000, allowed=here).collect()}
    assert [got[k]["status"] for k in range(10)] == ["ok", "ok", "failed", "failed", "failed", "ok", "ok", "ok", "ok", "failed"]
    assert got[1]["final_url"] == f"{server}/page" and "unsafe" in got[2]["error"] and "redirects" in got[3]["error"] and "404" in got[4]["error"] and "unsafe" in got[9]["error"]
    assert len(got[7]["body"]) == 131_072  # the chunk that passes the bound is the last one
    said = spark.createDataFrame([(k, "https://a.org/", r["content_type"], r["body"], r["status"], r["error"]) for k, r in got.items() if k < 9], "k int, final_url string, content_type string, body binary, status string, error string")
    text = {r["k"]: r["text"] for r in html.receive(said).collect()}
    assert (text[0], text[5], text[6], text[8], text[2]) == ("by type", "by begin", "plain <p> é", "a�b", None)


def test_source_of_urls(spark, server):
    class Here(fetch.BoundedSources):
        allowed = staticmethod(lambda u, s=server: u.startswith(s))

        @classmethod
        def name(cls):
            return "sources_here"

    spark.dataSource.register(Here)
    listed = [f"{server}/{p}" for p in ("page", "plain", "away", "long", "to")]
    df = spark.read.format("sources_here").option("urls", json.dumps(listed)).option("per_partition", 2).option("most", 70_000).load()
    assert df.rdd.getNumPartitions() == 3
    assert [(r["url"], r["status"], len(r["body"] or "")) for r in sorted(df.collect(), key=lambda r: listed.index(r["url"]))] == [
        (u, s, n) for u, s, n in zip(listed, ("ok", "ok", "failed", "ok", "ok"), (32, 12, 0, 131_072, 32))]
    fetch.register(spark)
    assert spark.read.format("bounded_sources").option("urls", json.dumps(listed[:1])).load().first()["error"].endswith("unsafe URL")


def test_urls_are_judged_alike(spark):
    given = ["https://a.org/x", "http://a.org", "https://localhost/", "https://u@a.org", "https://10.0.0.1/", "https://8.8.8.8/", "https://[::1]/", "https://a.local./", "https:///x", "", "x", "HTTPS://A.org"]
    df = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.safe_url(F.col("u")).alias("ok"))
    assert {r["u"]: r["ok"] for r in df.collect()} == {u: urls.safe(u) for u in given}


def artifacts(spark, rows, n=3):
    return spark.createDataFrame(rows, sink.SCHEMA).repartition(n)


def test_artifact_sets(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = [(f"id {k}/ü%", name, f"{k} {name}\n") for k in range(5) for name in render.ARTIFACTS]
    sink.publish(artifacts(spark, rows), at)
    read = lambda: sorted(map(tuple, sink.published(spark, at).collect()))
    assert read() == sorted(rows)
    assert sink.place("id 1/ü%", "SUMMARY.md", at).read_text() == "1 SUMMARY.md\n"
    fail = F.udf(lambda x: 1 // 0 if x.startswith("3") else x)
    with pytest.raises(Exception):  # noqa: B017
        sink.publish(artifacts(spark, [(i, n, c.upper()) for i, n, c in rows]).withColumn("content", fail("content")), at)
    with pytest.raises(Exception, match="more than one"):
        sink.publish(artifacts(spark, [*rows, rows[0]], 5), at)
    assert read() == sorted(rows)
    sink.publish(artifacts(spark, [("one", "a", "new")]), at)
    assert read() == [("one", "a", "new\n")]
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith(".")]
    with pytest.raises(Exception, match="mounted"):
        sink.publish(artifacts(spark, rows), "s3://bucket/x")


def test_scan_of_specifications(spark, tmp_path):
    good = "identity: Some One  # who\nfunction: 'to check'\nrounds: 8\nsources:\n  - https://a.org/x\n  - https://b.org\n"
    for name, said in {"a.yaml": good, "b.json": '{"identity": "B", "function": "f", "sources": ["https://c.org"]}', "c.yaml": "identity: x\n  y: 1\n", "d.yaml": "identity: D\nfunction: f\nrounds: 2\nsources: [http://x.org]\n", "e.yaml": "- x\n"}.items():
        (tmp_path / name).write_text(said)
    got = {r["identity_id"].rsplit("/", 1)[-1]: r for r in specs.check(specs.scan(spark, str(tmp_path))).collect()}
    assert got["Some One"].asDict() == {"identity_id": "Some One", "identity": "Some One", "function": "to check", "rounds": 8, "target": "practitioner", "zero_cost": True, "sources": ["https://a.org/x", "https://b.org"], "violations": []}
    assert got["B"]["rounds"] == 10 and got["B"]["violations"] == [] and len(got["D"]["violations"]) == 2
    assert [x.startswith("invalid specification: ") for k in ("c.yaml", "e.yaml") for x in got[k]["violations"]] == [True, True] and len(got) == 5


@pytest.mark.parametrize("sent", [(20_000, 100_000), (3, 100_000), (20_000, 2)])
def test_token_overlap(spark, sent):
    r = random.Random(6)
    words = [f"word{k}" for k in range(30)]
    say = lambda n: " ".join(r.choices(words, weights=range(1, 31), k=n))
    claims = [(k, say(r.randint(1, 8))) for k in range(40)] + [(40, ""), (41, None), (42, "the and")]
    sources = [(k, say(r.randint(1, 20))) for k in range(150)] + [(150, None), (151, ""), (152, "unknown tokens")]
    got = grounding.token_overlap(spark.createDataFrame(claims, "claim_id int, text string"), spark.createDataFrame(sources, "source_id int, text string"), 0.5, *sent)
    t = lambda s: {w[:-1] if w.endswith("s") and len(w) > 4 else w for w in (s or "").split()}
    want = {(c, s, len(t(x) & t(y))) for c, x in claims if x and x != "the and" for s, y in sources if len(t(x) & t(y)) >= max(1, -(-len(t(x)) // 2))}
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("quote_bytes", [1 << 20, 60])
def test_verbatim(spark, quote_bytes):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(("alpha", "beta", "ga", "δελτα", "aaaa")) for _ in range(n))
    sources = [(f"s{k}", say(r.randint(0, 60)).replace(" ", r.choice((" ", "\n", "  ")), 3)) for k in range(60)] + [("none", None), ("none", "")]
    cut = lambda t: (t or "")[(at := r.randint(0, 40)) : at + r.randint(20, 60)]
    quotes = [(k, cut(r.choice(sources)[1])) for k in range(80)] + [(80, "a" * 30), (81, None), (82, ""), (83, " ".join(["aaaa"] * 6)), (84, say(6)), (84, say(6))]
    sources += [("run", "a" * 40), ("s1", "again " + (sources[1][1] or ""))]
    plain = lambda t: " ".join((t or "").split())
    want = Counter((q, s) for q, x in quotes if len(plain(x)) >= 24 for s, y in sources if plain(x) in plain(y))
    got = grounding.verbatim(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(sources, "source_id string, text string"), quote_bytes=quote_bytes)
    assert Counter(map(tuple, got.collect())) == want and (80, "run") in want
    assert grounding.verbatim(spark.createDataFrame([], "quote_id int, quote string"), spark.createDataFrame(sources, "source_id string, text string")).count() == 0


def test_scores_in_event_time(spark, tmp_path):
    """Rows arrive shuffled within the delay; the result is that of the batch."""
    from datetime import datetime, timedelta

    from gradeloom.streaming.scores import ordered_scores

    r, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(k % 3, start + timedelta(seconds=k // 2), k, r.randint(0, 4)) for k in range(120)]
    arrive = sorted(rows, key=lambda x: x[1] + timedelta(seconds=r.uniform(0, 12)))
    last = [(k, start + timedelta(hours=1), 999, 0) for k in range(3)]  # lets the watermark pass all others
    for k, part in enumerate([arrive[:30], arrive[30:60], arrive[60:90], arrive[90:], last[:1], last[1:]]):
        spark.createDataFrame(part, "k int, at timestamp, i long, score int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k else 0)
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        came = spark.readStream.schema("k int, at timestamp, i long, score int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ordered_scores(came, ["k"], "k int", "at", "i", "score", "20 seconds").writeStream.format("memory").queryName("in_time").outputMode("append")
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(200)
        got = sorted((x.k, x.at, x.seq, x.score, x.observations) for x in spark.table("in_time").collect() if x.seq != 999)
    finally:
        spark.conf.unset(store)
    want = []
    for k in range(3):
        s = 0
        for n, (_, at, i, x) in enumerate(sorted((y for y in rows if y[0] == k), key=lambda y: (y[1], y[2]))):
            s = x if n == 0 else round((s * n + x) / (n + 1))
            want.append((k, at, i, s, n + 1))
    assert got == sorted(want)


class Model(BaseHTTPRequestHandler):
    """A model server: knows its role by the system text."""

    role_of = None

    def do_POST(self):  # noqa: N802
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        system, user = (m["content"] for m in said["messages"])
        assert said["model"] == "m" and user.endswith("\n/no_think")
        role = next(r for r, text in prompts.SYSTEMS.items() if text == system)
        content, _ = knowing()({"role": role, "user": user.removesuffix("\n/no_think")})
        data = json.dumps({"choices": [{"message": {"content": content}, "finish_reason": "stop"}]}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_main(spark, tmp_path, monkeypatch, capsys):
    s = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    (tmp_path / "specs").mkdir()
    for name in ("good", "bad"):
        (tmp_path / "specs" / f"{name}.yaml").write_text(f"identity: {name}\nfunction: grounded\nrounds: {6 if name == 'good' else 60}\nsources:\n  - https://{name}.org/x\n")
    page = f"<html><body><p>{TEXT}</p></body></html>".encode()
    monkeypatch.setattr(live.fetch, "fetched", lambda rows: rows.withColumns({"final_url": F.col("url"), "content_type": F.lit("text/html"), "body": F.lit(page), "status": F.lit("ok"), "error": F.lit(None).cast("string")}))
    arguments = [str(tmp_path / "specs"), str(tmp_path / "out"), "--ledger", str(tmp_path / "ledger"), "--url", f"http://127.0.0.1:{s.server_port}/v1/chat/completions", "--model", "m"]
    assert live.main(arguments) == 1  # one specification is bad
    out = capsys.readouterr()
    assert '"package_outcome":"CONDITIONAL PASS"' in out.out and "bad: specification: rounds must be" in out.err
    assert "https://good.org/x" in sink.place("good", "IDENTITY_CAPSULE.md", str(tmp_path / "out")).read_text()
    s.shutdown()
