import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import jsonx, urls
from gradeloom.functions import text as T
from gradeloom.operators import capabilities, curriculum, exams, gates, grounding, scoring
from gradeloom.plans import live, prompts, queries, render, responder, sink
from gradeloom.plans.run import run
from gradeloom.sources import html, specs


def values(spark, data, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").select("i", expr(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_tokens(spark):
    got = values(spark, ["policies ties series access classes status", "The ab Systems über 42 420", ""], T.tokens)
    assert [set(x) for x in got] == [{"policy", "ties"[:3] + "s", "sery", "access", "classe", "statu"}, {"ber", "420"}, set()]


def test_text(spark):
    assert values(spark, ["a" * 10, "a" * 11], lambda c: T.truncate(c, 10)) == ["a" * 10, "a" * 10 + T.CUT_MARK]
    assert values(spark, [" <think>x\ny</think> hi ", "<think>open"], T.strip_reasoning) == ["hi", "<think>open"]
    assert values(spark, [" a  b\x1cc 　"], T.normalize_space) == ["a b c"]
    assert values(spark, ["A b--C!", "?!"], T.slug) == ["a_b_c", None]


@pytest.mark.parametrize("n", [0, 299, 1500, 1501, 3001])
def test_sample(spark, n):
    text = "".join(random.Random(n).choice("abc é") for _ in range(n))
    (got,) = values(spark, [text], lambda c: T.sample_segments(c, 1500))
    third, half = 485, n // 2
    want = text if n <= 1500 else text[:third] + T.MIDDLE_MARK + text[half - third // 2 : half - third // 2 + third] + T.END_MARK + text[-third:]
    assert got == want


def test_urls(spark):
    good = ["https://example.com/x", "https://100.64.0.1", "https://2130706433", "https://127.1"]
    bad = ["http://example.com", "https://u:p@h", "https://localhost", "https://x.local.", "https://127.0.0.1", "https://[::1]", "https://[::1", "https://224.0.0.1", "", None]
    assert values(spark, good + bad, urls.safe_url) == [True] * len(good) + [False] * len(bad)


def test_json(spark):
    texts = ['{"a": 1}', '```json\n{"a": "}"}\n```', 'so {"a": {"b": 2}} end', '[{"a": 1}]', '{bad} {"a": 1}', "{", "none", '{"a": 1, "a": 2}']
    got = values(spark, texts, lambda c: jsonx.json_object(c))
    assert [r.json for r in got] == ['{"a": 1}', '{"a": "}"}', '{"a": {"b": 2}}', '{"a": 1}', None, None, None, '{"a": 2}']
    docs = ['{"v": %s}' % v for v in ("true", '"false"', "1", "false", '""', "0", "null", "[]", "{}", "[0]")] + ["{}"]
    assert values(spark, docs, lambda c: jsonx.truthy(c, "$.v")) == [True] * 3 + [False] * 6 + [True, False]
    assert values(spark, ['{"v": %s}' % v for v in ("3", "3.9", '" 3 "', '"3.5"', "null")], lambda c: jsonx.integer(c, "$.v")) == [3, 3, 3, None, None]


def test_html():
    page = "<html><title>T</title><script>x</script><nav>n</nav><p>a <b>b</p><!-- c --><footer>f</footer><p>&amp;d"
    assert html.text_of(page) == "T\na\nb\n&d"


def test_html_references():
    page = "<p>a&amp</p><p>&lt;b &ampx; &nope; &#65; &#65 c & d</p><xmp>&amp; &</xmp>"
    assert html.text_of(page).startswith("a&\n<b &x; &nope; A A c & d")
    assert html.text_of(page, closed=True) == html.text_of(page).replace("a&\n", "a&amp\n").replace("&x;", "&ampx;").replace("A A", "A &#65")


@pytest.mark.parametrize("name", ["q_html_text", "q_received"])
def test_pages_with_open_references(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    pages = [(i, f"https://example.com/{i}", f"<html><title>und&amp;&amp{'x' * (i % 3)}</title><p>a&amp</p><p>&lt;b&gt &quot;c&quot</p></html>") for i in range(1, 12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, queries.Q[name](spark, str(tmp_path)).collect())) == sorted(con.execute(queries.SQL[name]).fetchall())


def test_running_score_is_order_exact(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(0, 4)) for k in range(20) for i in range(12)]
    want = {}
    for k, _, s in rows:
        v, n = want.get(k, (0, 0))
        want[k] = (s if n == 0 else round((v * n + s) / (n + 1)), n + 1)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, score int")
    for parts in (1, 7):
        got = scoring.running_score(df.repartition(parts), ["k"], ["i"]).collect()
        assert {x.k: (x.score, x.observations) for x in got} == want


def test_status(spark):
    rows = spark.createDataFrame([(3, 2), (3, 1), (3, 0), (2, 2), (0, 0), (4, 5)], "s int, n int")
    got = [r[0] for r in rows.select(scoring.status(F.col("s"), F.col("n"))).collect()]
    assert got == ["PROXY_EVIDENCED", "PROVISIONAL_SINGLE_OBSERVATION", "UNTESTED", "WEAK_OR_FAILED", "UNTESTED", "PROXY_EVIDENCED"]


def test_exact_evidence(spark):
    blocks = spark.createDataFrame([("i", 0, "u", "Row level security policies\nprotect tables from reading")], "identity_id string, source_ord int, url string, text string")
    quote = "security policies protect tables"
    rows = [("i", 0, "security policies", "protect tables", "u", quote), ("i", 1, "security policies", "protect tables", "w", quote), ("i", 2, "quantum physics", "waves", "u", quote), ("i", 3, "security policies", "protect tables", "u", "security policies")]
    claims = spark.createDataFrame(rows, "identity_id string, cap_ord int, name string, description string, evidence_url string, evidence_quote string")
    assert [r.supported for r in sorted(grounding.exact_evidence(claims, blocks).collect(), key=lambda r: r.cap_ord)] == [True, False, False, False]


def test_curriculum(spark):
    caps = spark.createDataFrame([("i", "a", "A", "does a"), ("i", "b", "B", "does b")], "identity_id string, cap_id string, name string, description string")
    rows = [("i", 1, 2, "t", ["a"], [" x ", ""], True), ("i", 2, 2, " ", ["z"], ["y"], False), ("i", 3, 2, "extra", ["a"], ["y"], False)]
    tasks = spark.createDataFrame(rows, "identity_id string, round_no int, rounds int, task string, capability_ids array<string>, hidden_rubric array<string>, adversarial boolean")
    got = sorted(curriculum.validate(tasks, caps).collect(), key=lambda r: r.round_no)
    assert [(r.error, r.hidden_rubric) for r in got] == [(None, ["x"]), ("blank task", ["y"])]
    first = min(curriculum.strengthen_rubrics(tasks, caps).collect(), key=lambda r: r.round_no)
    assert first.hidden_rubric == [curriculum.NAMES_CHECK + "A.", curriculum.NEEDS_CHECK + "does a", curriculum.FACTS_GUARD, curriculum.PREMISE_GUARD]


def test_which_tasks_give_way():
    assert curriculum.replacements([["a"], ["a"], ["b"], ["a", "a"]], ["a", "b"], 2) == ({3: "b"}, None)
    assert curriculum.replacements([["a"], ["a"], ["b"], ["a", "a"]], ["b", "a"], 2) == ({3: "b"}, "no task can give way to a")
    assert curriculum.replacements([["a", "b"]] * 4, ["a", "b"], 2) == ({}, None) == curriculum.replacements([["x"]], [], 2)
    assert curriculum.replacements([["a"]], ["a"], 2) == ({}, "more critical capabilities than tasks")
    r = random.Random(5)
    for _ in range(300):
        must, ids = "abc"[: r.randint(1, 3)], [[r.choice("abcd") for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 10))]
        given, error = curriculum.replacements(ids, must, 2)
        after = [[given[k]] if k in given else x for k, x in enumerate(ids)]
        assert error or all(sum(c in x for x in after) >= 2 or any(x.count(c) > 1 for x in ids) for c in must)


def test_coverage_repair(spark):
    rows = [("i", k, f"t{k}", ["a"], ["some check of the answer"], k == 5, False) for k in range(6)] + [("j", 0, "t", ["a"], ["r"], False, False)]
    tasks = spark.createDataFrame(rows, "identity_id string, round_no int, task string, capability_ids array<string>, hidden_rubric array<string>, adversarial boolean, critical boolean")
    crit = spark.createDataFrame([(i, k, c, c.upper(), "d") for i in "ij" for k, c in enumerate("ab")], "identity_id string, cap_ord int, cap_id string, name string, description string")
    got = sorted(curriculum.ensure_coverage(tasks, crit).collect(), key=lambda r: (r.identity_id, r.round_no))
    assert [r.capability_ids for r in got[:6]] == [["a"]] * 4 + [["b"]] * 2
    assert got[5].task == curriculum.EVIDENCE_TASK.format("B", "d") and (got[5].adversarial, got[5].critical, got[4].adversarial) == (True, True, False)
    assert got[5].hidden_rubric == [curriculum.EVIDENCE_RUBRIC[0].format("B"), curriculum.EVIDENCE_RUBRIC[1], curriculum.PREMISE_GUARD] and len(got[4].hidden_rubric) == 2
    assert [r.error for r in got[6:]] == ["more critical capabilities than tasks"]


def test_white_space_of_all_kinds_is_stripped(spark):
    (row,) = spark.createDataFrame([(["\t\n", "  a\n", None, "\u2003", "b\xa0"],)], "x array<string>").select(curriculum.clean_items(F.col("x")).alias("x")).collect()
    assert row.x == ["a", "b"]
    said = spark.createDataFrame([("i", '{"rounds": [{"task": " \\t", "capability_ids": ["a"], "hidden_rubric": ["x"]}]}'), ("j", '{"rounds": 1}')], "identity_id string, object string")
    caps = spark.createDataFrame([("i", 0, "a", "A", "d", True)], "identity_id string, cap_ord int, cap_id string, name string, description string, critical boolean")
    asked = spark.createDataFrame([("i", 1), ("j", 1)], "identity_id string, rounds int")
    assert {r.identity_id: r.error for r in curriculum.grounded_curriculum(asked, said, caps).collect()} == {"i": "blank task", "j": "too few rounds"}


def qualified(spark, transfers, profile, failures=(False, False), score=3):
    specs = spark.createDataFrame([("i", 2), ("empty", 2)], "identity_id string, rounds int")
    rounds = spark.createDataFrame([("i", k, f) for k, f in enumerate(failures, 1)], "identity_id string, round_no int, critical_failure boolean")
    tr = spark.createDataFrame([("i", k, *t) for k, t in enumerate(transfers, 1)], "identity_id string, number int, score int, passed boolean, critical_failure boolean, corrections array<string>, adversarial boolean")
    caps = spark.createDataFrame([("i", 0, "c", True, score, 2), ("i", 1, "d", False, 0, 0)], "identity_id string, cap_ord int, cap_id string, critical boolean, score int, observations int")
    return {r.identity_id: r for r in gates.qualify(specs, rounds, tr, caps, profile).collect()}


def test_gates(spark):
    clean = [(3, None, False, None, False), (4, True, False, [], True)]
    got = qualified(spark, clean, "audit")
    assert {k: r.outcome for k, r in got.items()} == {"i": "CONDITIONAL PASS", "empty": "FAIL"} and got["i"].native_status == "NOT_RUN" and got["i"].transfer_scores == [3, 4]
    assert (got["empty"].transfer_clean, got["empty"].average, got["empty"].condition) == (False, 0.0, gates.NEXT_CLEAN)
    core = qualified(spark, clean, "core")["i"]
    assert (core.ready, core.outcome, core.condition) == (True, "CONDITIONAL PASS", gates.NEXT_QUALIFY)
    failed = qualified(spark, clean, "audit", (True, False))["i"]
    assert failed.outcome == "FAIL" and failed.critical_failures == ["1"]
    assert qualified(spark, clean, "conservative", score=2)["i"].weak_critical == ["c"]
    for change in ([(3, True, False, [" "], False), clean[1]], [clean[0], (4, False, False, [], True)], clean[::-1], clean[:1]):
        assert qualified(spark, change, "audit")["i"].outcome == "FAIL"
    fixed = qualified(spark, [(3, True, False, ["x", " "], False), (4, True, True, ["y"], True)], "audit")["i"]
    assert fixed.transfer_corrections == ["x", "y"] and fixed.critical_failures == ["transfer-2"] and fixed.transfer_profile_ready
    assert qualified(spark, [(3, True, False, ["x"], False), clean[1]], "conservative")["i"].outcome == "CONDITIONAL PASS"


def test_regressions_tail_before_blanks(spark):
    rows = [("i", k, " " if k in (5, 24) else f"c{k}") for k in range(25)]
    got = render.regression_set(spark.createDataFrame(rows, "identity_id string, ord int, case string")).collect()
    assert sorted(r.ord for r in got) == [k for k in range(6, 24)][-19:] and {r.status for r in got} == {"PROPOSED_UNVERIFIED"}


def test_replay(spark):
    asked = responder.requests(spark.createDataFrame([("r", "s", "u1", 0.0, 5), ("r", "s", "u2", 0.0, 5)], "role string, system string, user string, temperature double, max_tokens int"))
    h = {r.user: r.request_hash for r in asked.collect()}
    rec = spark.createDataFrame([(h["u1"], 1, '{"a"', "length"), (h["u1"], 2, 'x {"a": 1}', "stop")], "request_hash string, attempt int, content string, finish_reason string")
    none = spark.createDataFrame([], "request_hash string, content string")
    got = {r.user: r for r in responder.with_json(responder.replay(asked, rec), none).collect()}
    assert got["u1"].object == '{"a": 1}' and got["u2"].error == "no response"


def test_specs(spark):
    ok = ["https://example.com/a "]
    rows = [("a", " A ", "f", None, None, None, ok), ("b", " ", "f", 13, "t", False, ["http://x.org"]), ("c", "C", "f", 6, "t", True, []), ("d", "D", "f", 12, "t", True, None), ("e", "E", "f", 5, "t", True, ok * 13)]
    df = spark.createDataFrame(rows, "identity_id string, identity string, function string, rounds int, target string, zero_cost boolean, sources array<string>")
    got = {r.identity_id: r for r in specs.check(df).collect()}
    assert (got["a"].identity, got["a"].rounds, got["a"].target, got["a"].sources, got["a"].violations) == ("A", 10, "practitioner", ["https://example.com/a"], [])
    assert {k: len(r.violations) for k, r in got.items()} == {"a": 0, "b": 4, "c": 1, "d": 1, "e": 2}
    b = spark.createDataFrame([(bytearray("aé".encode()),)], "b binary").select(specs.cut_bytes(F.col("b"), 1)).first()[0]
    assert b == "a"


def test_capability_maps(spark):
    said = '{"capabilities": [3, {"id": "A b"}, {"id": "a-B", "name": "x"}, {"id": "?!"}, {"name": "n"}, {"id": "c", "name": " C ", "critical": "false"}]}'
    df = spark.createDataFrame([("i", said), ("j", "[]"), ("k", '{"capabilities": 1}')], "identity_id string, object string")
    got = sorted(capabilities.parse(df).collect(), key=lambda r: r.cap_ord)
    assert [(r.identity_id, r.cap_id, r.name, r.critical) for r in got] == [("i", "a_b", "a_b", False), ("i", "c", "C", True)]
    assert {r.error for r in capabilities.core_map(df).collect()} == {"too few usable capabilities"}
    quote = "security policies protect tables"
    items = ", ".join(f'{{"id": "c{k}", "name": "security policies", "description": "protect tables", "critical": true, "evidence_url": "u", "evidence_quote": "{quote if k != 1 else "of something else entirely"}"}}' for k in range(9))
    blocks = spark.createDataFrame([("i", "u", 0, quote + " well")], "identity_id string, url string, source_ord int, text string")
    got = capabilities.grounded_map(spark.createDataFrame([("i", f'{{"capabilities": [{items}]}}')], "identity_id string, object string"), blocks)
    assert [(r.cap_id, r.critical) for r in sorted(got.collect(), key=lambda r: r.cap_ord)] == [("c0", True), ("c2", True), ("c3", True), ("c4", False), ("c5", False), ("c6", False)]


def test_exam_coercion(spark):
    texts = ['{"score": 9}', '{"score": "3", "passed": "false"}', '{"score": "3.5"}', '{"score": 4, "corrections": ["", "y"], "capability_updates": {"a": 4, "b": "2", "c": "x", "d": -1}}', '{"score": -1, "corrections": "no", "capability_updates": []}', "none", '{"score": 4, "passed": false}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, object string")
    got = sorted(exams.coerce(df).collect(), key=lambda r: r.i)
    assert [(r.score, r.passed, r.error) for r in got] == [(4, True, None), (3, True, None), (0, False, "invalid score"), (3, True, None), (0, False, None), (0, False, "no object"), (4, False, None)]
    assert got[3].capability_updates == {"a": 3, "b": 2, "d": 0} and got[3].corrections == ["", "y"] and got[4].corrections == []
    core = sorted(exams.coerce(df, conservative=False).collect(), key=lambda r: r.i)
    assert core[3].score == 4 and core[3].capability_updates == {"a": 4, "b": 2, "c": None, "d": -1}
    x = spark.createDataFrame([(1, True, "l" * 501, ["", " c "]), (2, False, "l", [])], "i int, passed boolean, durable_lesson string, corrections array<string>")
    assert [(r.i, r.sub, r.lesson) for r in sorted(exams.lessons(x, ["i"]).collect())] == [(1, 0, "l" * 500 + T.CUT_MARK), (1, 1, "CORRECTION: c")]


def test_score_history_ends_in_the_running_score(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, i, r.randint(0, 4)) for k in range(9) for i in range(14)], "k int, i int, score int")
    last = {x.k: (x.score, x.observations) for x in scoring.score_history(df, ["k"], "i").where("i = 13").collect()}
    assert last == {x.k: (x.score, x.observations) for x in scoring.running_score(df, ["k"], ["i"]).collect()}


def test_replayed_run(spark):
    spec = spark.createDataFrame([("i", "f", "t", 2, []), ("bad", "f", "t", 2, ["x"])], "identity_id string, function string, target string, rounds int, violations array<string>")
    caps = spark.createDataFrame([("i", 0, "a", "A", "does a", True, "u", "q"), ("bad", 0, "a", "A", "", True, "u", "q")], "identity_id string, cap_ord int, cap_id string, name string, description string, critical boolean, evidence_url string, evidence_quote string")
    at = [("training", 1), ("training", 2), ("transfer", 1), ("transfer", 2)]
    tasks = spark.createDataFrame([(i, p, n, ["a"], (p, n) == at[3]) for i in ("i", "bad") for p, n in at], "identity_id string, phase string, round_no int, capability_ids array<string>, adversarial boolean")
    said = ['{"score": 2, "regression_case": "r1"}', '{"score": 4, "durable_lesson": "l", "capability_updates": {"a": 3, "zz": 1}}', '{"score": 3}', '{"score": 4}']
    responses = spark.createDataFrame([("i", p, n, s) for (p, n), s in zip(at, said)], "identity_id string, phase string, round_no int, object string")
    got = run(spec, caps, tasks, responses)
    (cap,) = got["capabilities"].collect()
    assert (cap.score, cap.observations, cap.status) == (2, 4, "WEAK_OR_FAILED")  # 2, then 2.5 -> 2, 2.33 -> 2, 2.5 -> 2
    assert [(r.identity_id, r.outcome) for r in got["qualification"].collect()] == [("i", "FAIL")]
    assert [r.lesson for r in got["lessons"].collect()] == ["l"] and [r.case for r in got["regressions"].collect()] == ["r1"]
    (state,) = got["states"].collect()
    assert "MODEL-PROPOSED SCOPE (UNVERIFIED)" in state.state and state.state.startswith("FUNCTION: f\n")
    assert sorted(r.name for r in got["artifacts"].collect()) == sorted(render.ARTIFACTS[:5])
    (audit,) = [json.loads(r.content) for r in got["artifacts"].collect() if r.name == "TRAINING_AUDIT.json"]
    assert [x["exam"]["score"] for x in audit["rounds"]] == [2, 4] and [x["capability_ids"] for x in audit["curriculum"]] == [["a"]] * 2 and [x["transfer"] for x in audit["transfers"]] == [1, 2] and audit["spec"]["function"] == "f"
    (line,) = got["outcomes"].collect()
    assert json.loads(line.line)["package_outcome"] == "FAIL"


TEXT = "Row level security policies decide which rows of a table may be read. Queues keep messages until they are handled and then archive them."
NAMES = {"security policies": "rows table read", "queues messages": "keep handled archive", "table rows": "security policies", "level security": "rows read"}


def knowing():
    """A model that knows its sources; its first answer as an examiner of round 1 is no JSON, its first exam 2 is a known task."""

    def model(r):
        role, user = r["role"], r["user"]
        if role == "architect":
            url = re.search('url="([^"]+)"', user)[1]
            return json.dumps({"capabilities": [{"id": n, "name": n, "description": d, "critical": True, "evidence_url": url, "evidence_quote": TEXT[:45] if k != 3 else "made up quote of enough length"} for k, (n, d) in enumerate(NAMES.items())]}), None
        if role == "core architect":
            return json.dumps({"capabilities": [{"id": f"c {k}", "critical": k < 2} for k in range(12)]}), None
        ids = ["c_0", "c_1"] if "FUNCTION:\ncore" in user else ["security_policies", "queues_messages", "table_rows"]
        task = lambda k, text: {"task": text, "capability_ids": [ids[k % len(ids)]], "hidden_rubric": ["x"], "adversarial": k % 2 == 1}
        if role in ("trainer", "transfer"):
            return json.dumps({"rounds": [task(k, f"{role} task {k}") for k in range(2 if role == "transfer" else 6 if "lazy" not in user else 3)]}), None
        if role == "single transfer":
            again = prompts.AGAIN in user or "NUMBER:\n1" in user
            return json.dumps({"rounds": [task(0, "a new task " + user.split("NUMBER:\n")[1][0] if again else " TRAINER  task 1")]}), None
        if role == "repair":
            return '{"score": 3, "regression_case": "case"}', None
        if "examiner" in role:
            return ("grade: three", None) if "trainer task 0" in user else ('```json\n{"score": 4, "durable_lesson": "l"}\n```', None)
        return "<think>hm</think> an answer", None

    return model


@pytest.mark.parametrize("profile", ["audit", "core"])
def test_live_run(spark, profile, tmp_path):
    rows = [(i, i, "core" if profile == "core" else "grounded", 6, None, True, [f"https://{i}.org/x", f"https://{i}.org/y"]) for i in ("good", "lazy", "lost")]
    rows = [(i, i, f"{f} lazy" if i == "lazy" else f, *x) for i, _, f, *x in rows] + [("odd", "odd", " ", 6, None, True, ["https://a.org"])]
    asked = specs.check(spark.createDataFrame(rows, "identity_id string, identity string, function string, rounds int, target string, zero_cost boolean, sources array<string>"))
    pages = [(i, k, ("http" if i == "lost" else "https") + f"://{i}.org/{'xy'[k]}", f"<html><body><p>{TEXT}</p></body></html>") for i in ("good", "lazy", "lost") for k in (0, 1)]
    got = live.run_live(asked, spark.createDataFrame(pages, "identity_id string, source_ord int, url string, html string"), responder.answering(knowing()), profile)
    assert {(r.identity_id, r.step, r.error) for r in got["failures"].collect()} == {
        ("odd", "specification", "identity and function are required"), ("lost", "sources", "no sources could be acquired"), ("lazy", "curriculum", "too few rounds")}
    assert {r.step: r.n for r in got["failed_by_step"].collect() if r.n} == {"specification": 1, "sources": 1, "curriculum": 1}
    (q,) = got["qualification"].collect()
    caps = sorted(got["capabilities"].collect(), key=lambda r: r.cap_ord)
    assert (q.identity_id, q.outcome, q.transfer_scores) == ("good", "CONDITIONAL PASS", [4, 4])
    if profile == "audit":
        assert [(c.cap_id, c.critical) for c in caps] == [("security_policies", True), ("queues_messages", True), ("table_rows", True)]
        assert [(c.score, c.observations) for c in caps] == [(4, 4), (4, 2), (4, 2)] and q.transfer_profile_ready  # 3, then 3.5 -> 4
    else:
        assert len(caps) == 10 and q.ready
    art = {r.name: r.content for r in got["artifacts"].collect()}
    assert sorted(art) == sorted(render.ARTIFACTS) and art["SOURCE_EXCERPTS.md"].count("<SOURCE ") == 2
    said, audit = json.loads(art["QUALIFICATION.json"]), json.loads(art["TRAINING_AUDIT.json"])
    assert sorted(audit) == ["curriculum", "rounds", "source_evidence", "spec", "transfers"] and len(audit["curriculum"]) == 6 and audit["rounds"][0]["answer"] == "an answer"
    if profile == "core":  # the model makes the capsule
        assert art["IDENTITY_CAPSULE.md"] == "an answer" and said["external_bootcamp_pass"] and len(said["capabilities"]) == 10 and {"model", "evaluation_type", "remaining_uncertainty", "source_evidence"} < set(said)
    else:
        assert "https://good.org/x" in art["IDENTITY_CAPSULE.md"] and said["training_package_ready"] is q.ready and said["capability_proxy_evidence"][0]["proxy_score"] == 4
    assert [c["case"] for c in json.loads(art["REGRESSION_SET.json"])["cases"]] == ["case"] and ("**Training rounds:** 6 " if profile == "core" else "6/6") in art["SUMMARY.md"]
    sink.publish(got["artifacts"], str(tmp_path / "out"))
    assert {(r.identity_id, r.name): r.content.strip() for r in sink.published(spark, str(tmp_path / "out")).collect()} == {("good", n): c.strip() for n, c in art.items()}
    if profile == "core":
        with pytest.raises(RuntimeError, match="odd: specification"):
            live.run_live(asked, spark.createDataFrame(pages, "identity_id string, source_ord int, url string, html string"), responder.answering(knowing()), profile, strict=True)
        with pytest.raises(RuntimeError, match=r"lost: sources: .*\(2 failed, 1 may\)"):
            live.run_live(asked, spark.createDataFrame(pages, "identity_id string, source_ord int, url string, html string"), responder.answering(knowing()), profile, most_failures=1)


def test_scores_over_a_stream(spark, tmp_path):
    from gradeloom.streaming.scores import running_scores

    r = random.Random(9)
    rows = [(k % 5, k, r.randint(0, 4)) for k in range(60)]
    for part in (rows[:25], rows[25:]):  # in order
        spark.createDataFrame(part, "k int, i int, score int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("k int, i int, score int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_scores(files, ["k"], "k int", "i", "score").writeStream.outputMode("update").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for x in spark.table("scores").collect():
        last[x.k] = max(last.get(x.k, (0, 0)), (x.observations, x.score))
    want = scoring.running_score(spark.createDataFrame(rows, "k int, i int, score int"), ["k"], ["i"]).collect()
    assert last == {x.k: (x.observations, x.score) for x in want}


def test_calls():
    asked = {"system": "s", "user": "u", "temperature": 0.1, "max_tokens": 900, "json_mode": True, "first_tokens": 400, "second_tokens": 800, "first_seconds": 180, "second_seconds": 300}
    sent, waits = [], []

    def post(said):
        def one(body, seconds):
            sent.append((body["max_tokens"], seconds, "response_format" in body))
            x = said.pop(0)
            if isinstance(x, Exception):
                raise x
            return {"choices": [{"message": {"content": x[0]}, "finish_reason": x[1]}]}

        return one

    assert responder.call(post([("{", "length"), ("{}", "stop")]), asked, sleep=waits.append) == ("{}", None)
    assert sent == [(400, 180, True), (800, 300, True)] and waits == []
    assert responder.call(post([OSError("down"), OSError("down")]), asked, sleep=waits.append) == (None, "OSError: down") and waits == [2, 4]
    sent.clear()
    assert responder.call(post([OSError(), OSError(), ("x", "length")]), asked, core=True, sleep=waits.append) == ("x", None)
    assert sent == [(900, 180, False)] * 3 and waits == [2, 4, 2, 4]


def test_runs_that_cost_are_refused(tmp_path):
    event = tmp_path / "e.json"
    event.write_text('{"repository": {"private": true}}')
    for env in ({"ZERO_COST": "false"}, {"GITHUB_EVENT_PATH": str(event)}):
        with pytest.raises(RuntimeError):
            responder.assert_zero_cost(env)
    event.write_text('{"repository": {"private": false}}')
    responder.assert_zero_cost({"ZERO_COST": "TRUE", "GITHUB_EVENT_PATH": str(event)})


def test_load_spec():
    row = specs.load('{"identity": "A", "function": "f", "sources": ["https://a.org", 3], "rounds": "7", "extra": 1}')
    assert (row["identity"], row["rounds"], row["zero_cost"], row["sources"], row["target"]) == ("A", 7, True, ["https://a.org", "3"], None)
    with pytest.raises(ValueError):
        specs.load("[1]")


def test_entry_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events", "labels", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert entry.entry(spark).columns == ["item_id", "doc_id"]
    sql = entry.oracle_sql()
    for name, q in entry.queries().items():
        if name.startswith("q_") and name in sql:
            df, rel = q(spark, sf), con.sql(sql[name])
            order = sorted(df.columns)
            assert order == sorted(rel.columns), name
            mine = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
            at = [rel.columns.index(c) for c in order]
            assert mine == sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall()), name
