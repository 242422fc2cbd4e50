"""Artifacts: capsules, regression sets, learned state; sink.py publishes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, truncate
from ..operators.grounding import tail

STATE_CHARS = 6_000


def learned_state(function: Column, snapshot: Column, lessons: Column, last: int = 16) -> Column:
    """A student's state of the core profile: function, scores, and the last lessons as a list."""
    recent = F.when(F.size(lessons) <= last, lessons).otherwise(F.slice(lessons, -last, last))
    lines = F.array_join(F.transform(recent, lambda x: F.concat(F.lit("- "), x)), "\n")
    return truncate(F.concat(F.lit("FUNCTION: "), function, F.lit("\nCAPABILITY EVIDENCE:\n"), snapshot, F.lit("\nVALIDATED LESSONS/CORRECTIONS:\n"), lines), STATE_CHARS)


def snapshot(capabilities: DataFrame) -> DataFrame:
    """A JSON text of each identity's capabilities in order."""
    rows = capabilities.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("cap_ord", "cap_id", "name", "description", "critical", "score", "observations"))).alias("c"))
    return rows.select("identity_id", F.to_json(F.transform("c", lambda x: x.dropFields("cap_ord"))).alias("snapshot"))


#: Labels of scopes that only a model has proposed.
SCOPE_STATUS = "MODEL-PROPOSED SCOPE (UNVERIFIED)"
STATE_NOTE = (
    "MODEL-PROPOSED SCOPE is UNVERIFIED beyond each exact source anchor. "
    "SOURCE-VERIFIED CORRECTIONS: none promoted automatically; consult the evidence_quote and evidence_url fields."
)


def evidence_snapshot(capabilities: DataFrame) -> DataFrame:
    """As snapshot(), with evidence, and descriptions named as scopes that are not verified."""
    item = F.struct(
        "cap_ord", F.col("cap_id").alias("id"), "name", F.coalesce("description", F.lit("")).alias("model_proposed_scope"), F.lit(SCOPE_STATUS).alias("scope_status"),
        F.coalesce("evidence_url", F.lit("")).alias("evidence_url"), F.coalesce("evidence_quote", F.lit("")).alias("evidence_quote"),
        F.coalesce("critical", F.lit(False)).alias("critical"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("observations", F.lit(0)).alias("observations"),
    )
    rows = capabilities.groupBy("identity_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    return rows.select("identity_id", F.to_json(F.transform("c", lambda x: x.dropFields("cap_ord"))).alias("snapshot"))


def source_only_state(function: Column, evidence: Column) -> Column:
    """A student's state that leaves lessons out: evidence and the note on what is not verified."""
    return truncate(F.concat_ws("\n", F.concat(F.lit("FUNCTION: "), function), F.lit("SOURCE-ANCHORED CAPABILITY EVIDENCE:"), evidence, F.lit(STATE_NOTE)), STATE_CHARS)


def regression_set(cases: DataFrame) -> DataFrame:
    """The last 20 cases of each identity, then without blanks, labelled as unverified."""
    last = tail(cases, ["identity_id"], "ord", 20).where(strip(F.col("case")) != "")
    return last.select("identity_id", "ord", "case", F.lit("PROPOSED_UNVERIFIED").alias("status"), F.lit("SAME_LOCAL_MODEL_EXAMINER").alias("provenance"))


#: The capsule's headings, in order, and what its lists say.
HEADINGS = (
    "Function", "Target Level", "Scope", "Source-Grounded Capability Notes", "Proxy Capability Evidence", "Source Routing", "Remaining Gaps",
    "Native Qualification Handoff",
)
SCOPE = "Bounded strictly by the supplied source set and external proxy exercises. It does not confer expert status or qualification by itself."
NO_NOTES, NO_EVIDENCE, NO_SOURCES = "- No capability survived exact source-evidence admission.", "- No capability evidence was produced.", "- No source URL was successfully acquired."
GAPS = (
    "- The supplied source set is bounded and does not establish exhaustive coverage of the function.",
    "- External proxy performance does not establish native competence.",
    "- Capability descriptions have exact source anchors only, in bounded samples of the sources.",
    "- Corrections of the examiner are hypotheses and are not promoted into this capsule.",
)
HANDOFF = "Native identity qualification has NOT been run. A native session that has read an audited version of this capsule is to be evaluated cold, on representative, adversarial, correction-handling and novel tasks."
PROVISIONAL = "- Single-observation or weak proxy capabilities remain provisional: "


def _lines(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    """The lines (arrays of them, null where there are none) of each identity in order."""
    got = rows.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("o"), line.alias("l"))))).alias("x"))
    return got.select("identity_id", F.flatten("x.l").alias(name))


def capsule(specs: DataFrame, sources: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Markdown of each identity. specs(identity_id, function, target), sources(identity_id, source_ord, url, status), capabilities(identity_id,
    cap_ord, name, description, evidence_quote, evidence_url, score, observations, status). Nothing but these is said: no
    lessons, no free text. Scopes are marked as unverified; names that are not evidenced are among the gaps."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    said = lambda c, *parts: F.when(text(F.col(c)) != "", F.concat(*parts))
    name = F.concat(F.lit("- **"), F.col("name"), F.lit("**: "))
    note = F.array_compact(F.array(
        F.concat(name, F.lit(f"{SCOPE_STATUS}: "), text(F.col("description"))), said("evidence_quote", F.lit("  - Source anchor: “"), text(F.col("evidence_quote")), F.lit("”")),
        said("evidence_url", F.lit("  - Source: "), text(F.col("evidence_url"))),
    ))
    proof = F.concat(name, F.col("status"), F.lit("; proxy score "), F.col("score"), F.lit("/4 across "), F.col("observations"), F.lit(" observation(s)."))
    parts = [
        _lines(capabilities, "cap_ord", F.when(text(F.col("description")) != "", note), "notes"), _lines(capabilities, "cap_ord", F.array(proof), "proofs"),
        _lines(capabilities, "cap_ord", F.when(F.col("status") != "PROXY_EVIDENCED", F.array("name")), "weak"),
        _lines(sources.where(F.col("url") != ""), "source_ord", F.when(F.col("status") == "ok", F.array(F.concat(F.lit("- "), F.col("url")))), "routes"),
    ]
    x = specs.select("identity_id", "function", "target")
    for part in parts:
        x = x.join(part, "identity_id", "left")
    some = lambda c, none: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(F.lit(none)))
    weak = F.when(F.size("weak") > 0, F.array(F.concat(F.lit(PROVISIONAL), F.array_join("weak", ", "), F.lit(".")))).otherwise(F.array().cast("array<string>"))
    body = [
        F.array("function"), F.array("target"), F.array(F.lit(SCOPE)), some("notes", NO_NOTES), some("proofs", NO_EVIDENCE), some("routes", NO_SOURCES),
        F.concat(F.array(*map(F.lit, GAPS)), weak), F.array(F.lit(HANDOFF)),
    ]
    lines = [F.array(F.lit("# Identity Capsule"), F.lit(""))]
    for heading, part in zip(HEADINGS, body):
        lines += [F.array(F.lit(f"## {heading}")), part, F.array(F.lit(""))]
    return x.select("identity_id", F.array_join(F.concat(*lines), "\n").alias("capsule"))


#: What a qualification is called.
PACKAGE, EVALUATION, COVERAGE = "EXTERNAL_IDENTITY_TRAINING_PACKAGE", "EXTERNAL_SEPARATE_CONTEXT_SAME_LOCAL_MODEL", "BOUNDED_TO_SUPPLIED_SOURCES_WITH_EXACT_CAPABILITY_QUOTES"
#: What a qualification leaves open.
DOUBTS = (
    "One local model plays trainer, student and examiner; only their prompts are apart.", "Proxy scores are of the simulation and say nothing of a native identity.",
    "The sources that were given cover a part of the domain.", "What examiners correct is kept for the audit and not taken into the capsule.",
)
CORE_DOUBTS = (DOUBTS[0], "Knowledge is made from bounded samples of the sources, which may leave things out.", "A fresh native session has to qualify before the identity counts as qualified.")
#: The names of the artifacts.
ARTIFACTS = ("IDENTITY_CAPSULE.md", "QUALIFICATION.json", "REGRESSION_SET.json", "TRAINING_AUDIT.json", "SUMMARY.md", "SOURCE_EXCERPTS.md")
EVIDENCE_NOTE = "Suggestions of an examiner that is the same model: hypotheses, no validated cases until they are verified independently."


def regression_artifact(specs: DataFrame, cases: DataFrame) -> DataFrame:
    """identity_id, content: the JSON text of each identity's regression_set(), with the note on its evidence."""
    rows = cases.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "case", "status", "provenance"))).alias("c"))
    x = specs.select("identity_id", "function").join(rows, "identity_id", "left")
    none = F.array().cast("array<struct<case: string, status: string, provenance: string>>")
    items = F.coalesce(F.transform("c", lambda x: x.dropFields("ord")), none)
    return x.select("identity_id", F.to_json(F.struct(F.col("identity_id").alias("identity"), "function", items.alias("cases"), F.lit(EVIDENCE_NOTE).alias("evidence_note"))).alias("content"))


def summary(specs: DataFrame, qualification: DataFrame, capabilities: DataFrame, capsules: DataFrame, done: DataFrame) -> DataFrame:
    """identity_id, content: the Markdown summary. done(identity_id, rounds_done, transfers_done)."""
    line = F.concat(F.lit("- `"), F.col("cap_id"), F.lit("`: "), F.col("status"), F.lit("; "), F.col("score"), F.lit("/4 across "), F.col("observations"), F.lit(" proxy observation(s)"))
    x = specs.select("identity_id", "function", "target", "rounds").join(qualification.select("identity_id", "ready", "condition"), "identity_id")
    x = x.join(_lines(capabilities, "cap_ord", F.array(line), "lines"), "identity_id", "left").join(capsules, "identity_id", "left").join(done, "identity_id", "left")
    field = lambda name, *value: F.concat(F.lit(f"**{name}:** "), *value, F.lit("  "))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return x.select("identity_id", F.concat_ws(
        "\n", F.concat(F.lit("# Training package: "), "identity_id"), F.lit(""), field("Function", F.col("function")), field("Target", F.col("target")),
        field("Training rounds completed", count("rounds_done"), F.lit("/"), count("rounds")), field("Transfer proxy tasks completed", count("transfers_done"), F.lit("/2")),
        field("Training package ready", F.col("ready").cast("string")), field("Native identity qualification", F.lit("NOT RUN")), F.lit("\n## Proxy capability evidence\n"),
        F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), F.lit("\n## Qualification boundary\n"), "condition", F.lit("\n## Identity capsule\n"), F.coalesce("capsule", F.lit("")),
    ).alias("content"))


def core_summary(specs: DataFrame, qualification: DataFrame, capabilities: DataFrame, capsules: DataFrame, done: DataFrame) -> DataFrame:
    """identity_id, content: the Markdown summary of the core profile."""
    line = F.concat(F.lit("- `"), F.col("cap_id"), F.lit("`: "), F.col("score"), F.lit("/4 across "), F.col("observations"), F.lit(" observation(s)"))
    x = specs.select("identity_id", "function", "target", "rounds").join(qualification.select("identity_id", "ready", "outcome", "average", "condition"), "identity_id")
    x = x.join(_lines(capabilities, "cap_ord", F.array(line), "lines"), "identity_id", "left").join(capsules, "identity_id", "left")
    field = lambda name, *value: F.concat(F.lit(f"**{name}:** "), *value, F.lit("  "))
    return x.select("identity_id", F.concat_ws(
        "\n", F.concat(F.lit("# Training result: "), "identity_id"), F.lit(""), field("Function", F.col("function")), field("Target", F.col("target")), field("Training rounds", F.col("rounds").cast("string")),
        field("External pass", F.col("ready").cast("string")), field("Project qualification outcome", F.lit("**"), F.col("outcome"), F.lit("**")), field("Transfer average", F.col("average").cast("string"), F.lit("/4")),
        F.lit("\n## Capability evidence\n"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"), F.lit("\n## Condition\n"), "condition", F.lit("\n## Identity capsule\n"), F.coalesce("capsule", F.lit("")),
    ).alias("content"))


def outcomes(qualification: DataFrame) -> DataFrame:
    """identity_id, line: the JSON line that is shown for each identity when a run ends."""
    shown = F.struct(F.col("outcome").alias("package_outcome"), F.col("ready").alias("training_package_ready"), F.col("native_status").alias("native_identity_qualification"), F.col("average").alias("transfer_proxy_average"))
    return qualification.select("identity_id", F.to_json(shown).alias("line"))

