"""A run over recorded exams: all identities at once, from checked specifications to artifacts.

With the examiner's responses recorded, rounds need no loop: scores are one ordered fold over all observations, those
of the transfers after those of the training. live.py asks a model round by round and ends here too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exams as E
from ..operators import gates, scoring
from . import render

NO_SOURCES = "identity_id string, source_ord int, url string, status string"


def observed(capabilities: DataFrame, exams: DataFrame) -> DataFrame:
    """The observations of coerced exams(identity_id, seq, score, capability_updates, capability_ids) on known capabilities."""
    known = capabilities.groupBy("identity_id").agg(F.collect_set("cap_id").alias("known_ids"))
    return scoring.observations(exams.join(known, "identity_id"))


def scored(capabilities: DataFrame, exams: DataFrame) -> DataFrame:
    """capabilities(identity_id, cap_id, ...) with score, observations and status after the exams."""
    last = scoring.running_score(observed(capabilities, exams), ["identity_id", "cap_id"], ["seq", "sub"])
    zero = F.lit(0)
    rows = capabilities.drop("score", "observations", "status").join(last, ["identity_id", "cap_id"], "left")
    rows = rows.withColumns({"score": F.coalesce("score", zero), "observations": F.coalesce("observations", zero)})
    return rows.withColumn("status", scoring.status(F.col("score"), F.col("observations")))


def coerced(tasks: DataFrame, responses: DataFrame, profile: str) -> DataFrame:
    """Tasks with their exams, and seq, which orders training before transfers."""
    seq = F.struct((F.col("phase") == "transfer").alias("late"), "round_no")
    return E.coerce(tasks.join(responses, ["identity_id", "phase", "round_no"]).withColumn("seq", seq), conservative=profile != "core")


def run(specs: DataFrame, capabilities: DataFrame, tasks: DataFrame, responses: DataFrame, profile: str = "audit", sources: DataFrame | None = None, packs: DataFrame | None = None, distil: Callable[..., DataFrame] | None = None, model: str = "") -> dict[str, DataFrame]:
    """specs(identity_id, function, target, rounds, violations), capabilities as of grounded_map(), tasks(identity_id, phase, round_no,
    capability_ids, adversarial, ...), responses(identity_id, phase, round_no, object, ...), sources(identity_id, source_ord, url, status, ...)
    and packs(identity_id, pack); phase is "training" or "transfer". -> capabilities, history (scores after every observation),
    qualification, lessons, regressions, states, capsules, outcomes and artifacts. Identities with violations take no part. distil(specs,
    capabilities, lessons, qualification) gives the capsules, if it isn't the evidence alone that makes them.
    """
    specs = specs.where(F.size("violations") == 0)
    sources = sources if sources is not None else specs.sparkSession.createDataFrame([], NO_SOURCES)
    mine = lambda rows: rows.join(specs.select("identity_id"), "identity_id", "left_semi")
    x = mine(coerced(tasks, responses, profile))
    caps = scored(mine(capabilities), x)
    history = scoring.score_history(observed(mine(capabilities), x).withColumn("at", F.struct("seq", "sub")), ["identity_id", "cap_id"], "at")
    transfers, training = x.where("phase = 'transfer'"), x.where("phase = 'training'")
    exams = transfers.select("identity_id", F.col("round_no").alias("number"), "score", "passed", "critical_failure", "corrections", "adversarial")
    result = gates.qualify(specs, training.select("identity_id", "round_no", "critical_failure"), exams, caps, profile)
    lessons = E.lessons(training, ["identity_id", "round_no"])
    regressions = render.regression_set(E.regression_cases(training, ["identity_id", F.col("round_no").alias("ord")]))
    if profile == "core":
        said = lessons.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("round_no", "sub", "lesson")))["lesson"].alias("lessons"))
        held = specs.join(render.snapshot(caps), "identity_id", "left").join(said, "identity_id", "left")
        state = render.learned_state(F.col("function"), F.coalesce("snapshot", F.lit("[]")), F.coalesce("lessons", F.array().cast("array<string>")))
    else:
        held = specs.join(render.evidence_snapshot(caps), "identity_id", "left")
        state = render.source_only_state(F.col("function"), F.coalesce("snapshot", F.lit("[]")))
    states = held.select("identity_id", state.alias("state"))
    capsules = distil(specs, caps, lessons, result) if distil else render.capsule(specs, mine(sources), caps)
    done = x.groupBy("identity_id").agg(F.count_if(F.col("phase") == "training").alias("rounds_done"), F.count_if(F.col("phase") == "transfer").alias("transfers_done"))
    return {
        "capabilities": caps, "history": history, "qualification": result, "lessons": lessons, "regressions": regressions, "states": states, "capsules": capsules,
        "outcomes": render.outcomes(result), "artifacts": artifacts(specs, caps, x, result, regressions, capsules, done, mine(sources), packs, profile, model),
    }


def artifacts(
    specs: DataFrame, caps: DataFrame, exams: DataFrame, result: DataFrame, regressions: DataFrame, capsules: DataFrame, done: DataFrame, sources: DataFrame, packs: DataFrame | None,
    profile: str = "audit", model: str = "",
) -> DataFrame:
    """identity_id, name, content: a row for each artifact of each identity."""
    core = profile == "core"
    first = lambda l, r: F.when(l["__o"] < r["__o"], -1).when(l["__o"] > r["__o"], 1).otherwise(0)

    def listed(rows: DataFrame, order: str, item, name: str) -> DataFrame:
        return rows.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), item.alias("x"))), first)["x"].alias(name))

    def given(rows: DataFrame, *names: str) -> list:
        return [F.col(c) for c in names if c in rows.columns]

    exam = F.struct("score", "passed", "critical_failure", "capability_updates", "corrections", "durable_lesson", "regression_case")
    task = F.struct(*given(exams, "task"), "capability_ids", *given(exams, "hidden_rubric"), "adversarial", *given(exams, "critical"))
    asked = lambda label: F.struct(F.col("round_no").alias(label), task.alias("task"), *given(exams, "answer"), exam.alias("exam"))
    training, late = exams.where("phase = 'training'"), exams.where("phase = 'transfer'")
    cap = [F.col("cap_id").alias("id"), "name", F.coalesce("description", F.lit("")).alias("description")]
    if core:
        cap += ["critical", "score", "observations"]
    else:
        anchors = [F.coalesce(c, F.lit("")).alias(c) for c in ("evidence_url", "evidence_quote")]
        cap += [*anchors, F.col("score").alias("proxy_score"), F.col("observations").alias("proxy_observations"), F.col("status").alias("proxy_status"), F.coalesce("critical", F.lit(False)).alias("critical")]
    proof = "capabilities" if core else "capability_proxy_evidence"
    parts = [
        listed(caps, "cap_ord", F.struct(*cap), proof), listed(sources, "source_ord", F.struct(*[c for c in sources.columns if c not in ("identity_id", "source_ord")]), "source_evidence"),
        listed(training, "round_no", asked("round"), "rounds_done"), listed(training, "round_no", task, "curriculum"), listed(late, "round_no", asked("transfer"), "transfers"),
    ]
    x = specs.join(result, "identity_id")
    for rows in parts:
        x = x.join(rows, "identity_id", "left")
    spec = F.struct(*[c for c in specs.columns if c != "violations"])
    start = [F.col("identity_id").alias("identity"), "function", "target"]
    if core:
        decided = F.struct(
            *start, F.lit(render.EVALUATION).alias("evaluation_type"), F.lit(model).alias("model"), F.lit(True).alias("zero_cost"), F.col("rounds").alias("training_rounds"), "source_evidence", proof, "transfer_scores",
            F.col("average").alias("transfer_average"), F.col("weak_critical").alias("critical_low_capabilities"), "critical_failures", F.col("ready").alias("external_bootcamp_pass"), "outcome", "condition",
            F.array(*map(F.lit, render.CORE_DOUBTS)).alias("remaining_uncertainty"),
        )
    else:
        more = ["transfer_clean", "transfer_profile_ready", "transfer_corrections"] if profile == "audit" else []
        decided = F.struct(
            *start, F.lit(render.PACKAGE).alias("artifact_type"), F.lit(render.EVALUATION).alias("evaluation_type"), F.lit(True).alias("zero_cost"), F.col("rounds").alias("training_rounds"), F.lit(render.COVERAGE).alias("source_coverage"),
            "source_evidence", proof, F.col("transfer_scores").alias("transfer_proxy_scores"), F.col("average").alias("transfer_proxy_average"), F.col("weak_critical").alias("weak_critical_capabilities"), "critical_failures",
            F.col("ready").alias("training_package_ready"), F.col("native_status").alias("native_identity_qualification"), "outcome", "condition", F.array(*map(F.lit, render.DOUBTS)).alias("remaining_uncertainty"), *more,
        )
    audit = F.struct(spec.alias("spec"), "source_evidence", "curriculum", F.col("rounds_done").alias("rounds"), "transfers")
    named = lambda rows, k, content: rows.select("identity_id", F.lit(render.ARTIFACTS[k]).alias("name"), content.alias("content"))
    out = (
        named(capsules, 0, F.col("capsule"))
        .unionByName(named(x, 1, F.to_json(decided)))
        .unionByName(named(render.regression_artifact(specs, regressions), 2, F.col("content")))
        .unionByName(named(x, 3, F.to_json(audit)))
        .unionByName(named((render.core_summary if core else render.summary)(specs, result, caps, capsules, done), 4, F.col("content")))
    )
    return out if packs is None else out.unionByName(named(packs.join(specs.select("identity_id"), "identity_id", "left_semi"), 5, F.col("pack")))
