"""A whole run with a model: every step asks for all identities at once, and its responses are kept before the next one.

Rounds depend on the scores of those before, so there is one pass for each round number, a dozen at most. An identity
that a step fails for leaves with a row in failures; in strict mode, or with more failures than are allowed, the run ends.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import written
from ..operators import capabilities as C
from ..operators import curriculum as U
from ..operators import exams as E
from ..operators import scoring
from ..sources import fetch, html
from ..sources import specs as spec_files
from . import prompts, render, responder, sink
from .run import coerced, observed, run

KNOWLEDGE_CHARS = 9_000
#: Lessons that are kept for later rounds and for the distiller, and characters of them that the distiller sees.
LESSONS, LESSON_CHARS = 20, 7_000


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the folder that the session names."""
    return written(df, "live")


def transfer_tasks(rows: DataFrame, caps: DataFrame, tasks: DataFrame, respond: responder.Responder) -> tuple[DataFrame, DataFrame]:
    """rows(identity_id, function, snapshot), training tasks -> the two transfers of each identity, and (identity_id, error). The first has one
    attempt, the second two; a scenario that is known, whatever its case and white space, is none. The second one is adversarial."""
    accepted, failures = None, None
    for number in (1, 2):
        prior, found = tasks.select("identity_id", "round_no", "task"), None
        if accepted is not None:
            prior = prior.unionByName(accepted.select("identity_id", (F.col("round_no") + 1_000).alias("round_no"), "task"))
        listed = prior.groupBy("identity_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("round_no", "task")))["task"]).alias("prior"))
        for attempt in range(1, number + 1):
            asking = rows.join(listed, "identity_id")
            if found is not None:
                asking = asking.join(found.select("identity_id"), "identity_id", "left_anti")
            said = responder.complete_json(prompts.transfer_designer(asking, number, attempt), respond, kept)
            one = U.validate(U.parse_tasks(said).withColumn("rounds", F.lit(1)), caps).where("error is null").drop("error", "rounds")
            one = U.strengthen_rubrics(one.withColumn("adversarial", F.lit(number == 2)), caps)
            one = one.withColumns({"text": F.col("task"), "attempt": F.lit(attempt)})
            new = U.first_fresh(one, prior.select("identity_id", F.col("task").alias("text")), T.normalize_task(F.col("text")), attempt).drop("text", "attempt")
            found = kept(new if found is None else found.unionByName(new))
        bad = rows.join(found.select("identity_id"), "identity_id", "left_anti").select("identity_id", F.lit(f"no usable transfer exam {number}").alias("error"))
        failures = bad if failures is None else failures.unionByName(bad)
        rows, found = rows.join(found.select("identity_id"), "identity_id", "left_semi"), found.withColumn("round_no", F.lit(number))
        accepted = found if accepted is None else accepted.unionByName(found)
    return accepted.join(rows.select("identity_id"), "identity_id", "left_semi"), failures


def run_live(specs: DataFrame, pages: DataFrame, respond: responder.Responder, profile: str = "audit", strict: bool = False, model: str = "", most_failures: int | None = None) -> dict[str, DataFrame]:
    """specs as of check(), pages(identity_id, source_ord, url, html, or body as of fetched()) -> what run() gives, failures(identity_id, step, error) and
    failed_by_step(step, n). More failures than ``most_failures`` (strict: any) end the run."""
    core, failures, counts = profile == "core", None, {}
    most = 0 if strict else most_failures

    def failed(step: str, rows: DataFrame) -> None:
        """Keeps the failures of a step; how many there are is observed while they are written."""
        nonlocal failures
        seen, said = Observation(f"failed {step}"), F.concat_ws(": ", "identity_id", "step", "error")
        rows = rows.select("identity_id", F.lit(step).alias("step"), "error").observe(seen, F.count(F.lit(1)).alias("n"), F.min(said).alias("first"))
        rows = kept(rows)
        counts[step] = seen.get["n"]
        if most is not None and sum(counts.values()) > most:
            raise RuntimeError(f"{seen.get['first']} ({sum(counts.values())} failed, {most} may)")
        failures = rows if failures is None else failures.unionByName(rows)

    failed("specification", specs.where(F.size("violations") > 0).select("identity_id", F.array_join("violations", "; ").alias("error")))
    specs = kept(specs.where(F.size("violations") == 0))
    acquired = html.receive(pages) if "body" in pages.columns else html.acquire(pages)
    evidence = kept(html.source_evidence(acquired, limit=3_200 if core else 1_500))
    packs = html.packs(evidence)
    rows = specs.join(packs, "identity_id", "left")
    failed("sources", rows.where("pack is null").select("identity_id", F.lit("no sources could be acquired").alias("error")))
    rows = kept(rows.where("pack is not null").withColumn("knowledge", F.col("pack")))
    if core:
        noted = responder.complete(prompts.notes(rows), respond, kept)
        failed("knowledge", noted.where("content is null"))
        rows = rows.drop("knowledge").join(noted.where("content is not null").select("identity_id", T.truncate(F.col("content"), KNOWLEDGE_CHARS).alias("knowledge")), "identity_id")

    said = responder.complete_json(prompts.architect(rows, core), respond, kept)
    blocks = evidence.where("status = 'ok'").select("identity_id", "url", "source_ord", F.col("sample").alias("text"))
    mapped = C.core_map(said) if core else C.grounded_map(said, blocks)
    caps = kept(mapped.where("error is null").drop("error"))
    rows = rows.join(caps.select("identity_id").distinct(), "identity_id", "left")
    failed("capabilities", rows.join(caps.select("identity_id").distinct(), "identity_id", "left_anti").select("identity_id", F.lit("too few usable capabilities").alias("error")))
    rows = kept(rows.join(caps.select("identity_id").distinct(), "identity_id", "left_semi"))

    zero = caps.withColumns({"score": F.lit(0), "observations": F.lit(0)})
    said = responder.complete_json(prompts.trainer(rows.join(render.snapshot(zero), "identity_id")), respond, kept)
    if core:
        checked = U.validate(U.parse_tasks(said).join(rows.select("identity_id", "rounds"), "identity_id"), caps)
        verdicts = U.verdicts(rows.select("identity_id", "rounds"), checked)
        planned = checked.drop("error", "rounds").unionByName(verdicts.where("error is not null"), allowMissingColumns=True)
    else:
        planned = U.grounded_curriculum(rows, said, caps)
    planned = kept(planned)
    bad = planned.where("error is not null").groupBy("identity_id").agg(F.first("error").alias("error"))
    failed("curriculum", bad)
    rows = kept(rows.join(bad.select("identity_id"), "identity_id", "left_anti"))
    tasks = kept(planned.join(rows.select("identity_id"), "identity_id", "left_semi").drop("error").withColumn("phase", F.lit("training")))

    held, responses = Held(kept(zero), None), []
    last = rows.agg(F.max("rounds")).first()[0] or 0
    for n in range(1, last + 1):
        now = tasks.where(F.col("round_no") == n)
        said = ask(rows, held, now, respond, profile, "training")
        responses.append(said)
        held = held.after(now, said, profile)
    designed = rows.join(render.snapshot(held.capabilities) if core else render.evidence_snapshot(held.capabilities), "identity_id")
    if core:
        listed = tasks.groupBy("identity_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("round_no", "task")))["task"]).alias("prior"))
        two = responder.complete_json(prompts.both_transfers(designed.join(listed, "identity_id")), respond, kept)
        checked = U.validate(U.parse_tasks(two).withColumn("rounds", F.lit(2)), caps)
        verdicts = U.verdicts(rows.select("identity_id", F.lit(2).alias("rounds")), checked)
        bad = verdicts.where("error is not null")
        late = checked.drop("error", "rounds").join(bad.select("identity_id"), "identity_id", "left_anti")
    else:
        late, bad = transfer_tasks(designed, caps, tasks, respond)
    failed("transfers", bad)
    rows = kept(rows.join(bad.select("identity_id"), "identity_id", "left_anti"))
    every = kept(tasks.unionByName(late.withColumn("phase", F.lit("transfer")), allowMissingColumns=True).join(rows.select("identity_id"), "identity_id", "left_semi"))
    responses.append(ask(rows, held, every.where("phase = 'transfer'"), respond, profile, "transfer"))
    distil = (lambda *parts: distilled(rows, respond, *parts)) if core else None
    out = run(specs.join(rows.select("identity_id"), "identity_id", "left_semi"), caps, every, reduce(DataFrame.unionByName, responses), profile, evidence.drop("text", "sample"), packs, distil, model)
    return {**out, "failures": failures, "failed_by_step": specs.sparkSession.createDataFrame(sorted(counts.items()), "step string, n long")}


@dataclass
class Held:
    """What identities have when a round begins: capabilities with their scores, and in the core profile the last lessons."""

    capabilities: DataFrame
    lessons: DataFrame | None

    def after(self, tasks: DataFrame, responses: DataFrame, profile: str) -> Held:
        """With a round's responses merged in; those of earlier rounds aren't read."""
        exams = coerced(tasks, responses, profile)
        caps = kept(scoring.merge_scores(self.capabilities, observed(self.capabilities, exams), ["identity_id", "cap_id"], ["seq", "sub"]))
        if profile != "core":
            return Held(caps, None)
        new = E.lessons(exams, ["identity_id", "round_no"]).groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("round_no", "sub", "lesson")))["lesson"].alias("lessons"))
        if self.lessons is not None:
            none, before = F.array().cast("array<string>"), self.lessons.withColumnRenamed("lessons", "before")
            both = F.concat(F.coalesce("before", none), F.coalesce("lessons", none))
            new = before.join(new, "identity_id", "full").select("identity_id", F.when(F.size(both) > LESSONS, F.slice(both, -LESSONS, LESSONS)).otherwise(both).alias("lessons"))
        return Held(caps, kept(new))


def distilled(rows: DataFrame, respond: responder.Responder, specs: DataFrame, caps: DataFrame, lessons: DataFrame, result: DataFrame) -> DataFrame:
    """identity_id, capsule: what the model makes of the evidence (core profile); identities without a response have none."""
    said = lessons.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("round_no", "sub", "lesson")))["lesson"].alias("lessons"))
    told = F.coalesce("lessons", F.array().cast("array<string>"))
    told = F.array_join(F.transform(F.when(F.size(told) > LESSONS, F.slice(told, -LESSONS, LESSONS)).otherwise(told), lambda x: F.concat(F.lit("- "), x)), "\n")
    decided = result.select("identity_id", F.to_json(F.struct(*[c for c in result.columns if c != "identity_id"])).alias("qualification"))
    x = rows.select("identity_id", "function", "target", "knowledge").join(render.snapshot(caps), "identity_id", "left").join(said, "identity_id", "left").join(decided, "identity_id")
    x = x.withColumns({"snapshot": F.coalesce("snapshot", F.lit("[]")), "told": T.truncate(told, LESSON_CHARS)})
    capsules = responder.complete(prompts.distiller(x), respond, kept)
    return capsules.select("identity_id", F.col("content").alias("capsule"))


def ask(rows: DataFrame, held: Held, now: DataFrame, respond: responder.Responder, profile: str, phase: str) -> DataFrame:
    """Responses to the tasks of now: each answered from one state, then examined."""
    core = profile == "core"
    if core:
        none, told = F.array().cast("array<string>"), held.lessons if held.lessons is not None else rows.select("identity_id", F.array().cast("array<string>").alias("lessons"))
        x = rows.join(render.snapshot(held.capabilities), "identity_id", "left").join(told, "identity_id", "left")
        state = render.learned_state(F.col("function"), F.coalesce("snapshot", F.lit("[]")), F.coalesce("lessons", none))
    else:
        x = rows.join(render.evidence_snapshot(held.capabilities), "identity_id", "left")
        state = render.source_only_state(F.col("function"), F.coalesce("snapshot", F.lit("[]")))
    facing = x.select("identity_id", "function", "rounds", "knowledge", state.alias("state")).join(now, "identity_id")
    answered = responder.complete(prompts.student(facing) if phase == "training" else prompts.transfer_student(facing), respond, kept)
    graded = facing.join(answered.select("identity_id", "round_no", F.col("content").alias("answer")), ["identity_id", "round_no"])
    said = responder.complete_json(prompts.examiner(graded, core), respond, kept)
    return kept(said.join(answered.select("identity_id", "round_no", F.col("content").alias("answer")), ["identity_id", "round_no"]).select("identity_id", F.lit(phase).alias("phase"), "round_no", "object", "answer"))


def main(arguments: list[str] | None = None) -> int:
    """A run from the shell: specifications, sources from their URLs, a model server, artifacts. 0 if no identity failed."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("specs", help="folder or file of specifications")
    p.add_argument("out", help="folder in which the set of artifacts is published")
    p.add_argument("--ledger", required=True, help="folder of the responses, which a later run uses again")
    p.add_argument("--url", default=os.environ.get("LLM_URL", "http://127.0.0.1:8080/v1/chat/completions"))
    p.add_argument("--model", default=os.environ.get("MODEL_NAME", "local"))
    p.add_argument("--profile", default="audit", choices=("core", "conservative", "audit"))
    p.add_argument("--strict", action="store_true", help="end at the first failure")
    given = p.parse_args(arguments)
    responder.assert_zero_cost()
    spark = SparkSession.builder.getOrCreate()
    asked = spec_files.check(spec_files.scan(spark, given.specs))
    pages = kept(fetch.fetched(asked.where(F.size("violations") == 0).select("identity_id", F.posexplode("sources").alias("source_ord", "url"))))
    answers = responder.Ledger(spark, given.ledger).through(responder.live(given.url, given.model, given.profile == "core"))
    got = run_live(asked, pages, answers, given.profile, given.strict, model=given.model)
    sink.publish(kept(got["artifacts"]), given.out)
    for r in got["outcomes"].toLocalIterator():
        print(r["line"], flush=True)
    failed = got["failures"].orderBy("identity_id").limit(100).collect()
    for r in failed:
        print(f"{r['identity_id']}: {r['step']}: {r['error']}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
