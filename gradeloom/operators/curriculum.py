"""Curricula: validation, rubric repair, coverage repair."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonx import truthy
from ..functions.text import clean_list, strip, weak_rubric
from ..functions.workers import sent_by_value

sent_by_value(__name__)

#: The texts that repaired rubrics carry.
NAMES_CHECK = "Correctly address the assigned capability: "
NEEDS_CHECK = "Demonstrate the source-bounded requirement: "
FACTS_GUARD = "Do not introduce unsupported facts; explicitly flag assumptions or claims not established by the supplied source evidence."
PREMISE_GUARD = "Detect and reject any material false premise or unsafe shortcut instead of complying with it."


#: The task that takes the place of another, and its rubric; {0} is the capability's name, {1} its description.
EVIDENCE_TASK = (
    "Independent evidence scenario for {0}: apply {1}. "
    "State the source-supported behavior, one realistic failure mode, and any material uncertainty."
)
EVIDENCE_RUBRIC = (
    "Correctly apply {0} using only the supplied source evidence.",
    "Identify a realistic failure mode or boundary without inventing unsupported behavior.",
)
TASK_FIELDS = ("task", "capability_ids", "hidden_rubric", "adversarial", "critical")


def clean_items(items: Column, most: int = 6) -> Column:
    return F.slice(clean_list(items), 1, most)


def parse_tasks(responses: DataFrame) -> DataFrame:
    """responses(identity_id, object: a JSON text) -> a row for each item of the list "rounds": identity_id, round_no (from 1), task,
    capability_ids, hidden_rubric, adversarial, critical. What is no object has no task; lists of a wrong type are null."""
    items = F.try_variant_get(F.try_parse_json("object"), "$.rounds", "array<variant>")
    rows = responses.select("identity_id", F.posexplode(items).alias("pos", "__item"))
    part = lambda f, kind: F.try_variant_get("__item", f"$.{f}", kind)
    texts = lambda f: F.transform(part(f, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    flag = lambda f: truthy(F.to_json("__item"), f"$.{f}")
    return rows.select(
        "identity_id", (F.col("pos") + 1).alias("round_no"), strip(part("task", "string")).alias("task"), texts("capability_ids").alias("capability_ids"),
        texts("hidden_rubric").alias("hidden_rubric"), flag("adversarial").alias("adversarial"), flag("critical").alias("critical"),
    )


def validate(tasks: DataFrame, capabilities: DataFrame) -> DataFrame:
    """tasks(identity_id, round_no, rounds, task, capability_ids, hidden_rubric) with rubric cleaned and error: too few
    tasks, else the first rule that a task of the first rounds breaks; extra rounds go."""
    none = F.array().cast("array<string>")
    known = capabilities.groupBy("identity_id").agg(F.collect_set("cap_id").alias("known"))
    t = tasks.where("round_no <= rounds").join(known, "identity_id", "left").withColumn("known", F.coalesce("known", none))
    unknown = F.filter("capability_ids", lambda c: ~F.array_contains("known", c))
    error = (
        F.when(strip(F.coalesce("task", F.lit(""))) == "", "blank task").when(F.size(F.coalesce("capability_ids", none)) == 0, "no capability")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown capability "), F.try_element_at(unknown, F.lit(1)))).when(F.size(F.coalesce("hidden_rubric", none)) == 0, "no rubric")
    )
    missing = F.when(F.count("*").over(Window.partitionBy("identity_id")) < F.col("rounds"), F.lit("too few rounds"))
    return t.select(*tasks.columns, F.coalesce(missing, error).alias("error")).withColumn("hidden_rubric", clean_items(F.col("hidden_rubric")))


def verdicts(specs: DataFrame, checked: DataFrame) -> DataFrame:
    """specs(identity_id, rounds) and tasks of validate() -> identity_id, error: of the first task with one, null where all are
    right; an identity without tasks has too few."""
    first = checked.groupBy("identity_id").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("round_no", "error")))["error"].alias("error"), F.lit(True).alias("some"))
    rows = specs.join(first, "identity_id", "left")
    return rows.select("identity_id", F.when(F.col("some").isNull() & (F.col("rounds") > 0), "too few rounds").otherwise(F.col("error")).alias("error"))


def unknown_ids(uses: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return uses.join(known, keys, "left_anti")


def strengthen_rubrics(tasks: DataFrame, capabilities: DataFrame, keep: int = 5) -> DataFrame:
    """Weak rubrics are replaced by checks of the tasks' capabilities; guards are added; the first keep items stay."""
    ids = tasks.select("identity_id", "round_no", F.posexplode("capability_ids").alias("pos", "cap_id"))
    known = ids.join(capabilities.select("identity_id", "cap_id", "name", "description"), ["identity_id", "cap_id"])
    known = known.groupBy("identity_id", "round_no").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "description"))).alias("c"))
    t = tasks.join(known, ["identity_id", "round_no"], "left")
    items = clean_list(F.col("hidden_rubric"))
    fresh = F.when(F.col("c").isNotNull(), F.array(
        F.concat(F.lit(NAMES_CHECK), F.array_join("c.name", ", "), F.lit(".")),
        F.concat(F.lit(NEEDS_CHECK), F.substring(F.array_join("c.description", " | "), 1, 500)),
    )).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("hidden_rubric", F.when(weak_rubric(items), fresh).otherwise(items))
    t = t.withColumn("hidden_rubric", guarded(F.col("hidden_rubric"), F.coalesce("adversarial", F.lit(False)), keep))
    return t.select(*tasks.columns)


def guarded(rubric: Column, adversarial: Column, keep: int = 5) -> Column:
    """The rubric with guards that it lacks, cut to its first items."""
    has = lambda s: F.exists(rubric, lambda x: F.lower(x).contains(s))
    more = F.array_compact(F.array(F.when(~has("unsupported"), F.lit(FACTS_GUARD)), F.when(adversarial & ~has("false premise"), F.lit(PREMISE_GUARD))))
    return F.slice(F.concat(rubric, more), 1, keep)


def coverage(tasks: DataFrame, capabilities: DataFrame) -> DataFrame:
    """How many tasks contain each critical capability."""
    uses = tasks.select("identity_id", F.explode(F.array_distinct("capability_ids")).alias("cap_id")).groupBy("identity_id", "cap_id").agg(F.count("*").alias("n_tasks"))
    return capabilities.where("critical").select("identity_id", "cap_id").join(uses, ["identity_id", "cap_id"], "left").fillna(0, ["n_tasks"])


def replacements(ids: Sequence[Sequence[str]], must: Sequence[str], least: int) -> tuple[dict[int, str], str | None]:
    """Which tasks (by index) are given to which capability, and an error. A task can go if it lacks the capability and each
    counted one that it names has more tasks than least; the last such task goes. Names count as often as listed."""
    given: dict[int, str] = {}
    held = [list(x) for x in ids]
    spare = {c: sum(c in x for x in held) - least for c in must}
    if len(must) * least > len(held):
        return given, "more critical capabilities than tasks"
    for c in must:
        while spare[c] < 0:
            free = [k for k, x in enumerate(held) if c not in x and all(spare.get(o, 1) > 0 for o in x)]
            if not free:
                return given, f"no task can give way to {c}"
            for o in held[free[-1]]:
                if o in spare:
                    spare[o] -= 1
            held[free[-1]], given[free[-1]], spare[c] = [c], c, spare[c] + 1
    return given, None


def ensure_coverage(tasks: DataFrame, critical: DataFrame, least: int = 2) -> DataFrame:
    """tasks(identity_id, round_no, task, capability_ids, hidden_rubric, adversarial, critical) so that each critical capability
    (identity_id, cap_ord, cap_id, name, description) has least tasks; with error, on all tasks of an identity that can't.

    Which tasks give way is a choice of one after the other, made in Python over an identity's dozen tasks; the tasks that
    take their place are put together by expressions.
    """
    names = critical.groupBy("identity_id").agg(F.array_sort(F.collect_list(F.struct("cap_ord", "cap_id"))).alias("c")).select("identity_id", F.col("c.cap_id").alias("must"))
    rows = tasks.select("identity_id", "round_no", "capability_ids").join(names, "identity_id", "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("round_no", kind="stable").reset_index(drop=True)
        must = pdf["must"].iloc[0]
        given, error = replacements(list(pdf["capability_ids"]), [] if must is None else list(must), least)
        return pd.DataFrame({"identity_id": pdf["identity_id"], "round_no": pdf["round_no"], "cap_id": [None if error else given.get(k) for k in range(len(pdf))], "error": error})

    kind = dict(tasks.dtypes)
    chosen = rows.groupBy("identity_id").applyInPandas(choose, f"identity_id {kind['identity_id']}, round_no {kind['round_no']}, cap_id string, error string")
    x = tasks.join(chosen, ["identity_id", "round_no"]).join(critical.select("identity_id", "cap_id", "name", "description"), ["identity_id", "cap_id"], "left")
    new = F.col("cap_id").isNotNull()
    filled = lambda s: F.replace(F.replace(F.lit(s), F.lit("{0}"), F.col("name")), F.lit("{1}"), F.col("description"))
    adversarial = F.coalesce("adversarial", F.lit(False))
    fresh = {
        "task": filled(EVIDENCE_TASK), "capability_ids": F.array("cap_id"), "hidden_rubric": guarded(F.array(*map(filled, EVIDENCE_RUBRIC)), adversarial),
        "adversarial": adversarial, "critical": F.lit(True),
    }
    return x.select(*[F.when(new, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in tasks.columns], "error")


def grounded_curriculum(specs: DataFrame, responses: DataFrame, capabilities: DataFrame, least: int = 2) -> DataFrame:
    """specs(identity_id, rounds) and responses(identity_id, object) -> tasks that are valid, with stronger rubrics and with each critical
    capability covered; and a row with an error for each identity that has none."""
    checked = validate(parse_tasks(responses).join(specs.select("identity_id", "rounds"), "identity_id"), capabilities)
    said = verdicts(specs.select("identity_id", "rounds"), checked)
    good = checked.drop("error", "rounds").join(said.where("error is null").select("identity_id"), "identity_id", "left_semi")
    covered = ensure_coverage(strengthen_rubrics(good, capabilities), capabilities.where("critical"), least)
    return covered.unionByName(said.where("error is not null"), allowMissingColumns=True)


def duplicate_tasks(candidates: DataFrame, accepted: DataFrame, key: Column) -> DataFrame:
    """Candidates whose normalised text no accepted task has (identity_id, text)."""
    seen = accepted.select("identity_id", key.alias("__k")).distinct()
    return candidates.withColumn("__k", key).join(seen, ["identity_id", "__k"], "left_anti").drop("__k")


def first_fresh(candidates: DataFrame, accepted: DataFrame, key: Column, attempts: int) -> DataFrame:
    """Of candidates(identity_id, attempt, text, ...) the first of so many attempts that no accepted task equals."""
    fresh = duplicate_tasks(candidates.where(F.col("attempt") <= attempts), accepted, key)
    w = Window.partitionBy("identity_id").orderBy("attempt")
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
