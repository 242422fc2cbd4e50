"""Exams: coercion of an examiner's JSON, its conservative bounds, lessons and regression cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import truthy, whole
from ..functions.text import clean_list, strip, truncate
from .scoring import bound_updates, exam_passed, exam_score

#: The mark of corrections among lessons, and the lengths of texts that are kept.
CORRECTION, LESSON_CHARS, CORRECTION_CHARS, REGRESSION_CHARS = "CORRECTION: ", 500, 450, 650


def coerce(exams: DataFrame, conservative: bool = True) -> DataFrame:
    """exams(..., object: a JSON text) -> object replaced by score, passed, critical_failure, capability_updates,
    corrections, durable_lesson, regression_case, error.

    A missing score is 0, one that is no number an error; values of a wrong type count as empty. Conservative: any
    correction bounds the score by 3, updates are bounded by the score, and passing needs 3.
    """
    v = F.try_parse_json("object")
    part = lambda f, kind="variant": F.try_variant_get(v, f"$.{f}", kind)
    score = whole(part("score"))
    x = exams.withColumns({
        "__raw": F.least(F.lit(4), F.greatest(F.lit(0), F.coalesce(score, F.lit(0)))),
        "error": F.when(v.isNull(), F.lit("no object")).when(part("score").isNotNull() & score.isNull(), F.lit("invalid score")),
        "critical_failure": truthy(F.col("object"), "$.critical_failure"),
        "corrections": F.coalesce(F.transform(part("corrections", "array<variant>"), lambda c: F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))), F.array().cast("array<string>")),
        "capability_updates": F.coalesce(F.transform_values(part("capability_updates", "map<string,variant>"), lambda k, c: whole(c)), F.create_map().cast("map<string,int>")),
        "durable_lesson": strip(F.coalesce(part("durable_lesson", "string"), F.lit(""))),
        "regression_case": strip(F.coalesce(part("regression_case", "string"), F.lit(""))),
        "__said": F.when(part("passed").isNotNull(), truthy(F.col("object"), "$.passed")),
    })
    x = x.withColumn("score", exam_score(F.col("__raw"), F.col("corrections")) if conservative else F.col("__raw"))
    x = x.withColumn("passed", exam_passed(F.col("__said"), F.col("score")) if conservative else F.coalesce("__said", F.col("score") >= 3))
    if conservative:
        x = x.withColumn("capability_updates", bound_updates(F.col("capability_updates"), F.col("score")))
    return x.drop("object", "__raw", "__said")


def lessons(exams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sub, lesson: the lesson of a passed exam, then its corrections that aren't blank."""
    own = F.when(F.col("passed") & (F.col("durable_lesson") != ""), truncate(F.col("durable_lesson"), LESSON_CHARS))
    fixes = F.transform(clean_list(F.col("corrections")), lambda c: F.concat(F.lit(CORRECTION), truncate(c, CORRECTION_CHARS)))
    return exams.select(*keys, F.posexplode(F.concat(F.array_compact(F.array(own)), fixes)).alias("sub", "lesson"))


def regression_cases(exams: DataFrame, keys: list[str], case: Column | None = None) -> DataFrame:
    return exams.where("regression_case <> ''").select(*keys, truncate(F.col("regression_case") if case is None else case, REGRESSION_CHARS).alias("case"))
