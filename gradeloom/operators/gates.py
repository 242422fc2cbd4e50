"""Qualification gates: one row per identity, also for identities without exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .scoring import status

#: Outcomes, and what has not been run.
PASS, CONDITIONAL, FAIL, NOT_RUN = "PASS", "CONDITIONAL PASS", "FAIL", "NOT_RUN"
#: What an outcome asks for next.
NEXT_QUALIFY = "The package is to be read by a fresh native session, which has to pass its own cold and transfer qualification."
NEXT_REPAIR = "Weak capabilities are to be repaired; then transfer and native qualification are run again."
NEXT_TRAIN = "The training does not yet support a competent transfer."
NEXT_CLEAN = "One clean ordinary and one clean adversarial transfer, without corrections, are needed before a native qualification."


def _in_order(order: Column, value: Column) -> Column:
    """The values that are not null, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"])


def transfer_summary(transfers: DataFrame) -> DataFrame:
    """transfers(identity_id, number, score, passed, critical_failure, corrections, adversarial)."""
    none = F.array().cast("array<string>")
    corrections, failed = F.coalesce("corrections", none), F.coalesce("critical_failure", F.lit(False))
    clean = (F.col("score") >= 3) & F.coalesce("passed", F.lit(True)) & ~failed & (F.size(corrections) == 0)
    number = F.col("number")
    return transfers.groupBy("identity_id").agg(
        F.count("*").alias("transfers"), F.bround(F.avg("score"), 3).alias("average"), F.min("score").alias("lowest"), F.bool_and(clean).alias("all_clean"),
        _in_order(number, F.col("score").cast("int")).alias("transfer_scores"), _in_order(number, F.coalesce("adversarial", F.lit(False))).alias("profile"),
        _in_order(number, F.when(failed, F.concat(F.lit("transfer-"), number.cast("string")))).alias("failed_transfers"),
        F.flatten(_in_order(number, F.filter(corrections, lambda c: strip(c) != ""))).alias("transfer_corrections"),
    )


def qualify(specs: DataFrame, rounds: DataFrame, transfers: DataFrame, capabilities: DataFrame, profile: str = "conservative") -> DataFrame:
    """specs(identity_id, rounds), rounds(identity_id, round_no, critical_failure), transfers as above,
    capabilities(identity_id, cap_ord, cap_id, critical, score, observations) -> identity_id, ready, outcome, average, condition, native_status,
    transfer_scores, weak_critical (ids in order), critical_failures (round numbers, then transfers), transfer_clean,
    transfer_profile_ready, transfer_corrections.

    Profiles: core; conservative; audit, which is conservative and asks for clean transfers, the second one adversarial.
    """
    failed = F.when(F.coalesce("critical_failure", F.lit(False)), F.col("round_no").cast("string"))
    r = rounds.groupBy("identity_id").agg(F.count("*").alias("done"), _in_order(F.col("round_no"), failed).alias("failed_rounds"))
    if profile == "core":
        weak = (F.col("observations") == 0) | (F.col("score") < 3)
    else:
        weak = status(F.col("score"), F.col("observations")) != "PROXY_EVIDENCED"
    c = capabilities.groupBy("identity_id").agg(_in_order(F.col("cap_ord"), F.when(F.col("critical") & weak, F.col("cap_id"))).alias("weak"))
    x = specs.select("identity_id", "rounds").join(r, "identity_id", "left").join(transfer_summary(transfers), "identity_id", "left").join(c, "identity_id", "left")
    none, no = F.array().cast("array<string>"), lambda c: F.coalesce(c, F.lit(False))
    x = x.withColumns({
        "average": F.coalesce("average", F.lit(0.0)), "weak_critical": F.coalesce("weak", none),
        "critical_failures": F.concat(F.coalesce("failed_rounds", none), F.coalesce("failed_transfers", none)),
        "transfer_clean": no((F.col("transfers") == 2) & F.col("all_clean")), "transfer_profile_ready": no(F.col("profile") == F.array(F.lit(False), F.lit(True))),
        "transfer_scores": F.coalesce("transfer_scores", F.array().cast("array<int>")), "transfer_corrections": F.coalesce("transfer_corrections", none),
    })
    sound = F.size("critical_failures") == 0
    able = sound & (F.size("weak_critical") == 0)
    if profile == "core":
        ready = (F.col("average") >= 3) & able
        close = (F.col("average") >= 2.5) & sound
        outcome = F.when(ready | close, CONDITIONAL).otherwise(FAIL)
        condition = F.when(ready, NEXT_QUALIFY).when(close, NEXT_REPAIR).otherwise(NEXT_TRAIN)
    else:
        ready = no((F.col("done") == F.col("rounds")) & (F.col("done") > 0) & (F.col("transfers") == 2) & (F.col("lowest") >= 3)) & able
        condition = F.lit(NEXT_QUALIFY)
        if profile == "audit":
            clean = F.col("transfer_clean") & F.col("transfer_profile_ready")
            ready, condition = ready & clean, F.when(clean, NEXT_QUALIFY).otherwise(NEXT_CLEAN)
        outcome = F.when(ready, CONDITIONAL).otherwise(FAIL)
    return x.select(
        "identity_id", ready.alias("ready"), outcome.alias("outcome"), "average", condition.alias("condition"), F.lit(NOT_RUN).alias("native_status"),
        "transfer_scores", "weak_critical", "critical_failures", "transfer_clean", "transfer_profile_ready", "transfer_corrections",
    )


def gate(specs: DataFrame, rounds: DataFrame, transfers: DataFrame, capabilities: DataFrame, profile: str = "conservative") -> DataFrame:
    """The decision of qualify() alone."""
    return qualify(specs, rounds, transfers, capabilities, profile).select("identity_id", "ready", "outcome", "average")
