"""Capability maps of model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonx import truthy
from ..functions.text import slug, strip
from .grounding import cap_critical, exact_evidence, first_by_key, head, keep_supported

FIELDS = ("name", "description", "evidence_url", "evidence_quote")


def parse(responses: DataFrame) -> DataFrame:
    """responses(identity_id, object: a JSON text) -> identity_id, cap_ord, cap_id, name, description, evidence_url,
    evidence_quote, critical: the first of each id, in the order of the list. Items that are no objects or have no
    usable id go; a missing name is the id."""
    items = F.try_variant_get(F.try_parse_json("object"), "$.capabilities", "array<variant>")
    rows = responses.select("identity_id", F.posexplode(items).alias("cap_ord", "__item"))
    rows = rows.where(F.schema_of_variant("__item").startswith("OBJECT"))
    text = lambda f: F.try_variant_get("__item", f"$.{f}", "string")
    rows = first_by_key(rows, ["identity_id"], slug(text("id")), F.col("cap_ord")).withColumn("cap_id", slug(text("id")))
    trimmed = {f: strip(F.coalesce(text(f), F.col("cap_id") if f == "name" else F.lit(""))) for f in FIELDS}
    return rows.select("identity_id", "cap_ord", "cap_id", *[c.alias(f) for f, c in trimmed.items()], truthy(F.to_json("__item"), "$.critical").alias("critical"))


def core_map(responses: DataFrame, least: int = 5, most: int = 10) -> DataFrame:
    """The first capabilities, with an error on identities that have too few."""
    n = F.count("*").over(Window.partitionBy("identity_id"))
    rows = parse(responses).withColumn("error", F.when(n < least, F.lit("too few usable capabilities")))
    return head(rows, ["identity_id"], F.col("cap_ord"), most)


def grounded_map(responses: DataFrame, blocks: DataFrame, least: int = 3, most: int = 6, most_critical: int = 3) -> DataFrame:
    """Capabilities with exact evidence in blocks(identity_id, url, source_ord, text); the first ones, and of these the
    first critical ones stay critical."""
    rows = keep_supported(exact_evidence(parse(responses), blocks), least).drop("supported")
    return cap_critical(head(rows, ["identity_id"], F.col("cap_ord"), most), ["identity_id"], F.col("cap_ord"), most_critical)
