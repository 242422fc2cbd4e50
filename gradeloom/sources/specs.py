"""Training specifications: defaults, and the rules that each breaks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import safe_url
from ..functions.workers import sent_by_value

sent_by_value(__name__)

#: Limits and defaults of a specification.
LEAST_ROUNDS, MOST_ROUNDS, MOST_SOURCES, ROUNDS, TARGET = 6, 12, 12, 10, "practitioner"


def cut_bytes(content: Column, most: int = 1_500_000) -> Column:
    """Text of the first bytes of a binary column; broken characters are replaced."""
    return F.make_valid_utf8(F.substring(content, 1, most).cast("string"))


def _scalar(s: str):
    """A plain or quoted value, or a list or a mapping in JSON or in brackets."""
    s = s.strip()
    if s[:1] in ("'", '"'):
        end = re.match(r"""'((?:[^']|'')*)'|"((?:[^"\\]|\\.)*)\"""", s)
        if not end or s[end.end() :].strip()[:1] not in ("", "#"):
            raise ValueError(f"unclosed or stray text: {s}")
        return end[1].replace("''", "'") if end[1] is not None else json.loads(f'"{end[2]}"')
    s = re.sub(r"(^|\s)#.*$", "", s).strip()
    if s[:1] in ("[", "{"):
        try:
            return json.loads(s)
        except ValueError:
            if s[0] == "[" and s[-1] == "]" and not re.search(r"[\[\]{}\"']", s[1:-1]):
                return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
            raise ValueError(f"neither a list nor a mapping: {s}") from None
    if s[:1] in ("&", "*", "!", "|", ">", "@", "`", "%"):
        raise ValueError(f"not supported: {s}")
    known = {"": None, "~": None, "null": None, "true": True, "false": False, "yes": True, "no": False, "on": True, "off": False}
    if s.lower() in known:
        return known[s.lower()]
    return int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s) if re.fullmatch(r"[+-]?\d+\.\d+", s) else s


def mapping(text: str) -> dict:
    """A document of block mappings, block lists and scalars: the part of YAML that specifications use. Anything else is an error."""
    lines = []
    for n, raw in enumerate(text.splitlines(), 1):
        if raw.strip() and not raw.lstrip().startswith("#") and raw.strip() not in ("---", "..."):
            if "\t" in raw[: len(raw) - len(raw.lstrip())]:
                raise ValueError(f"line {n}: a tab before the text")
            lines.append((len(raw) - len(raw.lstrip()), raw.strip(), n))

    def block(k: int, depth: int):
        """What begins at line k with that many spaces before it, and the line after it."""
        listed = lines[k][1] == "-" or lines[k][1].startswith("- ")
        out = [] if listed else {}
        while k < len(lines) and lines[k][0] == depth and (lines[k][1] == "-" or lines[k][1].startswith("- ")) == listed:
            _, said, n = lines[k]
            if listed:
                said = said[1:].strip()
                if re.match(r"[^\s'\"\[{#][^:#]*:(\s|$)", said):
                    raise ValueError(f"line {n}: mappings in lists are not supported")
                key = None
            else:
                m = re.match(r"""("[^"]*"|'[^']*'|[^\s:#'"\[{][^:#]*?)\s*:(?:\s+(.*)|$)""", said)
                if not m:
                    raise ValueError(f"line {n}: neither a key nor an item: {said}")
                key, said = m[1].strip("'\""), m[2] or ""
                if key in out:
                    raise ValueError(f"line {n}: {key} is there twice")
            k += 1
            below = k < len(lines) and (lines[k][0] > depth or (not listed and lines[k][0] == depth and lines[k][1].startswith("- ")))
            if below and not re.sub(r"(^|\s)#.*$", "", said).strip():
                value, k = block(k, lines[k][0])
            else:
                value = _scalar(said)
            if listed:
                out.append(value)
            else:
                out[key] = value
        if k < len(lines) and lines[k][0] > depth:
            raise ValueError(f"line {lines[k][2]}: unexpected indent")
        return out, k

    if not lines:
        raise ValueError("an empty specification")
    found, end = block(0, lines[0][0])
    if end < len(lines):
        raise ValueError(f"line {lines[end][2]}: unexpected indent")
    if not isinstance(found, dict):
        raise ValueError("a specification is a mapping")
    return found


def load(text: str) -> dict:
    """One specification, a JSON object or as of mapping(), as a row for check()."""
    said = json.loads(text) if text.lstrip().startswith("{") else mapping(text)
    word = lambda k: None if said.get(k) is None else str(said[k])
    given = said.get("sources")
    rounds = said.get("rounds", ROUNDS)
    return {
        "identity_id": word("identity"), "identity": word("identity"), "function": word("function"), "rounds": None if rounds is None else int(rounds),
        "target": word("target"), "zero_cost": said.get("zero_cost", True) is True, "sources": [str(x) for x in given] if isinstance(given, list) else [],
    }


ROW = "identity_id string, identity string, function string, rounds int, target string, zero_cost boolean, sources array<string>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The specifications in files at path, one a file, as rows for check(); error says why one can't be read, file where it is."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["file"], b["content"]):
                try:
                    rows.append({**load(bytes(content).decode()), "file": file, "error": None})
                except Exception as e:  # noqa: BLE001 - a file that can't be read is a row
                    rows.append({"identity_id": file, "sources": [], "zero_cost": True, "file": file, "error": f"invalid specification: {e}"})
            yield pd.DataFrame(rows, columns=[*(x.split()[0] for x in ROW.split(", ")), "file", "error"], dtype=object)

    return files.mapInPandas(read, f"{ROW}, file string, error string")


def check(specs: DataFrame) -> DataFrame:
    """specs(identity_id, identity, function, rounds, target, zero_cost, sources) -> trimmed, with defaults and
    violations: the rules that are broken, an empty array if none. identity_id is unique. The error of a scan() is one, and the only one."""
    if "error" in specs.columns:
        bad = specs.where("error is not null")
        none = F.array().cast("array<string>")
        rest = check(specs.where("error is null").drop("error", "file"))
        return rest.unionByName(bad.select(
            "identity_id", F.lit("").alias("identity"), F.lit("").alias("function"), F.lit(ROUNDS).alias("rounds"), F.lit(TARGET).alias("target"), F.lit(True).alias("zero_cost"), none.alias("sources"), F.array("error").alias("violations"),
        ))
    trimmed = lambda c: strip(F.coalesce(c, F.lit("")))
    each = specs.select("identity_id", F.posexplode("sources").alias("pos", "url")).withColumn("url", trimmed(F.col("url")))
    each = each.withColumn("bad", F.when(~safe_url(F.col("url")), F.concat(F.lit("unsafe source URL: "), "url")))
    urls = each.groupBy("identity_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "url")))["url"].alias("clean"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("bad").isNotNull(), F.struct("pos", "bad")))), lambda x: x["bad"]).alias("bad"),
    )
    none = F.array().cast("array<string>")
    x = specs.join(urls, "identity_id", "left").select(
        "identity_id", trimmed(F.col("identity")).alias("identity"), trimmed(F.col("function")).alias("function"),
        F.coalesce("rounds", F.lit(ROUNDS)).cast("int").alias("rounds"), strip(F.coalesce("target", F.lit(TARGET))).alias("target"),
        F.coalesce("zero_cost", F.lit(True)).alias("zero_cost"), F.coalesce("clean", none).alias("sources"), F.coalesce("bad", none).alias("bad"),
    )
    rules = F.array(
        F.when((F.col("identity") == "") | (F.col("function") == ""), F.lit("identity and function are required")),
        F.when(~F.col("rounds").between(LEAST_ROUNDS, MOST_ROUNDS), F.lit(f"rounds must be {LEAST_ROUNDS}..{MOST_ROUNDS}")),
        F.when(~F.col("zero_cost"), F.lit("zero_cost must be true")),
        F.when(~F.size("sources").between(1, MOST_SOURCES), F.lit(f"sources must be 1..{MOST_SOURCES} URLs")),
    )
    return x.withColumn("violations", F.concat(F.array_compact(rules), "bad")).drop("bad")
