"""JSON objects in model responses: extraction, truth of values, integers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .workers import sent_by_value

sent_by_value(__name__)

FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)
RESULT = StructType([StructField("json", StringType()), StructField("error", StringType())])


def _balanced(s: str) -> str | None:
    """From the first brace to the one that closes it; braces in strings don't count."""
    start = s.find("{")
    if start < 0:
        return None
    depth, quoted, i = 0, False, start
    while i < len(s):
        c = s[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if not depth:
                return s[start : i + 1]
        i += 1
    return None


def find_object(text: str | None) -> tuple[str | None, str | None]:
    s = re.sub(r"<think>.*?</think>", "", text or "", flags=re.S).strip()
    s = FENCE.sub("", s).strip()
    try:
        if isinstance(v := json.loads(s), dict):
            return json.dumps(v, ensure_ascii=False), None
    except ValueError:
        pass
    if (part := _balanced(s)) is None:
        return None, "no balanced object"
    try:
        return json.dumps(json.loads(part), ensure_ascii=False), None
    except ValueError:
        return None, "invalid object"


@F.pandas_udf(RESULT)
def json_object(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find_object(t) for t in texts], columns=["json", "error"])


def truthy(doc: Column, path: str) -> Column:
    """Truth of a value of a JSON text: false if absent, null, false, zero, or empty; so "false" is true."""
    v = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    text, kind = F.to_json(v), F.schema_of_variant(v)
    zero = F.coalesce(F.try_to_number(F.trim(text), F.lit("9999999999.99")) == 0, F.lit(False)) & ~kind.isin("STRING")
    return F.coalesce(~(text.isin("null", "false", '""', "[]", "{}", "0", "0.0") | (kind == "VOID") | zero), F.lit(False))


def whole(v: Column) -> Column:
    """int() of a variant: numbers lose their fraction, texts must be whole numbers; null where neither."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    return F.when(kind == "STRING", F.trim(text).try_cast("int")).when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).otherwise(text.try_cast("double").cast("int"))


def integer(doc: Column, path: str) -> Column:
    """whole() of a value of a JSON text."""
    return whole(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
