"""Validators: canonical conversations, trajectories, tool schemas and call arguments; gates over records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

ROLES = ("system", "user", "assistant", "tool")
KINDS = {"object": dict, "string": str, "array": list, "boolean": bool, "null": type(None)}


def canonical_problems(messages: list[dict], tools: list[dict]) -> list[str]:
    """Codes of broken invariants: roles, unique tool names and call ids, known tools and calls."""
    out = [] if messages else ["NO_MESSAGES"]
    names = [t["name"] for t in tools]
    if len(set(names)) < len(names):
        out.append("DUPLICATE_TOOL")
    known: set[str] = set()
    for at, m in enumerate(messages):
        if m.get("role") not in ROLES:
            out.append(f"BAD_ROLE: {at}")
        if m.get("content") is not None and not isinstance(m["content"], str):
            out.append(f"BAD_CONTENT: {at}")
        for call in m.get("tool_calls") or []:
            if call["name"] not in names:
                out.append(f"UNKNOWN_TOOL: {call['name']}")
            if call["id"] in known:
                out.append(f"DUPLICATE_CALL: {call['id']}")
            known.add(call["id"])
        if m.get("role") == "tool" and m.get("tool_call_id") not in known:
            out.append(f"UNKNOWN_CALL: {m.get('tool_call_id')}")
    return out


def schema_problems(schema, path: str = "$") -> list[str]:
    """Codes of a parameter schema that is not in the supported subset."""
    if not isinstance(schema, dict):
        return [f"SCH_NOT_OBJECT: {path}"]
    kinds = schema.get("type", "object")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    out = [f"SCH_TYPE: {path}" for k in kinds if k not in (*KINDS, "number", "integer")]
    properties = schema.get("properties", {})
    if not isinstance(properties, dict):
        return [*out, f"SCH_PROPERTIES: {path}"]
    required = schema.get("required", [])
    if not isinstance(required, list) or any(r not in properties for r in required):
        out.append(f"SCH_REQUIRED: {path}")
    if "enum" in schema and not isinstance(schema["enum"], list):
        out.append(f"SCH_ENUM: {path}")
    for name, inner in properties.items():
        out += schema_problems(inner, f"{path}.{name}")
    return out + (schema_problems(schema["items"], f"{path}[]") if "items" in schema else [])


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS.get(kind, object))


def argument_problems(value, schema: dict, path: str = "$") -> list[str]:
    """Codes of a value that does not fit its schema; a bool is not a number."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"ARG_TYPE: {path}"]
    out = [f"ARG_ENUM: {path}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"ARG_MISSING: {path}.{r}" for r in schema.get("required", []) if r not in value]
        for name, inner in value.items():
            if name in properties:
                out += argument_problems(inner, properties[name], f"{path}.{name}")
            elif properties and schema.get("additionalProperties") is False:
                out.append(f"ARG_UNKNOWN: {path}.{name}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for at, inner in enumerate(value):
            out += argument_problems(inner, schema["items"], f"{path}[{at}]")
    return out


def trajectory_problems(messages: list[dict], tools: list[dict], supervision: str = "COMPLETE_TRAJECTORY") -> list[str]:
    """Codes of a trajectory that can't be trained on: calls and results in turn, arguments that fit, an end."""
    schemas = {t["name"]: t.get("parameters") or {} for t in tools}
    out, waiting, last = [], [], None
    for at, m in enumerate(messages):
        role = m.get("role")
        if role == "tool":
            if not waiting:
                out.append(f"RESULT_WITHOUT_CALL: {at}")
            elif m.get("tool_call_id") != waiting[0]:
                out.append(f"RESULT_ORDER: {at}")
                waiting = [w for w in waiting if w != m.get("tool_call_id")]
            else:
                waiting.pop(0)
        elif waiting:
            out.append(f"CALL_WITHOUT_RESULT: {at}")
            waiting = []
        if role == "system" and at:
            out.append(f"LATE_SYSTEM: {at}")
        if role == last and role in ("user", "assistant"):
            out.append(f"REPEATED_ROLE: {at}")
        for call in (m.get("tool_calls") or []) if role == "assistant" else []:
            waiting.append(call["id"])
            if call["name"] in schemas:
                out += [f"{p} of {call['name']}" for p in argument_problems(call["arguments"], {"type": "object", **schemas[call["name"]]})]
        if role == "assistant" and not m.get("tool_calls") and not (m.get("content") or "").strip():
            out.append(f"EMPTY_ASSISTANT: {at}")
        last = role
    if not any(m.get("role") == "user" for m in messages):
        out.append("NO_USER")
    if last != "assistant":
        out.append("NO_FINAL_ASSISTANT")
    elif waiting and supervision != "CALL_PREDICTION":
        out.append("OPEN_FINAL_CALL")
    return out


@F.pandas_udf(ArrayType(StringType()))
def trajectory_issues(messages: pd.Series, tools: pd.Series, supervision: pd.Series) -> pd.Series:
    """Issues of canonical rows (JSON messages and tools)."""
    return pd.Series([trajectory_problems(json.loads(m), json.loads(t), s) if m and t else ["NO_ROW"] for m, t, s in zip(messages, tools, supervision, strict=True)])


def issue_counts(rows: DataFrame, issues: str = "issues") -> DataFrame:
    """(code, rows, n): how many rows have a code and how often; OK for rows without any."""
    each = rows.withColumn("__r", F.monotonically_increasing_id()).select("__r", F.explode(F.when(F.size(issues) > 0, F.transform(issues, lambda i: F.substring_index(i, ":", 1))).otherwise(F.array(F.lit("OK")))).alias("code"))
    return each.groupBy("code").agg(F.count_distinct("__r").alias("rows"), F.count("*").alias("n"))


def first_gate(rows: DataFrame) -> DataFrame:
    """``gate``: the first of contamination, supervision and trajectory that stops a row, null if none does."""
    gate = F.when(~F.coalesce(F.col("contamination_status"), F.lit("UNASSESSED")).isin("CLEAN"), "CONTAMINATION").when(~F.coalesce(F.col("supervision"), F.lit("")).isin("COMPLETE_TRAJECTORY", "CALL_PREDICTION"), "SUPERVISION").when(F.size("issues") > 0, "TRAJECTORY")
    return rows.withColumn("gate", gate)


def small_groups(rows: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Counterfactual groups with too few members."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)


def reference_problems(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(rows.columns)
