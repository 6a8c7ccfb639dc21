"""Source adapters: differently shaped tool-calling rows to one canonical conversation, or a reason.

Every adapter maps a raw row (a JSON text) to ``{id, tools, messages, supervision}`` or raises Reject; one
Arrow UDF applies any of them, so a corpus is normalized in a single pass with rejects beside results.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .validators import canonical_problems


class Reject(ValueError):
    """Why a row has no canonical form: ``CODE: detail``."""


def compact(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _json(value, what: str):
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except ValueError as wrong:
        raise Reject(f"BAD_JSON: {what}") from wrong


def tool_catalogue(raw) -> list[dict]:
    """Tools as name, description and parameters; exact repeats dropped."""
    out, seen = [], set()
    for tool in _json(raw, "tools") or []:
        tool = _json(tool, "tool")
        tool = tool.get("function", tool) if isinstance(tool, dict) else tool
        if not isinstance(tool, dict) or not tool.get("name"):
            raise Reject("BAD_TOOL: no name")
        made = {"name": tool["name"], "description": tool.get("description") or "", "parameters": tool.get("parameters") or {}}
        if compact(made) not in seen:
            seen.add(compact(made))
            out.append(made)
    return out


def _call(value, number: int) -> dict:
    if not isinstance(value, dict) or not isinstance(value.get("name"), str):
        raise Reject("BAD_CALL: no name")
    arguments = _json(value.get("arguments", value.get("parameters", {})), "arguments")
    if not isinstance(arguments, dict):
        raise Reject("BAD_CALL: arguments are not an object")
    return {"id": f"call_{number:04d}", "name": value["name"], "arguments": arguments}


def _row(messages: list[dict], tools, supervision: str = "COMPLETE_TRAJECTORY") -> dict:
    return {"messages": messages, "tools": tools, "supervision": supervision}


def generic(row: dict) -> dict:
    return _row([dict(m) for m in row.get("messages") or []], tool_catalogue(row.get("tools")))


def query_answers(row: dict) -> dict:
    """``query``, ``tools`` and ``answers`` (a JSON list of calls): one predicted call turn."""
    calls = [_call(c, i) for i, c in enumerate(_json(row.get("answers"), "answers") or [])]
    if not calls:
        raise Reject("NO_CALL: answers are empty")
    return _row([{"role": "user", "content": row.get("query")}, {"role": "assistant", "content": None, "tool_calls": calls}], tool_catalogue(row.get("tools")), "CALL_PREDICTION")


def _tagged(turns: list[tuple[str, str]], tag: str) -> list[dict]:
    """Messages of (role, text) turns; calls between tags; results go to calls in order."""
    pattern = re.compile(rf"<{tag}>(.*?)</{tag}>", re.DOTALL | re.IGNORECASE)
    out, waiting, number = [], [], 0
    for role, text in turns:
        if role == "tool":
            if not waiting:
                raise Reject("ORPHAN_RESULT: no call before it")
            out.append({"role": "tool", "content": text, "tool_call_id": waiting.pop(0)})
            continue
        found = pattern.findall(text or "") if role == "assistant" else []
        calls = []
        for body in found:
            values = _json(body.strip(), "call")
            for value in values if isinstance(values, list) else [values]:
                calls.append(_call(value, number))
                number += 1
        if f"<{tag}>".lower() in pattern.sub("", text or "").lower() and role == "assistant":
            raise Reject("UNCLOSED_CALL: tag without an end")
        message = {"role": role, "content": (pattern.sub("", text).strip() or None) if found else text}
        if calls:
            message["tool_calls"] = calls
            waiting = [c["id"] for c in calls]
        out.append(message)
    return out


def tagged(tag: str) -> Callable[[dict], dict]:
    """Rows with ``messages``, or one ``conversation`` text, whose calls stand between tags."""

    def adapt(row: dict) -> dict:
        if isinstance(row.get("messages"), list):
            turns = [(m.get("role"), m.get("content")) for m in row["messages"]]
        elif isinstance(row.get("conversation"), str):
            turns = [("assistant", row["conversation"])]
        else:
            raise Reject("NO_MESSAGES: neither messages nor conversation")
        if any("<think>" in (t or "") for _, t in turns):
            raise Reject("QUARANTINED: thought left in text")
        return _row(_tagged(turns, tag), tool_catalogue(row.get("tools")))

    return adapt


def instruction_output(row: dict) -> dict:
    """``instruction``, ``input`` (history) and ``output`` with tagged calls."""
    turns = [("system", row["instruction"])] if row.get("instruction") else []
    turns += [(m.get("role"), m.get("content")) for m in row.get("input") or []]
    return _row(_tagged([*turns, ("assistant", row.get("output") or "")], "tool_call"), tool_catalogue(row.get("tools")))


def python_calls(text: str) -> list[dict]:
    """``[Name(key=value), ...]`` with literal values; names may hold blanks and dots."""
    inner = text.strip()
    if not (inner.startswith("[") and inner.endswith("]")):
        return []
    names: dict[str, str] = {}

    def mask(match: re.Match) -> str:
        key = f"f{len(names)}"
        names[key] = match[2].strip()
        return f"{match[1]}{key}("

    masked = re.sub(r"(^\[|\)\s*,\s*)([^()\[\]'\"=,]+?)\s*\(", mask, inner)
    try:
        tree = ast.parse(masked, mode="eval").body
        return [{"name": names.get(c.func.id, c.func.id), "arguments": {k.arg: ast.literal_eval(k.value) for k in c.keywords}} for c in tree.elts]
    except (SyntaxError, ValueError, AttributeError) as wrong:
        raise Reject("BAD_CALL: not literal") from wrong


def from_value(row: dict) -> dict:
    """``conversations`` of from/value turns; calls as ``[Name(k=v)]``; a result goes to the last call."""
    roles = {"human": "user", "gpt": "assistant", "function_call": "assistant", "observation": "tool"}
    out = [{"role": "system", "content": row["system"]}] if row.get("system") else []
    number, last = 0, None
    for turn in row.get("conversations") or []:
        role = roles.get(turn.get("from"), turn.get("from"))
        text = turn.get("value") or ""
        if role == "tool":
            if last is None:
                raise Reject("ORPHAN_RESULT: no call before it")
            out.append({"role": "tool", "content": text, "tool_call_id": last})
            continue
        message = {"role": role, "content": text}
        calls = [_call(c, number + i) for i, c in enumerate(python_calls(text))] if role == "assistant" else []
        if calls:
            number += len(calls)
            last = calls[-1]["id"]
            message |= {"content": None, "tool_calls": calls}
        out.append(message)
    return _row(out, tool_catalogue(row.get("tools") or []))


_SPEAKER = re.compile(r"(USER|ASSISTANT|FUNCTION RESPONSE):", re.MULTILINE)


def _balanced(text: str) -> str | None:
    """The first JSON object in a text, by counting braces outside strings."""
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for at in range(start, len(text)) if start >= 0 else ():
        c = text[at]
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if not depth:
                return text[start : at + 1]
    return None


def chat_text(row: dict) -> dict:
    """``system`` and a ``chat`` text of USER, ASSISTANT and FUNCTION RESPONSE turns with <functioncall> objects."""
    parts = _SPEAKER.split(row.get("chat") or "")[1:]
    out = [{"role": "system", "content": row["system"]}] if row.get("system") else []
    number, waiting = 0, []
    for speaker, body in zip(parts[::2], parts[1::2], strict=False):
        body = body.replace("<|endoftext|>", "").strip()
        if speaker == "USER":
            out.append({"role": "user", "content": body})
        elif speaker == "FUNCTION RESPONSE":
            if not waiting:
                raise Reject("ORPHAN_RESULT: no call before it")
            out.append({"role": "tool", "content": body, "tool_call_id": waiting.pop(0)})
        else:
            message = {"role": "assistant", "content": body}
            if "<functioncall>" in body:
                before, _, after = body.partition("<functioncall>")
                raw = _balanced(after)
                if raw is None:
                    raise Reject("BAD_CALL: no object")
                # arguments may stand in single quotes, as a JSON text of their own
                fixed = re.sub(r"'(\{.*\})'", lambda m: json.dumps(m[1]), raw, flags=re.DOTALL)
                message = {"role": "assistant", "content": before.strip() or None, "tool_calls": [_call(_json(fixed, "call"), number)]}
                waiting, number = [message["tool_calls"][0]["id"]], number + 1
            out.append(message)
    tools = tool_catalogue(row["tools"]) if row.get("tools") else embedded_tools(row.get("system") or "")
    return _row(out, tools)


def embedded_tools(text: str) -> list[dict]:
    """Tool objects written into a prompt, one after another."""
    found = []
    while (raw := _balanced(text)) is not None:
        text = text[text.find(raw) + len(raw) :]
        try:
            value = json.loads(raw)
        except ValueError:
            continue
        if isinstance(value, dict) and value.get("name"):
            found.append(value)
    return tool_catalogue(found)


ADAPTERS: dict[str, Callable[[dict], dict]] = {
    "generic": generic,
    "xlam": query_answers,
    "when2call": tagged("TOOLCALL"),
    "button": tagged("call"),
    "looptool": instruction_output,
    "toolace": from_value,
    "glaive": chat_text,
}

#: Splits that hold evaluation data and are never normalized into training rows.
EVALUATION_SPLITS = ("preference", "mcq", "mcq_test", "llm_judge", "llm_judge_test")

NORMALIZED = "id string, tools string, messages string, supervision string, raw_hash string, canonical_hash string, status string, reason string"


def normalize_one(adapter: Callable[[dict], dict], raw: str | None, split: str) -> dict:
    digest = hashlib.sha256((raw or "").encode()).hexdigest()
    empty = dict.fromkeys(("id", "tools", "messages", "supervision", "canonical_hash")) | {"raw_hash": digest}
    try:
        if split in EVALUATION_SPLITS:
            raise Reject(f"EVALUATION_SPLIT: {split}")
        row = _json(raw, "row")
        if not isinstance(row, dict):
            raise Reject("BAD_ROW: not an object")
        made = adapter(row)
        if problems := canonical_problems(made["messages"], made["tools"]):
            raise Reject(problems[0])
    except Reject as why:
        return empty | {"status": "REJECTED", "reason": str(why)}
    except (TypeError, KeyError, AttributeError) as wrong:
        return empty | {"status": "REJECTED", "reason": f"BAD_SHAPE: {type(wrong).__name__}"}
    ident = next((str(row[k]) for k in ("id", "example_id", "uid") if row.get(k) not in (None, "")), f"og_{digest[:16]}")
    body = compact({"tools": made["tools"], "messages": made["messages"]})
    return {"id": ident, "tools": compact(made["tools"]), "messages": compact(made["messages"]), "supervision": made["supervision"], "raw_hash": digest, "canonical_hash": hashlib.sha256(body.encode()).hexdigest(), "status": "VALID", "reason": None}


def normalize(raw: DataFrame, source: str, split: str = "train", column: str = "raw") -> DataFrame:
    """``raw`` rows with source, split and the canonical columns; a row that has no canonical form has a reason."""
    ship(raw.sparkSession)
    adapter = ADAPTERS[source]

    @F.pandas_udf(NORMALIZED)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalize_one(adapter, v, split) for v in values], columns=[c.split()[0] for c in NORMALIZED.split(", ")])

    return raw.withColumn("n", run(column)).select(*(c for c in raw.columns if c != column), F.lit(source).alias("source"), F.lit(split).alias("split"), "n.*")


def ledger(normalized: DataFrame) -> DataFrame:
    """(source, status, reason, n): every row in one cell, repeated canonical rows as DUPLICATE after the first."""
    from .dedup import first_wins

    order = [c for c in ("row", "id", "raw_hash") if c in normalized.columns]
    valid = first_wins(normalized.where("status = 'VALID'"), F.col("canonical_hash"), order, "id").withColumn("status", F.when(F.col("kept"), "VALID").otherwise("DUPLICATE"))
    both = valid.select("source", "status", "reason").unionByName(normalized.where("status <> 'VALID'").select("source", "status", "reason"))
    return both.groupBy("source", "status", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))
