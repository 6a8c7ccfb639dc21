"""Generated text as decisions and calls.

Grammar: a call block is ``<tool_call>`` … ``</tool_call>``; it holds functions with parameters in tags, or one JSON object or
list of objects. ``<think>`` … ``</think>`` is left out of the content, as the call blocks are. Tags are read once, left to
right, case aside; a block that is never closed is text. Any problem in any block makes the whole output a format error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

TAG = re.compile(r"<(?P<close>/?)(?P<name>tool_call|think|function|parameter)(?:=(?P<value>[^>]+))?>", re.IGNORECASE)
_CALL = StructType([StructField(n, StringType()) for n in ("name", "arguments", "id")])
SCHEMA = StructType([StructField("decision", StringType()), StructField("calls", ArrayType(_CALL)), StructField("content", StringType()), StructField("status", StringType()), StructField("errors", ArrayType(StringType()))])

# The codes of the output, and phrases of prose that decide between a decline and a question.
CALL, ANSWER, CLARIFY, UNSUPPORTED = "CALL", "ANSWER", "CLARIFY", "UNSUPPORTED"
VALID, BROKEN = "RAW_VALID", "FORMAT_ERROR"
UNCLOSED, SILENT, HOLLOW = "UNCLOSED_TOOL_CALL", "EOS_WITHOUT_OUTPUT", "EMPTY_TOOL_CALL"
BAD_CALL, BAD_ARGUMENTS, NO_CALL, NO_OBJECT = "MALFORMED_TOOL_CALL", "MALFORMED_ARGUMENTS", "INVALID_TOOL_CALL", "INVALID_ARGUMENTS"
DECLINES = ("cannot help", "can't help", "unable to", "not supported", "unsupported")
QUESTIONS = ("could you clarify", "please provide", "which one")


@dataclass
class Reading:
    """What a text was found to hold so far."""

    calls: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def wrong(self, code: str, block: int, why: str) -> None:
        self.errors.append(f"{code}[{block}]: {why}")

    def add(self, name: str, arguments: dict, ident: str | None = None) -> None:
        text = json.dumps(arguments, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        self.calls.append({"name": name, "arguments": text, "id": ident})


def _blocks(text: str, wanted: str) -> Iterator[tuple[int, int, int, int]]:
    """Begin, body begin, body end and end of the closed blocks of one tag; what opens inside an open one is part of it."""
    opened = None
    for tag in TAG.finditer(text):
        if tag["name"].casefold() != wanted:
            continue
        if not tag["close"] and opened is None:
            opened = tag
        elif tag["close"] and opened is not None:
            yield opened.start(), opened.end(), tag.start(), tag.end()
            opened = None


def _outside(text: str, blocks: list[tuple[int, int, int, int]]) -> str:
    ends = [0, *(b[3] for b in blocks)]
    begins = [*(b[0] for b in blocks), len(text)]
    return "".join(text[a:b] for a, b in zip(ends, begins, strict=True))


def _tagged(body: str, block: int, reading: Reading) -> None:
    """Functions in tags: a parameter's text is its value."""
    found = False
    function, arguments, parameter, lost = None, {}, None, False
    for tag in TAG.finditer(body):
        kind, value = tag["name"].casefold(), (tag["value"] or "").strip()
        if kind == "function" and not tag["close"] and function is None and value:
            function, arguments, parameter, lost = value, {}, None, False
        elif kind == "parameter" and function is not None:
            if not tag["close"] and parameter is None and value:
                parameter, lost = (value, tag.end()), True
            elif tag["close"] and parameter is not None:
                arguments[parameter[0]] = body[parameter[1] : tag.start()].strip()
                parameter = None
        elif kind == "function" and tag["close"] and function is not None:
            found = True
            if lost and not arguments:
                reading.wrong(BAD_ARGUMENTS, block, "a parameter of the function is not closed")
            else:
                reading.add(function, arguments)
            function = None
    if not found:
        reading.wrong(BAD_CALL, block, "no closed function in the block")


def _object(value, block: int, reading: Reading) -> None:
    """One call as a JSON value; its arguments may be a JSON text."""
    name = value.get("name") if isinstance(value, dict) else None
    if not isinstance(name, str) or not name:
        reading.wrong(NO_CALL, block, "a call needs a name")
        return
    arguments = value.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except ValueError as cause:
            reading.wrong(BAD_ARGUMENTS, block, f"arguments are no JSON ({cause})")
            return
    if isinstance(arguments, dict):
        reading.add(name, arguments, value.get("id"))
    else:
        reading.wrong(NO_OBJECT, block, "arguments are no object")


def _block(body: str, block: int, reading: Reading) -> None:
    if any(t["name"].casefold() == "function" and t["value"] and not t["close"] for t in TAG.finditer(body)):
        _tagged(body, block, reading)
    elif body.lstrip()[:1] not in ("{", "["):
        reading.wrong(BAD_CALL, block, "the block has neither JSON nor a function tag")
    else:
        try:
            values = json.loads(body)
        except ValueError as cause:
            reading.wrong(BAD_CALL, block, f"the block is no JSON ({cause})")
            return
        for value in values if isinstance(values, list) else [values]:
            _object(value, block, reading)


def decide(prose: str) -> str:
    """The decision of text without any call."""
    folded = prose.casefold()
    if any(phrase in folded for phrase in DECLINES):
        return UNSUPPORTED
    return CLARIFY if "?" in prose or any(phrase in folded for phrase in QUESTIONS) else ANSWER


def parse_output(raw: str | None, truncated: bool = False) -> dict:
    """Decision, calls, content, status and errors of generated text."""
    raw = raw or ""
    blocks = list(_blocks(raw, "tool_call"))
    prose = _outside(raw, blocks)
    content = _outside(prose, list(_blocks(prose, "think"))).strip()
    reading = Reading()
    for number, (_, begin, end, _) in enumerate(blocks):
        _block(raw[begin:end], number, reading)
    if blocks and not reading.calls and not reading.errors:
        reading.errors.append(HOLLOW)
    elif not blocks and any(mark in raw.casefold() for mark in ("<tool_call", "</tool_call>")):
        reading.errors.append(UNCLOSED)
    elif not blocks and truncated and not content:
        reading.errors.append(SILENT)
    if reading.errors:
        return {"decision": ANSWER, "calls": [], "content": content, "status": BROKEN, "errors": reading.errors}
    return {"decision": CALL if blocks else decide(content), "calls": reading.calls, "content": content, "status": VALID, "errors": []}


@F.pandas_udf(SCHEMA)
def parsed(raw: pd.Series, truncated: pd.Series) -> pd.DataFrame:
    """``parse_output`` over columns."""
    return pd.DataFrame([parse_output(r, bool(t)) for r, t in zip(raw, truncated, strict=True)], columns=["decision", "calls", "content", "status", "errors"])


def prose_decision(text: Column | str) -> Column:
    """``decide`` as a column expression."""
    column = F.col(text) if isinstance(text, str) else text
    low = F.lower(column)
    declines, asks = F.lit(False), column.contains("?")
    for phrase in DECLINES:
        declines = declines | low.contains(phrase)
    for phrase in QUESTIONS:
        asks = asks | low.contains(phrase)
    return F.when(declines, UNSUPPORTED).when(asks, CLARIFY).otherwise(ANSWER)
