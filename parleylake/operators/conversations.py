"""Conversations: assembly from turns, structure facts, prompt states, first replies, reports and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DECISIONS = ("CALL", "ANSWER", "CLARIFY", "UNSUPPORTED")
MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string>"


def assemble(turns: DataFrame, ident: str = "conv_id", order: str = "turn") -> DataFrame:
    """(id, messages): turns in order as an array; a conversation's turns are what one task holds."""
    item = F.struct(F.col(order).alias("__o"), F.col("role"), F.col("text").alias("content"))
    empty = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    return turns.groupBy(F.col(ident).alias("id")).agg(F.array_sort(F.collect_list(item)).alias("m")).select("id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), empty.alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))).alias("messages"))


def _calls(m: Column) -> Column:
    return F.coalesce(F.size(m["tool_calls"]), F.lit(0))


def _has_text(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def structure(conversations: DataFrame, messages: str = "messages", tools: str | None = None) -> DataFrame:
    """Shape facts of every conversation: no text is read beyond emptiness."""
    m = F.col(messages)
    roles = F.transform(m, lambda x: x["role"])
    leading = F.coalesce(F.get(roles, 0) == "system", F.lit(False))
    body = F.when(leading, F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0)))).otherwise(roles)
    final = F.try_element_at(m, F.lit(-1))

    def count(role: str) -> Column:
        return F.size(F.filter(roles, lambda r: r == role))

    places = F.transform(m, lambda x, i: F.struct(i.alias("i"), x["role"].alias("role"), _calls(x).alias("calls")))
    last_assistant = F.array_max(F.transform(F.filter(places, lambda p: p["role"] == "assistant"), lambda p: p["i"]))
    with_call = F.filter(places, lambda p: (p["role"] == "assistant") & (p["calls"] > 0))
    first_result = F.array_min(F.transform(F.filter(places, lambda p: p["role"] == "tool"), lambda p: p["i"]))
    return conversations.select(
        "*",
        roles.alias("message_roles"),
        leading.alias("leading_system_message"),
        F.when(body == F.array(F.lit("user"), F.lit("assistant")), "single_exchange").otherwise("multi_turn").alias("exchange_shape"),
        count("user").alias("user_turns"),
        count("assistant").alias("assistant_turns"),
        count("tool").alias("tool_result_messages"),
        F.aggregate(with_call, F.lit(0), lambda a, p: a + p["calls"]).alias("structured_calls"),
        F.size(with_call).alias("assistant_turns_with_structured_call"),
        (F.size(tools) if tools else F.lit(0)).alias("tools_available"),
        F.try_element_at(roles, F.lit(-1)).alias("final_role"),
        F.coalesce((final["role"] == "assistant") & (_calls(final) > 0), F.lit(False)).alias("final_assistant_structured_call"),
        F.coalesce((final["role"] == "assistant") & _has_text(final["content"]), F.lit(False)).alias("final_assistant_prose"),
        F.coalesce(first_result < F.size(m) - 1, F.lit(False)).alias("tool_result_before_final"),
        F.coalesce(F.exists(with_call, lambda p: p["i"] < last_assistant), F.lit(False)).alias("structured_call_before_final_assistant"),
    )


def prompt_states(conversations: DataFrame, messages: str = "messages", profile: str = "broad", held_out: DataFrame | None = None) -> DataFrame:
    """A row for each assistant turn, with the messages before it and the system text so far.

    The ``residual`` profile leaves out openings that are not calls.
    """
    rows = conversations if held_out is None else conversations.join(held_out.select("id"), "id", "left_anti")
    turns = rows.select("id", F.col(messages).alias("m"), F.posexplode(messages).alias("turn", "message")).where(F.col("message.role") == "assistant")
    action = F.when(_calls(F.col("message")) > 0, "CALL").otherwise("ANSWER")
    prefix = F.slice("m", F.lit(1), F.col("turn"))
    systems = F.filter("prefix", lambda x: x["role"] == "system")
    out = turns.select(F.concat(F.col("id").cast("string"), F.lit("_turn_"), F.col("turn").cast("string")).alias("prompt_state_id"), "id", "turn", action.alias("target_action_type"), prefix.alias("prefix"))
    out = out.withColumn("system_prompt", F.coalesce(F.try_element_at(systems, F.lit(-1))["content"], F.lit("")))
    return out.where((F.col("target_action_type") == "CALL") | (F.col("turn") > 1)) if profile == "residual" else out


def first_replies(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """id, user, reply, reason (null: eligible) and unit of each conversation's opening exchange."""
    m = F.col(messages)
    body = F.when(F.coalesce(F.get(m, 0)["role"] == "system", F.lit(False)), F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    user, reply = F.get("body", 0), F.get("body", 1)
    shaped = F.coalesce((user["role"] == "user") & (reply["role"] == "assistant"), F.lit(False))
    reason = (
        F.when(~shaped, "NOT_USER_THEN_ASSISTANT")
        .when(_calls(reply) > 0, "STRUCTURAL_CALL")
        .when(~_has_text(reply["content"]) | user["content"].isNull(), "EMPTY_REPLY")
    )
    return conversations.select("id", body.alias("body")).select(
        "id",
        F.when(shaped, user["content"]).alias("user"),
        F.when(shaped, reply["content"]).alias("reply"),
        reason.alias("reason"),
        F.when(F.size("body") == 2, "SINGLE_EXCHANGE").otherwise("HAS_CONTINUATION").alias("unit"),
    )


def user_prompt(messages: Column) -> Column:
    """All user contents, joined by a blank."""
    return F.array_join(F.transform(F.filter(messages, lambda x: x["role"] == "user"), lambda x: F.coalesce(x["content"], F.lit(""))), " ")


def render(messages: Column) -> Column:
    """ChatML text of a conversation."""
    return F.array_join(F.transform(messages, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), F.coalesce(x["content"], F.lit("")), F.lit("<|im_end|>\n"))), "")


def rendered_user_turns(prompt: Column | str) -> Column:
    """User turns of a ChatML text."""
    return F.regexp_extract_all(prompt, F.lit(r"(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>"), F.lit(1))


def stats(conversations: DataFrame, by: str | None = None, messages: str = "messages") -> DataFrame:
    """samples, turns, mean turns and calls, by source or in all."""
    calls = F.aggregate(messages, F.lit(0), lambda a, x: a + _calls(x))
    rows = conversations.groupBy(by) if by else conversations.groupBy()
    return rows.agg(F.count("*").alias("samples"), F.sum(F.size(messages)).alias("turns"), (F.sum(F.size(messages)) / F.count("*")).alias("mean_turns"), F.sum(calls).alias("calls"))


def histogram(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n, share): counts of several columns in one pass over the rows."""
    each = F.array(*(F.struct(F.lit(name).alias("facet"), column.cast("string").alias("value")) for name, column in facets.items()))
    counted = rows.select(F.explode(each).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))
    total = counted.groupBy("facet").agg(F.sum("n").alias("total"))
    return counted.join(total, "facet").select("facet", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def refusal_profile(replies: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """n, refusals and rate by group."""
    return replies.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(T.refusal(text).isNotNull()).alias("refusals")).withColumn("rate", F.col("refusals") / F.col("n"))
