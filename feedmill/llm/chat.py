"""Chat formatting with DataFrame functions alone: tool calls linked to results, ordered, validated, as canonical JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.llm.common import written

#: Schemas of the tools' arguments that the query knows; callers give their own to canonical().
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}, "order": {"type": "string", "enum": ["date", "rank"]}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}, "precision": {"type": "integer"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "headers": {"type": "object"}, "retries": {"type": "array", "items": {"type": "number"}}}, "required": ["url"]},
}
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>>"
#: What an argument's text begins with if it stands for the result of another call of the conversation.
REFERENCE = "$call:"


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant satisfies a JSON Schema: type, enum, properties, required, additionalProperties (false), items, minimum, maximum, minLength, maxLength.

    The schema is unrolled, so the expression is as deep as the schema. A property that is absent or null counts as missing,
    unless its schema names null.
    """
    kind = F.schema_of_variant(value)
    out = F.lit(True)
    if names := schema.get("type"):
        out &= kind.rlike("^(" + "|".join(_KINDS[k] for k in (names if isinstance(names, list) else [names])) + ")$")
    if "enum" in schema:
        out &= F.to_json(value).isin([json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for x in schema["enum"]])
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    if "minimum" in schema:
        out &= ~kind.rlike(_KINDS["number"]) | (number >= schema["minimum"])
    if "maximum" in schema:
        out &= ~kind.rlike(_KINDS["number"]) | (number <= schema["maximum"])
    if "minLength" in schema:
        out &= (kind != "STRING") | (F.length(text) >= schema["minLength"])
    if "maxLength" in schema:
        out &= (kind != "STRING") | (F.length(text) <= schema["maxLength"])
    is_object = kind.startswith("OBJECT")
    for prop, rule in schema.get("properties", {}).items():
        own = F.try_variant_get(value, "$[" + json.dumps(prop) + "]", "variant")
        out &= ~is_object | own.isNull() | F.coalesce(F.is_variant_null(own), F.lit(False)) & F.lit("null" not in rule.get("type", "null")) | F.coalesce(fits(own, rule), F.lit(False))
    for prop in schema.get("required", []):
        own = F.try_variant_get(value, "$[" + json.dumps(prop) + "]", "variant")
        null_fits = "null" in (schema.get("properties", {}).get(prop, {}).get("type") or [])
        out &= ~is_object | own.isNotNull() & (F.lit(null_fits) | ~F.coalesce(F.is_variant_null(own), F.lit(False)))
    if schema.get("additionalProperties") is False:
        keys = F.json_object_keys(F.to_json(value))
        out &= ~is_object | (F.size(F.array_except(keys, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))) == 0)
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        out &= ~kind.startswith("ARRAY") | F.coalesce(F.forall(items, lambda x: F.coalesce(fits(x, schema["items"]), F.lit(False))), F.lit(False))
    return out


def valid_arguments(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """Whether a variant satisfies its tool's schema (see fits) and is an object; unknown tools fail."""
    out = F.lit(False)
    for tool, schema in tools.items():
        out = F.when(name == tool, F.schema_of_variant(arguments).startswith("OBJECT") & fits(arguments, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _parts(turns: DataFrame) -> DataFrame:
    """A row for each message and each call within one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    base = base.withColumn("looks", F.col("text").rlike(r"^\s*\{") & F.try_parse_json("text").isNotNull())
    base = base.withColumn("made", F.when((F.col("role") == "assistant") & F.col("looks"), F.from_json("text", _CALLS)))
    base = base.withColumn("answer", F.when((F.col("role") == "tool") & F.col("looks"), F.from_json("text", "struct<tool_call_id:string,content:string>")))
    calls = base.where(F.size("made.tool_calls") > 0).select("conv_id", "turn", "role", F.posexplode("made.tool_calls").alias("part", "call"))
    calls = calls.select("conv_id", "turn", (F.col("part") + 1).alias("part"), F.lit("call").alias("kind"), "role", F.col("call.id").alias("call_id"), F.coalesce("call.name", "call.function.name").alias("name"), F.coalesce("call.arguments", "call.function.arguments", F.lit("{}")).alias("body"))
    plain = base.select(
        "conv_id", "turn", F.lit(0).alias("part"), F.when(F.col("answer.tool_call_id").isNotNull(), "result").otherwise("message").alias("kind"), "role", F.col("answer.tool_call_id").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.when(F.col("answer.tool_call_id").isNotNull(), F.coalesce("answer.content", F.lit(""))).when(F.size("made.tool_calls") > 0, F.coalesce("made.content", F.lit(""))).otherwise(F.col("text")).alias("body"),
    )
    return plain.unionByName(calls)


def _levels(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, after, level, cyclic: the turn at which a call can stand at the earliest, and how many calls stand before it in a chain.

    A call stands after the answers of those that its arguments refer to; what refers to itself over others is cyclic.
    Links are doubled: round k joins links over 2^k references with themselves, and takes latest answers and longest
    chains along, so rounds are as many as the logarithm of the longest chain. A link over more references than
    a conversation has calls ends in a cycle.
    """
    key = ["conv_id", "call_id"]
    own = calls.groupBy(*key).agg(F.min("turn").alias("after"), F.min_by("body", F.struct("turn", "part", "body")).alias("body"))
    own = written(own.join(results.groupBy(*key).agg(F.min("turn").alias("answer")), key, "left"), "calls")
    uses = own.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r'"\$call:([^"]+)"'), F.lit(1)))).alias("used"))
    uses = written(uses.join(own.select("conv_id", F.col("call_id").alias("used")), ["conv_id", "used"], "left_semi").select(*key, "used"), "uses")
    alone = own.select(*key, "after", F.lit(0).alias("level"))
    if uses.isEmpty():
        return alone.withColumn("cyclic", F.lit(False))
    most = own.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    reach = own.select(*key, F.greatest("after", "answer").alias("latest"), F.lit(0).alias("level"))
    over, links = 1, uses
    while over <= most and not links.isEmpty():
        beyond = links.join(reach.withColumnRenamed("call_id", "used"), ["conv_id", "used"]).groupBy(*key).agg(F.max("latest").alias("_latest"), (F.max("level") + over).alias("_level"))
        reach = written(reach.join(beyond, key, "left").select(*key, F.greatest("latest", "_latest").alias("latest"), F.greatest("level", "_level").alias("level")), "reach")
        links = written(links.join(links.select("conv_id", F.col("call_id").alias("used"), F.col("used").alias("_used")), ["conv_id", "used"]).select(*key, F.col("_used").alias("used")).distinct(), "links")
        over *= 2
    told = uses.join(reach.select("conv_id", F.col("call_id").alias("used"), "latest"), ["conv_id", "used"]).groupBy(*key).agg(F.max("latest").alias("told"))
    cyclic = links.select(*key).distinct().withColumn("cyclic", F.lit(True))
    out = alone.drop("level").join(reach.select(*key, "level"), key).join(told, key, "left").join(cyclic, key, "left")
    cycle = F.coalesce("cyclic", F.lit(False))
    return out.select(*key, F.when(cycle, F.col("after")).otherwise(F.greatest("after", "told")).alias("after"), F.when(cycle, 0).otherwise(F.col("level")).alias("level"), cycle.alias("cyclic"))


def canonical(turns: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, part, kind, call_id, linked, valid, after, level, json: one row for each message, tool call and result.

    An assistant's text that is a JSON object with tool_calls (id, name, arguments, or OpenAI-like function)
    yields its calls as parts 1, 2, ...; a tool's text that is one with tool_call_id is a result; all else is a message.
    linked: a call has a result or a result a call with its id in its conversation (null for messages).
    valid: a call's arguments satisfy its tool's schema. Ordered by (after, level, kind = 'result', turn, part), calls stand
    after the results that they refer to ("$call:id" as an argument) and results after their calls: `after` is the turn
    that this makes of their own. json has sorted keys and no white space; numbers and strings as JSON has them.

    Only ids are joined, and no conversation is gathered: a very long one costs no task more than its rows.
    Ids count within their conversation; of repeated ids the earliest turn orders. Null texts are empty
    messages, null roles empty; null conv_id link with nothing. Repeated rows repeat; an empty table gives an empty result.
    """
    parts = written(_parts(turns), "parts")
    calls, results = parts.where("kind = 'call' and call_id is not null"), parts.where("kind = 'result' and call_id is not null")
    levels = _levels(calls, results)
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    facts = levels.join(answered, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("after").alias("call_after"), F.col("level").alias("call_level"), "cyclic", "answered")
    out = parts.join(facts, ["conv_id", "call_id"], "left")
    linked = F.when(F.col("kind") == "call", F.coalesce("answered", F.lit(False))).when(F.col("kind") == "result", F.col("call_after").isNotNull())
    parsed = F.try_parse_json("body")
    valid = F.when(F.col("kind") == "call", valid_arguments(F.col("name"), parsed, TOOLS if tools is None else tools))
    wrapped = lambda c: F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x")))
    quoted = lambda c: wrapped(c).substr(F.lit(6), F.length(wrapped(c)) - 6)
    call = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(parsed), quoted("body")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"type":"call"}'))
    result = F.concat(F.lit('{"content":'), quoted("body"), F.lit(',"id":'), quoted("call_id"), F.lit(',"type":"result"}'))
    message = F.concat(F.lit('{"content":'), quoted("body"), F.lit(',"role":'), quoted("role"), F.lit(',"type":"message"}'))
    return out.select(
        "conv_id", "turn", F.col("part").cast("long").alias("part"), "kind", "call_id", linked.alias("linked"), (valid & ~F.coalesce("cyclic", F.lit(False))).alias("valid"), F.greatest("turn", "call_after").alias("after"),
        F.coalesce("call_level", F.lit(0)).cast("long").alias("level"), F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message).alias("json"),
    )
