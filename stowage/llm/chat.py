"""Chats with tool calls: linked, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
from decimal import Decimal
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.skew import rank_within
from stowage.session import cut_lineage

#: JSON types by the names that schemas use.
_TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None),
}
CALL = "struct<call_no:int,id:string,name:string,error:string,after:array<string>>"


def _number(value: float) -> str:
    """The shortest digits that give the double back, laid out as in JavaScript."""
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # place of the decimal point after the first digit's place
    if len(text) <= point <= 21:
        out = text + "0" * (point - len(text))
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{point - 1:+d}"
    return ("-" if sign else "") + out


def canonical(value) -> str:
    """JSON as RFC 8785 spells it: keys by UTF-16 units, no blanks, letters as they are, doubles in their shortest form, so 1.0 is 1 and
    -0.0 is 0. Integers keep all their digits, also those that a double cannot hold."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return _number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def _is(value, kind: str) -> bool:
    """Whether a value is of a JSON type; 1.0 is an integer, true is no number."""
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def violation(value, schema: dict, at: str = "arguments") -> str | None:
    """The first way in which a value breaks a schema; None when it keeps it.

    Understands type (one or a list), enum, properties, required, additionalProperties (false) and items.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at} is not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at} is none of the values allowed"
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at} lacks {name}"
        for name in sorted(value):
            if name in fields:
                if error := violation(value[name], fields[name], f"{at}.{name}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{at} has unknown {name}"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if error := violation(x, schema["items"], f"{at}[{i}]"):
                return error
    return None


def _refuse(name: str):
    raise ValueError(name)


def _double(text: str) -> float:
    value = float(text)
    return value if isfinite(value) else _refuse(text)


def _parse(text: str):
    """The JSON value. Numbers beyond a double, lone surrogates and values nested too deeply to be written again are refused."""
    value = json.loads(text, parse_constant=_refuse, parse_float=_double)
    canonical([[[[value]]]]).encode()
    return value


def read_message(role: str | None, text: str | None, calls: str | None, call_id: str | None, tools: dict[str, dict]) -> tuple[str, list[tuple], str | None]:
    """Canonical JSON of a message, its calls (call_no, id, name, error, after) and an error of its call list."""
    message: dict = {"role": role, "content": text or ""}
    if call_id is not None:
        message["tool_call_id"] = call_id
    found, listed, error = [], [], None
    try:
        given = _parse(calls) if calls else []
        if not isinstance(given, list) or not all(isinstance(c, dict) for c in given):
            raise ValueError
    except (ValueError, RecursionError):
        given, error = [], "calls are no JSON list of objects"
    for i, call in enumerate(given):
        name, key, arguments = call.get("name"), call.get("id"), call.get("arguments", {})
        after = call.get("after") or []
        problem = None
        if isinstance(arguments, str):
            try:
                arguments = _parse(arguments)
            except (ValueError, RecursionError):
                problem = "arguments are no JSON"
        if not isinstance(name, str) or name not in tools:
            problem = problem or "unknown tool"
        if not isinstance(key, str) or not key:
            key, problem = None, problem or "no id"
        if not isinstance(after, list) or not all(isinstance(a, str) for a in after):
            after, problem = [], problem or "after is no list of ids"
        problem = problem or violation(arguments, tools[name])
        listed.append({"id": key, "name": name, "arguments": arguments})
        found.append((i, key, name if isinstance(name, str) else None, problem, sorted(set(after))))
    if listed:
        message["tool_calls"] = listed
    return canonical(message), found, error


def format_chats(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row per message (conv_id, turn, role, text, tool_calls, tool_call_id) in training order:
    conv_id, position, turn, role, json, n_calls, n_valid, n_linked, call_turn, status, error.

    * ``tool_calls`` is a JSON list of {id, name, arguments, after}; a tool message answers ``tool_call_id``. Calls and results are
      joined by conversation and id; where an id is used again, the k-th call (by turn) meets the k-th result.
    * Order: by turn, but a result follows its call, and a call follows the results of the calls named in its ``after``. Ties
      are by role, JSON and arrival. Messages that wait for each other in a ring keep their turn.
    * Arguments are checked against the JSON schemas in ``tools``. ``error`` is the first fault of a message.
    * ``status``: plain, call, result, orphan (a tool message without a call) or ring.

    Null conversations form one of their own, a null turn comes first, a null text is empty. No conversation is gathered in one
    task: links are hash joins, places are ranks that split a very large conversation. The rounds of the order are as
    many as the longest chain of ``after``.
    """
    @F.pandas_udf(f"struct<json:string,calls:array<{CALL}>,error:string>")
    def read(role: pd.Series, text: pd.Series, calls: pd.Series, call_id: pd.Series) -> pd.DataFrame:
        none = lambda s: s.astype(object).where(s.notna(), None)
        rows = [read_message(*r, tools) for r in zip(none(role), none(text), none(calls), none(call_id))]
        return pd.DataFrame({
            "json": [r[0] for r in rows],
            "calls": [[dict(zip(("call_no", "id", "name", "error", "after"), c)) for c in r[1]] for r in rows],
            "error": [r[2] for r in rows],
        })

    columns = ["role", "text", "tool_calls", "tool_call_id"]
    m = messages.select(
        F.monotonically_increasing_id().alias("uid"), "conv_id", "turn", "role", "tool_call_id",
        read(*[F.col(c).cast("string") for c in columns]).alias("m"),
    )
    m = cut_lineage(m.select("uid", "conv_id", "turn", "role", "tool_call_id", "m.*").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))), "messages")
    calls = m.select("uid", "conv", "turn", F.explode("calls").alias("c")).select("uid", "conv", "turn", "c.*").filter("id IS NOT NULL")
    results = m.filter("role = 'tool' AND tool_call_id IS NOT NULL").select("uid", "conv", "turn", F.col("tool_call_id").alias("id"))
    calls = cut_lineage(rank_within(calls, ["conv", "id"], [F.coalesce("turn", F.lit(-1)), F.col("uid"), F.col("call_no")], "k"), "calls")
    results = rank_within(results, ["conv", "id"], [F.coalesce("turn", F.lit(-1)), F.col("uid")], "k")
    links = cut_lineage(
        calls.select("conv", "id", "k", F.col("uid").alias("call_uid"), "call_no", F.col("turn").alias("call_turn"))
        .join(results.select("conv", "id", "k", F.col("uid").alias("result_uid")), ["conv", "id", "k"]), "links",
    )

    # A message waits for the messages whose calls its own calls name; the last use of an id before it, else the first.
    named = calls.select("uid", "conv", "turn", F.explode("after").alias("id"))
    uses = calls.select("conv", "id", F.col("uid").alias("on"), F.col("turn").alias("on_turn")).distinct()
    mine = F.coalesce("turn", F.lit(-1))
    theirs = F.coalesce("on_turn", F.lit(-1))
    waits = (
        named.join(uses, ["conv", "id"]).filter("uid <> on")
        .groupBy("uid", "id").agg(F.coalesce(
            F.max_by("on", F.when(theirs < mine, F.struct(theirs, "on"))), F.min_by("on", F.struct(theirs, "on"))).alias("on"))
        .select("uid", "on").distinct()
    )
    waits = cut_lineage(waits, "waits")
    first = m.select("uid", F.coalesce("turn", F.lit(-1)).cast("bigint").alias("own"))
    placed = first.join(waits.select("uid").distinct(), "uid", "left_anti").select("uid", F.col("own").alias("at"), F.lit(0).alias("level"))
    left = waits.select("uid").distinct()
    left_count, level = left.count(), 0
    placed = cut_lineage(placed, "placed") if left_count else placed
    while left_count:
        level += 1
        open_ = waits.join(placed.select(F.col("uid").alias("on"), "at"), "on", "left").join(left, "uid", "left_semi")
        ready = (
            open_.groupBy("uid").agg(F.count("*").alias("n"), F.count("at").alias("known"), F.max("at").alias("latest")).filter("n = known")
            .join(first, "uid").select("uid", F.greatest("latest", "own").alias("at"), F.lit(level).alias("level"))
        )
        ready = cut_lineage(ready, "ready")
        n = ready.count()
        if not n:
            break
        placed = cut_lineage(placed.union(ready), "placed")
        left = cut_lineage(left.join(ready, "uid", "left_anti"), "left")
        left_count -= n
    ring = left.withColumn("ring", F.lit(True)) if left_count else left.filter("false").withColumn("ring", F.lit(True))
    places = (
        first.join(placed, "uid", "left").join(ring, "uid", "left")
        .select("uid", F.coalesce("at", "own").alias("at"), F.coalesce("level", F.lit(0)).alias("level"), "own", F.coalesce("ring", F.lit(False)).alias("ring"))
    )
    answered = links.groupBy("call_uid").agg(F.count("*").alias("n_linked")).withColumnRenamed("call_uid", "uid")
    caller = links.select(F.col("result_uid").alias("uid"), "call_uid", "call_no", "call_turn")
    call_place = places.select(F.col("uid").alias("call_uid"), F.col("at").alias("call_at"), F.col("level").alias("call_level"), F.col("own").alias("call_own"))
    full = m.join(places, "uid").join(answered, "uid", "left").join(caller.join(call_place, "call_uid"), "uid", "left")
    is_call = F.size("calls") > 0
    linked = F.col("call_uid").isNotNull()
    full = full.select(
        "uid", "conv", "conv_id", "turn", "role", "json", F.size("calls").alias("n_calls"),
        F.size(F.filter("calls", lambda c: c["error"].isNull())).alias("n_valid"),
        F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), "call_turn",
        F.when(F.col("ring"), "ring").when(is_call, "call").when(linked, "result").when(F.col("role") == "tool", "orphan").otherwise("plain").alias("status"),
        F.coalesce("error", F.get(F.filter(F.transform("calls", lambda c: c["error"]), lambda e: e.isNotNull()), F.lit(0))).alias("error"),
        F.coalesce("call_at", "at").alias("at"), F.coalesce("call_level", "level").alias("level"), F.coalesce("call_own", "own").alias("own"),
        F.coalesce("call_uid", F.when(is_call, F.col("uid")), F.lit(-1)).alias("group"), F.coalesce(F.col("call_no") + 1, F.lit(0)).alias("sub"),
    )
    by = [F.col("at"), F.col("level"), F.col("own"), F.col("group"), F.col("sub"), F.coalesce("role", F.lit("")), F.col("json"), F.col("uid")]
    return rank_within(full, ["conv"], by, "position").select(
        "conv_id", "position", "turn", "role", "json", "n_calls", "n_valid", "n_linked", "call_turn", "status", "error")
