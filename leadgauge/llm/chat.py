"""Chat formatting: tool calls linked to their results.

A message with calls is a JSON object with `tool_calls`, a list of {id, name, arguments, after}; `after` names the calls whose
results a call needs. A result is a message of role `tool`, a JSON object with `tool_call_id` and `content`. Calls and
results are hash-joined by conversation and id; where an id recurs in a conversation, the n-th call has the n-th
result, by turn. Calls of one message are ordered topologically by `after`, ties in the order given; calls of earlier messages come before,
so turn and place order a conversation. Arguments are checked against the schema of the call's name.

Each call gets one row with a status, the first that holds of: `cycle` (its message's calls need each other), `unknown`
(no schema has its name), `invalid` (arguments do not fit), `dangling` (`after` names no earlier call), `unanswered` (no result, or one
from before the call) and `ok`; and one canonical JSON text: keys sorted, no blanks, no escapes of printable letters.

Messages that are no such objects have no calls, whatever their role; null texts too. Neither have those whose JSON holds numbers that are not
finite, half a surrogate pair, or more levels than can be read. Null conversation ids are one conversation. Calls
without an id are never answered. Equal messages are repeated calls. Arguments that are not an object are invalid. An empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CALLS = (
    "conv_id {0}, turn {1}, place int, call_id string, name string, arguments string, problem string, "
    "after array<string>"
)
RESULTS = "conv_id {0}, turn {1}, call_id string, content string"
#: Levels of JSON that can be written if they can be read.
SAFE_LEVELS = 100
_KINDS = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "integer": int,
    "number": (int, float),
    "null": type(None),
}


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fits(value: object, schema: dict) -> bool:
    """Whether a value fits a schema of type (one or a list), enum, bounds, lengths, items, properties, required, additionalProperties."""
    kinds = schema.get("type")
    if kinds is not None:
        is_bool = isinstance(value, bool)
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(isinstance(value, _KINDS[kind]) and is_bool == (kind == "boolean") for kind in kinds):
            return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return False
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return False
    if isinstance(value, list):
        return all(fits(item, schema.get("items", {})) for item in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(name not in value for name in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(name not in known for name in value):
            return False
        return all(fits(value[name], part) for name, part in known.items() if name in value)
    return True


def topological(names: list[str | None], needs: list[list[str]]) -> tuple[list[int], set[int]]:
    """An order of a message's calls in which each comes after those of the message that it needs, and those in or behind a
    cycle, which come last. Of several free ones the first given goes first."""
    own: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        if name is not None:
            own.setdefault(name, []).append(i)
    waits, followers = [0] * len(names), [[] for _ in names]
    for i, needed in enumerate(needs):
        for name in dict.fromkeys(needed):
            for j in own.get(name, ()):
                waits[i] += 1
                followers[j].append(i)
    free, order = [i for i, n in enumerate(waits) if not n], []
    heapq.heapify(free)
    while free:
        i = heapq.heappop(free)
        order.append(i)
        for j in followers[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, j)
    stuck = sorted(set(range(len(names))) - set(order))
    return order + stuck, set(stuck)


def _refused(name: str) -> None:
    raise ValueError(name)


def _finite(number: str) -> float:
    value = float(number)
    return value if math.isfinite(value) else _refused(number)


def _loaded(text: str | None) -> dict:
    """The JSON object of a message; an empty one if it holds none that can be written again."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_finite) if text and text.lstrip().startswith("{") else {}
        if text and ("\\u" in text or text.count("[") + text.count("{") > SAFE_LEVELS):
            canonical(value).encode()
    except (ValueError, RecursionError):  # the former also if a letter cannot be encoded
        return {}
    return value if isinstance(value, dict) else {}


def calls_of(text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(place, id, name, arguments, problem, after) of the calls of one message, in order."""
    listed = _loaded(text).get("tool_calls")
    calls = [call for call in listed if isinstance(call, dict)] if isinstance(listed, list) else []

    def text_of(value: object) -> str | None:
        return value if isinstance(value, str) else None if value is None else canonical(value)

    names = [text_of(call.get("id")) for call in calls]
    after = [call.get("after") if isinstance(call.get("after"), list) else [] for call in calls]
    needs = [[text_of(x) for x in given if x is not None] for given in after]
    order, stuck = topological(names, needs)
    rows = []
    for place, i in enumerate(order):
        name, arguments = text_of(calls[i].get("name")), calls[i].get("arguments")
        problem = None
        if i in stuck:
            problem = "cycle"
        elif name not in schemas:
            problem = "unknown"
        elif not isinstance(arguments, dict) or not fits(arguments, schemas[name]):
            problem = "invalid"
        rows.append((place, names[i], name, canonical(arguments), problem, needs[i]))
    return rows


def linked_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, place, call_id, name, status, result_turn, call) of every call of the messages
    (conv_id, turn, role, text); `call` is its canonical JSON."""
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for call in calls_of(text, schemas):
                    which.append(i)
                    found.append(call)
            at = pa.array(which, pa.int64())
            types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            columns = [pa.array([call[k] for call in found], kind) for k, kind in enumerate(types)]
            names = ["conv_id", "turn", "place", "call_id", "name", "arguments", "problem", "after"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, ids, contents = [], [], []
            for i, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                value = _loaded(text) if role == "tool" else {}
                if value.get("tool_call_id") is not None:
                    call_id, content = value["tool_call_id"], value.get("content")
                    which.append(i)
                    ids.append(call_id if isinstance(call_id, str) else canonical(call_id))
                    contents.append(canonical(content))
            at = pa.array(which, pa.int64())
            columns = [pa.array(ids, pa.string()), pa.array(contents, pa.string())]
            names = ["conv_id", "turn", "call_id", "content"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names)

    made = rows.mapInArrow(calls, CALLS.format(*kinds))
    answered = rows.mapInArrow(results, RESULTS.format(*kinds))
    nth_call = Window.partitionBy("conv_id", "call_id").orderBy("turn", "place", "arguments")
    nth_result = Window.partitionBy("conv_id", "call_id").orderBy("turn", "content")
    made = made.withColumn("nth", F.when(F.col("call_id").isNotNull(), F.row_number().over(nth_call)))
    answered = answered.withColumn("nth", F.row_number().over(nth_result)).select(
        F.col("conv_id").alias("r_conv"), F.col("turn").alias("result_turn"), F.col("call_id").alias("r_call"), "content", F.col("nth").alias("r_nth")
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("r_conv"))
        & (F.col("call_id") == F.col("r_call"))
        & (F.col("nth") == F.col("r_nth"))
    )
    linked = made.join(answered.hint("shuffle_hash"), same, "left")
    firsts = made.filter("call_id is not null").groupBy(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_call"))
    firsts = firsts.agg(F.min(F.struct("turn", "place")).alias("first"))
    needs = made.filter(F.size("after") > 0).select("conv_id", "turn", "place", "call_id", "nth", F.explode("after").alias("need"))
    met = (F.col("conv_id").eqNullSafe(F.col("d_conv"))) & (F.col("need") == F.col("d_call"))
    needs = needs.join(firsts, met, "left")
    earlier = F.coalesce(F.col("first") < F.struct("turn", "place"), F.lit(False))
    unmet = needs.filter(~earlier).select(
        F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn"), F.col("place").alias("u_place")
    )
    unmet = unmet.distinct().withColumn("unmet", F.lit(True))
    at = (
        F.col("conv_id").eqNullSafe(F.col("u_conv"))
        & F.col("turn").eqNullSafe(F.col("u_turn"))
        & (F.col("place") == F.col("u_place"))
    )
    linked = linked.join(unmet, at, "left")
    in_time = F.coalesce(F.col("result_turn") > F.col("turn"), F.lit(False))
    status = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("unmet"), "dangling")
        .when(~in_time, "unanswered")
        .otherwise("ok")
    )
    linked = linked.withColumn("status", status)
    # Keys in order; every value is canonical already but for ids, names and the list of needs.
    quoted = {c: F.coalesce(_quoted(F.col(c)), F.lit("null")) for c in ("call_id", "name", "status")}
    needs_json = F.concat(F.lit("["), F.array_join(F.transform("after", _quoted), ","), F.lit("]"))
    content = F.when(in_time, F.col("content")).otherwise("null")
    parts = {
        "after": needs_json,
        "arguments": F.col("arguments"),
        "id": quoted["call_id"],
        "name": quoted["name"],
        "result": content,
        "status": quoted["status"],
    }
    members = [F.concat(F.lit(f'"{name}":'), part) for name, part in parts.items()]
    call = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("call")
    shown = F.when(in_time, F.col("result_turn")).alias("result_turn")
    return linked.select("conv_id", "turn", "place", "call_id", "name", "status", shown, call)


def _quoted(text: F.Column) -> F.Column:
    """A text as a JSON string."""
    json_object = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(json_object, F.lit(6), F.length(json_object) - 6))
