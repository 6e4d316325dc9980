"""Chat formatting: tool calls linked to results, ordered, validated, as canonical JSON.

An assistant message may be a JSON object with ``tool_calls``, a list of ``{"id",
"name", "arguments", "after"}``; ``after`` names calls of the same message that must
come first. A tool message is a JSON object with ``tool_call_id`` and ``content``.
Anything else is plain text.
"""

from __future__ import annotations

import heapq
import json
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import materialize
from quire.plans.limits import tidy

#: JSON Schema types and the Python types of parsed values.
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
#: Nesting beyond this is no usable JSON.
MAX_DEPTH = 100


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and no escapes beyond the needed; whole floats as integers."""

    def plain(x: Any) -> Any:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def writable(value: Any) -> bool:
    """Whether a parsed value can be written again: finite numbers, whole characters, bounded nesting."""
    left = [(value, 0)]
    while left:
        x, depth = left.pop()
        if isinstance(x, float) and not math.isfinite(x):
            return False
        if isinstance(x, str) and not x.isascii() and any("\ud800" <= c <= "\udfff" for c in x):
            return False
        if isinstance(x, dict | list):
            if depth == MAX_DEPTH:
                return False
            if isinstance(x, dict):
                left += [(k, depth) for k in x]
                left += [(v, depth + 1) for v in x.values()]
            else:
                left += [(v, depth + 1) for v in x]
    return True


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``: type, enum, bounds, lengths, items, properties, required, additionalProperties."""
    kind = schema.get("type")
    if kind is not None:
        fits = isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))
        if not fits and not (kind == "integer" and isinstance(value, float) and value.is_integer()):
            return [f"{at}: not {kind}"]
    out = []
    # True and 1 are equal in Python, but not in JSON
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{at}: length")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def call_order(calls: list[dict]) -> tuple[list[int], bool]:
    """Indexes of ``calls`` so that each stands after those it names; earlier listed ones first.

    An id that several calls have means the first of them; names that no call has
    don't matter. The second value is False when names form a cycle; the calls
    that wait for it then keep their listed order at the end. Takes about as many steps as
    there are calls and names.
    """
    place: dict[str, int] = {}
    for i, c in enumerate(calls):
        if isinstance(c.get("id"), str):
            place.setdefault(c["id"], i)
    missing, waiting = [0] * len(calls), [[] for _ in calls]
    for i, c in enumerate(calls):
        after = c.get("after") if isinstance(c.get("after"), list) else []
        for needed in {place[x] for x in after if isinstance(x, str) and x in place}:
            missing[i] += 1
            waiting[needed].append(i)
    ready = [i for i, n in enumerate(missing) if not n]
    order: list[int] = []
    while ready:
        i = heapq.heappop(ready)
        order.append(i)
        for k in waiting[i]:
            missing[k] -= 1
            if not missing[k]:
                heapq.heappush(ready, k)
    rest = [i for i, n in enumerate(missing) if n]
    return order + rest, not rest


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str | None) -> dict | None:
    """The JSON object of a text; none where it isn't one that can be written again."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and writable(value) else None


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(slot, kind, call_id, status, json) of a message, then of its calls in order."""
    body = parsed(text) if role in ("tool", "assistant") else None
    if role == "tool":
        if body is None or not isinstance(body.get("tool_call_id"), str):
            return [(0, "result", None, "bad_json", canonical({"content": text, "role": role}))]
        made = {"content": body.get("content"), "role": role, "tool_call_id": body["tool_call_id"]}
        return [(0, "result", body["tool_call_id"], "ok", canonical(made))]
    calls = body.get("tool_calls") if body is not None else None
    if not isinstance(calls, list) or not all(isinstance(c, dict) for c in calls):
        return [(0, "message", None, "ok", canonical({"content": text, "role": role}))]
    order, acyclic = call_order(calls)
    names = [calls[i].get("id") for i in order]
    out = [(0, "message", None, "ok", canonical({"content": body.get("content"), "role": role, "tool_calls": names}))]
    for slot, i in enumerate(order, 1):
        call = calls[i]
        ident, name, arguments = call.get("id"), call.get("name"), call.get("arguments")
        if isinstance(arguments, str):
            arguments = parsed(arguments)
        written = canonical({"arguments": arguments, "id": ident, "name": name})
        if not isinstance(ident, str):
            ident, status = None, "bad_json"
        elif not acyclic:
            status = "cycle"
        elif not isinstance(name, str) or name not in schemas:
            status = "unknown_tool"
        else:
            wrong = violations(arguments, schemas[name])
            status = "bad_arguments " + "; ".join(wrong) if wrong else "ok"
        out.append((slot, "call", ident, status, written))
    return out


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, anchor_turn, anchor_slot, turn, kind, call_id, status, json), a row for each message and call.

    ``messages`` has conv_id, turn, role and text. Ordered by (anchor_turn,
    anchor_slot, kind, turn) a conversation's rows are topologically sorted: a
    call stands after its message and the calls it names, a result directly after
    its call, wherever it stood. Messages are parsed once, into a written table.
    The places of each (conv_id, call_id) are found by minima combined before
    their shuffle, and hash-joined to the rows; so a conversation of any size is
    spread, and none is gathered in a task.

    ``status``: ``ok``, ``bad_json`` (no usable id), ``cycle``, ``unknown_tool``,
    ``bad_arguments`` with the places, ``duplicate_call`` and ``duplicate_result``
    (an earlier one has the id), ``no_result`` (a valid call without any),
    ``orphan_result`` (a result without a call, which stays at its own turn).

    No text stops the job. JSON that can't be written again (numbers beyond the
    double range, NaN, halves of surrogate pairs, nesting deeper than
    ``MAX_DEPTH``, numbers of thousands of digits) counts as no JSON: a tool
    message is ``bad_json``, an assistant's is plain text, arguments given as such a
    string are null. An id that is no string makes its call ``bad_json``. Calls of a
    message are ordered in steps about as many as the calls and the names in them.

    Null or empty texts are plain messages with that content; a null role or turn
    is kept, a null turn coming first. Conversations are told apart by conv_id, null being
    one of them. Rows that agree in all four columns are rows of their own, but
    calls in them have one place and so count as one call. Only the four columns
    are read. An empty table gives an empty result.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    conv_type = rows.schema["conv_id"].dataType.simpleString()

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            at, found = [], []
            for i, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for made in parse_message(role, text, schemas):
                    at.append(i)
                    found.append(made)
            slot, kind, call_id, status, body = zip(*found, strict=True) if found else ((), (), (), (), ())
            where = pa.array(at, pa.int64())
            columns = [pa.array(slot, pa.int32()), *(pa.array(x, pa.string()) for x in (kind, call_id, status, body))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *columns], ["conv_id", "turn", "slot", "kind", "call_id", "status", "json"])

    made = rows.mapInArrow(tidy(parse), f"conv_id {conv_type}, turn long, slot int, kind string, call_id string, status string, json string")
    known = materialize(made, "chat-rows")
    place = F.struct("turn", "slot")
    first = known.filter("call_id IS NOT NULL").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("k")).agg(
        F.min(F.when(F.col("kind") == "call", place)).alias("call_at"), F.min(F.when(F.col("kind") == "result", place)).alias("result_at")
    )
    linked = known.join(first.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("k")), "left")
    is_result, usable = (F.col("kind") == "result"), F.col("call_id").isNotNull()
    moved = is_result & usable & F.col("call_at").isNotNull()
    status = (
        F.when((F.col("kind") == "call") & usable & (place != F.col("call_at")), "duplicate_call")
        .when(is_result & usable & F.col("call_at").isNull(), "orphan_result")
        .when(is_result & usable & (place != F.col("result_at")), "duplicate_result")
        .when((F.col("kind") == "call") & (F.col("status") == "ok") & F.col("result_at").isNull(), "no_result")
        .otherwise(F.col("status"))
    )
    return linked.select(
        "conv_id",
        F.when(moved, F.col("call_at.turn")).otherwise(F.col("turn")).alias("anchor_turn"),
        F.when(moved, F.col("call_at.slot")).otherwise(F.col("slot")).alias("anchor_slot"),
        "turn", "kind", "call_id", status.alias("status"), "json",
    )
