"""Tool-call linking for chat data.

Calls and results are joined by (conversation, identifier). Calls are ordered topologically: a call
comes after the call it depends on, found as its depth in the dependency forest by pointer doubling,
so a chain of n calls takes log2(n) joins whatever conversation it lies in. Arguments are validated
against the tool's schema, and linked calls are serialised as canonical JSON: keys in code point order, no
white space, no escapes but those that JSON asks for.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window, functions as F

from togglelog.llm.storage import written

# JSON types that a schema may name.
TYPES = ("string", "integer", "number", "boolean", "object", "array")
MAX_DOUBLINGS = 40


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def is_of_type(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, {"string": str, "boolean": bool, "object": dict, "array": list}[kind])


def argument_errors(arguments: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """Parsed arguments (None if they can't be written again as JSON), and what is wrong with them.

    A schema is {"properties": {name: kind}, "required": [name, ...]}; other names are not allowed, nor
    are numbers beyond the range of a double and halves of surrogate pairs, wherever they stand. A kind is one of
    TYPES, or {"type": one of TYPES} with, as it applies, "enum" (values), "minimum", "maximum", "items" (the kind of an
    array's items), and "properties" and "required" of an object, which may be left out to allow any names.
    """
    if schema is None:
        return None, ["unknown tool"]
    try:
        value = json.loads(arguments if arguments is not None else "", parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None, ["not JSON"]
    if not isinstance(value, dict):
        return None, ["not an object"]
    flaws = _flaws(value)
    return None if flaws else value, flaws + object_errors(value, schema)


def object_errors(value: dict, schema: dict, within: str = "") -> list[str]:
    """What is wrong with an object's names and values; names are given with those they are within."""
    errors = [f"missing {within}{k}" for k in schema.get("required", ()) if k not in value]
    for k in sorted(filter(_is_text, value)):  # others are flaws already
        kind = schema.get("properties", {}).get(k)
        if kind is not None:
            errors += value_errors(value[k], kind, within + k)
        elif "properties" in schema:
            errors.append(f"unexpected {within}{k}")
    return errors


def value_errors(value, kind: str | dict, name: str) -> list[str]:
    spec = {"type": kind} if isinstance(kind, str) else kind
    if "type" in spec and not is_of_type(value, spec["type"]):
        return [f"{name} is not {spec['type']}"]
    errors = []
    # 1, 1.0 and true are different values
    if "enum" in spec and not any(type(x) is type(value) and x == value for x in spec["enum"]):
        errors.append(f"{name} is none of its values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        errors += [f"{name} is below {spec['minimum']}"] if value < spec.get("minimum", value) else []
        errors += [f"{name} is above {spec['maximum']}"] if value > spec.get("maximum", value) else []
    if isinstance(value, list) and "items" in spec:
        errors += [e for i, x in enumerate(value) for e in value_errors(x, spec["items"], f"{name}[{i}]")]
    if isinstance(value, dict) and ("properties" in spec or "required" in spec):
        errors += object_errors(value, spec, f"{name}.")
    return errors


def _is_text(value: str) -> bool:
    """Whether a string can be written as UTF-8."""
    return not any("\ud800" <= c <= "\udfff" for c in value)


def _flaws(value) -> list[str]:
    """What makes parsed JSON impossible to write again."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += [*x, *x.values()]
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, float) and not math.isfinite(x):
            found.add("number out of range")
        elif isinstance(x, str) and not _is_text(x):
            found.add("half of a surrogate pair")
    return sorted(found)


def _no_constant(name: str):
    raise ValueError(name)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each (conv_id, call_id) of messages.

    messages: conv_id, turn, kind (call or result), call_id, name, arguments (JSON text), after (call_id
    of the same conversation that must come first, or null), content (of a result).
    Result: conv_id, call_id, status (linked, no_result, no_call), depth, cyclic, position (from 1 in the
    conversation, topological: depth, turn, call_id), errors, valid, json.

    Of several calls or results with one identifier the first counts (by turn, then by content); rows
    whose conv_id, call_id or kind is null, or of another kind, take no part. An `after` that names no
    call is ignored; a call that leads into a cycle is cyclic, has a null depth and comes last. The
    json is null for a result without a call. Other columns are ignored; an empty table stays empty.
    """
    rows = messages.where("conv_id IS NOT NULL AND call_id IS NOT NULL AND kind IN ('call', 'result')")
    call = F.min(F.when(F.col("kind") == "call", F.struct("turn", "name", "arguments", "after")))
    result = F.min(F.when(F.col("kind") == "result", F.struct("turn", "content")))
    linked = rows.groupBy("conv_id", "call_id").agg(call.alias("call"), result.alias("result"))
    linked = written(linked, "linked")
    depths = _depths(linked.where("call IS NOT NULL").select("conv_id", "call_id", F.col("call.after").alias("after")))
    # a map of the tools of the run, not of the data
    serialise = F.pandas_udf(_serialiser(schemas), "errors array<string>, json string")
    has_call, has_result = F.col("call").isNotNull(), F.col("result").isNotNull()
    status = F.when(has_call & has_result, "linked").when(has_call, "no_result").otherwise("no_call")
    out = linked.join(depths, ["conv_id", "call_id"], "left").withColumn(
        "made", serialise("call_id", "call.name", "call.arguments", "result.content", has_call)
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("depth").isNull(), "depth", F.coalesce("call.turn", "result.turn"), "call_id")
    return out.select(
        "conv_id",
        "call_id",
        status.alias("status"),
        "depth",
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.row_number().over(order).alias("position"),
        F.coalesce("made.errors", F.array().cast("array<string>")).alias("errors"),
        (has_call & (F.size("made.errors") == 0) & ~F.coalesce("cyclic", F.lit(False))).alias("valid"),
        "made.json",
    )


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, cyclic) by pointer doubling along `after`."""
    names = calls.select("conv_id", F.col("call_id").alias("after"))
    up = calls.join(names.withColumn("there", F.lit(True)), ["conv_id", "after"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("after")).alias("up")
    )
    up = written(up.withColumn("depth", F.col("up").isNotNull().cast("long")), "depths")
    for _ in range(MAX_DOUBLINGS):
        waiting = up.where("up IS NOT NULL")
        if waiting.isEmpty():
            break
        step = up.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        up = written(
            up.join(step, ["conv_id", "up"], "left").select(
                "conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "depths",
        )
    cyclic = F.col("up").isNotNull()
    return up.select("conv_id", "call_id", F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def _serialiser(schemas: dict[str, dict]):
    def run(ids, names, arguments, contents, has_call):
        import pandas as pd

        out = []
        for call_id, name, text, content, there in zip(ids, names, arguments, contents, has_call):
            if not there:
                out.append(([], None))
                continue
            value, errors = argument_errors(text, schemas.get(name))
            made = {"id": call_id, "name": name, "arguments": value if value is not None else text, "result": content}
            out.append((errors, canonical_json(made)))
        return pd.DataFrame(out, columns=["errors", "json"])

    return run
