"""Linking tool calls to their results, ordering and checking them, and writing them as canonical JSON.

Calls and results meet in a join on conversation and identifier; logs may number ids per conversation.
Repeats of an identifier in a conversation are folded before the join (the earliest by turn and content
is linked); repeats that differ from it can be had as rows of their own, with status ``duplicate_id``. Calls are put in topological order of their dependencies within a
conversation; arguments are checked against a schema per tool; each link becomes one JSON text with
sorted keys and no spare blanks.

Rows without an identifier are kept, each by itself, with status ``no_id``. Arguments that are no JSON
object, unknown tools, unmet dependencies and dependencies in a circle are errors of the row, never of
the job. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, forget, stored

_KINDS = {
    "string": str,
    "integer": int,
    "number": (int, float),
    "boolean": bool,
    "array": list,
    "object": dict,
}


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and plain characters; halves of a surrogate pair become U+FFFD."""
    return _whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _whole(text: str | None) -> str | None:
    """The text without halves of surrogate pairs, which JSON can write but no column can hold."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _finite(number: str) -> float:
    if math.isinf(value := float(number)):
        raise OverflowError(number)
    return value


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _same(a, b) -> bool:
    """Equal as JSON: true is not 1."""
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def problem(value, schema: dict, at: str = "") -> str | None:
    """The first way in which a value breaks a schema: type, enum, least and most, length, required and
    unknown properties, and the same of properties and items. Bounds of numbers hold for numbers only, and
    lengths for texts only, as JSON Schema has it."""
    kind = schema.get("type")
    if kind:
        fits = isinstance(value, _KINDS[kind]) and (kind == "boolean" or not isinstance(value, bool))
        if not fits:
            return f"{at or 'arguments'}: not {kind}"
    if "enum" in schema and not any(_same(value, allowed) for allowed in schema["enum"]):
        return f"{at}: not one of the allowed values"
    if _is_number(value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: out of range"
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return f"{at}: too short"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{at}{name}"):
                    return found
            elif not schema.get("additionalProperties", True):
                return f"{at}{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for item in value:
            if found := problem(item, schema["items"], f"{at}[]"):
                return found
    return None


def waves(calls: DataFrame) -> DataFrame:
    """``node`` (conv and id), ``wave``, ``missing`` (a dependency that is no call of the conversation), ``circle``.

    Calls in the order of (wave, turn) never come before what they depend on: a wave rises wherever a
    call stands earlier in the log than its dependency. A log that is in order has one wave, however
    long it is; passes over the data are needed only along dependencies that point backwards.
    """
    # Structs compare nulls as equal: calls without a conversation depend on each other as well.
    home, node = F.struct("conv").alias("home"), F.struct("conv", "id").alias("node")
    nodes = calls.select(home, "turn", node)
    wanted = calls.select(home, "conv", "turn", node, F.explode(F.array_distinct("after")).alias("id"))
    wanted = wanted.select("home", "turn", "node", F.struct("conv", "id").alias("dep"))
    known = nodes.select(F.lit(True).alias("known"), F.col("turn").alias("dep_turn"), F.col("node").alias("dep"))
    edges = stored(wanted.join(known, "dep", "left"), "edges")
    missing = edges.where("known IS NULL").select("node").distinct().withColumn("missing", F.lit(True))
    rise = F.coalesce((F.col("dep_turn") >= F.col("turn")).cast("int"), F.lit(0)).alias("rise")
    edges_in = edges.where("known").select("node", "dep", "home", rise)
    backward = edges_in.where("rise = 1").groupBy("home").agg(F.count("*").alias("bound"))
    state = stored(nodes.select("node", "home", F.lit(0).cast("long").alias("wave")), "waves")
    circles = None
    if not backward.isEmpty():
        # Only conversations that are out of order take part.
        moving = stored(edges_in.join(backward, "home"), "edges")
        while True:
            reach = moving.join(state.select(F.col("node").alias("dep"), F.col("wave").alias("w")), "dep")
            reach = reach.groupBy("node").agg(F.max(F.col("w") + F.col("rise")).alias("reach"), F.max("bound").alias("bound"))
            step = state.join(reach, "node", "left").select(
                "node",
                "home",
                # More rises than backward dependencies: a circle, which stops rising here.
                F.greatest("wave", F.least(F.col("reach"), F.col("bound") + 1)).alias("wave"),
                F.coalesce(F.least(F.col("reach"), F.col("bound") + 1) > F.col("wave"), F.lit(False)).alias("moved"),
                F.coalesce(F.col("reach") > F.col("bound"), F.lit(False)).alias("circle"),
            )
            step = stored(step, "waves")
            forget(state)
            state = step
            if state.where("moved").isEmpty():
                break
        circles = state.where("circle").select("home").distinct().withColumn("circle", F.lit(True))
    out = state.select("node", "home", "wave").join(missing, "node", "left")
    out = out.join(circles, "home", "left") if circles is not None else out.withColumn("circle", F.lit(False))
    return out.select(
        "node", "wave", F.coalesce("missing", F.lit(False)).alias("missing"), F.coalesce("circle", F.lit(False)).alias("circle")
    )


def _folded(rows: DataFrame, given: list[str], n: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each (conv, id) with all rows counted, and a row per other one that differs."""
    kinds = rows.where("id IS NOT NULL").groupBy("conv", "id", *given).agg(F.count("*").alias(n))
    kinds = stored(kinds.select(F.struct("conv", "id").alias("node"), F.struct(*given).alias("own"), n), "kinds")
    first = kinds.groupBy("node").agg(F.min("own").alias("first"), F.sum(n).alias(n), F.count("*").alias("kinds"))
    first = stored(first, "first")
    many = first.where("kinds > 1").select("node", "first")
    others = kinds.join(many, "node").where("own != first").select("node.*", "own.*", n)
    return first.select("node", F.col("first").alias("own"), n), others


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], repeats: bool = False) -> DataFrame:
    """One row per conversation and identifier, and per row without one.

    ``calls`` has conv, turn, id, name, arguments (JSON text), after (ids it depends on); ``results``
    has conv, turn, id, content. Gives conv, turn (of the call, else of the result), call_id, name,
    status (linked, no_result, no_call, no_id), wave, valid, error, n_calls, n_results and ``record``,
    the canonical JSON of call and result.

    With ``repeats`` each further call or result of an identifier that differs from the first in any
    column has a row as well: status duplicate_id, no wave, and the number of its equals.
    """
    calls_of, call_repeats = _folded(calls, ["turn", "name", "arguments", "after"], "n_calls")
    results_of, result_repeats = _folded(results, ["turn", "content"], "n_results")
    c = calls_of.select("node", "own.*", "n_calls")
    r = results_of.select("node", F.col("own").alias("r"), "n_results")
    both = c.join(waves(c.select("node.*", "turn", "after")), "node").join(r, "node", "full").select(
        "node.conv",
        F.coalesce("turn", "r.turn").alias("turn"),
        F.col("node.id").alias("call_id"),
        "name",
        "arguments",
        F.col("r.content").alias("content"),
        F.when(F.col("n_calls").isNull(), "no_call")
        .when(F.col("n_results").isNull(), "no_result")
        .otherwise("linked")
        .alias("status"),
        "wave",
        F.coalesce("missing", F.lit(False)).alias("missing"),
        F.coalesce("circle", F.lit(False)).alias("circle"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )

    def alone(df: DataFrame, call: bool, status: str = "no_id") -> DataFrame:
        text = F.lit(None).cast("string")
        n = "n_calls" if call else "n_results"
        count = F.col(n) if n in df.columns else F.lit(1).cast("long")
        return df.select(
            "conv",
            "turn",
            F.col("id").alias("call_id"),
            (F.col("name") if call else text).alias("name"),
            (F.col("arguments") if call else text).alias("arguments"),
            (text if call else F.col("content")).alias("content"),
            F.lit(status).alias("status"),
            F.lit(None).cast("long").alias("wave"),
            F.lit(False).alias("missing"),
            F.lit(False).alias("circle"),
            (count if call else F.lit(0).cast("long")).alias("n_calls"),
            (F.lit(0).cast("long") if call else count).alias("n_results"),
        )

    nameless = [alone(calls.where("id IS NULL"), True), alone(results.where("id IS NULL"), False)]
    further = [alone(call_repeats, True, "duplicate_id"), alone(result_repeats, False, "duplicate_id")]
    for rows in [*nameless, *(further if repeats else [])]:
        both = both.unionByName(rows)
    given = ("call_id", "name", "arguments", "content", "missing", "circle", "n_calls", "status")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, records = [], []
            for call_id, name, text, content, missing, circle, n_calls, status in zip(*columns(batch, *given), strict=True):
                error, arguments = None, None
                if n_calls:
                    try:
                        arguments = json.loads(text or "", parse_constant=lambda x: 1 / 0, parse_float=_finite)
                    except (ValueError, ZeroDivisionError, RecursionError):
                        error, arguments = "arguments: not JSON", text
                    except OverflowError:
                        error, arguments = "arguments: a number is too large", text
                    else:
                        schema = schemas.get(name)
                        error = "name: unknown tool" if schema is None else problem(arguments, schema)
                    if error is None and missing:
                        error = "after: no such call"
                    if error is None and circle:
                        error = "after: in a circle"
                    if error is None and status == "duplicate_id":
                        error = "id: not its first call"
                errors.append(_whole(error))
                records.append(canonical({"arguments": arguments, "id": call_id, "name": name, "result": content}))
            keep = [(f, c) for f, c in zip(batch.schema, batch.columns) if f.name in _KEPT]
            schema = pa.schema([*[f for f, _ in keep], ("error", pa.string()), ("record", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in keep], pa.array(errors, pa.string()), pa.array(records, pa.string())], schema=schema
            )

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name in _KEPT]
    checked = both.mapInArrow(run, ", ".join([*kept, "error string", "record string"]))
    return checked.withColumn("valid", F.col("error").isNull() & (F.col("n_calls") > 0))


_KEPT = ("conv", "turn", "call_id", "name", "status", "wave", "n_calls", "n_results")

# Tools by which a conversation's turns are told as calls. Fixed values.
TURN_TOOLS = {
    "ask": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["query", "turn"],
        "additionalProperties": False,
    },
    "follow_up": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 1},
            "previous": {"type": "string"},
        },
        "required": ["query", "turn", "previous"],
        "additionalProperties": False,
    },
}


def turns_as_calls(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results told by a chat log: a user's turn asks, the turn after it by the assistant is
    the result. A later question follows the one two turns before it, if there is one."""
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    has_id = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asks = talks.where("role = 'user'")
    before = asks.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("follows", F.lit(True))
    asks = asks.join(before, ["conv_id", "turn"], "left")
    previous = F.when(F.col("follows"), ident(F.col("turn") - 2))
    calls = asks.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.when(has_id, ident(F.col("turn"))).alias("id"),
        F.when(previous.isNull(), "ask").otherwise("follow_up").alias("name"),
        F.to_json(F.struct(previous.alias("previous"), F.col("text").alias("query"), "turn")).alias("arguments"),
        F.when(previous.isNull(), F.array().cast("array<string>")).otherwise(F.array(previous)).alias("after"),
    )
    results = talks.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.when(has_id, ident(F.col("turn") - 1)).alias("id"),
        F.col("text").alias("content"),
    )
    return calls, results
