"""Operator 8: tool-call linking for chat data.

`link_calls(calls, results, schemas)` joins calls and results by identifier, orders the calls of a conversation so
that each comes after those it depends on, validates arguments against JSON schemas and writes each linked call as
canonical JSON (sorted keys, no spaces, UTF-8 as it is).

* Join: results are first reduced to the earliest one of each identifier and their number (map-side, so an identifier
  with very many results costs one row per task), then joined by a hash of the identifier; a full outer join keeps calls
  without a result (`missing_result`) and results without a call (`missing_call`). A null identifier links with nothing.
* Order: (wave, turn, call_id). A call that depends on no other call of its conversation has wave 0, any other call the
  wave after the last one that it depends on; calls on a cycle, or behind one, have a null wave and status `cycle`.
  Dependencies on unknown identifiers, and on calls of other conversations, are ignored; calls without a conversation
  aren't ordered (wave 0). Conversations of up to `LONG` calls and dependencies are ordered by one task each; longer
  ones aren't gathered: rounds over all of them peel off one wave after the other.
* Validation: `type`, `required`, `properties`, `additionalProperties`, `items`, `enum`, `minLength`, `maxLength`,
  `minimum`, `maximum`. Arguments that aren't JSON (NaN, infinities and numbers beyond a double's range
  aren't), and names without a schema, are errors too; such arguments are kept as text.

Nulls give `null` in the JSON and fail the schema if it asks for a value. Repeated calls each get their row. Empty
tables give empty results. Extra columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import spread_join
from .stage import written

#: The most rows (calls and dependencies) of a conversation that one task orders.
LONG = 1 << 18

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}


_KEYWORDS = set("type enum minLength maxLength minimum maximum items properties required additionalProperties".split())
_NOTES = set("title description default examples deprecated readOnly writeOnly $schema $id $comment".split())


def supported(schema: dict, at: str = "$") -> None:
    """Raise ValueError if the schema says what `violations` doesn't check."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema that isn't an object is not supported")
    if unknown := sorted(set(schema) - _KEYWORDS - _NOTES):
        raise ValueError(f"{at}: not supported: {', '.join(unknown)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: not supported: additionalProperties with a schema")
    if "items" in schema:
        supported(schema["items"], f"{at}[]")
    for k, x in schema.get("properties", {}).items():
        supported(x, f"{at}.{k}")


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of the schema the value breaks, in order."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            out.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: too small")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: too large")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in own:
                out += violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def canonical(value: Any) -> str:
    """Raises ValueError for numbers that JSON has no form for."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str) -> Any:
    """The value of JSON. NaN, infinities, numbers beyond a double's range, and what nests too deep aren't accepted."""
    try:
        value = json.loads(text)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


def _levels(table: pa.Table) -> pa.Table:
    """call_id, wave of a conversation's rows (call_id, on; on is null in a call's own row)."""
    missing: dict[Any, int] = {}
    after: dict[Any, list] = {}
    for call, on in zip(table.column("call_id").to_pylist(), table.column("on").to_pylist(), strict=True):
        missing.setdefault(call, 0)
        if on is not None:
            missing[call] += 1
            after.setdefault(on, []).append(call)
    wave: dict[Any, int | None] = dict.fromkeys(missing)
    level, ready = 0, [call for call, n in missing.items() if not n]
    while ready:
        freed = []
        for call in ready:
            wave[call] = level
            for next_one in after.get(call, ()):
                missing[next_one] -= 1
                if not missing[next_one]:
                    freed.append(next_one)
        level, ready = level + 1, freed
    return pa.table({"call_id": pa.array(list(wave), table.schema.field("call_id").type), "wave": pa.array(list(wave.values()), pa.int32())})


def _peeled(nodes: DataFrame, left: DataFrame) -> DataFrame:
    """The same of conversations of any length, by one round for each wave: calls `nodes`, dependencies `left` (call_id, on)."""
    placed = nodes.select("call_id", F.lit(None).cast("int").alias("wave")).limit(0)
    wave = 0
    while nodes.take(1):
        ready = written(nodes.join(left.select("call_id").distinct(), "call_id", "left_anti"), "wave")
        if not ready.take(1):
            return placed.unionByName(nodes.select("call_id", F.lit(None).cast("int").alias("wave")))
        placed = placed.unionByName(ready.select("call_id", F.lit(wave).alias("wave")))
        nodes = written(nodes.join(ready, "call_id", "left_anti"), "unplaced")
        left = written(left.join(ready.select(F.col("call_id").alias("on")), "on", "left_anti").select("call_id", "on"), "waiting")
        wave += 1
    return placed


def _waves(calls: DataFrame) -> DataFrame:
    """call_id, wave of the calls in conversations with dependencies; wave null on cycles and behind them."""
    order = calls.where("call_id is not null").groupBy("call_id").agg(F.min("conv_id").alias("conv_id"))
    asked = calls.select("call_id", F.explode("after").alias("on")).where("call_id is not null and on is not null").distinct()
    deps = asked.join(order, "call_id").join(order.select(F.col("call_id").alias("on"), F.col("conv_id").alias("conv_on")), "on").where("conv_on = conv_id")
    deps = written(deps.select("conv_id", "call_id", "on"), "dependencies")
    nodes = order.join(deps.select("conv_id").distinct(), "conv_id", "left_semi")
    rows = written(deps.unionByName(nodes.select("conv_id", "call_id", F.lit(None).cast(deps.schema["on"].dataType).alias("on"))), "calls")
    sizes = written(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    long = written(sizes.where(F.col("rows") > LONG), "long")
    # what one task gathers has at most LONG rows
    few = rows.join(long.select("conv_id"), "conv_id", "left_anti") if long.take(1) else rows
    kind = rows.schema["call_id"].dataType.simpleString()
    waves = few.groupBy("conv_id").applyInArrow(_levels, f"call_id {kind}, wave int")
    if long.take(1):
        many = written(spread_join(rows, long, "conv_id", "rows", long.agg(F.sum("rows")).first()[0]), "long-calls")
        waves = waves.unionByName(_peeled(many.where("on is null").select("call_id"), many.where("on is not null").select("call_id", "on")))
    return waves


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON), after (array of call_id); results: conv_id, turn, call_id, content.

    Returns conv_id, call_id, turn, wave, status, n_results, valid, errors, json; one row per call or unmatched identifier.
    Schemas with keywords that aren't checked raise ValueError.
    """
    for name, schema in schemas.items():
        supported(schema, name)
    earliest = results.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content", "conv_id")).alias("result"))
    earliest = written(earliest, "results").withColumnRenamed("call_id", "result_id")
    waves = _waves(calls).select(F.col("call_id").alias("wave_id"), "wave", F.lit(True).alias("turned"))
    own = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.lit(True).alias("called")).join(waves, F.col("call_id") == F.col("wave_id"), "left")
    linked = own.join(earliest, F.col("call_id") == F.col("result_id"), "full")
    status = (
        F.when(F.col("called").isNull(), "missing_call").when(F.col("result_id").isNull(), "missing_result").when(F.col("turned") & F.col("wave").isNull(), "cycle").otherwise("linked")
    )
    linked = linked.select(
        F.coalesce("conv_id", "result.conv_id").alias("conv_id"), F.coalesce("call_id", "result_id").alias("call_id"), F.coalesce("turn", "result.turn").alias("turn"),
        F.when(F.col("turned"), F.col("wave")).when(F.col("called"), F.lit(0)).alias("wave"), status.alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "name", "arguments", "result.content",
    )

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, out = [], [], []
            for row in batch.select(["call_id", "status", "name", "arguments", "content"]).to_pylist():
                wrong: list[str] = []
                arguments = None
                if row["status"] != "missing_call":
                    try:
                        arguments = parsed(row["arguments"] or "null")
                        wrong = violations(arguments, schemas[row["name"]]) if row["name"] in schemas else ["name: no schema"]
                    except ValueError:
                        wrong, arguments = ["arguments: not JSON"], row["arguments"]
                valid.append(not wrong and row["status"] != "missing_call")
                errors.append(wrong)
                out.append(canonical({"arguments": arguments, "id": row["call_id"], "name": row["name"], "result": row["content"]}))
            head = [batch.column(c) for c in ("conv_id", "call_id", "turn", "wave", "status", "n_results")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())], ["conv_id", "call_id", "turn", "wave", "status", "n_results", "valid", "errors", "json"])

    kinds = {c: linked.schema[c].dataType.simpleString() for c in ("conv_id", "call_id", "turn")}
    return linked.mapInArrow(serialise, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, wave int, status string, n_results long, valid boolean, errors array<string>, json string")


#: The schema of a turn that asks for a reply.
REPLY_SCHEMA = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of plain turns (conv_id, turn, role, text).

    A user's turn calls `reply` under the identifier "conversation:turn" and depends on the user's turn before; an
    assistant's turn is the result for the turn before it. Other roles are neither.
    """
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    prompt = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    calls = conversations.where("role = 'user'").select("conv_id", "turn", F.when(named, ident(0)).alias("call_id"), F.lit("reply").alias("name"), prompt.alias("arguments"), F.when(named, F.array(ident(2))).alias("after"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", F.when(named, ident(1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_turns_sql() -> str:
    """`link_calls` of `turns_as_calls` as SQL for DuckDB over `conversations`."""
    return """
WITH RECURSIVE calls AS (SELECT conv_id, turn, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || turn END AS call_id, text, true AS is_call FROM conversations WHERE role = 'user'),
answers AS (SELECT CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || (turn - 1) END AS result_id, turn, text, conv_id FROM conversations WHERE role = 'assistant'),
results AS (SELECT result_id, count(*) AS n_results, min((turn, text, conv_id)) AS r FROM answers WHERE result_id IS NOT NULL GROUP BY 1),
ids AS (SELECT DISTINCT call_id, conv_id || ':' || (turn - 2) AS dep FROM calls WHERE call_id IS NOT NULL),
waves AS (SELECT call_id, 0 AS wave FROM ids WHERE dep NOT IN (SELECT call_id FROM ids) UNION ALL SELECT i.call_id, w.wave + 1 FROM waves w JOIN ids i ON i.dep = w.call_id),
linked AS (SELECT c.*, result_id, n_results, r[1] AS r_turn, r[2] AS content, r[3] AS r_conv, coalesce(is_call, false) AS called, wave FROM calls c FULL JOIN results ON call_id = result_id LEFT JOIN waves w ON w.call_id = c.call_id)
SELECT coalesce(conv_id, r_conv) AS conv_id, coalesce(call_id, result_id) AS call_id, coalesce(turn, r_turn) AS turn, CASE WHEN called THEN coalesce(wave, 0) END::INTEGER AS wave,
       CASE WHEN NOT called THEN 'missing_call' WHEN result_id IS NULL THEN 'missing_result' ELSE 'linked' END AS status, coalesce(n_results, 0)::BIGINT AS n_results,
       called AND length(coalesce(text, '')) >= 20 AND turn >= 0 AS valid,
       CASE WHEN NOT called THEN []::VARCHAR[] WHEN text IS NULL THEN ['$.prompt: not string'] WHEN length(text) < 20 THEN ['$.prompt: too short'] ELSE []::VARCHAR[] END AS errors,
       '{"arguments":' || CASE WHEN called THEN '{"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '}' ELSE 'null' END || ',"id":' || coalesce(to_json(coalesce(call_id, result_id))::VARCHAR, 'null')
       || ',"name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM linked"""
