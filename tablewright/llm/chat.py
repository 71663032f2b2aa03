"""Chat formatting: tool calls linked to their results.

DataFrame functions alone.  Calls and results meet by a hash join on their
identifier (ids are spread evenly, so a long conversation is no hot key); calls
are ordered topologically by the calls they depend on, level by level; their
arguments are validated against the tool's schema; every message is serialised
as canonical JSON (keys sorted, no blanks), which the variant type gives.

Defined cases: a call id used again has the dependencies of the first by turn;
of several results the first by turn answers; calls that depend on a missing
call depend on nothing there; calls on a cycle, or behind one, have a null
level; arguments that aren't a JSON object are invalid; a tool without a schema
makes a call invalid; null ids link with nothing; repeated messages give
repeated rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: JSON type names by what the variant type calls them.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$"}

#: A value's form: a type's name, ``{"enum": [...]}``, ``{"array": form}`` or
#: ``{"object": schema}``; a schema's fields have a form and whether they must be.
Form = str | dict
Schema = dict[str, tuple[Form, bool]]


def canonical(text: Column) -> Column:
    """Canonical JSON text; null where ``text`` doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def fits(value: Column, form: Form) -> Column:
    """Whether a variant that isn't null has the form."""
    if isinstance(form, str):
        return F.schema_of_variant(value).rlike(TYPES[form])
    if "enum" in form:
        return F.to_json(value).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in form["enum"]])
    if "array" in form:
        return F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(fits(x, form["array"]), F.lit(False))), F.lit(False))
    fields: Schema = form["object"]
    keys = F.json_object_keys(F.to_json(value))
    ok = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)).cast("array<string>"))) == 0)
    for field, (inner, required) in fields.items():
        here = F.try_variant_get(value, f"$.{field}", "variant")
        absent = here.isNull() | (F.schema_of_variant(here) == "VOID")
        ok = ok & F.when(absent, F.lit(not required)).otherwise(F.coalesce(fits(here, inner), F.lit(False)))
    return ok


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """Whether arguments satisfy the schema of the tool ``name``: required
    fields present, known fields of their form at any depth, no unknown fields."""
    parsed, found = F.try_parse_json(arguments), F.lit(False)
    for tool, fields in schemas.items():
        found = F.when(name == tool, fits(parsed, {"object": fields})).otherwise(found)
    return F.coalesce(found, F.lit(False))


def topological_levels(calls: DataFrame) -> DataFrame:
    """``call_id, level`` of ``calls`` (``call_id, depends_on array<string>``,
    ids distinct): 0 without dependencies, else one more than the deepest.
    Chains by pointer doubling, other graphs by one round a level; each round
    reads settled rows."""
    nodes = settled(calls.select("call_id").filter("call_id IS NOT NULL").distinct())
    edges = calls.select("call_id", F.explode("depends_on").alias("needs")).distinct()
    edges = settled(edges.join(nodes.select(F.col("call_id").alias("needs")), "needs", "left_semi"))
    if edges.groupBy("call_id").count().filter("count > 1").isEmpty():
        return chain_levels(nodes, edges)
    found = settled(nodes.join(edges, "call_id", "left_anti").withColumn("level", F.lit(0)))
    frontier, level = found, 0
    while not frontier.isEmpty():
        level += 1
        met = frontier.select(F.col("call_id").alias("needs"), F.lit(True).alias("met"))
        marked = settled(edges.select("call_id", "needs").join(met, "needs", "left"))
        free = marked.groupBy("call_id").agg(F.bool_and(F.col("met").isNotNull()).alias("free")).filter("free")
        frontier = settled(free.select("call_id", F.lit(level).alias("level")))
        found, edges = found.unionByName(frontier), marked.filter("met IS NULL")
    return nodes.join(found, "call_id", "left")


def chain_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels where a call depends on at most one: each round a call's pointer
    skips as far again, and its level adds what it skipped.  A pointer that is
    left after as many rounds as the longest chain needs runs in a cycle."""
    length = F.when(F.col("needs").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    now = settled(nodes.join(edges, "call_id", "left").select("call_id", F.col("needs").alias("to"), length.alias("level")))
    for _ in range(nodes.count().bit_length() + 1):
        if now.filter("to IS NOT NULL").isEmpty():
            break
        far = now.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        now = settled(now.join(far, "to", "left").select("call_id", F.col("next").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return now.select("call_id", F.when(F.col("to").isNull(), F.col("level").cast("int")).alias("level"))


def link_tool_calls(messages: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """``messages``: ``conv_id, turn, role, content, call_id, answers, name,
    arguments, depends_on``; a call has ``call_id``, a result ``answers``.

    Adds ``linked`` (the call has a result, the result has a call), ``valid``
    (calls), ``level`` (calls, and results by their call) and ``canonical``."""
    calls = messages.filter("call_id IS NOT NULL")
    first = calls.groupBy("call_id").agg(F.min(F.struct("turn", "depends_on")).alias("f")).select("call_id", "f.depends_on")
    levels = topological_levels(first)
    results = messages.filter("answers IS NOT NULL").groupBy("answers").agg(F.min("turn").alias("answered"))
    known = settled(levels.join(results, F.col("call_id") == F.col("answers"), "left").select(F.col("call_id").alias("id"), "level", F.col("answered").isNotNull().alias("has_result")))
    # Known ids are settled, so that a skewed join can be split; messages
    # without an id stay where they are.
    named = messages.withColumn("id", F.coalesce("call_id", "answers"))
    met = named.filter("id IS NOT NULL").join(known, "id", "left")
    rows = met.unionByName(named.filter("id IS NULL").withColumns({"level": F.lit(None).cast("int"), "has_result": F.lit(None).cast("boolean")}))
    is_call, is_result = F.col("call_id").isNotNull(), F.col("answers").isNotNull()
    valid = F.when(is_call, valid_arguments(F.col("name"), F.col("arguments"), schemas))
    linked = F.when(is_call, F.coalesce("has_result", F.lit(False))).when(is_result, F.col("has_result").isNotNull())
    # Struct fields stand in the order of their names; null ones are left out.
    body = F.to_json(F.struct(F.when(is_call, F.try_parse_json("arguments")).alias("arguments"), F.col("id").alias("call_id"), F.when(~is_call, F.col("content")).alias("content"), F.when(is_call, F.col("name")).alias("name"), "role", "turn"))
    return rows.withColumns({"valid": valid, "linked": linked, "canonical": body}).select("conv_id", "turn", "role", "id", "linked", "valid", "level", "canonical")


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as calls and results: each user turn calls the tool
    ``reply`` with its text and turn, the turn after it is the result if it is
    the assistant's, and a call depends on the call two turns before."""
    key = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    user, assistant = (F.col("role") == "user") & placed, (F.col("role") == "assistant") & placed
    return conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(user, key(0)).alias("call_id"),
        F.when(assistant, key(1)).alias("answers"),
        F.when(user, F.lit("reply")).alias("name"),
        F.when(user, F.to_json(F.struct("text", "turn"))).alias("arguments"),
        F.when(user, F.array(key(2))).alias("depends_on"),
    )


CONVERSATION_SCHEMAS: dict[str, Schema] = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
