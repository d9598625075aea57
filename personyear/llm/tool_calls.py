"""Tool calls of conversations: linked to results, ordered, validated, serialised.  DataFrame functions only.

Calls and results meet in a hash join on conversation and call id.  A call comes
after the calls it depends on: its level is the length of the longest chain below
it, found by taking away, round by round, all calls whose dependencies are gone.
Arguments are parsed as variants, which keep object fields sorted, so the JSON
written from them is canonical.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personyear.operators.ranks import running_before
from personyear.session import written

_TYPES = {
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def _key(id_col: str, conversation: str = "conv_id") -> Column:
    """Names a call in a conversation; null where the id is."""
    return F.concat(F.coalesce(F.col(conversation).cast("string"), F.lit("null")), F.lit(":"), F.col(id_col))


def argument_errors(schemas: dict[str, dict[str, dict[str, Any]]], name: Column, arguments: Column) -> Column:
    """What is wrong with a call's arguments, as sorted texts ``parameter: fault``.

    ``schemas`` maps a tool to its parameters; a parameter may have ``type``,
    ``required``, ``minimum``, ``maximum`` and ``enum``.  Parameters not listed are
    faults, as are unknown tools and arguments that are not one JSON object without
    repeated fields.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    faults = [
        F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), "tool: unknown"),
        F.when(~is_object, "arguments: not an object"),
    ]
    for tool, parameters in schemas.items():
        here = (name == tool) & is_object
        for parameter, rule in parameters.items():
            found = F.try_variant_get(value, f"$.{parameter}", "variant")
            kind = F.schema_of_variant(found)
            present = found.isNotNull()
            if rule.get("required"):
                faults.append(F.when(here & ~present, f"{parameter}: missing"))
            if "type" in rule:
                fits = F.lit(False)
                for prefix in _TYPES[rule["type"]]:
                    fits = fits | kind.startswith(prefix)
                faults.append(F.when(here & present & ~fits, f"{parameter}: not {rule['type']}"))
            number = F.try_variant_get(value, f"$.{parameter}", "double")
            for side, bad in (("minimum", lambda x, b: x < b), ("maximum", lambda x, b: x > b)):
                if side in rule:
                    faults.append(F.when(here & bad(number, rule[side]), f"{parameter}: beyond {side}"))
            if "enum" in rule:
                text = F.try_variant_get(value, f"$.{parameter}", "string")
                faults.append(F.when(here & present & ~F.coalesce(text.isin(rule["enum"]), F.lit(False)), f"{parameter}: not listed"))
        names = F.map_keys(F.from_json(arguments, "map<string,string>"))
        unlisted = F.array_except(names, F.array(*(F.lit(p) for p in parameters)).cast("array<string>"))
        faults.append(F.when(here & (F.size(unlisted) > 0), F.concat(F.lit("unlisted: "), F.array_join(F.array_sort(unlisted), ","))))
    return F.array_sort(F.array_compact(F.array(*faults)))


def levels(calls: DataFrame) -> DataFrame:
    """``key, level, unknown``: the level of each call id, null on or behind a cycle, and whether a dependency is no call.

    ``calls`` has ``key`` and ``needs``, the keys it depends on.  A round takes away
    one level; both tables shrink, and each is written, so that plans stay short.
    There are as many rounds as levels.
    """
    nodes = written(calls.where("key is not null").select("key").distinct(), "calls")
    wanted = calls.where("key is not null").select("key", F.explode("needs").alias("need")).distinct()
    known = nodes.select(F.col("key").alias("need"), F.lit(True).alias("known"))
    edges = written(wanted.join(known, "need", "left"), "edges")
    unknown = edges.where("known is null").select("key").distinct().withColumn("unknown", F.lit(True))
    left, waiting, done, level = nodes, edges.where("known").select("key", "need"), None, 0
    while True:
        free = written(left.join(waiting.select("key").distinct(), "key", "left_anti"), "level")
        if free.isEmpty():
            break
        numbered = free.withColumn("level", F.lit(level))
        done = numbered if done is None else done.union(numbered)
        left = written(left.join(free, "key", "left_anti"), "calls-left")
        gone = free.withColumnRenamed("key", "need")
        waiting = written(waiting.join(gone, "need", "left_anti").select("key", "need"), "edges-left")
        level += 1
    found = nodes if done is None else nodes.join(done, "key", "left")
    if done is None:
        found = found.withColumn("level", F.lit(None).cast("int"))
    return found.join(unknown, "key", "left").select("key", "level", F.coalesce("unknown", F.lit(False)).alias("unknown"))


def link_tool_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict[str, Any]]], others: DataFrame | None = None
) -> DataFrame:
    """One row per call, per result without a call and per other message, in topological order of its conversation.

    ``calls`` has ``conv_id, turn, call_id, name, arguments`` (JSON text) and
    ``depends_on`` (call ids); ``results`` has ``conv_id, turn, call_id, output``;
    ``others``, messages that are neither, has ``conv_id, turn, role, text``.
    Other columns are not read.

    Returned: ``conv_id, call_id, turn, name, status, level, position, errors,
    n_results, json``.  ``status`` is ``answered``, ``unanswered``, ``cycle`` (the
    call is on or behind a cycle of dependencies), ``orphan`` (a result without a
    call) or ``message`` (one of ``others``, with its role and text as ``json``).
    ``position`` counts a conversation's rows by level (cycles, then orphans, then
    messages, last), turn and id, from 0.  Of several results the first by turn and
    output is the answer.  Calls that share an id share level and answer.  A call
    without id has no result and nothing waits for it; a result without id is an
    orphan.  Conversations without id are one conversation.
    """
    asked = calls.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments", "depends_on", _key("call_id").alias("key")
    )
    prefix = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"))
    asked = asked.withColumn("needs", F.transform(F.coalesce("depends_on", F.array().cast("array<string>")), lambda x: F.concat(prefix, x)))
    asked = written(asked, "asked")
    given = results.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "output", _key("call_id").alias("key"))
    answers = given.where("key is not null").groupBy("key").agg(
        F.min(F.struct("turn", "output")).alias("answer"), F.count("*").alias("n_results")
    )
    ordered = levels(asked)
    linked = asked.join(ordered, "key", "left").join(answers, "key", "left")
    arguments = F.try_parse_json("arguments")
    errors = argument_errors(schemas, F.col("name"), F.col("arguments"))
    unknown = F.when(F.col("unknown"), F.array(F.lit("depends_on: unknown call"))).otherwise(F.array().cast("array<string>"))
    level = F.when(F.col("key").isNull(), 0).otherwise(F.col("level"))
    status = F.when(level.isNull(), "cycle").when(F.col("answer").isNotNull(), "answered").otherwise("unanswered")
    rows = linked.select(
        "conv_id", "call_id", "turn", "name",
        status.alias("status"),
        level.alias("level"),
        F.array_sort(F.concat(errors, unknown)).alias("errors"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.to_json(
            F.struct(
                arguments.alias("arguments"), F.array_sort("depends_on").alias("depends_on"), F.col("call_id").alias("id"),
                "name", F.col("answer.output").alias("result"), status.alias("status"),
            )
        ).alias("json"),
    )
    orphans = given.join(asked.select("key").where("key is not null").distinct(), "key", "left_anti").select(
        "conv_id", "call_id", "turn",
        F.lit(None).cast("string").alias("name"),
        F.lit("orphan").alias("status"),
        F.lit(None).cast("int").alias("level"),
        F.array().cast("array<string>").alias("errors"),
        F.lit(0).cast("long").alias("n_results"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("output").alias("result"), F.lit("orphan").alias("status"))).alias("json"),
    )
    every = rows.unionByName(orphans)
    if others is not None:
        every = every.unionByName(
            others.select(
                "conv_id", F.lit(None).cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"),
                F.lit(None).cast("string").alias("name"),
                F.lit("message").alias("status"),
                F.lit(None).cast("int").alias("level"),
                F.array().cast("array<string>").alias("errors"),
                F.lit(0).cast("long").alias("n_results"),
                F.to_json(F.struct("role", F.lit("message").alias("status"), "text")).alias("json"),
            )
        )
    # Conversations of any size: positions come from a running count over ranges of the order.
    group = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    behind = F.when(F.col("status") == "message", 2).when(F.col("status") == "orphan", 1).otherwise(0)
    last = F.when(behind > 0, F.lit(2**31 - 2) + behind.cast("long")).otherwise(F.coalesce("level", F.lit(2**31 - 2)))
    every = written(every.withColumns({"group": group, "rank": last}), "linked")
    # Equal rows need an order too; any will do, as they are equal.
    every = every.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("group"), F.col("rank"), F.col("turn"), F.col("call_id"), F.col("json"), F.col("row")]
    counted = running_before(every, order, F.lit(1), "before")
    starts = counted.groupBy("group").agg(F.min("before").alias("start"))
    return counted.join(starts, "group").select(
        "conv_id", "call_id", "turn", "name", "status", "level", (F.col("before") - F.col("start")).alias("position"),
        "errors", "n_results", "json",
    )


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool traffic derived from plain conversations: assistant turns are calls, user turns the results of the turn before.

    Messages of any other role, or of none, are the third table.

    The tool and its arguments follow from turn, length and text, so some arguments
    break their schema, some calls have no result and some results no call.  A call
    depends on the one at half its turn, if it is not the same.
    """
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    size = F.length("text")
    tool = F.element_at(F.array(F.lit("note"), F.lit("search"), F.lit("translate")), (F.col("turn") % 3 + 1).cast("int"))
    query = F.when(size >= 20, F.col("text"))
    target = F.element_at(F.array(*(F.lit(x) for x in ("fr", "es", "de", "en", "??"))), (size % 5 + 1).cast("int"))
    arguments = (
        F.when(tool == "search", F.to_json(F.struct((size % 12).alias("top"), query.alias("query"))))
        .when(tool == "translate", F.to_json(F.struct(F.col("text"), target.alias("target"))))
        .otherwise(F.to_json(F.struct((size % 2 == 0).alias("pinned"), F.col("text").alias("body"))))
    )
    half = F.floor(F.col("turn") / 2)
    needs = F.when((F.col("turn") > 0) & (half != F.col("turn")), F.array(call_id(half))).otherwise(F.array().cast("array<string>"))
    calls = messages.where("role = 'assistant'").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), needs.alias("depends_on")
    )
    results = messages.where("role = 'user'").select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("output")
    )
    known = F.coalesce(F.col("role").isin("assistant", "user"), F.lit(False))
    return calls, results, messages.where(~known).select("conv_id", "turn", "role", "text")


#: Schemas of the derived tools.
SCHEMAS = {
    "search": {"query": {"type": "string", "required": True}, "top": {"type": "integer", "minimum": 1, "maximum": 10}},
    "translate": {"text": {"type": "string", "required": True}, "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}},
    "note": {"body": {"type": "string", "required": True}, "pinned": {"type": "boolean"}},
}
