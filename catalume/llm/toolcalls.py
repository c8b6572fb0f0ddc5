"""Tool-call linking in DataFrame functions alone.

Calls meet their results by identifier, are layered by what they depend on,
validated against their tool's parameters, and serialised as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpointed

_KEY = ["conv_id", "call_id"]


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (conv_id, call_id) with ``level``: 0 without dependencies, else one more than the deepest.

    Each round settles the calls whose dependencies are all settled, so rounds are as many as the
    deepest chain and only open edges move. Calls on or behind a cycle get a null level.
    edges: conv_id, call_id, needs; those to unknown calls must be left out beforehand.
    """
    settled = nodes.join(edges.select(*_KEY).distinct(), _KEY, "left_anti").withColumn("level", F.lit(0))
    done, open_, depth = [checkpointed(settled)], checkpointed(edges.select(*_KEY, "needs").distinct()), 0
    while not open_.isEmpty():
        # Edges to what the last round settled fall away; a call without others is settled now.
        last = done[-1].select("conv_id", F.col("call_id").alias("needs"))
        rest = checkpointed(open_.join(last, ["conv_id", "needs"], "left_anti").select(*_KEY, "needs"))
        depth += 1
        now = checkpointed(open_.select(*_KEY).distinct().join(rest.select(*_KEY).distinct(), _KEY, "left_anti").withColumn("level", F.lit(depth)))
        if now.isEmpty():
            break
        done.append(now)
        open_ = rest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return nodes.join(out, _KEY, "left")


def positions(calls: DataFrame) -> DataFrame:
    """calls (conv_id, level, seq, call_id) with position: their place in that order in the conversation.

    Calls are sorted over all partitions, so a conversation of any length is no burden; a row for each
    partition that a conversation lies in tells how many of its calls lie before.
    """
    order = ["conv_id", F.col("level").asc_nulls_last(), "seq", "call_id"]
    kept = checkpointed(calls.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    kept = kept.withColumn("__part", F.shiftright("__id", 33))
    parts = kept.groupBy("conv_id", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return kept.join(parts, ["conv_id", "__part"]).withColumn("position", F.col("__before") + F.col("__id") - F.col("__first")).drop("__id", "__part", "__first", "__before")


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    out = F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
    return out.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("number")


def argument_errors(given: Column, schema: Column) -> Column:
    """Sorted faults of a map of variants against a map from parameter to (type, required)."""
    name = lambda kind: lambda p: F.concat(F.lit(kind), p)
    missing = F.transform(F.filter(F.map_keys(schema), lambda p: F.element_at(schema, p)["required"] & ~F.map_contains_key(given, p)), name("missing:"))
    unknown = F.transform(F.filter(F.map_keys(given), lambda p: ~F.map_contains_key(schema, p)), name("unknown:"))
    kind, wanted = (lambda p: _json_type(F.element_at(given, p))), (lambda p: F.element_at(schema, p)["type"])
    fits = lambda p: (kind(p) == wanted(p)) | ((kind(p) == "integer") & (wanted(p) == "number"))
    wrong = F.transform(F.filter(F.map_keys(given), lambda p: F.map_contains_key(schema, p) & ~fits(p)), name("type:"))
    return F.array_sort(F.concat(missing, unknown, wrong))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call: conv_id, call_id, seq, name, level, position, status
    (linked, unanswered, orphan), n_calls, n_results, valid, errors, json.

    calls: conv_id, call_id, seq, name, arguments (JSON text), depends_on (array of call_ids);
    results: conv_id, call_id, seq, content; schemas: name, param, type (of JSON Schema), required.
    Other columns are ignored. position is a call's place, from 0, in the topological order of its conversation
    by level, seq and call_id; calls on or behind a cycle come last. A parameter given twice counts once, by its
    least type, and is required if one row says so (null does not); a row without param names a tool that may have none.
    Numbers are as the JSON parser takes them: 1.0 is written 1, 1e0 as 1.0.
    A call_id given twice counts once, by its least seq and arguments; so does a result. Rows
    without conv_id or call_id are dropped, having nothing to link by. Arguments that aren't a JSON
    object give the error ``json``, a tool without schema ``tool``, a dependency on an unknown call
    ``needs:ID``, a cycle ``cycle``; null arguments are an empty object. Objects' keys are sorted and
    no space is left in ``json``; fields without value are left out. Empty tables give empty results.
    """
    named = lambda df: df.where("conv_id is not null and call_id is not null")
    first = F.struct("seq", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    one = checkpointed(named(calls).groupBy(*_KEY).agg(F.count("*").alias("n_calls"), F.min(first).alias("c")).select(*_KEY, "n_calls", "c.*"))
    answer = named(results).groupBy(*_KEY).agg(F.count("*").alias("n_results"), F.min(F.struct("seq", "content")).alias("r")).select(*_KEY, "n_results", F.col("r.seq").alias("__seq"), F.col("r.content").alias("result"))
    needs = one.select(*_KEY, F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs is not null")
    known = one.select("conv_id", F.col("call_id").alias("needs"))
    loose = needs.join(known, ["conv_id", "needs"], "left_anti").groupBy(*_KEY).agg(F.collect_set(F.concat(F.lit("needs:"), "needs")).alias("__loose"))
    levels = layers(one.select(*_KEY), needs.join(known, ["conv_id", "needs"], "left_semi"))
    params = schemas.where("name is not null").groupBy("name", "param").agg(F.min("type").alias("type"), F.coalesce(F.max("required"), F.lit(False)).alias("required"))
    entries = F.filter(F.collect_list(F.struct("param", F.struct("type", "required"))), lambda e: e["param"].isNotNull())
    tool = params.groupBy("name").agg(F.map_from_entries(entries).alias("__schema"))
    levels = positions(levels.join(one.select(*_KEY, "seq"), _KEY)).drop("seq")
    linked = one.join(levels, _KEY).join(loose, _KEY, "left").join(tool, "name", "left").join(answer, _KEY, "full_outer")
    given = F.coalesce(F.col("arguments"), F.lit("{}"))
    is_call = F.col("n_calls").isNotNull()
    parsed = F.try_parse_json(given)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    linked = linked.withColumn("__args", F.when(is_call & is_object, parsed))
    linked = linked.withColumn("__map", F.when(F.col("__args").isNotNull(), F.from_json(given, "map<string,variant>")))
    none = F.array().cast("array<string>")
    faults = F.concat(
        F.when(is_call & F.col("__args").isNull(), F.array(F.lit("json"))).otherwise(none),
        F.when(is_call & F.col("__schema").isNull(), F.array(F.lit("tool"))).otherwise(none),
        F.when(is_call & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none),
        F.array_sort(F.coalesce("__loose", none)),
        F.when(F.col("__map").isNotNull() & F.col("__schema").isNotNull(), argument_errors(F.col("__map"), F.col("__schema"))).otherwise(none),
    )
    status = F.when(~is_call, "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    linked = linked.withColumn("errors", F.array_join(faults, ",")).withColumn("status", status)
    fields = F.struct(F.col("__args").alias("arguments"), "call_id", F.when(F.size("depends_on") > 0, F.array_sort(F.array_distinct("depends_on"))).alias("depends_on"), "level", "name", "result", "status")
    return linked.select(*_KEY, F.coalesce("seq", "__seq").alias("seq"), "name", "level", "position", "status", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.when(is_call, F.col("errors") == "").alias("valid"), "errors", F.to_json(fields).alias("json"))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in conversations: a user's turn asks a tool, the assistant's turn after it answers.

    The tool and its arguments follow from the turn's text; a call builds on that of the turn
    halfway back, as follow-up questions do.
    """
    ident = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    text, words = F.coalesce("text", F.lit("")), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    back = F.floor(F.col("turn") / 4) * 2
    number = F.when(words % 5 == 0, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.substring_index(text, "\n", 1).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    query = F.when(words % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(', "query" : '), quoted))
    arguments = F.concat(F.lit('{"words" : '), number, query, F.when(words % 11 == 0, F.lit(', "lang": "xx"')).otherwise(F.lit("")), F.lit("}"))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("measure")), (words % 3 + 1).cast("int"))
    calls = turns.where("role = 'user'").select("conv_id", ident(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), name.alias("name"), arguments.alias("arguments"), F.when(back < F.col("turn"), F.array(ident(back))).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


#: The parameters of the tools that ``conversation_calls`` names: name, param, type, required.
TOOLS = [("search", "query", "string", True), ("search", "words", "integer", False), ("lookup", "query", "string", True), ("lookup", "words", "number", True), ("lookup", "lang", "string", False), ("measure", "words", "integer", True), ("measure", "query", "string", False)]
