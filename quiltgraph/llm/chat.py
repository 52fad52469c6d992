"""Chat formatting with linked tool calls, all in DataFrame expressions.

Messages are (conv_id, turn, role, text). An assistant's text that is a JSON object with
``tool_calls`` (an array of {id, name, arguments}) makes calls; a tool's text that is
a JSON object with ``tool_call_id`` is a result. Calls and results are hash-joined on
(conv_id, id) through one aggregate row for each key, so repeats never multiply, and go
back to their messages by a row number: the messages that call or answer are
written once with it, all others are formatted as they are read.
Arguments may hold {"$ref": id} to use another call's result: a call's level is one
more than the highest level of what it refers to, found in rounds that settle
calls whose references are settled; what never settles is in a cycle. Arguments
are checked against schemas by parameter (type, required). Each message is
written as canonical JSON: keys sorted, no blanks, nulls left out; calls and results
keep what other members their own JSON has.

Defined results: a null text is null content and is left out; null roles and ids likewise;
text that isn't such JSON is plain content; results without a call and calls without a
result are kept and counted as not linked; repeated rows, and rows of one turn, are
messages each, with the calls or the id of their own text; a null turn changes nothing;
calls and results of a null conv_id are kept, in the order of the text, and never linked;
a call of a tool without a schema is valid; other columns are ignored; no rows, no results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import cut, scratch_path

#: Types that a schema may name, and how Spark describes such JSON values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}

ROW = "message_row"  # a message's number, carried where it is given

Schemas = dict[str, dict[str, tuple[str, bool]]]


def _parsed(text: str) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(F.col(text)))


def _faults(schemas: Schemas) -> Column:
    """How many parameters of a call (name, arguments) are missing, mistyped or unknown."""
    total = F.lit(0)
    given = F.coalesce(F.json_object_keys(F.to_json("arguments")), F.array().cast("array<string>"))
    for name, parameters in schemas.items():
        n = F.when(F.col("arguments").isNull() & F.lit(any(need for _, need in parameters.values())), 1).otherwise(0)
        for parameter, (kind, need) in parameters.items():
            value = F.try_variant_get("arguments", f"$['{parameter}']", "variant")
            fits = F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$")
            n = n + F.when(~F.array_contains(given, parameter), int(need)).when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)
        n = n + F.size(F.array_except(given, F.array(*map(F.lit, parameters)).cast("array<string>")))
        total = F.when(F.col("name") == name, n).otherwise(total)
    return total


def tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, turn, k, id, name, arguments, faults) of each call."""
    own = [c for c in messages.columns if c == ROW]
    made = messages.where("role = 'assistant'").select("conv_id", "turn", *own, F.try_variant_get(_parsed("text"), "$.tool_calls", "array<variant>").alias("calls"))
    each = made.select("conv_id", "turn", *own, F.posexplode("calls").alias("k", "call"))
    get = lambda path, kind: F.try_variant_get("call", path, kind)
    calls = each.select("conv_id", "turn", *own, F.col("k").cast("long").alias("k"), get("$.id", "string").alias("id"), get("$.name", "string").alias("name"), get("$.arguments", "variant").alias("arguments"))
    calls = calls.withColumn("arguments", F.when(~F.is_variant_null("arguments"), F.col("arguments")))
    return calls.withColumn("faults", _faults(schemas))


def tool_results(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, id) of each result."""
    own = [c for c in messages.columns if c == ROW]
    found = messages.where("role = 'tool'").select("conv_id", "turn", *own, F.try_variant_get(_parsed("text"), "$.tool_call_id", "string").alias("id"))
    return found.where("id is not null")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of each call's id; level is null in a cycle and after one."""
    ids = calls.where("conv_id is not null and id is not null").groupBy("conv_id", "id").agg(F.flatten(F.collect_set(F.regexp_extract_all(F.to_json("arguments"), F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1)))).alias("refs"))
    needs = ids.select("conv_id", "id", F.explode("refs").alias("ref")).distinct()
    needs = cut(needs.join(ids.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_semi"))
    settled = ids.join(needs, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).alias("level"))
    level, open_ = 0, needs
    while not open_.isEmpty():
        level += 1
        settled = cut(settled)
        blocked = open_.join(settled.select("conv_id", F.col("id").alias("ref")), ["conv_id", "ref"], "left_anti").select("conv_id", "id").distinct()
        fresh = cut(open_.select("conv_id", "id").distinct().join(blocked, ["conv_id", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        settled = settled.unionByName(fresh.withColumn("level", F.lit(level)))
        open_ = cut(open_.join(fresh, ["conv_id", "id"], "left_anti"))
    return ids.select("conv_id", "id").join(settled, ["conv_id", "id"], "left")


def linked_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """Calls with what answers them: (..., level, n_results, result_turn)."""
    calls = tool_calls(messages, schemas)
    results = tool_results(messages).groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n_results"), F.min("turn").alias("result_turn"))
    return calls.join(levels(calls), ["conv_id", "id"], "left").join(results, ["conv_id", "id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))


def linked_results(messages: DataFrame) -> DataFrame:
    """Results with the call that they answer, if any: (..., name, call_turn, linked)."""
    own = [c for c in messages.columns if c == ROW]
    calls = tool_calls(messages, {}).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "k", "name")).alias("c"))
    return tool_results(messages).join(calls, ["conv_id", "id"], "left").select("conv_id", "turn", *own, "id", F.col("c.name").alias("name"), F.col("c.turn").alias("call_turn"), F.col("c").isNotNull().alias("linked"))


def _quoted(value: Column) -> Column:
    """A string as JSON; null stays null."""
    whole = F.to_json(F.struct(value.alias("a")))
    return F.when(value.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def _canonical(own: dict[str, Column], given: Column) -> Column:
    """An object of ``own`` members and those of a map of variants that have other names: by name, without nulls."""
    member = lambda name, json: F.struct(name.alias("name"), json.alias("json"))
    others = F.map_filter(given, lambda k, v: ~k.isin(*own) & v.isNotNull() & ~F.is_variant_null(v))
    more = F.transform(F.map_keys(others), lambda k: member(k, F.to_json(F.element_at(others, k))))
    known = F.array(*(member(F.lit(k), v) for k, v in own.items()))
    all_ = F.array_sort(F.filter(F.concat(known, F.coalesce(more, F.array().cast("array<struct<name:string,json:string>>"))), lambda m: m["json"].isNotNull()))
    return F.concat(F.lit("{"), F.array_join(F.transform(all_, lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["json"])), ","), F.lit("}"))


def format_messages(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row per message: its canonical JSON, its calls and results, and how many of them are linked and valid."""
    source = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    answers = F.try_variant_get(_parsed("text"), "$.tool_call_id", "string")
    calling = (F.col("role") == "assistant") & F.try_variant_get(_parsed("text"), "$.tool_calls", "array<variant>").isNotNull()
    is_result = F.coalesce((F.col("role") == "tool") & answers.isNotNull(), F.lit(False))
    linking = F.coalesce(calling, F.lit(False)) | is_result
    path = scratch_path(messages.sparkSession, "chat")
    source.where(linking).withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    numbered = messages.sparkSession.read.parquet(path)
    one = F.struct(F.coalesce("level", F.lit(2147483647)).alias("level"), "k", F.to_json(F.struct("arguments", "id", "name")).alias("json"))
    calls = linked_calls(numbered, schemas or {}).groupBy(ROW).agg(
        F.sort_array(F.collect_list(one)).alias("calls"),
        F.count_if(F.col("n_results") > 0).alias("linked"),
        F.count_if(F.col("faults") > 0).alias("invalid"),
    )
    results = linked_results(numbered).select(ROW, F.col("linked").cast("long").alias("answered"))
    rows = numbered.join(calls, ROW, "left").join(results, ROW, "left").unionByName(source.where(~linking), allowMissingColumns=True)
    is_call = F.coalesce(calling, F.lit(False)) & F.col("calls").isNotNull()
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    called = F.when(is_call, F.concat(F.lit("["), F.array_join(F.transform("calls", lambda c: c["json"]), ","), F.lit("]")))
    inner = F.try_variant_get(_parsed("text"), "$.content", "string")
    own = {"content": _quoted(inner), "role": _quoted(F.col("role")), "tool_call_id": F.when(is_result, _quoted(answers)), "tool_calls": called}
    linked = _canonical(own, F.try_variant_get(_parsed("text"), "$", "map<string,variant>"))
    zero = F.lit(0).cast("long")
    return rows.select(
        "conv_id", "turn", "role",
        F.when(is_call | is_result, linked).otherwise(plain).alias("message"),
        F.when(is_call, F.size("calls").cast("long")).otherwise(zero).alias("n_calls"),
        F.when(is_call, F.coalesce("linked", zero)).when(is_result, F.coalesce("answered", zero)).otherwise(zero).alias("n_linked"),
        F.when(is_call, F.coalesce("invalid", zero)).otherwise(zero).alias("n_invalid"),
    )


def conversation_json(formatted: DataFrame) -> DataFrame:
    """(conv_id, chat) with a conversation's messages in one array, by turn; a conversation must fit one row."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "message")))
    return formatted.groupBy("conv_id").agg(rows.alias("m")).select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["message"]), ","), F.lit("]")).alias("chat"))


MESSAGES_SQL = """
SELECT conv_id, turn, role,
  CAST(json_object('content', text, 'role', role) AS VARCHAR) AS message,
  CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid
FROM conversations
"""
