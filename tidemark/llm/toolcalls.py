"""Chat formatting: tool calls linked to their results, ordered, checked against schemas and written as canonical JSON.

SQL functions alone. Calls and results meet in a hash join on their identifier; one row a call on either side. A call may
follow another one; its level is its distance from the start of that chain, found by pointer doubling, so a chain of n calls
takes log2(n) joins and no conversation is gathered in one place. Levels are a topological order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Arguments by tool: name to (type, required).
SCHEMAS = {"ask": {"text": ("string", True), "turn": ("integer", True)}}
_TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def levels(calls: DataFrame) -> DataFrame:
    """id and level of distinct calls (id, after): 0 without a call before it; null on a cycle or behind one.

    ``after`` that names no call counts as none. Each round doubles the distance that is looked back.
    """
    known = calls.select(F.col("id").alias("_k"))
    state = calls.join(known, F.col("after") == F.col("_k"), "left").select("id", F.col("_k").alias("up"), F.col("_k").isNotNull().cast("long").alias("level"))
    state = cut(state)
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        there = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        state = cut(state.join(there, F.col("up") == F.col("_id"), "left").select("id", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")))
    return state.select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def valid(tool: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether the arguments are a JSON object with all required names, no unknown ones, and the types asked for."""
    tree, names = F.try_parse_json(arguments), F.json_object_keys(arguments)
    out = F.lit(False)
    for name, fields in schemas.items():
        good = names.isNotNull() & (F.size(F.array_except(names, F.array(*[F.lit(x) for x in fields]))) == 0)
        for field, (kind, required) in fields.items():
            fits = F.schema_of_variant(F.try_variant_get(tree, f"$.{field}", "variant")).rlike(f"^({_TYPES[kind]})$")
            good = good & F.when(F.array_contains(names, field), F.coalesce(fits, F.lit(False))).otherwise(F.lit(not required))
        out = F.when(tool == name, F.coalesce(good, F.lit(False))).otherwise(out)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """id, level, linked, valid, results (how many) and json of each distinct call.

    calls: id, tool, arguments (JSON text), after (an id or null); results: id, content. Of calls with one id, and of results
    for one, the least counts. A result without a call is dropped. Arguments that aren't JSON give invalid and stand
    in the text as a string. Keys are in order, without blanks; what is null is left out. A null id is no call.
    """
    fields = ["tool", "arguments", "after"]
    first = calls.where("id is not null").groupBy("id").agg(F.min(F.struct(*[F.col(x) for x in fields])).alias("_c")).select("id", "_c.*")
    answer = results.where("id is not null").groupBy(F.col("id").alias("_r")).agg(F.min("content").alias("content"), F.count("*").alias("n"))
    first = cut(first)
    rows = first.join(answer, F.col("id") == F.col("_r"), "left").join(levels(first.select("id", "after")).withColumnRenamed("id", "_l"), F.col("id") == F.col("_l"))
    tree = F.coalesce(F.try_parse_json("arguments"), F.expr("cast(arguments as variant)"))
    rows = rows.withColumn("_t", tree)
    json = F.to_json(F.struct(F.col("after"), F.col("_t").alias("arguments"), F.col("id"), F.col("level"), F.col("content").alias("result"), F.col("tool")))
    return rows.select("id", "level", F.col("_r").isNotNull().alias("linked"), valid(F.col("tool"), F.col("arguments"), schemas).alias("valid"), F.coalesce("n", F.lit(0)).alias("results"), json.alias("json"))


def of_turns(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in plain conversations (conv_id, turn, role, text): each user turn asks, the turn after it answers.

    A call's id is conversation:turn, and it follows the call two turns before. A null conversation or turn is no call.
    """
    turn, name = F.col("turn").cast("long"), F.col("conv_id").cast("string")
    here = chat.where("role = 'user'").select(
        F.concat_ws(":", name, turn.cast("string")).alias("id"), F.lit("ask").alias("tool"), F.to_json(F.struct(F.col("text").cast("string").alias("text"), turn.alias("turn"))).alias("arguments"),
        F.concat_ws(":", name, (turn - 2).cast("string")).alias("after"), name.isNotNull() & turn.isNotNull(),
    )
    here = here.where(here[here.columns[-1]]).drop(here.columns[-1])
    back = chat.where("role = 'assistant' and conv_id is not null and turn is not null").select(F.concat_ws(":", name, (turn - 1).cast("string")).alias("id"), F.col("text").cast("string").alias("content"))
    return here, back


def formatted(chat: DataFrame) -> DataFrame:
    """Every user turn of conversations as a linked call; null text is a missing argument, so the call is invalid.

    Of repeated turns the least text counts; long texts stay whole; other columns are ignored; an empty table gives an empty
    result.
    """
    return link(*of_turns(chat))


FORMATTED_SQL = r"""
with asked as (
  select conv_id || ':' || turn as id, min(row(coalesce(text, ''), text)) as t, any_value(conv_id) as conv, any_value(turn) as turn,
         count(text) as texts, count(*) as n, min(text) as text
  from conversations where role = 'user' and conv_id is not null and turn is not null group by 1),
answers as (
  select conv_id || ':' || (turn - 1) as id, min(text) as content, count(*) as n
  from conversations where role = 'assistant' and conv_id is not null and turn is not null group by 1),
chain as (
  select a.id, a.turn, a.conv, a.text, a.conv || ':' || (a.turn - 2) as after, b.id is not null as has_before
  from asked a left join asked b on b.id = a.conv || ':' || (a.turn - 2)),
placed as (
  select *, row_number() over (partition by conv, turn % 2, grp order by turn) - 1 as level
  from (select *, sum(case when has_before then 0 else 1 end) over (partition by conv, turn % 2 order by turn) as grp from chain))
select p.id, p.level, r.id is not null as linked, p.text is not null as valid, coalesce(r.n, 0) as results,
       '{"after":' || to_json(p.after) || ',"arguments":{' || coalesce('"text":' || to_json(p.text) || ',', '') || '"turn":' || p.turn || '},"id":' || to_json(p.id)
       || ',"level":' || p.level || coalesce(',"result":' || to_json(r.content), '') || ',"tool":"ask"}' as json
from placed p left join answers r on r.id = p.id
"""
