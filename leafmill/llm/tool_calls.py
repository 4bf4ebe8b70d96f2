"""Chat formatting: tool calls and results linked by identifier, ordered, validated, and written as canonical JSON.

DataFrame functions only.  Messages carry an identifier where they call a tool
and where they answer a call; an identifier names a call within its conversation.
Of several calls (results) with one identifier the earliest counts, by turn and
text digest; what counts is found by a minimum for each identifier before any
join, so a hot identifier costs one row.  Calls may wait for other calls.  Chains,
in which each call waits for one other, are passed by doubling pointers, in rounds
as many as the logarithm of their length; calls that wait for several are settled
round by round over what chains lead to.  What is left waits in a circle.
Arguments are held against the tool's parameters.

Canonical JSON has sorted keys, no spaces, and one spelling for each value: numbers
are exact at any length (1, 1.0 and 1e0 are 1), and strings are escaped alike.
Texts that aren't JSON, or repeat a key in one object, have none.

A message's place is (``topo``, ``turn``): a call of level k has topo 2k, its
results 2k + 1, other messages none.

Cases: messages without identifiers are plain; empty identifiers are identifiers;
rows with a null conversation share one; null texts and arguments are null in
JSON, and arguments that are null or not JSON have an error; numbers with an
exponent of ten digits or more keep their spelling; calls that wait for unknown
calls have an error and don't wait; repeated rows have equal results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, scratch, settle, table


class Parameter(NamedTuple):
    key: str
    kind: str  # string, integer, number, boolean, array or object
    required: bool
    least: float | None = None  # characters of a string, value of a number
    most: float | None = None


#: The tools that turns of plain conversations are taken to call.
TOOLS = {
    "search": [Parameter("query", "string", True, 1), Parameter("limit", "integer", True, 1, 100), Parameter("exact", "boolean", False)],
    "rate": [Parameter("text", "string", True), Parameter("score", "number", True, 0, 1), Parameter("tags", "array", False), Parameter("about", "object", False)],
}

#: Tokens of JSON: strings, numbers, what is between them.  All repeats are possessive, so long texts need no deep stack.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|.'
NUMBER = r"^-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?$"
#: Stands before a number's digits while it is held as a string; in strings it is doubled.
MARK = "￿"


def quoted(text: Column) -> Column:
    """A string as JSON; null is null."""
    boxed = F.to_json(F.array(text))
    return F.coalesce(F.when(text.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2)), F.lit("null"))


def canonical_number(token: Column) -> Column:
    """One spelling for each value, exact at any length: plain digits, or with an exponent where more than 20 zeros would stand at an end."""
    sign = F.when(token.startswith("-"), "-").otherwise("")
    fraction = F.regexp_extract(token, r"\.([0-9]+)", 1)
    exponent = F.coalesce(F.try_to_number(F.regexp_extract(token, r"[eE]\+?(-?[0-9]+)$", 1), F.lit("S999999999")).cast("int"), F.lit(0))
    digits = F.ltrim(F.concat(F.regexp_extract(token, r"^-?([0-9]+)", 1), fraction), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    power = exponent - F.length(fraction) + F.length(digits) - F.length(short)
    point = F.length(short) + power
    head, tail = F.substring(short, F.lit(1), point), F.substring(short, point + 1, F.length(short))
    rest = F.when(F.length(short) > 1, F.concat(F.lit("."), F.substring(short, F.lit(2), F.length(short)))).otherwise("")
    power_sign = F.when(point > 0, "e+").otherwise("e")
    return (
        F.when(short == "", "0").when(token.rlike("[eE][+-]?[0-9]{10}"), F.lower(token))
        .when((power >= 0) & (power <= 20), F.concat(sign, short, F.repeat(F.lit("0"), power)))
        .when((power < 0) & (point > 0), F.concat(sign, head, F.lit("."), tail))
        .when((power < 0) & (point > -20), F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -point), short))
        .otherwise(F.concat(sign, F.substring(short, 1, 1), rest, power_sign, (point - 1).cast("string")))
    )


def marked(json: Column) -> Column:
    """JSON with each number as a string of the mark and its canonical digits, for JSON functions know numbers of limited length only."""
    inner = lambda t: F.regexp_replace(F.regexp_replace(t, MARK, MARK * 2), r"(?<!\\)((?:\\\\)*+)\\u[fF]{4}", "$1" + MARK * 2)
    number = lambda t: F.concat(F.lit('"' + MARK), canonical_number(t), F.lit('"'))
    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(f"(?s){TOKEN}"), F.lit(0)), lambda t: F.when(t.startswith('"'), inner(t)).when(t.rlike(NUMBER), number(t)).otherwise(t)), "")


def well_formed(json: Column) -> Column:
    """Whether a text is one JSON value and nothing after it (repeated keys may be in it)."""
    return F.json_object_keys(F.concat(F.lit('{"x":'), json, F.lit("}"))).isNotNull()


def parsed(json: Column) -> Column:
    """A variant: an array of the marked value; null for what isn't JSON, or repeats a key."""
    # What may follow a value in an array may not follow it in an object, so both hold for a value alone.
    return F.when(well_formed(json), F.try_parse_json(F.concat(F.lit("["), marked(json), F.lit("]"))))


def canonical(value: Column) -> Column:
    """JSON with sorted keys, no spaces and one spelling for each number, of what ``parsed`` gives; null is null."""
    out = F.to_json(value)
    out = F.regexp_replace(out, f'"{MARK}([-+.e0-9]+)"', "$1")
    return F.regexp_replace(F.substring(out, F.lit(2), F.length(out) - 2), MARK * 2, MARK)


def argument_errors(name: Column, arguments: Column, value: Column, tools: dict[str, list[Parameter]]) -> Column:
    """What speaks against a call's arguments (``value``: as ``parsed`` gives them), as a sorted array of ``reason:key``."""
    keys = F.json_object_keys(arguments)
    one = lambda *x: F.array(*map(F.lit, x))
    out = F.when(name.isNull() | ~name.isin(*tools), one("unknown_tool")).when(arguments.isNull() | ~well_formed(arguments), one("not_json"))
    out = out.when(value.isNull(), one("repeated_key")).when(keys.isNull(), one("not_an_object"))
    for tool, parameters in tools.items():
        found = []
        for p in parameters:
            path = f"$[0]['{p.key}']"
            shape, text = F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.try_variant_get(value, path, "string")
            string, number = shape == "STRING", text.rlike(f"^{MARK}[^{MARK}]")
            kind = (
                F.when(string & number & text.rlike(r"^.-?(?:[0-9]+|.*e\+.*)$"), "integer").when(string & number, "number").when(string, "string")
                .when(shape == "BOOLEAN", "boolean").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("null")
            )
            given = F.array_contains(keys, p.key)
            fits = kind.isin("integer", "number") if p.kind == "number" else kind == p.kind
            if p.required:
                found.append(F.when(~given, F.lit(f"missing:{p.key}")))
            found.append(F.when(given & ~fits, F.lit(f"type:{p.key}")))
            size = F.length(F.regexp_replace(text, MARK * 2, MARK)).cast("double") if p.kind == "string" else F.substring(text, F.lit(2), F.length(text)).try_cast("double")
            if p.least is not None:
                found.append(F.when(given & fits & (size < p.least), F.lit(f"least:{p.key}")))
            if p.most is not None:
                found.append(F.when(given & fits & (size > p.most), F.lit(f"most:{p.key}")))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(p.key) for p in parameters])), lambda k: F.concat(F.lit("unknown:"), k))
        out = out.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*found)), unknown)))
    return out


def pointers(single: DataFrame) -> DataFrame:
    """For calls that wait for one call (``call_id``, ``before``): the first call up their chain that doesn't, and how far it is.

    Pointers double, so rounds are the logarithm of the longest chain.  What still
    moves when chains must have ended goes round in a circle and is left out.
    """
    every = settle(single.select("call_id", F.col("before").alias("root"), F.lit(1).cast("long").alias("far"), F.lit(True).alias("moving")), "pointers")
    left, total = 1, every.count()
    while not every.where("moving").isEmpty():
        if left > 2 * total:
            return every.where("not moving").drop("moving")
        up = every.select(F.col("call_id").alias("root"), F.col("root").alias("top"), F.col("far").alias("more"))
        moved = every.where("moving").join(up, "root", "left")
        moved = moved.select("call_id", F.coalesce("top", "root").alias("root"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("top").isNotNull().alias("moving"))
        every, left = settle(every.where("not moving").unionByName(moved), "pointers"), left * 2
    return every.drop("moving")


def levels(calls: DataFrame) -> DataFrame:
    """Level of each call (``call_id``, ``after``): 0 without calls before it, else one above the highest; none in or behind a circle."""
    waits = calls.select("call_id", F.explode(F.array_distinct("after")).alias("before"))
    waits = settle(waits.join(calls.select(F.col("call_id").alias("before")), "before", "left_semi"), "waits")
    fan = waits.groupBy("call_id").agg(F.count("*").alias("n"), F.min("before").alias("before"))
    single, several = fan.where("n = 1"), settle(fan.where("n > 1").select("call_id", "n"), "several")
    chained = pointers(single.select("call_id", "before"))
    free = calls.select("call_id").join(single.select("call_id"), "call_id", "left_anti").select("call_id", F.col("call_id").alias("root"), F.lit(0).cast("long").alias("far"))
    placed = settle(chained.unionByName(free), "placed")
    if several.isEmpty():
        return placed.select("call_id", F.col("far").cast("int").alias("level"))
    where = placed.select(F.col("call_id").alias("before"), "root", "far")
    edges = settle(waits.join(several, "call_id").join(where, "before").select("call_id", "root", "far"), "edges")
    # Each round holds the calls settled in the one before against the edges, and rewrites only calls that still wait.
    waiting = several.select("call_id", F.col("n").alias("left"), F.lit(0).cast("long").alias("level"))
    done = [settle(free.select("root").join(several.select(F.col("call_id").alias("root")), "root", "left_anti").withColumn("level", F.lit(0).cast("long")), "known")]
    while not done[-1].isEmpty():
        hits = edges.join(done[-1], "root").groupBy(F.col("call_id").alias("hit")).agg(F.count("*").alias("settled"), (F.max(F.col("level") + F.col("far")) + 1).alias("up"))
        now = waiting.join(hits, F.col("call_id") == F.col("hit"), "left")
        now = settle(now.select("call_id", (F.col("left") - F.coalesce("settled", F.lit(0))).alias("left"), F.greatest("level", "up").alias("level")), "waiting")
        done.append(now.where("left = 0").select(F.col("call_id").alias("root"), "level"))
        waiting = now.where("left > 0")
    known = done[0]
    for part in done[1:]:
        known = known.unionByName(part)
    return placed.join(known, "root").select("call_id", (F.col("level") + F.col("far")).cast("int").alias("level"))


def key(conv_id: Column, call_id: Column) -> Column:
    """What names a call: its identifier within its conversation (a null conversation is one, too)."""
    conv = F.coalesce(F.concat(F.length(conv_id.cast("string")).cast("string"), F.lit(":"), conv_id.cast("string")), F.lit(":"))
    return F.concat(conv, F.lit(":"), call_id)


def keyed(messages: DataFrame) -> DataFrame:
    """Messages with the keys of their call or result and of the calls they wait for, and their place among messages with one key."""
    own = lambda c: key(F.col("conv_id"), c)
    m = messages.select("conv_id", "turn", "role", "text", "call_id", "name", "arguments", "after", F.when(F.col("call_id").isNull(), F.col("result_of")).alias("result_of"))
    m = m.withColumn("order", F.struct("turn", F.md5(F.concat_ws("\n", "text", "name", "arguments")).alias("print")))
    waits = F.transform(F.array_distinct("after"), lambda x: F.struct(own(x).alias("key"), x.alias("id")))
    return m.withColumns({"call": own(F.col("call_id")), "result": own(F.col("result_of")), "waits": waits})


def call_facts(m: DataFrame) -> DataFrame:
    """One row for each call (``link``): the call and the result that count, the number of results, level, and calls it waits for that don't exist."""
    called = m.where("call is not null").groupBy("call").agg(F.min(F.struct("order", "waits")).alias("x"))
    called = settle(called.select("call", F.col("x.order").alias("first_call"), F.col("x.waits").alias("waits")), "calls")
    answered = m.where("result is not null").groupBy("result").agg(F.min("order").alias("first_result"), F.count("*").alias("results"))
    # One row for each identifier on both sides: the results of a partition make a small hash table.
    linked = called.join(answered.hint("shuffle_hash"), called["call"] == answered["result"], "left")
    placed = levels(called.select(F.col("call").alias("call_id"), F.col("waits.key").alias("after"))).withColumnRenamed("call_id", "call")
    known = called.select(F.col("call").alias("known"))
    lost = called.select("call", F.explode("waits").alias("before"))
    lost = lost.join(known, F.col("before.key") == F.col("known"), "left_anti").groupBy("call").agg(F.array_sort(F.collect_set(F.concat(F.lit("no_call:"), "before.id"))).alias("lost"))
    facts = linked.join(placed, "call", "left").join(lost, "call", "left")
    return facts.select(F.col("call").alias("link"), "first_call", "first_result", F.coalesce("results", F.lit(0)).alias("results"), "level", F.coalesce("lost", F.array().cast("array<string>")).alias("lost"))


def link_tool_calls(messages: DataFrame, tools: dict[str, list[Parameter]]) -> DataFrame:
    """Status, place, errors and canonical JSON of each message.

    ``messages``: conv_id, turn, role, text, call_id, name, arguments (JSON),
    after (array of call ids), result_of; identifiers are those of the message's
    conversation.  Of a message that both calls and answers, the call is taken.
    """
    m = keyed(messages)
    with scratch(messages.sparkSession) as keep:
        facts = keep(settle(call_facts(m), "facts"))

    # A message without identifiers gets one that no other has, so that it isn't joined in one heap of nulls.
    at = F.coalesce("call", "result", F.concat(F.lit("\0"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    m = look_up(m.withColumn("at", at).drop("call", "result", "waits"), facts.withColumn("at", F.col("link")), "at", "left")
    call, result = F.col("call_id").isNotNull(), F.col("result_of").isNotNull()
    status = (
        F.when(call & (F.col("order") != F.col("first_call")), "duplicate_call").when(call & F.col("level").isNull(), "circular")
        .when(call & (F.col("results") > 0), "answered").when(call, "unanswered").when(result & F.col("link").isNull(), "orphan")
        .when(result & (F.col("order") == F.col("first_result")), "linked").when(result, "duplicate_result").otherwise("plain")
    )
    m = m.withColumn("value", F.when(call, parsed(F.col("arguments"))))
    errors = F.when(call, F.concat(argument_errors(F.col("name"), F.col("arguments"), F.col("value"), tools), F.col("lost")))
    text = F.when(
        call,
        F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("value")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")),
    ).otherwise(F.concat(F.lit('{"content":'), quoted(F.col("text")), F.when(result, F.concat(F.lit(',"id":'), quoted(F.col("result_of")))).otherwise(""), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")))
    topo = F.when(call, F.col("level") * 2).when(result, F.col("level") * 2 + 1)
    return m.select("conv_id", "turn", "role", F.coalesce("call_id", "result_of").alias("call_id"), status.alias("status"), topo.cast("int").alias("topo"), F.array_join(F.coalesce(errors, F.array().cast("array<string>")), ",").alias("errors"), text.alias("canonical"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages: a user's turn calls a tool, after the call two turns before; an assistant's turn answers the turn before.

    Identifiers are numbered within each conversation, as usual, so conversations
    share them.  Every eighth turn has arguments as they should be; others spell
    numbers in other ways, or have arguments that are damaged or don't fit.
    """
    ident = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    text, limit, case = quoted(F.col("text")), (F.col("turn") + 1).cast("string"), F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(8))
    spelled = {
        1: ['{ "query" :', text, ', "limit" :', limit, ".0 }"],
        2: ['{"query":', text, ',"limit":' + "1234567890" * 5 + "}"],
        3: ['{"limit":1,"query":', text, ',"limit":2}'],
        4: ['{"query":', text],
        5: ['{"query":', text, ',"exact":true}'],
        6: ['{"limit":"', limit, '","query":', text, "}"],
        7: ['{"text":', text, ',"score":5E-1,"tags":["\\u0061\\/",-0.0],"about":{"b":-1.50,"a":[1E2,null,{}]}}'],
    }
    arguments = F.concat(F.lit('{"query":'), text, F.lit(',"limit":'), limit, F.lit("}"))
    for k, parts in spelled.items():
        arguments = F.when(case == k, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(arguments)
    name = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 4, "erase").when(case == 7, "rate").otherwise("search")
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(user, ident(F.col("turn"))).alias("call_id"),
        F.when(user, name).alias("name"),
        F.when(user, arguments).alias("arguments"),
        F.when(user & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
        F.when(assistant, ident(F.col("turn") - 1)).alias("result_of"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations`` as linked, ordered, validated calls and results."""
    return link_tool_calls(from_turns(table(spark, sf_dir, "conversations")), TOOLS)


#: Levels by recursion along turns; conversations whose (conv_id, turn) are unique.
ORACLE = """
with recursive calls as (select conv_id, turn, text from conversations where role = 'user'),
levels as (
  select conv_id, turn, 0 as level from calls c where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2 and c.turn >= 2)
  union all
  select c.conv_id, c.turn, l.level + 1 from calls c join levels l on c.conv_id = l.conv_id and c.turn = l.turn + 2),
facts as (select c.*, l.level, m.role as next_role from calls c join levels l using (conv_id, turn)
  left join conversations m on m.conv_id = c.conv_id and m.turn = c.turn + 1),
cased as (select *, (conv_id * 3 + turn) % 8 as k, case when (conv_id + turn) % 5 = 4 then 'erase' when (conv_id * 3 + turn) % 8 = 7 then 'rate' else 'search' end as name,
  coalesce(cast(to_json(text) as varchar), 'null') as body,
  case when text is null then ['type:'] when length(text) < 1 then ['least:'] else []::varchar[] end as bad
  from conversations)
select m.conv_id, m.turn, m.role,
  case m.role when 'user' then 'call_' || m.turn when 'assistant' then 'call_' || (m.turn - 1) end as call_id,
  case m.role when 'user' then case when own.next_role = 'assistant' then 'answered' else 'unanswered' end
    when 'assistant' then case when before.conv_id is null then 'orphan' else 'linked' end else 'plain' end as status,
  cast(case m.role when 'user' then own.level * 2 when 'assistant' then before.level * 2 + 1 end as integer) as topo,
  case when m.role = 'user' then array_to_string(list_concat(
    case when m.name = 'erase' then ['unknown_tool'] when k = 4 then ['not_json'] when k = 3 then ['repeated_key']
      when k = 7 then case when m.text is null then ['type:text'] else []::varchar[] end
      else list_sort(list_concat(list_transform(bad, lambda x: x || 'query'),
        case when k = 2 then ['most:limit'] when k = 5 then ['missing:limit'] when k = 6 then ['type:limit']
          when m.turn + 1 < 1 then ['least:limit'] when m.turn + 1 > 100 then ['most:limit'] else []::varchar[] end)) end,
    case when m.turn >= 2 and not exists (select 1 from calls p where p.conv_id = m.conv_id and p.turn = m.turn - 2)
      then ['no_call:call_' || (m.turn - 2)] else []::varchar[] end), ',') else '' end as errors,
  case m.role
    when 'user' then '{"arguments":' || case
        when k in (3, 4) then 'null'
        when k = 2 then '{"limit":' || repeat('1234567890', 5) || ',"query":' || body || '}'
        when k = 5 then '{"exact":true,"query":' || body || '}'
        when k = 6 then '{"limit":"' || (m.turn + 1) || '","query":' || body || '}'
        when k = 7 then '{"about":{"a":[100,null,{}],"b":-1.5},"score":0.5,"tags":["a/",0],"text":' || body || '}'
        else '{"limit":' || (m.turn + 1) || ',"query":' || body || '}' end
      || ',"id":"call_' || m.turn || '","name":"' || m.name || '","role":"user"}'
    when 'assistant' then '{"content":' || body || ',"id":"call_' || (m.turn - 1) || '","role":"assistant"}'
    else '{"content":' || body || ',"role":' || to_json(m.role) || '}' end as canonical
from cased m
left join facts own on m.role = 'user' and own.conv_id = m.conv_id and own.turn = m.turn
left join facts before on m.role = 'assistant' and before.conv_id = m.conv_id and before.turn = m.turn - 1
"""
