"""Tool-call linking for chat transcripts.

Calls and results are hash-joined by identifier, arguments are validated against the
tools' schemas, and the graph of calls, their results and the calls that use these is put in
topological order by peeling off, round after round, what waits for nothing any more.
Where the graph doesn't say otherwise turns keep their order. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm._base import dropped, stored, table

MESSAGES = "conv_id long, turn long, role string, content string, calls array<struct<id:string,name:string,arguments:string>>, call_id string"
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}


def _problems(schema: dict, args: Column, value: Column) -> list[Column]:
    """A message or null for each constraint of a JSON Schema's object (type, required,
    enum, lengths, bounds and additionalProperties of its own properties)."""
    out, required = [], set(schema.get("required", ()))
    for name, rule in sorted(schema.get("properties", {}).items()):
        path = "$['" + name.replace("'", "\\'") + "']"
        here = F.try_variant_get(value, path, "variant")
        if name in required:
            out.append(F.when(here.isNull(), F.lit(f"{name}: missing")))
        if "type" in rule:
            out.append(F.when(here.isNotNull() & ~F.schema_of_variant(here).rlike(KINDS[rule["type"]]), F.lit(f"{name}: not {rule['type']}")))
        text, number = F.try_variant_get(value, path, "string"), F.try_variant_get(value, path, "double")
        if "enum" in rule:  # by value: true is not "true", and 1 is 1.0
            allowed = [_plain_numbers(F.to_json(F.parse_json(F.lit(json.dumps(x))))) for x in rule["enum"]]
            out.append(F.when(here.isNotNull() & ~_plain_numbers(F.to_json(here)).isin(*allowed), F.lit(f"{name}: not in enum")))
        for key, bad in (
            ("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x),
            ("minimum", lambda x: number < x), ("maximum", lambda x: number > x),
        ):
            if key in rule:
                out.append(F.when(bad(rule[key]), F.lit(f"{name}: {key} {rule[key]}")))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.json_object_keys(args), F.array(*map(F.lit, sorted(schema.get("properties", {})))))
        out.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
    return out


def argument_errors(name: Column, args: Column, tools: dict[str, dict]) -> Column:
    """Sorted list of what is wrong with a call's arguments; empty if nothing is."""
    value = F.try_parse_json(args)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        found = F.array_compact(F.array(F.lit(None).cast("string"), *_problems(schema, args, value)))
        out = F.when(name.eqNullSafe(tool), F.when(~is_object, F.array(F.lit("arguments: not an object"))).otherwise(F.array_sort(found))).otherwise(out)
    return out


#: strings, numbers, and what is between them
TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def _plain_numbers(text: Column) -> Column:
    """JSON text with one text for each number: whole ones below 10 ** 15 without point or exponent, others without zeros at their end."""

    def plain(t: Column) -> Column:
        value = t.try_cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        fraction = F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+(?=$|E)", "$1"), r"\.(?=$|E)", "")
        return F.when(~t.rlike(r"^-?[0-9]+[.eE]"), t).when(whole, value.cast("long").cast("string")).otherwise(fraction)

    return F.when(text.rlike("[0-9][.eE]"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), plain), "")).otherwise(text)


def canonical(args: Column) -> Column:
    """JSON text with sorted keys, no white space and one text for each number; text that is no JSON as a JSON string."""
    quoted = F.to_json(F.struct(args.alias("x")))
    return F.coalesce(_plain_numbers(F.to_json(F.try_parse_json(args))), F.when(args.isNotNull(), F.substr(quoted, F.lit(6), F.length(quoted) - 6)))


def references(args: Column) -> Column:
    """The ids of results that a call's arguments use: ``{"$result": id}`` in place of a value, at any depth."""
    found = F.regexp_extract_all(F.to_json(F.try_parse_json(args)), F.lit(r'\{"\$result":"((?:[^"\\]|\\.)*)"\}'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.get_json_object(F.concat(F.lit('{"x":"'), x, F.lit('"}')), "$.x")))


def peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, stuck) of a graph, given as rows (k, a, b) where node b of conversation k waits for node a.

    ``a`` and ``b`` are structs that begin with turn and pos. Each round peels the nodes that wait for none
    that is left. levels has rows (k, node, level, anchor): the round, and the latest (turn, pos) of the node's
    own and those that it waits for, directly or not. stuck has rows (k, node): those on a cycle or
    behind one. There are as many rounds, each of three joins, as the longest chain has nodes; conversations share rounds.
    """
    at = lambda node: F.struct(F.col(node)["turn"].alias("turn"), F.col(node)["pos"].alias("pos"))
    open_ = stored(edges.distinct(), "edges")
    names = lambda side: open_.select("k", F.col(side).alias("node")).distinct()
    now = stored(names("a").join(names("b").hint("shuffle_hash"), ["k", "node"], "left_anti").select("k", "node", F.lit(0).alias("level"), at("node").alias("anchor")), "level")
    levels, waiting, level = now, None, 0
    while not open_.isEmpty():
        done = now.select("k", F.col("node").alias("a"), "anchor").hint("shuffle_hash")
        reached = open_.join(done, ["k", "a"]).select("k", F.col("b").alias("node"), "anchor")
        reached = reached if waiting is None else reached.unionByName(waiting)
        reached = reached.groupBy("k", "node").agg(F.max("anchor").alias("anchor"))
        past, open_ = open_, stored(open_.join(done.select("k", "a"), ["k", "a"], "left_anti"), "edges")
        left = names("b").hint("shuffle_hash")
        level += 1
        now = stored(reached.join(left, ["k", "node"], "left_anti").select("k", "node", F.lit(level).alias("level"), F.greatest("anchor", at("node")).alias("anchor")), "level")
        before, waiting = waiting, stored(reached.join(left, ["k", "node"], "left_semi"), "waiting")
        for old in (past, before):
            if old is not None:
                dropped(open_.sparkSession, old)
        if now.isEmpty():
            break
        levels = levels.unionByName(now)
    return levels, open_.select("k", F.col("b").alias("node")).distinct()


def linked(messages: DataFrame, tools: dict[str, dict], block: int = 64) -> DataFrame:
    """One row per plain message, call and result of ``messages`` (columns by MESSAGES; others
    are ignored): conv_id, turn, kind, call_id, status, errors, position, json.

    A message with calls gives a row per call, and one for itself if it has content. A
    call's status is answered, unanswered, or duplicate (its id was called before in the
    conversation); a result's is linked, orphan (no such call) or duplicate (not the
    first result by turn). position counts the messages that come before in the topological order: a
    result stands after its call, right behind it where no other call has the same place, later
    than in the log if the log has them earlier; a call that uses results (see ``references``) stands
    after them, and moves back behind them if the log has it earlier. Rows that tie, repeated
    ones among them, share a position. errors are joined by "; "; among them are uses of results that
    no call of the conversation gives, and that a call is on a cycle of uses or waits for one: such calls keep
    their place. Null conversations are one conversation; null turns come first; null ids link with nothing. A
    conversation is ranked in blocks of turns, so that none is ever sorted in one task. An empty table gives no rows.
    """
    m = messages.select(*[x.split(" ")[0] for x in MESSAGES.split(", ")])
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("~"))
    calls = m.select("conv_id", "turn", F.posexplode("calls").alias("pos", "c")).select(
        "conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pos"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), conv.alias("k")
    )
    results = m.where("call_id IS NOT NULL").select("conv_id", "turn", "call_id", "content", conv.alias("k"))
    plain = m.where("call_id IS NULL AND (calls IS NULL OR size(calls) = 0 OR content IS NOT NULL)").select("conv_id", "turn", "role", "content")

    def firsts(df: DataFrame, order: list[str], name: str) -> DataFrame:
        return df.where("call_id IS NOT NULL").groupBy("k", "call_id").agg(F.min(F.struct(*order)).alias(name))

    # by identifier: no conversation is a key by itself
    both = firsts(calls, ["turn", "pos"], "call").join(firsts(results, ["turn"], "result").hint("shuffle_hash"), ["k", "call_id"], "full")
    both = stored(both, "calls-and-results").hint("shuffle_hash")
    zero = F.lit(0).cast("long")
    node = lambda turn, pos, result: F.struct(turn.alias("turn"), pos.alias("pos"), result.alias("result"))
    own, given = node(F.col("turn"), F.col("pos"), F.lit(False)), node(F.col("call.turn"), F.col("call.pos"), F.lit(True))

    # calls that use results, and what these wait for, are peeled; other calls wait for nothing, and their results for them
    may = F.col("arguments").contains('"$result"') | F.col("arguments").contains("\\u")
    uses = calls.where(may).select("k", own.alias("b"), F.explode(references(F.col("arguments"))).alias("call_id")).join(both, ["k", "call_id"], "left")
    uses = stored(uses.select("k", "b", "call_id", F.when(F.col("call").isNotNull() & F.col("result").isNotNull(), given).alias("a")), "uses")
    notes = None
    if not uses.isEmpty():
        source = node(F.col("a")["turn"], F.col("a")["pos"], F.lit(False))
        touched = uses.select("k", F.col("b").alias("a")).union(uses.where("a IS NOT NULL").select("k", source.alias("a"))).distinct()
        answers = both.where("call IS NOT NULL AND result IS NOT NULL").select("k", node(F.col("call.turn"), F.col("call.pos"), F.lit(False)).alias("a"), given.alias("b"))
        answers = answers.join(touched.hint("shuffle_hash"), ["k", "a"], "left_semi")
        levels, stuck = peeled(answers.unionByName(uses.where("a IS NOT NULL").select("k", "a", "b")))
        unknown = uses.where("a IS NULL").groupBy("k", "b").agg(F.array_sort(F.collect_set("call_id")).alias("unknown"))  # of one call
        # what is known of a node; calls and results without edges have nothing here
        notes = levels.select("k", "node", "level", "anchor", F.lit(False).alias("stuck")).unionByName(stuck.select("k", "node", F.lit(True).alias("stuck")), allowMissingColumns=True)
        notes = notes.join(unknown.withColumnRenamed("b", "node"), ["k", "node"], "full").hint("shuffle_hash")
    nothing = {"level": "int", "anchor": "struct<turn:bigint,pos:bigint>", "stuck": "boolean", "unknown": "array<string>"}

    def noted(df: DataFrame) -> DataFrame:
        if notes is None:
            return df.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
        return df.join(notes, (df.k.eqNullSafe(notes.k)) & df.node.eqNullSafe(notes.node), "left").drop(notes.k).drop(notes.node)

    def place(turn: Column, pos: Column) -> Column:
        """The key of the order: where the graph puts the row, its round there, and its place in the log."""
        start = F.coalesce("anchor", F.struct(F.col("node")["turn"].alias("turn"), F.col("node")["pos"].alias("pos")))
        level = F.coalesce("level", F.col("node")["result"].cast("int"), F.lit(0))
        return F.struct(start["turn"].alias("turn"), F.coalesce(start["pos"], zero).alias("pos"), level.alias("level"), turn.alias("own"), pos.alias("then"))

    repeated = F.col("call").isNotNull() & ~((F.col("call.turn").eqNullSafe(F.col("turn"))) & (F.col("call.pos") == F.col("pos")))
    wrong = F.concat(
        argument_errors(F.col("name"), F.col("arguments"), tools), F.transform(F.coalesce("unknown", F.array().cast("array<string>")), lambda x: F.concat(F.lit("no result: "), x)),
        F.when(F.coalesce("stuck", F.lit(False)), F.array(F.lit("cycle of results"))).otherwise(F.array().cast("array<string>")),
    )
    on = lambda df: df.join(both, ["k", "call_id"], "left")
    call_rows = noted(on(calls).withColumn("node", own)).select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id",
        F.when(repeated, "duplicate").when(F.col("result").isNotNull(), "answered").otherwise("unanswered").alias("status"),
        wrong.alias("errors"),
        F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(","), F.substring(F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.lit("call").alias("type"))), F.lit(2), F.lit(1 << 30))).alias("json"),
        place(F.col("turn"), F.col("pos")).alias("key"),
    )
    late = F.col("call").isNotNull()
    result_rows = noted(on(results).withColumn("node", F.when(late, given).otherwise(node(F.col("turn"), zero, F.lit(False))))).select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id",
        F.when(~late, "orphan").when(F.col("result.turn").eqNullSafe(F.col("turn")), "linked").otherwise("duplicate").alias("status"),
        F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type"))).alias("json"),
        place(F.col("turn"), zero).alias("key"),
    )
    plain_rows = plain.withColumn("node", node(F.col("turn"), zero, F.lit(False))).select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct("content", "role", F.lit("message").alias("type"))).alias("json"),
        F.struct(F.col("turn").alias("turn"), zero.alias("pos"), F.lit(0).alias("level"), F.col("turn").alias("own"), zero.alias("then")).alias("key"),
    )
    rows = plain_rows.unionByName(call_rows).unionByName(result_rows).withColumn("conv", conv).withColumn("block", F.floor(F.coalesce("key.turn", F.lit(-1)) / block))
    keys = rows.groupBy("conv", "block", "key").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = keys.groupBy("conv", "block").agg(F.sum("n").alias("n")).withColumn("base", before(W.partitionBy("conv").orderBy("block"))).drop("n")
    places = keys.withColumn("inner", before(W.partitionBy("conv", "block").orderBy("key"))).join(blocks, ["conv", "block"])
    places = places.select("conv", "block", "key", (F.col("base") + F.col("inner")).alias("position")).hint("shuffle_hash")
    out = rows.join(places, (rows.conv == places.conv) & (rows.block == places.block) & rows.key.eqNullSafe(places.key))
    return out.select("conv_id", "turn", "kind", "call_id", "status", F.array_join("errors", "; ").alias("errors"), "position", "json")


#: Schemas of the calls that ``from_turns`` derives.
TOOLS = {
    "ask": {"type": "object", "properties": {"text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0}, "chars": {"type": "integer"}}, "required": ["text", "turn"], "additionalProperties": False},
    "digest": {"type": "object", "properties": {"text": {"type": "string", "maxLength": 600}, "turn": {"type": "integer", "maximum": 5}, "chars": {"type": "integer", "maximum": 500}}, "required": ["text", "turn"], "additionalProperties": False},
}


def from_turns(conversations: DataFrame) -> DataFrame:
    """A tool log of a table of turns: each user turn calls ``ask`` or, from 200 characters on,
    ``digest``; each assistant turn is the result for the turn before; the rest are messages."""
    name = F.when(F.length("text") < 200, "ask").otherwise("digest")
    args = F.to_json(F.struct("text", F.col("turn").alias("turn"), F.length("text").alias("chars")))
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    none = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    call = F.array(F.struct(ident(F.col("turn")).alias("id"), name.alias("name"), args.alias("arguments")))
    return conversations.select(
        "conv_id", "turn", "role", F.when(~F.col("role").eqNullSafe("user"), F.col("text")).alias("content"),
        F.when(F.col("role") == "user", call).otherwise(none).alias("calls"), F.when(F.col("role") == "assistant", ident(F.col("turn") - 1)).alias("call_id"),
    )


def op4_chat_tool_calls(spark, sf_dir):
    """The calls, results and messages that ``from_turns`` derives from the whole of ``conversations``, linked and ordered.
    Null texts are messages without content, turns without a partner are unanswered or orphans, repeated turns tie."""
    return linked(from_turns(table(spark, sf_dir, "conversations")), TOOLS)


ORACLE = """
WITH m AS (SELECT *, 'c' || conv_id || '-' || turn AS own, 'c' || conv_id || '-' || (turn - 1) AS prev, length(text) AS n FROM conversations),
calls AS (SELECT *, CASE WHEN n < 200 THEN 'ask' ELSE 'digest' END AS name FROM m WHERE role = 'user'),
res AS (SELECT * FROM m WHERE role = 'assistant'),
ids AS (SELECT DISTINCT own FROM calls), rids AS (SELECT DISTINCT prev FROM res),
e AS (
  SELECT conv_id, turn, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status, '' AS errors,
    '{"content":' || to_json(text) || ',"role":"' || role || '","type":"message"}' AS json, turn AS kt, 0 AS kp, 0 AS kn
  FROM m WHERE role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT conv_id, turn, 'call', own, CASE WHEN own IN (SELECT prev FROM rids) THEN 'answered' ELSE 'unanswered' END,
    CASE WHEN name = 'ask' THEN CASE WHEN n < 20 THEN 'text: minLength 20' ELSE '' END
      ELSE array_to_string(list_filter([CASE WHEN n > 500 THEN 'chars: maximum 500' END, CASE WHEN n > 600 THEN 'text: maxLength 600' END, CASE WHEN turn > 5 THEN 'turn: maximum 5' END], lambda x: x IS NOT NULL), '; ') END,
    '{"arguments":{"chars":' || n || ',"text":' || to_json(text) || ',"turn":' || turn || '},"id":"' || own || '","name":"' || name || '","type":"call"}', turn, 1, 0
  FROM calls
  UNION ALL
  SELECT conv_id, turn, 'result', prev, CASE WHEN prev IN (SELECT own FROM ids) THEN 'linked' ELSE 'orphan' END, '',
    '{"content":' || to_json(text) || ',"id":"' || prev || '","type":"result"}',
    CASE WHEN prev IN (SELECT own FROM ids) THEN turn - 1 ELSE turn END, CASE WHEN prev IN (SELECT own FROM ids) THEN 1 ELSE 0 END, CASE WHEN prev IN (SELECT own FROM ids) THEN turn + 1 ELSE 0 END
  FROM res
)
SELECT conv_id, turn, kind, call_id, status, errors, rank() OVER (PARTITION BY conv_id ORDER BY kt, kp, kn) - 1 AS position, json FROM e
"""
