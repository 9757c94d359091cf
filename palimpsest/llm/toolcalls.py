"""Chat formatting: tool calls linked to their results, in topological order, checked against schemas, as canonical JSON.

DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: what a schema's type may be, and the types of a parsed value that satisfy it
_TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT<.*$",
    "array": r"^ARRAY<.*$",
    "null": r"^VOID$",
}

_SALTS = 64


_KEY = ["conversation", "call_id"]


def _on(left: str, right: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conversation, call_id, level) of calls (conversation, call_id, parent_id): 0 without a known parent, else one more than the parent's.

    A parent is looked for in the call's own conversation. Each round doubles the distance that every open call looks up,
    so a chain of n calls takes log2(n) rounds; what is open after that is in a cycle or hangs from one and has level NULL. A
    round is one join on the identifier, and only open calls are joined and stored again.
    """
    known = calls.select("conversation", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    now = stored(calls.alias("c").join(known.alias("k"), _on("c", "k", "conversation") & (F.col("c.parent_id") == F.col("k.parent_id")), "left").select(
        "c.conversation", "c.call_id", F.when(F.col("there"), F.col("c.parent_id")).alias("up"),
        F.when(F.col("there"), 1).otherwise(0).cast("long").alias("level")), "levels")
    closed, now = now.where("up is null"), now.where("up is not null")
    left, reach, total = now.count(), 1, calls.count()
    while left and reach <= total:
        far = closed.unionByName(now)
        far = far.select("conversation", F.col("call_id").alias("id"), F.col("up").alias("next"), F.col("level").alias("more"))
        now = stored(now.alias("c").join(far.alias("f"), _on("c", "f", "conversation") & (F.col("c.up") == F.col("f.id"))).select(
            "c.conversation", "c.call_id", F.col("next").alias("up"), (F.col("c.level") + F.col("more")).alias("level")), "levels")
        closed, now = closed.unionByName(now.where("up is null")), now.where("up is not null")
        left, reach = now.count(), 2 * reach
    return closed.unionByName(now).select(*_KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def problems(arguments: Column, parameters: Column) -> Column:
    """Sorted array of what is wrong with parsed arguments (variant) under parameters (array of name, type, required).

    Not an object; ``missing x``; ``type of x``; ``unknown x``. parameters NULL: ``unknown tool``.
    """
    fields = F.when(F.schema_of_variant(arguments).startswith("OBJECT<"), arguments.cast("map<string,variant>"))

    def fault(p):
        value = F.element_at(fields, p["parameter"])
        kind = F.schema_of_variant(value)
        wrong = ~F.coalesce(*[F.when(p["type"] == name, kind.rlike(pattern)) for name, pattern in _TYPES.items()], F.lit(False))
        return F.when(value.isNull(), F.when(p["required"], F.concat(F.lit("missing "), p["parameter"]))).when(
            wrong, F.concat(F.lit("type of "), p["parameter"]))

    names = F.transform(parameters, lambda p: p["parameter"])
    extra = F.transform(F.array_except(F.map_keys(fields), names), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.filter(F.transform(parameters, fault), lambda x: x.isNotNull()), extra)
    return F.when(parameters.isNull(), F.array(F.lit("unknown tool"))).when(
        fields.isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(found))


def formatted(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tool calls and their results: conversation, turn, call_id, level, status, results, problems, valid, message.

    calls: conversation, turn, call_id, name, arguments (JSON text), parent_id (the call whose result it uses, or NULL).
    results: conversation, call_id, content. schemas: tool, parameter, type, required; a tool without parameters has one row
    with a NULL parameter. Calls and results meet in a join on conversation and identifier; a NULL conversation is one like any other.

    Every distinct call and every distinct result is in exactly one row. status says which:

    * ``linked``, ``pending`` (no result), ``cycle`` (its level is NULL): the call of its identifier, the smallest by turn, name,
      arguments and parent. Its message has the smallest result that is not NULL; ``results`` is the number of all.
    * ``duplicate``: another call with the same identifier; ``unidentified``: a call without one. Level NULL, no results.
    * ``extra``: another result of a call; ``orphan``: a result that no call asked for, or without identifier (problem ``unknown
      call``). turn and level NULL; ``results`` tells how many rows had this content.

    (level, turn, call_id) is a topological order of each conversation: a call comes after the one it depends on. A parent that
    does not exist makes a call a root with the problem ``unknown parent``. ``message`` is canonical JSON: keys sorted, no
    blanks; arguments that are no JSON stay a string. Equal rows are combined before the shuffle, so a hot identifier is one row
    per task and content. Empty tables give empty results. Other columns are not read.
    """
    fields = ["turn", "name", "arguments", "parent_id"]
    known = stored(calls.select(*_KEY, *fields).distinct(), "calls")
    first = known.where("call_id is not null").groupBy(*_KEY).agg(F.min(F.struct(*fields)).alias("c")).select(*_KEY, "c.*")
    first = stored(first, "first-calls")
    told = stored(results.groupBy(*_KEY, "content").agg(F.count("*").alias("n")), "results")
    answers = stored(told.where("call_id is not null").groupBy(*_KEY).agg(
        F.min(F.struct(F.col("content").isNull(), "content")).getField("content").alias("content"), F.sum("n").alias("results")), "answers")
    main = first.alias("c").join(levels(first).alias("l"), _on("c", "l", *_KEY), "left").join(answers.alias("a"), _on("c", "a", *_KEY), "left").select(
        "c.*", "level", "content", "results", F.when(F.col("level").isNull(), "cycle").when(F.col("results").isNull(), "pending").otherwise("linked").alias("status"))
    other = known.alias("k").join(first.alias("f"), _on("k", "f", *_KEY, *fields), "left_anti").select(
        "k.*", F.lit(None).cast("long").alias("level"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("results"),
        F.when(F.col("call_id").isNull(), "unidentified").otherwise("duplicate").alias("status"))

    tools = schemas.where("tool is not null").groupBy("tool").agg(F.array_sort(F.collect_set(F.when(
        F.col("parameter").isNotNull(), F.struct("parameter", "type", "required")))).alias("parameters"))
    # most calls may be of one tool: they are dealt out by salt, and each tool's schema is there for every salt
    tools = tools.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = main.unionByName(other).withColumn("_salt", F.pmod(F.xxhash64("conversation", "call_id", "arguments"), F.lit(_SALTS)).cast("int"))
    rows = rows.join(tools, (F.col("name") == F.col("tool")) & (F.col("_salt") == F.col("salt")), "left")
    rows = rows.withColumn("parsed", F.try_parse_json("arguments")).withColumn("problems", problems(F.col("parsed"), F.col("parameters")))
    lost = (F.col("level") == 0) & F.col("parent_id").isNotNull()
    rows = rows.withColumn("problems", F.when(lost, F.array_append("problems", F.lit("unknown parent"))).otherwise(F.col("problems")))
    # members in alphabetical order; to_json leaves NULL members out
    message = F.to_json(F.struct(
        F.col("parsed").alias("arguments"),
        F.when(F.col("parsed").isNull(), F.col("arguments")).alias("arguments_text"),
        F.col("call_id").alias("id"), F.col("name"), F.col("parent_id").alias("parent"), F.col("content").alias("result")))
    rows = rows.select("conversation", "turn", "call_id", "level", "status", F.coalesce("results", F.lit(0)).alias("results"), "problems",
                       (F.size("problems") == 0).alias("valid"), message.alias("message"))

    asked = first.select(*_KEY, F.lit(True).alias("asked"))
    rest = told.alias("t").join(asked.alias("k"), _on("t", "k", *_KEY), "left").join(
        answers.alias("a"), _on("t", "a", *_KEY), "left").where("asked is null or not (t.content <=> a.content)")
    fault = F.when(F.col("asked").isNull(), F.array(F.lit("unknown call"))).otherwise(F.array().cast("array<string>"))
    rest = rest.select("t.conversation", F.lit(None).cast("long").alias("turn"), "t.call_id", F.lit(None).cast("long").alias("level"),
                       F.when(F.col("asked"), "extra").otherwise("orphan").alias("status"), F.col("n").alias("results"), fault.alias("problems"),
                       F.coalesce("asked", F.lit(False)).alias("valid"), F.to_json(F.struct(
                           F.col("t.call_id").alias("id"), F.col("t.content").alias("result"))).alias("message"))
    return rows.unionByName(rest)


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, context) of a chat table (conv_id, turn, role, text): what a user asks is a call, what the assistant says
    in the next turn its result, and a call depends on the user's turn two before. Turns of every other role are context, one row
    each in the form of :func:`formatted`, their message the role and the text.

    Identifiers are ``call_<turn>``, so every conversation has the same. A text of up to 20 words is a call of ``lookup``, a longer one of
    ``answer``; a text of several lines is asked as an array of lines.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conversation"), F.col("turn").cast("long").alias("turn"), "role",
                                F.col("text").cast("string").alias("text"))
    name = lambda turn: F.concat(F.lit("call_"), turn)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    arguments = F.when(F.col("text").contains("\n"), F.to_json(F.struct(F.split("text", "\n").alias("query"), words.alias("words")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("query"), words.alias("words"))))
    calls = rows.where("role = 'user'").select(
        "conversation", "turn", name(F.col("turn")).alias("call_id"), F.when(words <= 20, "lookup").otherwise("answer").alias("name"),
        arguments.alias("arguments"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("parent_id"))
    results = rows.where("role = 'assistant'").select("conversation", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    context = rows.where("role is null or role not in ('user', 'assistant')").select(
        "conversation", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("level"), F.lit("context").alias("status"),
        F.lit(0).cast("long").alias("results"), F.array().cast("array<string>").alias("problems"), F.lit(True).alias("valid"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("role"))).alias("message"))
    return calls, results, context
