"""Chat formatting: tool calls linked to their results and written as canonical JSON.

Calls and results are joined by identifier; calls are ordered topologically by
the identifiers they depend on; arguments are validated against the tools'
schemas; each call becomes one line of JSON with sorted keys and no spaces.
Only DataFrame functions are used. Identifiers are aggregated before they are
joined, so one identifier with very many rows meets no other side row by row.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import discard, join_groups, keep

#: JSON Schema types and what they are called as variants.
KINDS = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT",
    "array": r"^ARRAY",
    "null": r"^VOID$",
}


def field_path(name: str) -> str:
    """A variant path to one field; a name can't hold both kinds of quotes."""
    if "'" in name and '"' in name:
        raise ValueError(f"property name with both kinds of quotes: {name}")
    return f"$['{name}']" if "'" not in name else f'$["{name}"]'


#: Keywords of JSON Schema that only describe.
REMARKS = {"title", "description", "default", "examples", "format", "$schema", "$id", "$comment"}
KEYWORDS = {
    "type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum",
    "minItems", "maxItems", "items", "properties", "required", "additionalProperties",
}


def has_kind(value: Column, name: str) -> Column:
    """Whether a variant is of a JSON Schema type; a whole number is an integer however it is written."""
    match = F.schema_of_variant(value).rlike(KINDS[name])
    if name == "integer":
        number = F.try_variant_get(value, "$", "double")
        match = match | (F.schema_of_variant(value).rlike("^(DOUBLE|FLOAT)$") & (number == F.floor(number)))
    return match


def meets(value: Column, rule: dict) -> Column:
    """Whether a variant meets a rule of JSON Schema; keywords outside KEYWORDS and REMARKS raise an error.

    As in JSON Schema, a keyword for one type holds for values of other types. The result may be null where ``value`` is.
    """
    unknown = set(rule) - KEYWORDS - REMARKS
    if unknown:
        raise ValueError(f"schema keywords that aren't known: {sorted(unknown)}")
    checks: list[Column] = []

    def holds_for(kind: str, check: Column) -> None:
        checks.append(~has_kind(value, kind) | F.coalesce(check, F.lit(False)))

    if "type" in rule:
        kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        checks.append(F.array_contains(F.array(*[has_kind(value, k) for k in kinds]), True))
    for word in ("enum", "const"):
        if word in rule:
            options = rule[word] if word == "enum" else [rule[word]]
            checks.append(F.to_json(value).isin(*[F.to_json(F.parse_json(F.lit(json.dumps(o)))) for o in options]))
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    for word, test in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n), ("pattern", lambda n: text.rlike(n))):
        if word in rule:
            holds_for("string", test(rule[word]))
    bounds = {"minimum": lambda n: number >= n, "maximum": lambda n: number <= n, "exclusiveMinimum": lambda n: number > n, "exclusiveMaximum": lambda n: number < n}
    for word, test in bounds.items():
        if word in rule:
            holds_for("number", test(float(rule[word])))
    items = F.try_variant_get(value, "$", "array<variant>")
    for word, test in (("minItems", lambda n: F.size(items) >= n), ("maxItems", lambda n: F.size(items) <= n), ("items", lambda n: F.forall(items, lambda x: meets(F.coalesce(x, F.parse_json(F.lit("null"))), n)))):
        if word in rule:
            holds_for("array", test(rule[word]))
    required, known = set(rule.get("required", ())), rule.get("properties", {})
    for name in [*known, *sorted(required - set(known))]:
        field = F.try_variant_get(value, field_path(name), "variant")
        present = F.coalesce(meets(field, known.get(name, {})), F.lit(False))
        holds_for("object", F.when(field.isNull(), F.lit(name not in required)).otherwise(present))
    if rule.get("additionalProperties", True) is not True:
        others = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin(*known) if known else F.lit(True))
        extra = rule["additionalProperties"]
        null = F.parse_json(F.lit("null"))
        holds_for("object", F.size(others) == 0 if extra is False else F.forall(F.map_values(others), lambda v: meets(F.coalesce(v, null), extra)))
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out


def parsed(arguments: Column) -> Column:
    """A JSON text as a variant; null if it isn't JSON, or holds a number of over 38 digits or beyond the range of doubles.

    Other numbers keep their value: 1.0 and 1 are both written 1, those with an exponent as doubles.
    """
    outside = F.regexp_replace(arguments, r'"(\\.|[^"\\])*+"', "")
    exponents = F.regexp_extract_all(outside, F.lit(r"[-0-9.]+[eE][-+0-9]+"), F.lit(0))
    exact = ~outside.rlike(r"[0-9][0-9.]{38,}") & F.forall(exponents, lambda x: F.abs(x.try_cast("double")) < float("inf"))
    return F.when(exact, F.try_parse_json(arguments))


def validate(value: Column, schema: dict) -> Column:
    """Whether a variant is an object that meets ``schema``; null, what isn't JSON (see ``parsed``), isn't."""
    return F.coalesce(has_kind(value, "object") & meets(value, schema), F.lit(False))


def validate_calls(name: Column, value: Column, schemas: dict[str, dict]) -> Column:
    """Validity by the tool's own schema; calls of unknown tools are invalid."""
    out = F.lit(False)
    for tool, schema in schemas.items():
        out = F.when(name == tool, validate(value, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


#: Longest list of dependencies that shortcuts are looked for in.
FEW = 16
#: Levels never come near this; lengths on cycles stop growing here.
MOST = 1 << 40


def order_calls(calls: DataFrame) -> DataFrame:
    """call_id and position, its level: 0 without dependencies, else one more than the highest of those it depends on.

    ``calls`` has call_id and depends_on (array of identifiers; those that no call has are
    ignored, as are nulls and a call's own). Repeated rows of an identifier depend on what any of
    them does. Calls on or behind a cycle have a null position; so has a null identifier.
    """
    ids = calls.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.array_distinct(F.flatten(F.collect_set("depends_on"))).alias("deps"))
    ids, _ = keep(ids, "toolcall-ids")
    wants = ids.select("call_id", F.explode("deps").alias("dep")).where("dep <> call_id")
    there = wants.groupBy("dep").agg(F.count("*").alias("n")).join(ids.select(F.col("call_id").alias("dep")), "dep")
    there, _ = keep(there, "toolcall-deps")
    edges = join_groups(wants, there, ["dep"], ["call_id"], "inner").select("call_id", "dep")
    return levels(ids.select("call_id"), edges).withColumnRenamed("level", "position")


def levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """call_id and level for distinct ids and edges (call_id, dep) between them.

    An edge says that a call stands ``far`` levels above another at least. In each round the edges of a
    call learn of the call they lead to. If that is placed, its level counts and the edge goes.
    If it has a single edge left itself, the edge jumps over it, which halves chains.
    Else it stays, unless it is a shortcut: another edge leads there by a detour of no fewer levels.
    So chains and trees take rounds by the logarithm of their depth; what keeps branching
    and meeting again takes a round per level of that.
    """
    rest, rest_path = keep(edges.select("call_id", "dep", F.lit(1).cast("long").alias("far"), F.lit(None).cast("long").alias("least")), "toolcall-rest")
    placed = ids.join(rest, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))
    placed, _ = keep(placed, "toolcall-levels")
    parts = [placed]
    while True:
        lists = rest.groupBy("call_id").agg(F.count("*").alias("size"), F.collect_list(F.struct("dep", "far")).alias("next"), F.max("least").alias("own"))
        # longer lists aren't handed to those that depend on them
        news = lists.select(F.col("call_id").alias("dep"), F.lit(None).cast("long").alias("level"), F.when(F.col("size") <= FEW, F.col("next")).alias("next"), "own")
        # a jump may lead to what was placed in any round before
        news = news.unionByName(reduce(DataFrame.unionByName, parts).select(F.col("call_id").alias("dep"), "level"), allowMissingColumns=True)
        wanted = rest.groupBy("dep").agg(F.count("*").alias("n"))
        news, news_path = keep(news.join(wanted, "dep"), "toolcall-news")
        heard = join_groups(rest, news, ["dep"], ["call_id"], "left")
        up = lambda x: F.when(x.isNotNull(), F.least(F.col("far") + x, F.lit(MOST)))
        jump = F.coalesce(F.size("next") == 1, F.lit(False))
        reached = F.when(F.col("level").isNotNull(), up(F.col("level"))).when(jump, up(F.col("own")))
        edge = lambda dep, far, direct: F.struct(dep.alias("dep"), far.alias("far"), F.lit(direct).alias("direct"))
        # a detour counts only by a call that comes after in a fixed order, so that a cycle can't take itself away
        after = lambda x: (F.length("dep") > F.length(x)) | ((F.length("dep") == F.length(x)) & (F.col("dep") > x))
        detours = F.transform(F.filter(F.coalesce("next", F.array().cast(news.schema["next"].dataType)), lambda e: after(e["dep"])), lambda e: edge(e["dep"], up(e["far"]), False))
        given = (
            F.when(F.col("level").isNotNull(), F.array(edge(F.lit(None).cast("string"), F.lit(None).cast("long"), True)))
            .when(jump, F.array(edge(F.element_at("next", 1)["dep"], up(F.element_at("next", 1)["far"]), True)))
            .otherwise(F.concat(F.array(edge(F.col("dep"), F.col("far"), True)), detours))
        )
        cells = heard.select("call_id", F.greatest("least", reached).alias("least"), F.explode(given).alias("e")).select("call_id", "least", "e.*")
        merged = cells.groupBy("call_id", "dep").agg(F.max(F.when(F.col("direct"), F.col("far"))).alias("far"), F.max(F.when(~F.col("direct"), F.col("far"))).alias("detour"), F.max("least").alias("least"))
        # a row without dep carries what the placed ones say
        open_ = merged.where(F.col("dep").isNull() | (F.col("far").isNotNull() & F.coalesce(F.col("detour") < F.col("far"), F.lit(True))))
        whole, whole_path = keep(open_.select("call_id", "dep", "far", "least"), "toolcall-whole")
        state = whole.groupBy("call_id").agg(F.count("dep").alias("open"), (F.max("least")).alias("level"))
        fresh, _ = keep(state.where("open = 0").select("call_id", "level"), "toolcall-levels")
        if fresh.isEmpty():
            return ids.join(reduce(DataFrame.unionByName, parts), "call_id", "left")
        parts.append(fresh)
        known = whole.groupBy("call_id").agg(F.max("least").alias("known"))
        new, new_path = keep(whole.where("dep IS NOT NULL").drop("least").join(known, "call_id").withColumnRenamed("known", "least"), "toolcall-rest")
        for path in (rest_path, news_path, whole_path):
            discard(ids.sparkSession, path)
        rest, rest_path = new, new_path
        if rest.isEmpty():
            return ids.join(reduce(DataFrame.unionByName, parts), "call_id", "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call with its result, position, validity and canonical JSON.

    ``calls``: call_id, name, arguments (JSON text) and depends_on; ``results``:
    call_id, seq, content. Of several results the one of lowest seq counts
    (then of least content); n_results says how many there were. Calls with a
    null identifier link with nothing, and have no position. Results without a call don't appear.
    Repeated rows of one identifier are given out alike; an empty table gives no rows.
    Other columns of ``calls`` pass through, except those added here.
    """
    added = ("n_results", "linked", "position", "valid", "json")
    calls = calls.drop(*added)
    found = (
        results.where(F.col("call_id").isNotNull())
        .groupBy("call_id")
        .agg(F.count("*").alias("n_results"), F.min(F.struct("seq", "content")).alias("first"))
    )
    order = order_calls(calls.select("call_id", "depends_on"))
    packed = calls.select("call_id", F.struct(*[F.col(f"`{c}`") for c in calls.columns]).alias("_row"))
    joined = packed.join(found, "call_id", "left").join(order, "call_id", "left").withColumn("value", parsed(F.col("_row.arguments")))
    arguments = F.to_json("value")
    fields = {
        "arguments": F.coalesce(arguments, F.to_json(F.struct(F.col("_row.arguments").alias("invalid")))),
        "depends_on": F.coalesce(F.to_json(F.array_sort(F.array_compact(F.array_distinct(F.col("_row.depends_on"))))), F.lit("[]")),
        "id": json_string(F.col("call_id")),
        "name": json_string(F.col("_row.name")),
        "result": json_string(F.col("first.content")),
    }
    pairs = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return joined.select(
        *[F.col(f"_row.`{c}`") for c in calls.columns],
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("n_results").isNotNull().alias("linked"),
        "position",
        validate_calls(F.col("_row.name"), F.col("value"), schemas).alias("valid"),
        F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("json"),
    )


def json_string(value: Column) -> Column:
    """A JSON string of a text; null is null."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


#: What a turn asks of the model, as a tool.
REPLY_SCHEMAS = {
    "reply": {
        "properties": {"prompt": {"type": "string", "minLength": 1}, "role": {"type": "string", "enum": ["user", "system"]}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "role", "turn"],
        "additionalProperties": False,
    }
}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls and results.

    A turn of any role but assistant or tool calls ``reply`` under the identifier
    conv_id:turn, depending on the two turns before it; a turn of an assistant or a
    tool is the result of the identifier of the turn before it. Turns with a
    null conv_id or turn have a null identifier.
    """
    answer = F.coalesce(F.col("role").isin("assistant", "tool"), F.lit(False))
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    calls = conversations.where(~answer).select(
        "conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "role", F.col("turn").cast("long").alias("turn"))).alias("arguments"),
        F.array(name(1), name(2)).alias("depends_on"),
    )
    results = conversations.where(answer).select(name(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results
