"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of several layouts become canonical turns array<struct<role,text>>:

1. The nested field paths of a record are listed in a normal form and hashed. For a column of structs the paths
   are the schema's and known before any row is read; for JSON text they are each row's own, taken from the
   schema of the parsed variant.
2. The hash selects a declarative mapping: a list of steps, each of which makes one turn from fields or
   many from an array of messages. Layouts without a mapping give null turns, so callers can set them aside.
3. A template marks the turns, and control strings inside texts are escaped: `~` is written `~0`, `<` as `~1`
   and `[` as `~2`, so neither bracket nor angle occurs in a formatted text but in marks, and reading back is exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake.llm import text

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Field:
    """One turn of a fixed role; further paths are appended after a blank line where they hold text."""

    role: str
    paths: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Messages:
    """One turn for each element of an array of structs; `roles` renames those of the layout's own convention."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


#: The convention of layouts with "from" and "value".
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))

#: Layouts by their nested field paths.
LAYOUTS: dict[tuple[str, ...], tuple[Field | Messages, ...]] = {
    ("completion", "prompt"): (Field("user", ("prompt",)), Field("assistant", ("completion",))),
    ("prompt", "response"): (Field("user", ("prompt",)), Field("assistant", ("response",))),
    ("answer", "question"): (Field("user", ("question",)), Field("assistant", ("answer",))),
    ("instruction", "output"): (Field("user", ("instruction",)), Field("assistant", ("output",))),
    ("input", "instruction", "output"): (Field("user", ("instruction", "input")), Field("assistant", ("output",))),
    ("input", "instruction", "output", "system"): (Field("system", ("system",), optional=True), Field("user", ("instruction", "input")), Field("assistant", ("output",))),
    ("messages[].content", "messages[].role"): (Messages("messages", "role", "content"),),
    ("messages[].role", "messages[].text"): (Messages("messages", "role", "text"),),
    ("conversations[].from", "conversations[].value"): (Messages("conversations", "from", "value", SPEAKERS),),
    ("messages[].content", "messages[].role", "system"): (Field("system", ("system",), optional=True), Messages("messages", "role", "content")),
}


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """sha256 of the sorted paths, one to a line."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The leaf paths of a type; `[]` marks elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _role(role: Column, renamed: tuple[tuple[str, str], ...]) -> Column:
    known = F.coalesce(role, F.lit(""))
    for other, name in renamed:
        known = F.when(F.coalesce(role, F.lit("")) == other, F.lit(name)).otherwise(known)
    return known


def _turn(role: Column, value: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(value, F.lit("")).alias("text"))


def _map_struct(steps: tuple[Field | Messages, ...], record: Column) -> Column:
    def each(step: Messages) -> Column:
        turns = F.transform(record[step.path], lambda m: _turn(_role(m[step.role].cast("string"), step.roles), m[step.text].cast("string")))
        return F.coalesce(turns, F.array().cast(TURNS))

    parts = []
    for step in steps:
        if isinstance(step, Messages):
            parts.append(each(step))
        else:
            first, *more = [record[p].cast("string") for p in step.paths]
            value = first
            for extra in more:
                value = F.concat(F.coalesce(value, F.lit("")), F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))
            one = F.array(_turn(F.lit(step.role), value))
            parts.append(F.when(F.coalesce(value, F.lit("")) != "", one).otherwise(F.array().cast(TURNS)) if step.optional else one)
    return F.concat(*[p.cast(TURNS) for p in parts])


def turns_of_struct(rows: DataFrame, record: str, out: str = "turns") -> DataFrame:
    """Adds canonical turns of a struct column; its fingerprint is known from the schema. A null record has null turns."""
    kind = rows.schema[record].dataType
    chosen = {fingerprint(paths): steps for paths, steps in LAYOUTS.items()}.get(fingerprint(field_paths(kind)))
    if chosen is None:
        return rows.withColumn(out, F.lit(None).cast(TURNS))
    return rows.withColumn(out, F.when(F.col(record).isNotNull(), _map_struct(chosen, F.col(record))))


def _paths_of_json(parsed: Column) -> Column:
    """A row's schema in a normal form: scalar types and nulls are alike, keys are in order as variants keep them."""
    schema = F.schema_of_variant(parsed)
    return F.regexp_replace(schema, r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DATE|TIMESTAMP|TIMESTAMP_NTZ|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "_")


def _json_form(paths: tuple[str, ...]) -> str:
    """The normal form that _paths_of_json gives for a record with these paths."""
    tree: dict = {}
    for path in sorted(paths):
        at, names = tree, path.split(".")
        for name in names[:-1]:
            at = at.setdefault(name, {})
        at[names[-1]] = None

    def show(node: dict | None, name: str = "") -> str:
        if node is None:
            return "_"
        inner = ", ".join(f"{k.removesuffix('[]')}: {'ARRAY<' + show(v) + '>' if k.endswith('[]') else show(v)}" for k, v in sorted(node.items()))
        return f"OBJECT<{inner}>"

    return show(tree)


#: A field for what is no JSON.
MALFORMED = "_malformed"


def _skeleton(record: Column) -> Column:
    """JSON with the same fields, whose strings are cut to 64 characters and have no escapes."""
    return F.regexp_replace(F.regexp_replace(record, r"(?s)\\.", ""), r'"([^"]{0,64})[^"]*+"', '"$1"')


def turns_of_json(rows: DataFrame, record: str, out: str = "turns") -> DataFrame:
    """Adds canonical turns of a JSON text column in which each row may have its own layout.

    The hash of a row's own field paths picks the mapping. Null, malformed or unknown layouts give null turns. Texts may
    be of any length that a column holds; empty arrays give no turns; repeated rows are alike, an empty table stays empty.
    A column `out` that is there already stays, and the new one gets underscores behind its name.
    """
    out = text.free_name(rows.columns, out)
    # a variant holds values of limited size, but only paths are wanted: of records beyond it strings are cut before
    key = F.sha2(F.coalesce(_paths_of_json(F.try_parse_json(F.col(record))), _paths_of_json(F.try_parse_json(_skeleton(F.col(record))))), 256)
    result = F.lit(None).cast(TURNS)
    for paths, steps in LAYOUTS.items():
        fields = {}
        for path in paths:
            top, _, leaf = path.partition("[].")
            fields.setdefault(top, []).append(leaf)
        kind = ", ".join(f"`{top}`: " + (f"array<struct<{', '.join(f'`{x}`: string' for x in leaves)}>>" if leaves != [""] else "string") for top, leaves in fields.items())
        typed = F.from_json(F.col(record), f"struct<{kind}, `{MALFORMED}`: string>", {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": MALFORMED})
        mine = hashlib.sha256(_json_form(paths).encode()).hexdigest()
        result = F.when((key == mine) & typed[MALFORMED].isNull(), _map_struct(steps, typed)).otherwise(result)
    return rows.withColumn(out, result)


# The template: marks around each turn. The marks are fixed values; roles without marks of their own name themselves.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}


def escape(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("~1"), F.lit("<")), F.lit("~2"), F.lit("[")), F.lit("~0"), F.lit("~"))


def _format_turn(turn: Column) -> Column:
    body = escape(turn["text"])
    shown = F.concat(F.lit("[ROLE]"), escape(turn["role"]), F.lit("[TEXT]"), body, F.lit("[/ROLE]"))
    for role, (begin, end) in MARKS.items():
        shown = F.when(turn["role"] == role, F.concat(F.lit(begin), body, F.lit(end))).otherwise(shown)
    return shown


def render(turns: Column) -> Column:
    """One string with all turns in order; empty for no turns, null for null."""
    return F.array_join(F.transform(turns, _format_turn), "")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered string: array<struct<role, text, loss>>; loss marks what a model is trained on.

    Neither `[` nor `<` is in a text, so each turn runs from its opening mark to the next mark.
    """
    pattern = r"(?:\[INST\]|<s>|<<SYS>>|\[ROLE\][^\[<]*\[TEXT\])[^\[<]*(?=\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"
    raw = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def turn(x: Column) -> Column:
        role = unescape(F.substring_index(F.substring(x, 7, 2**31 - 1), "[TEXT]", 1))
        body = F.substring_index(x, "[TEXT]", -1)
        for name, (begin, _) in MARKS.items():
            role = F.when(F.startswith(x, F.lit(begin)), F.lit(name)).otherwise(role)
            body = F.when(F.startswith(x, F.lit(begin)), F.substring(x, len(begin) + 1, 2**31 - 1)).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"), (role == "assistant").alias("loss"))

    return F.transform(raw, turn)


def gathered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record for each conversation from a table of turns: (conv, record), in the plainest layout that holds it.

    A question and its answer are prompt and completion; turns behind one that sets the scene are messages with a
    system text; all others are messages. Turns are in the order of turn, role, text, nulls first; null roles and
    texts are empty strings. Null ids are one conversation. A conversation is one value by nature; its rows meet in
    one task, which holds that conversation and no more. An empty table gives no records.
    """
    entry = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    grouped = rows.select(F.col(conv_col).alias("conv"), entry.alias("entry")).groupBy("conv").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    shown = lambda entries: F.transform(entries, lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content")))
    first, second = (F.try_element_at("entries", F.lit(k)) for k in (1, 2))
    pair = (F.size("entries") == 2) & (first["role"] == "user") & (second["role"] == "assistant")
    scene = (first["role"] == "system") & (first["content"] != "")
    behind = F.slice("entries", 2, F.greatest(F.size("entries"), F.lit(1)))
    record = F.when(pair, F.to_json(F.struct(first["content"].alias("prompt"), second["content"].alias("completion"))))
    record = record.when(scene & (F.size("entries") > 1), F.to_json(F.struct(first["content"].alias("system"), shown(behind).alias("messages"))))
    return grouped.select("conv", record.otherwise(F.to_json(F.struct(shown("entries").alias("messages")))).alias("record"))
