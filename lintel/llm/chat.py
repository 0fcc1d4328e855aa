"""Chat formatting by schema fingerprint, in DataFrame operations only.

``fingerprint`` hashes the sorted nested field paths of a schema. The hash picks a
declarative mapping (which paths hold prompt, answer, message list, role and text),
so prompt, instruction, message and turn-per-row layouts all become canonical turns
``array<struct<role, text>>``: a table's by its schema, JSON records' row by row. ``render`` then writes one marked-up string per
conversation, as runs of text with a loss flag; ``parse`` reads the turns back.

Template, one line for each turn: ``<turn>### role: text</turn>``. Inside a role or
text ``\\`` becomes ``\\\\``, ``<`` ``\\l``, ``#`` ``\\h`` and (roles only) ``:`` ``\\c``,
so neither ``<turn>`` nor ``### Assistant:`` can occur unmarked and the escape is undone exactly.

Defined results: null texts and roles count as empty; turns sort by (turn, role, text),
nulls first, which settles ties and keeps repeated rows; a null conversation id is a conversation of
its own; an empty table gives no conversation; further columns with other names are ignored.
Loss covers the texts of turns whose role is exactly ``assistant``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, HEAD, CLOSE = "<turn>", "### ", "</turn>\n"
TURN = "struct<role:string,text:string>"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Every nested field path; ``[]`` marks the elements of an array, ``{}`` the values of a map."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower()))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, prefix + "{}")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else _text(role)).alias("role"), _text(text).alias("text"))


def _single(*pairs: tuple[str, str]) -> Callable[[], Column]:
    """Turns from single fields. An empty system prompt or input makes no turn."""
    return lambda: F.filter(
        F.array(*[_turn(role, F.col(path)) for role, path in pairs]), lambda t: (t["role"] != "system") | (t["text"] != "")
    )


def _listed(path: str, role: str, text: str) -> Callable[[], Column]:
    """Turns from a list of messages; other names for the same roles are mapped."""
    named = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

    def build() -> Column:
        def role_of(m: Column) -> Column:
            got = F.lower(_text(m[role]))
            out = got
            for k, v in named.items():
                out = F.when(got == k, F.lit(v)).otherwise(out)
            return out

        return F.transform(F.col(path), lambda m: _turn(role_of(m), m[text]))

    return build


def _instruction() -> Column:
    asked = F.when(_text(F.col("input")) == "", _text(F.col("instruction"))).otherwise(
        F.concat_ws("\n\n", _text(F.col("instruction")), _text(F.col("input")))
    )
    return F.array(_turn("user", asked), _turn("assistant", F.col("output")))


#: Layout name: (field paths that it has, the expression of its turns). Turn-per-row tables have no expression: they are grouped.
LAYOUTS: dict[str, tuple[list[str], Callable[[], Column] | None]] = {
    "turn_rows": (["conv_id", "turn", "role", "text"], None),
    "prompt_response": (["prompt", "response"], _single(("user", "prompt"), ("assistant", "response"))),
    "prompt_completion": (["prompt", "completion"], _single(("user", "prompt"), ("assistant", "completion"))),
    "question_answer": (["question", "answer"], _single(("user", "question"), ("assistant", "answer"))),
    "system_prompt_response": (["system", "prompt", "response"], _single(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "instruction_output": (["instruction", "output"], _single(("user", "instruction"), ("assistant", "output"))),
    "instruction_input_output": (["instruction", "input", "output"], _instruction),
    "messages": (["messages[].role", "messages[].content"], _listed("messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"], _listed("conversations", "from", "value")),
    "turns": (["turns[].role", "turns[].text"], _listed("turns", "role", "text")),
}
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(schema: T.StructType, ignore: tuple[str, ...] = ()) -> str:
    """The layout whose fingerprint the schema has: with all its paths, else with the most of a known layout's."""
    paths = [p for p in field_paths(schema) if p.split(".")[0].split("[")[0] not in ignore]
    exact = BY_FINGERPRINT.get(fingerprint(paths))
    if exact:
        return exact
    held = [(len(own), name) for name, (own, _) in LAYOUTS.items() if set(own) <= set(paths)]
    if not held:
        raise ValueError(f"no layout has the fingerprint {fingerprint(paths)} ({', '.join(paths)})")
    return max(held)[1]


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns array<struct<role, text>>) from any known layout."""
    layout = layout_of(df.schema, (id_col,) if "turn" not in df.columns else ())
    build = LAYOUTS[layout][1]
    if build is not None:
        return df.select(F.col(id_col), F.coalesce(build(), F.array().cast(f"array<{TURN}>")).alias("turns"))
    rows = df.select(
        F.col(id_col), F.struct(F.col("turn"), _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text")).alias("t")
    )
    sorted_turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"], t["text"]))
    return rows.groupBy(id_col).agg(sorted_turns.cast(f"array<{TURN}>").alias("turns"))


# ---- records whose layouts differ from row to row ------------------------------------------------

#: Fields of the layouts, as a record's JSON may hold them; absent ones are null.
_RECORD = T.StructType(
    [*[T.StructField(x, T.StringType()) for x in ("prompt", "response", "completion", "question", "answer", "system", "instruction", "input", "output")]]
    + [T.StructField(name, T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in keys]))) for name, keys in (("messages", ("role", "content")), ("conversations", ("from", "value")), ("turns", ("role", "text")))]
)


def record_paths(record: Column) -> Column:
    """The field paths of a JSON record, sorted, as ``field_paths`` writes them: its keys, and those of the objects in its lists."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    lists = [f.name for f in _RECORD if isinstance(f.dataType, T.ArrayType)]

    def below(name: str) -> Column:
        elements = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
        inner = F.flatten(F.transform(elements, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        return F.transform(F.coalesce(inner, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{name}[]."), k))

    flat = F.filter(keys, lambda k: ~k.isin(lists))
    return F.array_sort(F.array_distinct(F.concat(flat, *[below(x) for x in lists])))


def record_fingerprint(record: Column) -> Column:
    return F.substring(F.sha2(F.array_join(record_paths(record), "\n").cast("binary"), 256), 1, 16)


def mixed_turns(df: DataFrame, record_col: str, id_col: str = "conv_id") -> DataFrame:
    """(id, layout, turns) from JSON records of any layouts, each row by its own fingerprint. A record of no known layout, or
    that is no JSON object, has a null layout and no turns."""
    known = {k: name for k, name in BY_FINGERPRINT.items() if LAYOUTS[name][1] is not None}
    layout = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), record_fingerprint(F.col(record_col)))
    read = df.select(F.col(id_col).alias("__lx_id"), layout.alias("layout"), F.from_json(F.col(record_col), _RECORD).alias("r")).select("__lx_id", "layout", "r.*")
    turns = F.lit(None).cast(f"array<{TURN}>")
    for name in known.values():
        turns = F.when(F.col("layout") == name, LAYOUTS[name][1]()).otherwise(turns)
    return read.select(F.col("__lx_id").alias(id_col), "layout", F.coalesce(turns, F.array().cast(f"array<{TURN}>")).alias("turns"))


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(c: Column) -> Column:
    """Every backslash begins a code of two characters, so splitting at ``\\\\`` from the left meets real codes only."""

    def plain(part: Column) -> Column:
        out = F.replace(F.replace(part, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
        return F.replace(out, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")


def render(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, segments array<struct<text, loss>>, formatted). The loss mask is the runs' flags: ``formatted`` is the runs joined."""

    def runs(t: Column) -> Column:
        head = F.concat(F.lit(OPEN + HEAD), escape(t["role"], role=True), F.lit(": "))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
        )

    out = turns.select(id_col, F.flatten(F.transform("turns", runs)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns that ``formatted`` holds."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def turn(line: Column) -> Column:
        body = F.substring(line, F.lit(len(OPEN + HEAD) + 1), F.lit(2**31 - 1))
        role = F.substring_index(body, ": ", 1)
        rest = F.substring(body, F.length(role) + 3, F.lit(2**31 - 1))
        return F.struct(unescape(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(lines, turn)


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def format_chats(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    return render(canonical_turns(df, id_col), id_col)
