"""Shared dialogs: turns from streamed tables or transcripts, and their renderings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.predicates import ENQUEUE, detected_provider, unsupported_reason
from lintel.functions.text import escape_html, escape_links_notation, trim

TURNS = "array<struct<id:string,role:string,content:string>>"
CHAT = f"title string, conversation_id string, turns {TURNS}"


# ---- the streamed table: an array whose integers are places in itself --------------------


def stream_chunks(html: str) -> list[str]:
    """The string literals that the page hands to its stream."""
    out, at, reader = [], html.find(ENQUEUE), json.JSONDecoder()
    while at >= 0:
        try:
            value, _ = reader.raw_decode(html, at + len(ENQUEUE))
            out.append(value if isinstance(value, str) else json.dumps(value))
        except ValueError:
            pass
        at = html.find(ENQUEUE, at + 1)
    return out


def resolve_table(table: list) -> object:
    """The object that the table's first entry stands for. Negative places are null; ``_n`` names the key at place n; a place
    that is met inside of itself is null there. What a place stands for so depends on the places around it: it is remembered
    with the places below it, and used again only where none of them is around."""
    done: dict[int, tuple[object, frozenset[int]]] = {}

    def at(place: object, around: frozenset[int]) -> tuple[object, frozenset[int], bool]:
        """The value, the places in it, and whether one of those around cut it short."""
        if isinstance(place, bool) or not isinstance(place, int):
            return place, frozenset(), False
        if place < 0 or place >= len(table):
            return None, frozenset(), False
        if place in around:
            return None, frozenset(), True
        if place in done and done[place][1].isdisjoint(around):
            return (*done[place], False)
        value, here, below, cut = table[place], around | {place}, {place}, False

        def inner(x: object) -> object:
            nonlocal cut
            got, places, short = at(x, here)
            below.update(places)
            cut = cut or (short and x != place)
            return got

        if isinstance(value, list):
            made: object = [inner(x) for x in value]
        elif isinstance(value, dict):
            made = {(str(inner(int(k[1:]))) if re.fullmatch(r"_\d+", k) else k): inner(v) for k, v in value.items()}
        else:
            made = value
        if not cut:
            done[place] = made, frozenset(below)
        return made, frozenset(below), cut

    return at(0, frozenset())[0]


def holder_of(value: object, key: str) -> dict | None:
    """The first object, parents before children, with a list under ``key``."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get(key), list):
                return x
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return None


def message_text(content: object) -> str:
    if isinstance(content, str):
        return content
    if not isinstance(content, dict):
        return ""
    if isinstance(content.get("parts"), list):
        texts = [p if isinstance(p, str) else p.get("text") if isinstance(p, dict) else None for p in content["parts"]]
        return "\n\n".join(t for t in texts if isinstance(t, str) and t)
    return content["text"] if isinstance(content.get("text"), str) else ""


def chat_of(html: str | None) -> dict:
    """Title, id and visible turns of a streamed chat; turns are null where there is no such stream."""
    for chunk in stream_chunks(html or ""):
        try:
            table = json.loads(chunk)
        except ValueError:
            continue
        found = holder_of(resolve_table(table), "linear_conversation") if isinstance(table, list) else None
        if found is None:
            continue
        turns = []
        for k, item in enumerate(found["linear_conversation"]):
            m = item.get("message") if isinstance(item, dict) and isinstance(item.get("message"), dict) else item
            if not isinstance(m, dict) or not isinstance(m.get("author"), dict) or m["author"].get("role") not in ("user", "assistant"):
                continue
            if isinstance(m.get("metadata"), dict) and m["metadata"].get("is_visually_hidden_from_conversation"):
                continue
            if text := message_text(m.get("content")).strip():
                turns.append({"id": m["id"] if isinstance(m.get("id"), str) and m["id"] else f"chatgpt-turn-{k + 1}", "role": m["author"]["role"], "content": text})
        text = lambda key: found[key] if isinstance(found.get(key), str) else None  # noqa: E731, B023
        return {"title": text("title"), "conversation_id": text("conversation_id"), "turns": turns}
    return {"title": None, "conversation_id": None, "turns": None}


def parse_chat(html: Column) -> Column:
    @F.pandas_udf(CHAT)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chat_of(x) for x in s], columns=["title", "conversation_id", "turns"])

    return run(html)


# ---- transcripts: gaps and islands over lines --------------------------------------------

PREFIX = r"(?i)^\s*(user:|assistant:|u:|a:)"


def transcript_turns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, role, content): a prefixed line opens a turn, what follows belongs to it; blank turns go."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("ord", "line"))
    prefix = F.lower(F.regexp_extract("line", PREFIX, 1))
    order = Window.partitionBy(id_col).orderBy("ord")
    seen = lines.withColumn("prefix", prefix).withColumn("turn", F.sum((F.col("prefix") != "").cast("int")).over(order)).where("turn > 0")
    text = F.when(F.col("prefix") != "", F.regexp_replace("line", PREFIX, "")).otherwise(F.col("line"))
    parts = seen.withColumn("part", F.when(F.col("prefix") != "", F.ltrim(text)).otherwise(text))
    joined = parts.groupBy(id_col, "turn").agg(
        F.max(F.when(F.col("prefix").isin("user:", "u:"), "user").when(F.col("prefix") != "", "assistant")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n").alias("content"),
    )
    kept = joined.withColumn("content", trim(F.col("content"))).where("content <> ''")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("turn"))).select(id_col, "n", "role", "content")


def visible_turns(rows: DataFrame, id_col: str = "conv_id", ord_col: str = "turn", role_col: str = "role", text_col: str = "text", hidden_col: str | None = None) -> DataFrame:
    """User and assistant turns with text; ids come from the place before filtering."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(ord_col, role_col, text_col))
    numbered = rows.withColumn("place", place).withColumn("content", trim(F.coalesce(F.col(text_col), F.lit(""))))
    shown = F.lit(True) if hidden_col is None else ~F.coalesce(F.col(hidden_col), F.lit(False))
    kept = numbered.where(F.col(role_col).isin("user", "assistant") & (F.col("content") != "") & shown)
    return kept.select(id_col, "place", F.concat(F.lit("chatgpt-turn-"), "place").alias("id"), F.col(role_col).alias("role"), "content")


def gathered(turns: DataFrame, id_col: str = "conv_id", ord_col: str = "place") -> DataFrame:
    """(id, turns) in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(ord_col, "id", "role", "content"))), lambda t: F.struct(t["id"].alias("id"), t["role"].alias("role"), t["content"].alias("content")))
    return turns.groupBy(id_col).agg(listed.alias("turns"))


def capture_dialogs(pages: DataFrame, static_col: str = "static_html", rendered_col: str = "rendered_html", url_col: str = "url") -> DataFrame:
    """Each dialog from its static page, else from the rendered one, with provider, status and reason."""
    parsed = pages.withColumn("_s", parse_chat(F.col(static_col))).withColumn("_r", parse_chat(F.col(rendered_col)))
    has = lambda c: F.coalesce(F.size(f"{c}.turns"), F.lit(0)) > 0
    body = F.coalesce(F.col(rendered_col), F.col(static_col), F.lit(""))
    provider = detected_provider(body, F.col(url_col))
    best = F.when(has("_s"), F.col("_s")).when(has("_r"), F.col("_r"))
    out = parsed.withColumn("_d", best).withColumn("provider", provider)
    return out.select(
        F.col(url_col).alias("source_url"), "provider",
        F.when(has("_s"), "static").when(has("_r"), "browser").otherwise("none").alias("capture_method"),
        F.when(F.col("_d").isNotNull(), "ok").otherwise("unsupported").alias("status"),
        F.col("_d.title").alias("title"), F.col("_d.conversation_id").alias("conversation_id"),
        F.coalesce(F.col("_d.turns"), F.array().cast(TURNS)).alias("turns"),
        F.when(F.col("_d").isNull(), unsupported_reason(body, F.col("provider"))).alias("unsupported_reason"),
        F.when(~has("_s") & has("_r"), F.array(F.lit("static page held no transcript"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


# ---- renderings -------------------------------------------------------------------------


def _name(role: Column) -> Column:
    return F.when(role == "user", "User").otherwise("Assistant")


def _field(indent: int, name: str, value: Column) -> Column:
    shown = F.concat(F.lit(f'{" " * indent}{name} "'), escape_links_notation(value.cast("string")), F.lit('"'))
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", shown)


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def as_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_name(t["role"]), F.lit(":\n"), t["content"], F.lit("\n"))), "\n")


def as_markdown(turns: Column, title: Column, provider: Column, url: Column, method: Column, conversation: Column) -> Column:
    head = _lines(
        F.concat(F.lit("# "), F.coalesce(title, F.lit("Shared Dialog Capture"))), F.lit(""),
        F.concat(F.lit("- Provider: `"), provider, F.lit("`")), F.concat(F.lit("- Source: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("- Capture method: `"), method, F.lit("`")), F.lit("- Status: `ok`"),
        F.concat(F.lit("- Conversation ID: `"), conversation, F.lit("`")),
    )
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("**"), _name(t["role"]), F.lit("**\n\n"), t["content"])), "\n\n")
    return F.concat(F.concat_ws("\n\n", head, F.when(F.size(turns) > 0, body)), F.lit("\n"))


def as_demo_memory(turns: Column, title: Column, url: Column, conversation: Column, label: str = "shared-dialog") -> Column:
    def event(t: Column) -> Column:
        return _lines(
            F.concat(F.lit('  event "'), escape_links_notation(t["id"]), F.lit('"')), _field(4, "role", t["role"]), _field(4, "content", t["content"]),
            _field(4, "demoLabel", F.lit(label)), _field(4, "conversationId", conversation), _field(4, "conversationTitle", title), _field(4, "evidence", url),
        )

    return F.concat(F.concat_ws("\n", F.lit("demo_memory"), F.transform(turns, event)), F.lit("\n"))


def as_meta_language(turns: Column, title: Column, provider: Column, url: Column, method: Column, conversation: Column, status: Column, reason: Column) -> Column:
    def turn(t: Column) -> Column:
        return _lines(F.concat(F.lit('  turn "'), escape_links_notation(t["id"]), F.lit('"')), _field(4, "role", t["role"]), F.lit('    visibility "visible"'), _field(4, "content", t["content"]))

    head = _lines(
        F.lit("shared_dialog_capture"), _field(2, "provider", provider), _field(2, "sourceUrl", url), _field(2, "captureMethod", method), _field(2, "status", status),
        _field(2, "conversationId", conversation), _field(2, "title", title), F.lit("  diagnostics"), _field(4, "status", status), _field(4, "unsupportedReason", reason),
    )
    return F.concat(F.concat_ws("\n", head, F.transform(turns, turn)), F.lit("\n"))


def as_html(markdown: Column, title: Column) -> Column:
    name = escape_html(F.coalesce(title, F.lit("Shared Dialog Capture")))
    return F.concat(F.lit('<!doctype html>\n<html>\n<head><meta charset="utf-8"><title>'), name, F.lit("</title></head>\n<body><pre>"), escape_html(markdown), F.lit("</pre></body>\n</html>\n"))


def extension(fmt: Column) -> Column:
    low = F.lower(fmt)
    return F.when(low.isin("markdown", "md"), "md").when(low.isin("txt", "text"), "txt").when(low == "html", "html").when(low.isin("meta-language", "meta_language", "demo-memory", "demo_memory"), "lino").otherwise("json")


def as_json(**fields: Column) -> Column:
    """A capture as indented JSON; unknown fields are null."""
    return F.concat(F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n"))
