"""Chat formatting by schema fingerprints.

A record's nested field paths, sorted and hashed, select a declarative mapping that turns its layout into canonical
turns (role, text). Records may be JSON texts of mixed layouts (``canonical``) or rows of a table, one per turn
(``from_rows``). ``formatted`` renders turns by one template and gives the spans that count for the loss; ``parsed``
and ``unmasked`` read both back.

Template, per turn: ``<s>[role]``, line feed, text, ``</s>``, line feed. In roles and texts a backslash becomes
``\\e``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\k``; in roles a line feed becomes ``\\n``. So no control string
of any usual template survives in a text, and reading back is exact.

Null text or role: empty. Null id: one conversation. Turns that tie are ordered by role and text; repeated rows are
repeated turns. A JSON text that fits no mapping, or null: no turns. An empty table gives an empty result. Other
columns don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``paths`` name the layout; either ``turns`` lists (role, field) pairs, or ``items`` names an array of which ``role`` and ``text`` are fields."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""


#: The known layouts.
LAYOUTS = (
    Layout(("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("messages", "messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Layout(("conversations", "conversations[].from", "conversations[].value"), items="conversations", role="from", text="value"),
    Layout(("turns", "turns[].role", "turns[].text"), items="turns", role="role", text="text"),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(payload: Column) -> Column:
    """The sorted paths of a JSON text that any layout knows: its fields, and the fields of all items of its arrays."""
    none = F.array().cast("array<string>")
    items = sorted({x.items for x in LAYOUTS if x.items})
    parsed = F.from_json(payload, ", ".join(f"`{x}` array<string>" for x in items))

    def of_items(name: str) -> Column:
        keys = F.transform(parsed[name], lambda item: F.coalesce(F.json_object_keys(item), none))
        return F.transform(F.array_distinct(F.flatten(F.coalesce(keys, F.array(none)))), lambda k: F.concat(F.lit(f"{name}[]."), k))

    known = F.array(*(F.lit(x) for x in sorted({p for x in LAYOUTS for p in x.paths})))
    top = F.coalesce(F.json_object_keys(payload), none)
    return F.array_sort(F.array_intersect(F.concat(top, *map(of_items, items)), known))


def _named(role: Column, names: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    for other, name in names.items():
        role = F.when(role == other, F.lit(name)).otherwise(role)
    return role


def _turns(items: Column, layout: Layout, names: dict[str, str]) -> Column:
    return F.transform(items, lambda m: F.struct(_named(m[layout.role], names).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))


def canonical(df: DataFrame, payload: str = "payload", names: dict[str, str] = ROLES) -> DataFrame:
    """``df`` with ``fingerprint`` and ``turns`` of the JSON texts in ``payload``; ``names`` maps other names of roles."""
    text = F.col(payload)
    sign = F.sha2(F.array_join(field_paths(text), "\n").cast("binary"), 256)
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        if layout.items:
            parsed = F.from_json(text, f"`{layout.items}` array<struct<`{layout.role}`:string,`{layout.text}`:string>>")[layout.items]
            made = _turns(parsed, layout, names)
        else:
            parsed = F.from_json(text, ", ".join(f"`{f}` string" for _, f in layout.turns))
            made = F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(parsed[f], F.lit("")).alias("text")) for r, f in layout.turns))
        turns = F.when(sign == fingerprint(layout.paths), made).otherwise(turns)
    return df.withColumns({"fingerprint": sign, "turns": F.coalesce(turns, F.array().cast(TURNS))})


#: Tables with one turn in a row: the fingerprint of (order, role, text) columns selects the columns to gather.
ROW_LAYOUTS = {fingerprint(x): x for x in (("turn", "role", "text"), ("turn", "role", "content"), ("position", "from", "value"))}


def from_rows(df: DataFrame, key: str) -> DataFrame:
    """``key``, ``fingerprint`` and ``turns`` of a table with one turn in a row.

    The columns' fingerprint selects which are order, role and text. Each conversation is gathered in one row, which
    its result needs anyway, as a nested record that then goes the way of all records.
    """
    known = {c for x in ROW_LAYOUTS.values() for c in x}
    columns = ROW_LAYOUTS.get(fingerprint([c for c in df.columns if c in known]))
    if columns is None:
        raise ValueError(f"no layout has the columns {sorted(set(df.columns) & known)}")
    order, role, text = columns
    row = F.struct(F.col(order).alias("at"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    items = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    records = gathered.select(key, F.to_json(F.struct(items.alias("turns"))).alias("__record"))
    return canonical(records, "__record", names={}).drop("__record")


def escaped(text: Column) -> Column:
    for raw, code in (("\\", "\\e"), ("<", "\\l"), ("[", "\\k")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in (("<", "\\l"), ("[", "\\k"), ("\\", "\\e")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def formatted(df: DataFrame, turns: str = "turns", learned: str = "assistant") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans`` (start from 1, length, both in code points)."""
    pieces = F.transform(turns, lambda t: F.struct((t["role"] == learned).alias("learned"), F.concat(F.lit("<s>["), _role(t["role"]), F.lit("]\n")).alias("head"), escaped(t["text"]).alias("body")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        body = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(body.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((body + F.length(p["body"]) + F.lit(5)).alias("at"), F.when(p["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return df.withColumn("__pieces", pieces).withColumns({"formatted": F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit("</s>\n"))), ""), "loss_spans": F.aggregate("__pieces", start, add, lambda acc: acc["spans"])}).drop("__pieces")


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    units = F.filter(F.split(text, "</s>\n", -1), lambda u: u != "")

    def turn(unit: Column) -> Column:
        split = F.instr(unit, "]\n")
        head = F.replace(F.substring(unit, F.lit(5), split - 5), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescaped(head).alias("role"), unescaped(F.substring(unit, split + 2, F.length(unit))).alias("text"))

    return F.transform(units, turn)


def unmasked(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"], s["length"]))), "")


def digests(df: DataFrame, key: str) -> DataFrame:
    """The figures of formatted conversations, all read back from the output."""
    turns = parsed(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unmasked(F.col("formatted"), F.col("loss_spans"))
    return df.select(key, F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The registered query in DuckDB's SQL.
SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\k') as body, replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\k'), chr(10), '\n') as head from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(head) + length(body) + 11)::bigint as formatted_chars
from e group by conv_id
"""
