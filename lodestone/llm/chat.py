"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON text. Its nested field paths, those that some layout reads, are sorted and hashed; the hash selects a
declared layout, or, for a mixture, the most specific layout whose paths the record holds; its mapping turns the record into
canonical turns (turn number, role, text). Layouts are data:
``LAYOUTS`` maps required paths to where role and text stand. The template wraps every turn in control strings and
escapes those inside texts, so the output can be read back exactly; ``read_back`` does, and gives the loss mask as spans.

Null text or role counts as empty. Records of an unknown layout, of broken JSON or null keep a row with no turns and layout
null. Turns with equal numbers are ordered by role and text; repeated rows are repeated turns. An empty table gives no rows.
Fields the layout does not read are ignored, whatever their names. A conversation is one output text, so it is the unit of a task.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import unused

OPEN, CLOSE, LEARNT = "### ", "</turn>\n", "assistant"
# Control strings, each with its escape. The escape character comes first.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


class Layout(NamedTuple):
    """``paths`` a record must have; ``rows``: array of messages with its role and text fields; ``fields``: (role, path) in order."""
    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = {
    "messages": Layout(("messages", "messages[].content", "messages[].role"), rows=("messages", "role", "content")),
    "exchange": Layout(("conversations", "conversations[].from", "conversations[].value"), rows=("conversations", "from", "value")),
    "instruction": Layout(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    "instruction with input": Layout(("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    "system instruction": Layout(("instruction", "output", "system"), fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    "system instruction with input": Layout(("input", "instruction", "output", "system"), fields=(
        ("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    "system completion": Layout(("completion", "prompt", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    "system response": Layout(("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "completion": Layout(("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    "response": Layout(("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    "preference": Layout(("chosen", "prompt", "rejected"), fields=(("user", "prompt"), ("assistant", "chosen"))),
    "question": Layout(("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    "turn": Layout(("role", "text", "turn")),
}
KNOWN_PATHS = sorted({p for layout in LAYOUTS.values() for p in layout.paths})
LISTS = sorted({layout.rows[0] for layout in LAYOUTS.values() if layout.rows})


def path_hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def known_paths(record: Column) -> Column:
    """The record's nested field paths that layouts read, message fields over all messages. Fields with null values count as present."""
    none = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(record), none)

    def nested(name: str) -> Column:
        items = F.from_json(F.get_json_object(record, f"$.{name}"), "array<map<string,string>>")
        keys = F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), none)))
        return F.transform(F.coalesce(keys, none), lambda key: F.concat(F.lit(f"{name}[]."), key))

    return F.array_intersect(F.concat(top, *[nested(name) for name in LISTS]), F.array(*[F.lit(p) for p in KNOWN_PATHS]))


def layout_of(record: Column) -> Column:
    """Name of the layout a record has, or null.

    The hash of its paths names the layout at once where it has just the paths of one; else it is the layout with the most
    paths among those the record holds in full, the first of equal ones.
    """
    def chosen(present: Column) -> Column:
        mark = path_hash(present)
        required = {name: F.array(*[F.lit(p) for p in layout.paths]) for name, layout in LAYOUTS.items()}
        exact = reduce(lambda got, item: got.when(mark == path_hash(item[1]), item[0]), required.items(), F.when(F.lit(False), F.lit("")))
        by_size = sorted(required, key=lambda name: -len(LAYOUTS[name].paths))
        return reduce(lambda got, name: got.when(F.size(F.array_except(required[name], present)) == 0, name), by_size, exact)

    return F.element_at(F.transform(F.array(known_paths(record)), chosen), 1)


def _role(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(name)), name, F.lit(""))


def canonical_turns(record: Column, layout: Column) -> Column:
    """array<struct(turn, role, text)> of a record under its layout."""
    def turn(number: Column, role: Column, text: Column) -> Column:
        return F.struct(number.cast("bigint").alias("turn"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def of(plan: Layout) -> Column:
        if plan.rows:
            name, role, text = plan.rows
            items = F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")
            return F.transform(items, lambda m, i: turn(i, _role(m[role]), m[text]))
        if plan.fields:
            parts = [turn(F.lit(i), F.lit(role), F.get_json_object(record, f"$.{path}")) for i, (role, path) in enumerate(plan.fields)]
            return F.array(*parts)
        one = F.from_json(record, "turn bigint, role string, text string")
        return F.array(turn(one["turn"], F.coalesce(one["role"], F.lit("")), one["text"]))

    none = F.array().cast(TURNS)
    chosen = reduce(lambda got, item: got.when(layout == item[0], of(item[1])), LAYOUTS.items(), F.when(layout.isNull(), none))
    return F.coalesce(chosen.otherwise(none), none)


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    """Every escape stands behind a backslash that no text can hold alone, so plain replacement restores the text."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def formatted(turns: Column) -> Column:
    """The conversation as one text: control string, role, line end, text, closing control string, for every turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(OPEN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE))), "")


def read_back(conversations: DataFrame, column: str = "formatted", turns_column: str = "back") -> DataFrame:
    """``conversations`` with array<struct(role, text, start, length, learnt)> read from the formatted ``column``. ``start``
    and ``length`` span the escaped text in code points of the conversation; ``learnt`` spans are the loss mask.

    A turn is read from its own part alone; where parts begin is one running sum, so work follows the length.
    """
    def turn(part: Column) -> Column:
        head = F.length(F.substring_index(part, "\n", 1)) + 1
        role = unescaped(F.replace(F.substring(F.substring_index(part, "\n", 1), F.lit(len(OPEN) + 1), F.length(part)), F.lit("\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substring(part, head + 1, F.length(part))).alias("text"), head.alias("head"), F.length(part).alias("size"))

    def place(t: Column, begin: Column) -> Column:
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), (begin + t["head"]).alias("start"), (t["size"] - t["head"]).alias("length"),
                        (t["role"] == LEARNT).alias("learnt"))

    parts, begins = unused(conversations, "parts"), unused(conversations, "begins")
    split = F.split(F.col(f"`{column}`"), "</turn>\n", -1)
    read = conversations.withColumn(parts, F.transform(F.slice(split, F.lit(1), F.size(split) - 1), turn))
    read = read.withColumn(begins, F.aggregate(parts, F.array(F.lit(0)), lambda done, t: F.array_append(
        done, F.element_at(done, -1) + t["size"] + len(CLOSE))))
    return read.withColumn(turns_column, F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), place)).drop(parts, begins)


def format_records(records: DataFrame, id_column: str = "conv_id", record_column: str = "record") -> DataFrame:
    """(conv_id, layouts, formatted) per conversation; records of one id are put together in turn order.

    ``records`` holds one JSON text per row, a whole conversation or one turn of it.
    """
    rows = records.select(records[f"`{id_column}`"].alias("conv_id"), records[f"`{record_column}`"].alias("record"))
    rows = rows.withColumn("layout", layout_of(F.col("record")))
    rows = rows.select("conv_id", "layout", canonical_turns(F.col("record"), F.col("layout")).alias("turns"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("layout")).alias("layouts"), F.array_sort(F.flatten(F.collect_list("turns"))).alias("turns"))
    return whole.select("conv_id", "layouts", formatted(F.col("turns")).alias("formatted"))


def turn_records(rows: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Tables with one row per turn as records."""
    as_json = F.to_json(F.struct(*[rows[f"`{c}`"].alias(name) for c, name in ((turn, "turn"), (role, "role"), (text, "text"))]), {"ignoreNullFields": "false"})
    return rows.select(rows[f"`{id_column}`"].alias("conv_id"), as_json.alias("record"))
