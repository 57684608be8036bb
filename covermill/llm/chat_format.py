"""Chat formatting with DataFrame operations only: heterogeneous records become canonical turns, then text.

A record is a VARIANT value. The nested paths of its fields, without their types and without fields that a
layout doesn't know, are hashed; the hash selects one of the declared layouts, which says where turns, roles and texts lie. Turns are
written with a template whose control strings are escaped inside roles and texts, so that the
formatted text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in public use give a meaning to; escaped inside texts.
CONTROL = [TURN_OPEN, TURN_CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: The role whose texts are learned from.
LEARNED = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where a kind of record holds its turns.

    ``fields`` are the top-level fields that every such record has. Either ``items`` is the one that is an
    array, whose elements have a ``role`` and a ``text`` field, or ``turns`` lists (role, paths of texts
    that are joined by a line feed) in order; a turn whose texts are all missing or empty is left out
    if it is marked optional.
    """

    fields: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


#: Record layouts of public instruction data.
LAYOUTS = {
    "turn_row": Layout("role text turn", role="role", text="text"),
    "messages": Layout("messages", "messages"),
    "conversations": Layout("conversations", "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    "instruction_input": Layout("input instruction output", turns=(("user", ("instruction", "input"), False), ("assistant", ("output",), False))),
    "instruction": Layout("instruction output", turns=(("user", ("instruction",), False), ("assistant", ("output",), False))),
    "prompt_completion": Layout("completion prompt", turns=(("user", ("prompt",), False), ("assistant", ("completion",), False))),
    "prompt_response": Layout("prompt response", turns=(("user", ("prompt",), False), ("assistant", ("response",), False))),
    "system_prompt_response": Layout("prompt response system", turns=(("system", ("system",), True), ("user", ("prompt",), False), ("assistant", ("response",), False))),
}

_TURNS = "array<struct<role: string, text: string>>"


def layout_paths(layout: Layout) -> list[str]:
    """The nested field paths of a layout, in order of their names."""
    if layout.items is None:
        return sorted(layout.fields.split())
    return sorted([f"{layout.items}[]", *(f"{layout.items}[].{c}" for c in (layout.role, layout.text))])


def known_paths(record: Column) -> Column:
    """Those field paths of a VARIANT that some layout knows, in order; nulls count as there, types don't matter."""

    def held(path: str) -> Column:
        items, array, inner = path.partition("[]")
        if not array:
            return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()
        listed = F.try_variant_get(record, f"$.{items}", "array<variant>")
        if not inner:
            return listed.isNotNull()
        return F.exists(listed, lambda x: F.try_variant_get(x, f"${inner}", "variant").isNotNull())

    known = sorted({p for layout in LAYOUTS.values() for p in layout_paths(layout)})
    return F.array_compact(F.array(*[F.when(held(p), F.lit(p)) for p in known]))


def fingerprint(paths: Column) -> Column:
    """A hash of nested field paths."""
    return F.xxhash64(paths)


def layout_of(record: Column) -> Column:
    """The layout whose field paths a record has: the one with the most, and of those the first declared; null if there is none.

    Fields that the layout doesn't know don't matter. An empty array of turns has the layout of its name.
    """
    by_size = sorted(LAYOUTS, key=lambda name: -len(layout_paths(LAYOUTS[name])))

    def chosen(paths: Column) -> Column:
        literal = lambda names: F.array(*[F.lit(p) for p in names])
        out = F.lit(None).cast("string")
        for name in [x for x in by_size if LAYOUTS[x].items]:
            empty = literal([f"{LAYOUTS[name].items}[]"])
            bare = F.size(F.try_variant_get(record, f"$.{LAYOUTS[name].items}", "array<variant>")) == 0
            out = F.when(bare & (fingerprint(F.array_intersect(paths, literal(layout_paths(LAYOUTS[name])))) == fingerprint(empty)), name).otherwise(out)
        for name in reversed(by_size):
            own = literal(layout_paths(LAYOUTS[name]))
            out = F.when(fingerprint(F.array_intersect(paths, own)) == fingerprint(own), name).otherwise(out)
        return out

    # the paths are bound once and used by every layout
    return F.element_at(F.transform(F.array(known_paths(record)), chosen), 1)


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _canonical(record: Column, layout: Layout) -> Column:
    """The turns of a record of one layout: an array of (role, text)."""

    def turn(role: Column, text: Column) -> Column:
        for theirs, ours in layout.roles.items():
            role = F.when(role == theirs, ours).otherwise(role)
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.items:
        items = F.try_variant_get(record, f"$.{layout.items}", "array<variant>")
        return F.transform(items, lambda x: turn(_text(x, layout.role), _text(x, layout.text)))
    if not layout.turns:
        return F.array(turn(_text(record, layout.role), _text(record, layout.text)))
    turns = []
    for role, paths, optional in layout.turns:
        text = F.array_join(F.filter(F.array(*[_text(record, p) for p in paths]), lambda x: x.isNotNull() & (x != "")), "\n")
        one = F.array(turn(F.lit(role), text))
        turns.append(F.when(text != "", one).otherwise(F.array().cast(_TURNS)) if optional else one)
    return F.concat(*turns)


def canonical_turns(df: DataFrame, record: str = "record", turns: str = "turns") -> DataFrame:
    """Adds ``layout`` and the canonical turns, an array of (role, text), of each VARIANT record.

    A null record or one of no declared layout has null for both; null roles and texts are empty. All
    other columns and all rows are kept.
    """
    value = F.col(record)
    df = df.withColumn("layout", layout_of(value))
    out = F.lit(None).cast(_TURNS)
    for name, layout in LAYOUTS.items():
        out = F.when(F.col("layout") == name, _canonical(value, layout)).otherwise(out)
    return df.withColumn(turns, out)


# --- template ------------------------------------------------------------------------------------------


def control_pattern(backslashes: str = r"(\\*)") -> str:
    """Matches a control string, with any number of backslashes after its first character."""
    tails = sorted((x[1:] for x in CONTROL), key=len, reverse=True)
    quoted = "|".join("".join(c if c.isalnum() or c in "_<>" else "\\" + c for c in x) for x in tails)
    return rf"([<\[]){backslashes}({quoted})"


def escape(text: Column) -> Column:
    """Puts a backslash after the first character of each control string, one more where some already stand."""
    return F.regexp_replace(text, control_pattern(), r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Takes one backslash away again; the exact inverse of ``escape``."""
    return F.regexp_replace(text, control_pattern(r"\\(\\*)"), "$1$2$3")


def _escape_role(role: Column) -> Column:
    # a role ends at its line feed, so its own line feeds and backslashes are written out
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a line feed is an odd number of backslashes before an n
    return F.replace(F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), F.lit("\\\\"), F.lit("\\"))


def format_records(rows: DataFrame, record: str = "record", key: str = "conv_id", order: str | None = None) -> DataFrame:
    """One row per ``key`` of a table of VARIANT records of any declared layouts, mixed at will.

    ``formatted`` is the template's text and ``loss_mask`` an array with one (chars, skip, take) per turn:
    the turn's code points, and which of them are learned from (an assistant's escaped text).

    Records of one key follow each other by ``order``, nulls first, and by their formatted turns if that ties or
    isn't given; repeated rows repeat. Each is formatted where it lies; only finished pieces are gathered. A null record or one of no layout adds no turn, and a key of
    such records only has an empty text. Null roles and texts are empty; rows with a null key are one
    conversation. An empty table gives no row; other columns are ignored. The text of a conversation
    is one value, so one conversation has to fit into a row.
    """
    at = F.lit(None).cast("long") if order is None else F.col(order)
    turns = canonical_turns(rows.select(F.col(key).alias("key"), at.alias("at"), F.col(record).alias("record")))

    def written(t: Column) -> Column:
        before = F.concat(F.lit(TURN_OPEN), _escape_role(t["role"]), F.lit("\n"))
        return F.struct((t["role"] == LEARNED).alias("learned"), before.alias("before"), escape(t["text"]).alias("body"))

    def finished(w: Column) -> Column:
        piece = F.concat(w["before"], w["body"], F.lit(TURN_CLOSE + "\n"))
        mask = F.struct(
            F.length(piece).alias("chars"),
            F.when(w["learned"], F.length(w["before"])).otherwise(F.length(piece)).alias("skip"),
            F.when(w["learned"], F.length(w["body"])).otherwise(0).alias("take"),
        )
        return F.struct(piece.alias("piece"), mask.alias("mask"))

    pieces = F.transform(F.transform(F.coalesce("turns", F.array().cast(_TURNS)), written), finished)
    gathered = turns.select("key", "at", pieces.alias("pieces")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "pieces"))).alias("records"))
    gathered = gathered.select("key", F.flatten("records.pieces").alias("p"))
    return gathered.select(F.col("key").alias(key), F.array_join("p.piece", "").alias("formatted"), F.col("p.mask").alias("loss_mask"))


def format_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``format_records`` of a table by turn (``key``, ``turn``, ``role``, ``text``): each row is a record, in order of ``turn``."""
    record = F.to_variant_object(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").cast("long").alias("turn")))
    return format_records(rows.select(F.col(key).alias("key"), F.col("turn").cast("long").alias("at"), record.alias("record")), "record", "key", "at").withColumnRenamed("key", key)


def read_turns(formatted: str = "formatted", loss_mask: str = "loss_mask") -> tuple[Column, Column]:
    """The turns of a formatted text, an array of (role, text), and the learned text, both unescaped."""
    # a control string never stands unescaped in a turn, so each opening begins a turn
    opened = F.split(F.col(formatted), r"<\|im_start\|>", -1)
    pieces = F.slice(opened, F.lit(2), F.size(opened))
    role_end = lambda x: F.instr(x, "\n")
    text = lambda x: F.substring(x, role_end(x) + 1, F.length(x) - role_end(x) - len(TURN_CLOSE) - 1)
    turns = F.transform(pieces, lambda x: F.struct(_unescape_role(F.substring(x, F.lit(1), role_end(x) - 1)).alias("role"), unescape(text(x)).alias("text")))
    learned = F.zip_with(pieces, F.col(loss_mask), lambda x, m: unescape(F.substring(x, m["skip"] - len(TURN_OPEN) + 1, m["take"])))
    return turns, F.array_join(learned, "")
