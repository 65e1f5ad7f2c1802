"""Chat formatting by a declarative template, in DataFrame functions only.

A finite-state machine over the roles says whether turns come in a valid order;
the conversation is formatted either way and the verdict is a column. The
output is a list of text segments, each with a loss flag; joined, they are the
formatted conversation. Control strings inside roles and texts are broken by a
backslash after their first character (and backslashes doubled), so that a
text can never pass for a mark, and unescape() gives the text back.

Defined cases: a null text or role counts as empty; turns with the same number
are ordered by role, then text, and repeated rows are turns of their own; a
null turn number comes last; each row with a null conversation id is a
conversation of its own, as nothing joins such rows; very long texts are taken whole;
only the named columns are read, so others may have any name; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, further control strings to escape, the roles that are learnt, and the machine: (state, role) to the next state."""

    turn_open: str = "<|start|>"
    turn_text: str = "<|text|>"
    turn_close: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
    learnt: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escape(text: Column, template: Template) -> Column:
    marks = [template.turn_open, template.turn_text, template.turn_close, *template.controls]
    pattern = "|".join(f"{_quoted(m[0])}(?={_quoted(m[1:])})" for m in dict.fromkeys(marks))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def order_state(roles: Column, template: Template) -> Column:
    """The state after all roles; 'error' once there is no move, and for good."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)))
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("error")))


def format_chats(rows: DataFrame, template: Template | None = None, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(id, n_turns, order_valid, segments array<struct<text, loss>>, formatted)."""
    t = template or Template()
    empty = F.lit("")
    turn = F.struct(F.col(turn_column).isNull().alias("late"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), empty).alias("role"), F.coalesce(F.col(text_column), empty).alias("text"))
    alone = F.when(F.col(id_column).isNull(), F.monotonically_increasing_id()).alias("alone")
    grouped = rows.groupBy(F.col(id_column).alias("key"), alone).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        said = reduce(lambda a, b: a | b, [x["role"] == F.lit(r) for r in t.learnt])
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(t.turn_open), escape(x["role"], t), F.lit(t.turn_text)), F.lit(False)),
            piece(escape(x["text"], t), said),
            piece(F.lit(t.turn_close), F.lit(False)),
        )

    made = grouped.select(
        "key",
        F.size("turns").cast("long").alias("n_turns"),
        order_state(F.transform("turns", lambda x: x["role"]), t).isin(*t.accepting).alias("order_valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumnRenamed("key", id_column)


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    t = template or Template()
    parts = F.split(formatted, _quoted(t.turn_open))
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, t.turn_text, 1)
        at = F.length(role) + len(t.turn_text)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(part, at + 1, F.length(part) - at - len(t.turn_close))).alias("text"))

    return F.transform(parts, turn)


def read_learnt(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
