"""Chat formatting by a role automaton and a declarative template (DataFrame functions only)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What each role's turn looks like, which roles carry loss, and which turn may follow which.

    ``turns`` maps a role to the tag that opens and closes its turns; other
    roles get ``ROLE`` with their name. ``moves`` lists (state, role) -> state;
    a missing move is an error, which keeps its own state.
    """

    turns: dict[str, str] = field(default_factory=lambda: {"system": "SYS", "user": "INST", "assistant": "OUT"})
    loss: tuple[str, ...] = ("assistant",)
    start: str = "<s>"
    end: str = "</s>"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        tags = [*self.turns.values(), "ROLE"]
        return [self.start, self.end, *(f"[{t}]" for t in tags), *(f"[/{t}]" for t in tags)]


def _places(template: Template, between: str) -> str:
    """Matches behind a control string's first character what ``between`` does, if the rest follows."""
    tails: dict[str, list[str]] = {}
    for control in template.controls():
        tails.setdefault(control[0], []).append(re.escape(control[1:]))
    return "|".join(f"(?<=[{re.escape(c)}]){between}(?=\\\\*(?:{'|'.join(t)}))" for c, t in sorted(tails.items()))


def escape(text: Column, template: Template) -> Column:
    """Put a backslash behind the first character of every control string, however many it has already."""
    return F.regexp_replace(text, _places(template, ""), r"\\")


def unescape(text: Column, template: Template) -> Column:
    """Undo ``escape``: take one backslash out of every control string that has some."""
    return F.regexp_replace(text, _places(template, r"\\"), "")


def _by_role(role: Column, template: Template, other: Column, build: Callable[[Column], Column]) -> Column:
    out = None
    for name, tag in template.turns.items():
        out = F.when(role == name, build(F.lit(tag))) if out is None else out.when(role == name, build(F.lit(tag)))
    return out.otherwise(other)


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: its text, its segments and the automaton's verdict.

    Reads conv_id, turn, role, text; other columns are ignored. Rows are taken
    by turn, ties by role and text, null turns first; a null text is empty, a
    null role is the empty role. Returns conv_id, n_turns, segments (array of
    text, loss), formatted (the joined segments), valid (every move is allowed
    and the last state is final), bad_turn (0-based number of the first turn
    that is not allowed, else null). Invalid conversations are formatted too.
    A null conv_id is a conversation of its own; repeated rows are repeated
    turns; an empty table gives an empty result.
    """
    template = template or Template()
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    tag_open = lambda tag: F.concat(F.lit(f"{template.start}["), tag, F.lit("] "))
    tag_close = lambda tag: F.concat(F.lit(" [/"), tag, F.lit(f"]{template.end}\n"))
    other_open = F.concat(F.lit(f"{template.start}[ROLE] "), F.url_encode("role"), F.lit(" "))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        _by_role(F.col("role"), template, other_open, tag_open).alias("opening"),
        escape(F.col("text"), template).alias("body"),
        _by_role(F.col("role"), template, tag_close(F.lit("ROLE")), tag_close).alias("closing"),
        F.col("role").isin(*template.loss).alias("loss"),
    )
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "opening", "body", "closing", "loss"))).alias("turns")
    )
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}/{role}", to)))

    def step(at: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("/"), turn["role"]))
        return F.struct(
            F.coalesce(to, at["state"]).alias("state"),
            (at["seen"] + 1).alias("seen"),
            F.when(at["bad"].isNull() & to.isNull(), at["seen"]).otherwise(at["bad"]).alias("bad"),
        )

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("bad"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["opening"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                F.struct(t["closing"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    run = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), F.aggregate("turns", begin, step).alias("run"))
    return run.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("run.bad").isNull() & F.col("run.state").isin(*template.final)).alias("valid"),
        F.col("run.bad").cast("long").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The (role, text) turns of a formatted conversation, texts unescaped."""
    template = template or Template()
    tags = "|".join(re.escape(t) for t in [*template.turns.values(), "ROLE"])
    pieces = F.filter(F.split(formatted, re.escape(template.end) + "\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        tag = F.regexp_extract(piece, r"(?s)^" + re.escape(template.start) + rf"\[({tags})\] ", 1)
        inner = F.substring(piece, F.length(tag) + len(template.start) + 4, F.length(piece) - 2 * F.length(tag) - len(template.start) - 7)
        named = tag == "ROLE"
        role = F.when(named, F.url_decode(F.substring_index(inner, " ", 1)))
        for name, short in template.turns.items():
            role = role.when(tag == short, F.lit(name))
        body = F.when(named, F.substring(inner, F.length(F.substring_index(inner, " ", 1)) + 2, F.length(inner))).otherwise(inner)
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
