"""Chat formatting: a finite-state machine over roles checks the turn order, a declarative template writes the segments.

Native: DataFrame functions only. A conversation becomes one row, so the unit of work is one conversation; nothing is
gathered across conversations, and no key is shared between them.

Order of turns: by turn, null turns last, then by role and text, so ties and repeated rows have one order. A null role
or text is empty; a role without markers of its own is written by name. Rows with a null conv_id form one conversation.
Texts are written whole, whatever their length; a
conversation is one row, so it has to fit a task. Columns beyond conv_id, turn, role and text are not read, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Markers:
    """What stands before and after a role's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers by role, those of any other role, and the machine: state -> role -> next state.

    A marker without its outer white space is a control string. Where a text holds one, a backslash is put behind its
    first character; backslashes of the text are doubled before. Reading drops the first backslash of each pair of
    characters again, so every text comes back, and no text can forge a turn.
    """

    roles: dict[str, Markers]
    other_before: str = "[ROLE]"
    other_between: str = "[/ROLE]"
    other_after: str = "[/TURN]\n"
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=dict)
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = self.controls()
        whole = [m for r in self.roles.values() for m in (r.before, r.after)] + [self.other_before, self.other_between, self.other_after]
        for a in controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a marker needs two characters and no backslash: {a!r}")
            for b in [*controls, *whole]:
                if any(a[k:].startswith(b) or b.startswith(a[k:]) for k in range(1, len(a))):
                    raise ValueError(f"marker {b!r} overlaps the end of {a!r}")

    def controls(self) -> list[str]:
        found = {m.strip() for r in self.roles.values() for m in (r.before, r.after)}
        found |= {self.other_before.strip(), self.other_between.strip(), self.other_after.strip()}
        return sorted(found, key=lambda x: (-len(x), x))

    def escape(self, text: Column) -> Column:
        pattern = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in self.controls())
        return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), pattern, r"\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


CHAT = Template(
    roles={
        "system": Markers("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Markers("[INST] ", " [/INST]\n"),
        "assistant": Markers("<s> ", " </s>\n", loss=True),
    },
    moves={
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
)


def _walk(roles: Column, template: Template) -> Column:
    """The machine's run: the state it ends in, how many turns it took, and the first turn (from 0) it refused or -1."""

    def step(at: Column, role: Column) -> Column:
        state = F.lit(None).cast("string")
        for name, moves in template.moves.items():
            for on, to in moves.items():
                state = F.when((at["state"] == name) & (role == on), F.lit(to)).otherwise(state)
        refused = state.isNull() & (at["refused"] < 0)
        return F.struct(
            F.coalesce(state, at["state"]).alias("state"),
            (at["turns"] + 1).alias("turns"),
            F.when(refused, at["turns"]).otherwise(at["refused"]).alias("refused"),
        )

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("turns"), F.lit(-1).alias("refused"))
    return F.aggregate(roles, begin, step)


def _segments(turn: Column, template: Template) -> Column:
    """A turn's three segments: what stands before its text, the escaped text, and what follows."""
    before = F.concat(F.lit(template.other_before), template.escape(turn["role"]), F.lit(template.other_between))
    after, loss = F.lit(template.other_after), F.lit(False)
    for role, m in template.roles.items():
        here = turn["role"] == role
        before = F.when(here, F.lit(m.before)).otherwise(before)
        after = F.when(here, F.lit(m.after)).otherwise(after)
        loss = F.when(here, F.lit(m.loss)).otherwise(loss)
    segment = lambda text, counts: F.struct(text.alias("text"), counts.alias("loss"))
    return F.array(segment(before, F.lit(False)), segment(template.escape(turn["text"]), loss), segment(after, F.lit(False)))


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, valid and refused_turn.

    valid says whether the machine took every turn and ended in a final state; refused_turn is the first turn, counted
    from 0, that it refused, else null. A conversation that isn't valid is formatted all the same.
    """
    said = F.struct(
        F.col("turn").isNull().alias("unplaced"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = turns.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    ran = whole.withColumn("ran", _walk(F.transform("said", lambda t: t["role"]), template))
    parts = ran.withColumn("segments", F.flatten(F.transform("said", lambda t: _segments(t, template))))
    return parts.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ((F.col("ran.refused") < 0) & F.col("ran.state").isin(*template.final)).alias("valid"),
        F.when(F.col("ran.refused") >= 0, F.col("ran.refused")).alias("refused_turn"),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation, as an array of (role, text): the inverse of the template."""
    kinds = [f"{re.escape(m.before)}.*?{re.escape(m.after)}" for m in template.roles.values()]
    kinds.append(f"{re.escape(template.other_before)}.*?{re.escape(template.other_between)}.*?{re.escape(template.other_after)}")
    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{'|'.join(kinds)})"), F.lit(0))

    def read(piece: Column) -> Column:
        name = F.substring_index(piece, template.other_between, 1)
        role = template.unescape(F.substring(name, len(template.other_before) + 1, 2**31 - 1))
        begin, end = F.length(name) + len(template.other_between), F.lit(len(template.other_after))
        for own, m in template.roles.items():
            here = piece.startswith(m.before)
            role = F.when(here, F.lit(own)).otherwise(role)
            begin = F.when(here, F.lit(len(m.before))).otherwise(begin)
            end = F.when(here, F.lit(len(m.after))).otherwise(end)
        text = F.substring(piece, begin + 1, F.length(piece) - begin - end)
        return F.struct(role.alias("role"), template.unescape(text).alias("text"))

    return F.transform(pieces, read)


def read_loss(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
