"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template is data: for each role the strings that open and close its turn and whether its text is learned. Formatting a
conversation gives segments (text, loss), three a turn; the formatted text is all of them in order, so the loss mask is
the segments whose flag is set. The machine is data too: for each state the roles that may follow and the state that
they lead to. A conversation in a wrong order is formatted all the same, since what to do with it is the caller's choice:
``valid`` says whether the order is legal, ``complete`` whether it ends in an accepting state, ``wrong_turn`` where it
first breaks.

Every mark starts with ``[`` or ``<`` or has one of them after white space. Inside texts and names of roles these two, ``]``
and the backslash are written as two characters each, so no text can hold, begin or end a mark, whatever is put beside
it, and the formatted text reads back to the same turns. All of it is DataFrame functions: marks and flags are chosen row by
row before the one shuffle, which brings a conversation's turns together. A conversation is one row of the result, as a
document is elsewhere, so it has to fit in memory; turns combine on the map side, and how many conversations there are,
or how alike they are, doesn't matter.

Defined results: rows come in order of turn (nulls first), then role, then text; rows that repeat stay repeated; a null text
is empty, a null role the empty name; a role that the template doesn't know gets marks that hold its name, isn't learned,
and breaks the order; rows with a null conv_id are one conversation; an empty table gives no conversations; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may not stand in a text as it is, and what is written for it. The backslash comes first and is read back last.
ESCAPES = (("\\", "\\-"), ("[", "\\("), ("]", "\\)"), ("<", "\\{"))


@dataclass(frozen=True)
class Turn:
    """How the turns of one role are written."""

    role: str
    opening: str
    closing: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, and the machine: state -> role -> next state, from ``start`` to one of ``accepting``."""

    turns: tuple[Turn, ...]
    moves: dict[str, dict[str, str]]
    accepting: tuple[str, ...]
    start: str = "start"


INSTRUCT = Template(
    turns=(
        Turn("system", "<<SYS>>\n", "\n<</SYS>>\n"),
        Turn("user", "[INST] ", " [/INST]"),
        Turn("assistant", "<s>", "</s>", learned=True),
    ),
    moves={
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    accepting=("answered",),
)
#: Marks of roles that a template doesn't know; the name stands between the first two.
OTHER = ("[ROLE ", "]", "[/ROLE]")
#: The state after a role that may not come; no role leads out of it.
BROKEN = "broken"


def escaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _by_role(role: Column, template: Template, value, otherwise: Column) -> Column:
    return reduce(lambda c, t: c.when(role == t.role, F.lit(value(t))), template.turns, F.when(F.lit(False), otherwise)).otherwise(otherwise)


def turn_segments(role: Column, text: Column, template: Template = INSTRUCT) -> Column:
    """The three segments of a turn: opening, text, closing."""
    opening = _by_role(role, template, lambda t: t.opening, F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])))
    closing = _by_role(role, template, lambda t: t.closing, F.lit(OTHER[2]))
    learned = _by_role(role, template, lambda t: t.learned, F.lit(False))
    return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in ((opening, F.lit(False)), (escaped(text), learned), (closing, F.lit(False)))])


def walked(roles: Column, template: Template = INSTRUCT) -> Column:
    """What the machine says of an array of roles: its last state, and the position from 0 of the first role that may not come
    (null if all may)."""
    steps = F.create_map(*[F.lit(x) for state, out in template.moves.items() for role, to in out.items() for x in (f"{state}\n{role}", to)])
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("wrong"))

    def step(now: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(steps, F.concat(now["state"], F.lit("\n"), role)), F.lit(BROKEN))
        wrong = F.when(now["wrong"].isNull() & (to == BROKEN), now["at"]).otherwise(now["wrong"])
        return F.struct(to.alias("state"), (now["at"] + 1).alias("at"), wrong.alias("wrong"))

    return F.aggregate(roles, start, step)


def formatted_conversations(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, segments (text, loss), valid, complete, wrong_turn: one row a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", role.alias("role"), turn_segments(role, text, template).alias("segments")).alias("t"))
    together = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    seen = together.withColumn("walk", walked(F.col("turns.role"), template))
    return seen.select(
        "conv_id",
        F.flatten("turns.segments").alias("segments"),
        F.col("walk.wrong").isNull().alias("valid"),
        F.col("walk.state").isin(*template.accepting).alias("complete"),
        F.get(F.col("turns.turn"), F.col("walk.wrong")).alias("wrong_turn"),
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.filter(segments, lambda s: s["loss"])["text"], ""))


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text was made of, by its marks alone."""
    body = r"[^\[<]*"
    kinds = [(re.escape(t.opening), re.escape(t.closing)) for t in template.turns]
    kinds.append((re.escape(OTHER[0]) + body + re.escape(OTHER[1]), re.escape(OTHER[2])))
    chunks = F.regexp_extract_all(formatted, F.lit("|".join(f"{a}{body}{b}" for a, b in kinds)), F.lit(0))

    def turn(chunk: Column) -> Column:
        def between(opening: Column, closing: str) -> Column:
            return unescaped(F.substring(chunk, opening + 1, F.length(chunk) - opening - len(closing)))

        named = F.instr(chunk, OTHER[1])
        found = F.when(F.lit(False), F.struct(F.lit("").alias("role"), F.lit("").alias("text")))
        for t in template.turns:
            found = found.when(F.startswith(chunk, F.lit(t.opening)), F.struct(F.lit(t.role).alias("role"), between(F.lit(len(t.opening)), t.closing).alias("text")))
        name = unescaped(F.substring(chunk, F.lit(len(OTHER[0]) + 1), named - len(OTHER[0]) - 1))
        return found.otherwise(F.struct(name.alias("role"), between(named, OTHER[2]).alias("text")))

    return F.transform(chunks, turn)


def chat_digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, then valid, complete, wrong_turn; counts and
    digests are read back from the formatted text and its segments."""
    done = formatted_conversations(conversations, template).withColumns({"formatted": formatted_text(F.col("segments")), "learned": learned_text(F.col("segments"))})
    read = done.withColumn("turns", read_turns(F.col("formatted"), template))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
        "wrong_turn",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, numbered -1, of two turns whose texts hold control strings."""
    probe = conversations.sparkSession.createDataFrame([(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
