"""Chat formatting in DataFrame functions only.

A declarative template names the markers, the roles that bear loss and the transitions of a finite-state machine over roles.
Control strings inside texts and roles are escaped so that the output can be read back:
a backslash is doubled, then ``<|`` becomes ``<\\|`` and, in roles, a line feed becomes ``<\\n``. After that no marker can occur in a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first_state: str = "begin"
    final_states: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; what is not listed is an error.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system", ("begin", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Format each conversation: conv_id, formatted, segments (text, loss), valid, bad_turn.

    Turns stand by turn number, then role and text, nulls first; null roles and texts count as empty; rows that repeat are turns that
    repeat; a null conv_id is one conversation. The machine reads the roles in order: ``bad_turn`` is the first turn (from 0) it
    doesn't accept, ``valid`` says that there is none and that the conversation ends in a final state. Conversations that aren't valid
    are formatted all the same. An empty table gives no rows.
    """
    t = template or ChatTemplate()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("_turn"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    step = lambda at, role: F.coalesce(F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role)), F.lit("error"))
    run = F.aggregate(
        F.transform("_turns", lambda x: x["role"]),
        F.struct(F.lit(t.first_state).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda at, role: F.struct(step(at, role).alias("state"), (at["n"] + 1).alias("n"), F.coalesce(at["bad"], F.when(step(at, role) == "error", at["n"])).alias("bad")),
    )
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "_turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.start), escape_role(x["role"]), F.lit(t.after_role)), F.lit(False)),
                segment(escape(x["text"]), x["role"].isin(list(t.loss_roles))),
                segment(F.lit(t.end), F.lit(False)),
            ),
        )
    )
    out = chats.select("conv_id", segments.alias("segments"), run.alias("_run"))
    valid = F.col("_run.bad").isNull() & F.col("_run.state").isin(list(t.final_states))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", valid.alias("valid"), F.col("_run.bad").alias("bad_turn"))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The turns (role, text) and the loss text of each formatted conversation, read from ``formatted`` and ``segments`` alone."""
    t = template or ChatTemplate()
    bodies = F.filter(F.split("formatted", "\\Q" + t.end + "\\E", -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(t.start) + 1), F.char_length(x))
        at = F.instr(body, F.lit(t.after_role))
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + len(t.after_role), F.char_length(body))).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("*", F.transform(bodies, turn).alias("turns"), loss.alias("loss_text"))
