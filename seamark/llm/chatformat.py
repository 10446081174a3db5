"""Chat formatting: a finite-state machine over roles and a declarative template with a loss mask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import let, struct

END = "reject"


@dataclass(frozen=True)
class Template:
    """How a turn is written, and which orders of turns are well formed.

    Control strings begin with "<|"; inside texts and roles that sign is written "<\\|" (and "<\\|" as
    "<\\\\|", and so on), so they never hold a control string and can be read back.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accept: tuple[str, ...] = ("answered",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: backslashes and line feeds are written as two signs."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(text: Column) -> Column:
    plain = F.replace(unescape(text), F.lit("\\\\"), F.lit("\0\0"))     # one pass over pairs, through a pair that no role holds
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\0\0"), F.lit("\\"))


def _moved(template: Template, state: Column, role: Column) -> Column:
    out = None
    for (at, word), to in template.moves.items():
        here = (state == at) & (role == word)
        out = F.when(here, to) if out is None else out.when(here, to)
    return out.otherwise(END)


def segments(turns: Column, template: Template) -> Column:
    """Text segments of a conversation, each with its loss flag: only the texts of trained roles are learned."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        struct(text=F.concat(F.lit(template.begin), _role(t["role"]), F.lit("\n")), loss=F.lit(False)),
        struct(text=escape(t["text"]), loss=t["role"].isin(*template.trained)),
        struct(text=F.lit(template.end + "\n"), loss=F.lit(False)))))


def format_conversations(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: id, segments (text, loss), state, valid.

    A conversation is one training example and one row of the result, so its turns meet in one
    task; nothing larger than a conversation does.  Turns are ordered by their number, nulls first;
    equal numbers by role, then text.  Null roles and texts are empty.  Rows repeated are turns repeated.
    Conversations in an order that the machine rejects are formatted too, with valid = false.  Rows with a
    null id are one conversation.  An empty table gives an empty result; other columns are not read.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: _moved(template, s, t["role"]))
    return talks.select(F.col("conv").alias(conv_col), segments(F.col("turns"), template).alias("segments"), state.alias("state")).withColumn(
        "valid", F.col("state").isin(*template.accept))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) out of the formatted string alone."""
    begin, end = (s.replace("|", r"\|") for s in (template.begin, template.end))
    parts = F.split(formatted, begin, -1)
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: let(F.split(p, "\n", 2), lambda half: struct(
        role=_role_back(half[0]), text=unescape(F.split(half[1], end + "\n$", -1)[0]))))


def digest(formatted: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """Figures read back from the output: from the joined string for the turns, from the segments under the mask for the loss."""
    whole = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    back = whole.withColumn("turns", read_back(F.col("formatted"), template)).withColumn(
        "learned", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
