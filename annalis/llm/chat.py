"""Chat formatting with DataFrame functions only.

A template says how a turn is written and which roles are learned; a machine over roles
checks the order of turns. Control characters inside roles and texts are escaped, so that
the written conversation can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is open + role + between + text + close. Texts of ``learned`` roles carry the loss.

    ``escapes`` maps control characters to a letter behind a backslash; every marker must
    contain one of them, and ``between`` must hold a colon.
    """

    open: str = "### "
    between: str = ": "
    close: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    escapes: dict[str, str] = field(default_factory=lambda: {"#": "h", "<": "l"})
    start: str = "start"
    #: (state, role) -> state; a pair that is missing is a violation
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})


def escape(text: Column, template: Template, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in [*template.escapes.items(), *([(":", "c")] if role else [])]:
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def unescape(text: Column, template: Template) -> Column:
    def part(piece: Column) -> Column:
        for char, letter in [*template.escapes.items(), (":", "c")]:
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(char))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): segments, formatted, first_violation.

    ``segments`` are (text, loss) in order, and ``formatted`` is their texts joined.
    ``first_violation`` is the 0-based turn that the machine does not allow, or null.
    A conversation becomes one training text, so that its turns meet in one row. Turns are
    ordered by turn, role and text, null turns first; repeated turns stay. Null texts and
    null roles count as empty. A null conv_id is a conversation. Other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), t["role"]))
        return F.struct(F.coalesce(to, t["role"]).alias("state"),
                        F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"), (acc["at"] + 1).alias("at"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(t["role"], template, True), F.lit(template.between))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.learned).alias("loss")),
                       F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")))

    out = chats.select("conv_id", F.aggregate("turns", first, step)["bad"].alias("first_violation"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "first_violation")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, template.close.replace("/", "\\/"), -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(body: Column) -> Column:
        two = F.split(F.substring(body, len(template.open) + 1, 2147483647), template.between, 2)
        return F.struct(unescape(two[0], template).alias("role"), unescape(two[1], template).alias("text"))

    return F.transform(bodies, turn)


def learned_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss flags, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
