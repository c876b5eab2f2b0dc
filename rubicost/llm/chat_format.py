"""Chat formatting with DataFrame functions only.

A declarative template (``TEMPLATE``) names the marks around a turn, the roles
that carry loss and the finite-state machine that says which role may follow
which. ``format_conversations`` groups the rows of a conversation, orders them
by turn, runs the machine over the roles and emits text segments, each with a
loss flag: these are the output, ``formatted`` is their texts joined, and the loss
mask covers the segments with the flag. ``read_back`` recovers the turns from
the formatted text, ``loss_text`` the text under the mask from the segments.

Control strings inside texts are escaped reversibly: a backslash goes before
each backslash and before each ``|`` that follows ``<``; in roles also before
a line feed. No text or role can therefore contain ``<|``.

Defined results: a null text or role is the empty string; rows with one turn
number are ordered by role, then text; repeated rows stay; a null ``conv_id``
is a conversation of its own; a null turn sorts first; an empty table gives no
rows; other columns are ignored. A conversation is one output row, so its
turns meet in one task; its size is the bound there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "<|im_start|>",
    "after_role": "\n",
    "close": "<|im_end|>\n",
    "loss_roles": ["assistant"],
    "start": "start",
    "accept": ["assistant"],
    "next": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
}

INVALID = "invalid"


def escaped(text: Column, role: bool = False) -> Column:
    """Puts a backslash before what could be read as a control string."""
    return F.regexp_replace(text, r"(\\|(?<=<)\||\n)" if role else r"(\\|(?<=<)\|)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_state(roles: Column, template: dict = TEMPLATE) -> Column:
    """State after the machine has read an array of roles; ``invalid`` absorbs."""
    moves = F.create_map(*[F.lit(x) for s, to in template["next"].items() for r, t in to.items() for x in (f"{s}>{r}", t)])
    step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), role)), F.lit(INVALID))
    return F.aggregate(roles, F.lit(template["start"]), step)


def format_conversations(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss), formatted."""
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(template["open"]), escaped(t["role"], role=True), F.lit(template["after_role"])), F.lit(False)),
                part(escaped(t["text"]), t["role"].isin(template["loss_roles"])),
                part(F.lit(template["close"]), F.lit(False)),
            ),
        )
    )
    valid = final_state(F.transform("turns", lambda t: t["role"]), template).isin(template["accept"])
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Array of (role, text) that a formatted text holds."""
    quoted = "\\Q" + template["open"] + "\\E"
    parts = F.split(formatted, quoted)
    turns = F.slice(parts, F.lit(2), F.size(parts))
    head = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"

    def turn(x: Column) -> Column:
        role = F.regexp_extract(x, head, 1)
        n = F.length(role) + 1
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, n + 1, F.length(x) - n - len(template["close"]))).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
