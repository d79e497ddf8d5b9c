"""Chat formatting by a finite-state machine over roles (operator 6), as DataFrame expressions.

A declarative template names the control strings, the label and loss flag of each
role, and the machine's moves.  A conversation's rows, in turn order, become text
segments (header, body, end of turn), each with a loss flag; only bodies of roles
with loss carry it.  The machine gives the final state and whether the order of the
turns is accepted; conversations out of order are formatted all the same and marked.

Control strings inside texts are escaped reversibly: backslashes are doubled, then a
backslash parts the first character of every control string from the rest.  No
control string occurs in an escaped text, so the output is split at the control
strings alone; unescaping drops one backslash before any character.

Defined cases: null texts and null roles are empty; roles outside the template get
a label of their own (``=`` and the escaped role) without loss; null conversation ids
are one conversation; equal turn numbers are ordered by role, then text; equal rows
are separate turns; an empty table gives an empty result; other columns are not
read.  A conversation is one output row, so its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import let

TEMPLATE = {
    "open": "### ",
    "separator": ": ",
    "close": "</turn>\n",
    "guards": ["### ", "</turn>"],
    "roles": {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)},
    "start": "start",
    "moves": {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
              ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    "accepting": ["assistant"],
}
OTHER_ROLE = "="
REJECTED = "rejected"


def escape(text: Column, guards: list[str]) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for g in guards:
        out = F.replace(out, F.lit(g), F.lit(g[0] + "\\" + g[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def final_state(roles: Column, template: dict = TEMPLATE) -> Column:
    """State of the machine after the roles; ``rejected`` once no move fits."""
    moves = literal_map({f"{s} {r}": t for (s, r), t in template["moves"].items()})
    move = lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit(" "), r)), F.lit(REJECTED))
    return F.aggregate(roles, F.lit(template["start"]), move)


def segments_of(turn: Column, template: dict) -> Column:
    """Header, body and end of one turn, with loss flags."""
    labels = literal_map({r: label for r, (label, _) in template["roles"].items()})
    losses = [r for r, (_, loss) in template["roles"].items() if loss]
    other = F.concat(F.lit(OTHER_ROLE), escape(turn["role"], [*template["guards"], template["separator"]]))
    header = F.concat(F.lit(template["open"]), F.coalesce(F.element_at(labels, turn["role"]), other), F.lit(template["separator"]))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(piece(header, F.lit(False)), piece(escape(turn["text"], template["guards"]), turn["role"].isin(losses)),
                   piece(F.lit(template["close"]), F.lit(False)))


def format_conversations(df: DataFrame, template: dict = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, segments array<struct<text, loss>>, state, valid): a row per conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"),
                                                         empty(text_col).alias("text")).alias("t"))
    turns = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    made = turns.select("id", F.flatten(F.transform("turns", lambda t: segments_of(t, template))).alias("segments"),
                        final_state(F.transform("turns", lambda t: t["role"]), template).alias("state"))
    return made.select(F.col("id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                       "segments", "state", F.col("state").isin(template["accepting"]).alias("valid"))


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> of the turns in a formatted text, unescaped."""
    roles = literal_map({label: r for r, (label, _) in template["roles"].items()})
    parts = F.split(formatted, "\\Q" + template["close"] + "\\E", -1)
    opened, gap = len(template["open"]), len(template["separator"])

    def turn(part: Column) -> Column:
        label = F.substring_index(F.substring(part, opened + 1, 1 << 30), template["separator"], 1)
        return let(label, lambda n: F.struct(
            F.coalesce(F.element_at(roles, n), unescape(F.substring(n, len(OTHER_ROLE) + 1, 1 << 30))).alias("role"),
            unescape(F.substring(part, F.length(n) + opened + gap + 1, F.length(part))).alias("text")))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
