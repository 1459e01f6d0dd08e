"""Chat formatting, natively in Spark.

A declarative template gives every role its opening and closing mark and whether its text
bears loss.  A finite-state machine over the roles validates the order of turns.  A
conversation becomes a list of segments ``(text, loss)``, whose concatenation is the
formatted text; control strings inside texts are escaped, so it can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.store import table

ESCAPE = "\\"


@dataclass(frozen=True)
class Mark:
    """What stands before and after a role's text, and whether the text bears loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role; other roles use ``other``, with their escaped name inside its mark.

    ``turns`` maps a state to the roles that may follow; the state is the last role.
    """

    begin: str = "<s>"
    roles: dict[str, Mark] = field(
        default_factory=lambda: {
            "system": Mark("[SYS] ", " [/SYS]"),
            "user": Mark("[INST] ", " [/INST]"),
            "assistant": Mark("[ANS] ", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE] ", "</s>")
    controls: tuple[str, ...] = (
        "<s>",
        "</s>",
        "[SYS]",
        "[/SYS]",
        "[INST]",
        "[/INST]",
        "[ANS]",
        "[ROLE]",
        "[/ROLE]",
    )
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def escaped(self, text: Column) -> Column:
        """``text`` without control strings: each is broken after its first character."""
        out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
        for control in self.controls:
            out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
        return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(template: Template, role: Column, known, other: Column) -> Column:
    out = None
    for name, mark in template.roles.items():
        out = (F if out is None else out).when(role == name, known(mark))
    return out.otherwise(other)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, segments, formatted, valid_order, complete`` of every conversation.

    Turns are ordered by (turn, role, text), so ties and repeated rows have one order and
    all are kept; null turns come first.  A null text or role counts as empty, and unknown
    roles are formatted but not valid.  A null ``conv_id`` is a conversation of its own.
    Conversations out of order are formatted all the same and marked.  Other columns are not
    read.  A conversation is one row, as its digest needs it whole; nothing larger is
    gathered.
    """
    template = template or Template()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.sort_array(
        F.collect_list(F.struct("turn", blank("role").alias("role"), blank("text").alias("text")))
    )
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))

    allowed = F.create_map(
        *[
            F.lit(x)
            for state, roles in template.turns.items()
            for role in roles
            for x in (f"{state}>{role}", role)
        ]
    )
    state = F.aggregate(
        "turns",
        F.lit("").cast("string"),
        # a turn out of order leads to a state that nothing leaves
        lambda s, t: F.coalesce(F.try_element_at(allowed, F.concat(s, F.lit(">"), t["role"])), F.lit("!")),
    )
    first, middle, last = template.other

    def segments(t: Column) -> Column:
        opened = _by_role(
            template,
            t["role"],
            lambda m: F.lit(m.open),
            F.concat(F.lit(first), template.escaped(t["role"]), F.lit(middle)),
        )
        closed = _by_role(template, t["role"], lambda m: F.lit(m.close), F.lit(last))
        loss = _by_role(template, t["role"], lambda m: F.lit(m.loss), F.lit(False))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(opened, F.lit(False)),
            piece(template.escaped(t["text"]), loss),
            piece(closed, F.lit(False)),
        )

    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return grouped.select(
        "conv_id",
        F.concat(begin, F.flatten(F.transform("turns", segments))).alias("segments"),
        state.alias("state"),
    ).select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("state") != "!").alias("valid_order"),
        (F.col("state") == "assistant").alias("complete"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The array of ``(role, text)`` that a formatted conversation holds."""
    template = template or Template()
    first, middle, last = template.other
    marks = [m.open for m in template.roles.values()] + [first]
    body = F.substring(formatted, len(template.begin) + 1, 1 << 30)
    pieces = F.filter(
        F.split(body, "(?=" + "|".join(map(re.escape, marks)) + ")"), lambda p: p != ""
    )
    named = f"(?s)^{re.escape(first)}(.*?){re.escape(middle)}"

    def turn(piece: Column) -> Column:
        role = unescaped(F.regexp_extract(piece, named, 1))
        text = F.regexp_replace(piece, named, "")
        text = F.substring(text, F.lit(1), F.length(text) - len(last))
        for name, mark in template.roles.items():
            mine = F.startswith(piece, F.lit(mark.open))
            inner = F.substring(
                piece,
                F.lit(len(mark.open) + 1),
                F.length(piece) - len(mark.open) - len(mark.close),
            )
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and checksums read back from the segments and the formatted text."""
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    borne = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(borne, lambda s: unescaped(s["text"])), "")
    return (
        formatted.withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(joined, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid_order",
            "complete",
        )
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(-1).cast("long").alias("conv_id"),
                        F.lit(turn).cast("long").alias("turn"),
                        F.lit(role).alias("role"),
                        F.lit(control).alias("text"),
                    )
                    for turn, role in enumerate(("user", "assistant"))
                ]
            )
        )
    )
    return digest(format_conversations(given.unionByName(extra)))


OP7_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    chr(92), chr(92) || chr(92)), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'),
    '[SYS]', '[' || chr(92) || 'SYS]'), '[/SYS]', '[' || chr(92) || '/SYS]'),
    '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'),
    '[ANS]', '[' || chr(92) || 'ANS]'), '[ROLE]', '[' || chr(92) || 'ROLE]'),
    '[/ROLE]', '[' || chr(92) || '/ROLE]') AS safe,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
              ELSE 18 + length(role) END AS marks,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(safe) + marks))::BIGINT AS formatted_chars,
       bool_and(coalesce(before, '') || '>' || role IN
         ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid_order,
       bool_and(coalesce(before, '') || '>' || role IN
         ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))
         AND bool_or(back = 1 AND role = 'assistant') AS complete
FROM escaped GROUP BY conv_id
"""
