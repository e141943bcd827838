"""Chat formatting: a finite-state machine over roles and a declarative template, with DataFrame functions only.

A template gives for each role the control strings around a turn and whether its text is learned. Formatting emits
text segments, each with a loss flag; the formatted text is their concatenation. In texts, every character that begins
a control string is followed by an inserted escape character, so no control string can occur in a text, and removing
the escape characters restores the text: formatting is reversible for any texts.

Rows of a conversation are ordered by turn, then role and text; a null turn comes first, a null role is the empty role,
a null text is empty, repeated rows are turns of their own, and null conv_ids form one conversation. Roles that the
template doesn't know are marked with their name. An order of turns that the machine doesn't accept gives valid =
false; such conversations are formatted all the same, and the caller decides. Texts of any length are kept whole: a
conversation is one row. An empty table gives no conversation; other columns than the four are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS]", "[/SYS]"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("", "</s>", learned=True),
        }
    )
    #: Marks a role that isn't in `turns`: role_before, the role, role_after, the text, role_end.
    role_before: str = "[ROLE]"
    role_after: str = "[/ROLE]"
    role_end: str = "[/END]"
    escape: str = "\\"
    #: From a state (the last role; "" at the start) to the roles that may follow.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    #: Roles that a conversation may end with.
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        found = {s for t in self.turns.values() for s in (t.before, t.after) if s}
        return sorted(found | {self.role_before, self.role_after, self.role_end})

    def check(self) -> None:
        """Raise unless texts are restored exactly and turns can be told apart."""
        all_ = self.controls()
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c for c in all_):
            raise ValueError("control strings need two characters or more, without the escape character")
        for a in all_:
            for b in all_:
                if a != b and a.startswith(b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"the control strings {a} and {b} overlap")
        if sum(not t.before for t in self.turns.values()) > 1 or any(not t.after for t in self.turns.values()):
            raise ValueError("every turn needs an end mark, and all but one a mark at the start")

    def firsts(self) -> list[str]:
        return sorted({c[0] for c in self.controls()})

    def escaped(self, text: Column) -> Column:
        return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c + self.escape)), self.firsts(), text)

    def unescaped(self, text: Column) -> Column:
        return reduce(lambda t, c: F.replace(t, F.lit(c + self.escape), F.lit(c)), self.firsts(), text)

    def pattern(self) -> str:
        """A turn as it stands in the formatted text."""
        marked = [t for t in self.turns.values() if t.before]
        open_ = [t for t in self.turns.values() if not t.before]
        parts = [f"{re.escape(t.before)}.*?{re.escape(t.after)}" for t in marked]
        parts.append(f"{re.escape(self.role_before)}.*?{re.escape(self.role_after)}.*?{re.escape(self.role_end)}")
        parts += [f".*?{re.escape(t.after)}" for t in open_]
        return "(?s)(?:" + "|".join(parts) + ")"


def format_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, end_state, segments (array of text and loss flag) and formatted, a row for each conversation."""
    template = template or Template()
    template.check()
    grouped = chats.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("_turns")
    )
    steps = F.create_map(*[F.lit(x) for s, nexts in template.follows.items() for r in nexts for x in (f"{s}\n{r}", r)])
    state = F.aggregate(
        "_turns",
        F.lit(""),
        lambda s, t: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit("\n"), t["role"])), F.lit("!")),
    )

    def turn_segments(t: Column) -> Column:
        text = template.escaped(t["text"])

        def segments(before: Column, learned: bool, after: str) -> Column:
            return F.array(
                F.struct(before.alias("text"), F.lit(False).alias("loss")),
                F.struct(text.alias("text"), F.lit(learned).alias("loss")),
                F.struct(F.lit(after).alias("text"), F.lit(False).alias("loss")),
            )

        other = F.concat(F.lit(template.role_before), template.escaped(t["role"]), F.lit(template.role_after))
        out = F
        for role, k in template.turns.items():
            out = out.when(t["role"] == role, segments(F.lit(k.before), k.learned, k.after))
        return out.otherwise(segments(other, False, template.role_end))

    return (
        grouped.withColumn("end_state", state)
        .withColumn("valid", F.col("end_state").isin(*template.ends))
        .withColumn("segments", F.filter(F.flatten(F.transform("_turns", turn_segments)), lambda s: s["text"] != ""))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", "valid", "end_state", "segments", "formatted")
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text), read back from a formatted text."""
    template = template or Template()

    def turn(token: Column) -> Column:
        def between(before: Column, after: str) -> Column:
            body = F.substr(token, before + 1, F.length(token) - before - len(after))
            return template.unescaped(body)

        head = F.instr(token, F.lit(template.role_after))
        skip = len(template.role_before)
        other = F.struct(
            template.unescaped(F.substr(token, F.lit(skip + 1), head - skip - 1)).alias("role"),
            between(head + (len(template.role_after) - 1), template.role_end).alias("text"),
        )
        out = F.when(F.startswith(token, F.lit(template.role_before)), other)
        for role, k in sorted(template.turns.items(), key=lambda x: -len(x[1].before)):
            made = F.struct(F.lit(role).alias("role"), between(F.lit(len(k.before)), k.after).alias("text"))
            out = out.when(F.startswith(token, F.lit(k.before)), made) if k.before else out.otherwise(made)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(template.pattern()), F.lit(0)), turn)


def learned_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, as it was before escaping."""
    template = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")
