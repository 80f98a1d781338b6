"""Chat formatting with a reversible template and a loss mask (operator 3). Expressions only.

The turns of a conversation are collected as structs, sorted and cut into runs of one role; a run
becomes one block ``<|turn|>role<|text|>text<|more|>text<|done|>``. Control strings inside a text
or role get a backslash after their first character, in front of any backslashes that are there
already, so no text holds a control string and decoding takes exactly one backslash away.

The loss mask covers the texts of the trained roles, one span per turn, and is given twice: per
turn (``loss_turns``) and as runs of code points over the whole string (``loss_runs``).

Cases: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first,
so repeated rows and ties have one order. Rows without a conversation id form one conversation. An
empty table gives an empty result. Columns besides the four named ones are ignored. A conversation
is one value of the result, so its size is bounded by what one string may hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers of this template, other templates' control strings to neutralise, trained roles."""

    open: str = "<|turn|>"
    text: str = "<|text|>"
    more: str = "<|more|>"
    close: str = "<|done|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)

    @property
    def markers(self) -> tuple[str, ...]:
        return self.open, self.text, self.more, self.close

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.markers}
        if any(h in c[1:] for c in self.markers for h in heads) or any(len(c) < 2 for c in (*self.markers, *self.reserved)):
            raise ValueError("a marker may not hold another marker's first character, and needs two characters")

    def escape(self, text: Column) -> Column:
        """Put a backslash after the first character, where any number of them and the rest follow."""
        return F.regexp_replace(text, "|".join(rf"(?<={re.escape(h)})(?=\\*(?:{rest}))" for h, rest in self._heads().items()), r"\\")

    def unescape(self, text: Column) -> Column:
        """Take that backslash away."""
        return F.regexp_replace(text, "|".join(rf"(?<={re.escape(h)})\\(?=\\*(?:{rest}))" for h, rest in self._heads().items()), "")

    def _heads(self) -> dict[str, str]:
        """Alternatives of what follows each first character of the control strings."""
        by_head: dict[str, list[str]] = {}
        for c in (*self.markers, *self.reserved):
            by_head.setdefault(c[0], []).append(re.escape(c[1:]))
        return {h: "|".join(rest) for h, rest in by_head.items()}


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: its id, ``formatted``, ``loss_turns``, ``loss_runs``."""
    t = template
    rows = turns.select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    chats = chats.withColumn("first", first)
    merged = F.transform("first", lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get("first", k + 1), n) - s))
    chats = chats.withColumn("runs", merged)

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(run: Column) -> Column:
        role = F.get(run, F.lit(0))["role"]
        head = F.array(piece(F.concat(F.lit(t.open), t.escape(role), F.lit(t.text)), F.lit(False)))
        texts = F.transform(run, lambda x, i: F.concat(F.when(i > 0, F.array(piece(F.lit(t.more), F.lit(False)))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")), F.array(piece(t.escape(x["text"]), role.isin(list(t.trained))))))
        return F.concat(head, F.flatten(texts), F.array(piece(F.lit(t.close), F.lit(False))))

    chats = chats.withColumn("pieces", F.flatten(F.transform("runs", block)))
    formatted = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    loss_turns = F.transform("turns", lambda x: x["role"].isin(list(t.trained)))
    loss_runs = F.transform("pieces", lambda p: F.struct(F.char_length(p["text"]).alias("chars"), p["loss"].alias("loss")))
    return chats.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), loss_turns.alias("loss_turns"), loss_runs.alias("loss_runs"))


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), *, conv_col: str = "conv_id") -> DataFrame:
    """The turns read back from the string, and what lies under the loss mask: ``turns`` (array of
    role, text), ``loss_text`` (the runs of ``loss_runs`` that are masked, cut out of ``formatted``
    by their code points and unescaped)."""
    t = template
    blocks = F.filter(F.split("formatted", re.escape(t.open)), lambda b: b != "")
    cut = F.transform(blocks, lambda b: F.split(b, "|".join(map(re.escape, (t.text, t.more, t.close)))))
    # Each block is now: role, texts, and what follows the closing marker (nothing).
    turns = F.flatten(F.transform(cut, lambda c: F.transform(F.slice(c, F.lit(2), F.size(c) - 2), lambda x: F.struct(t.unescape(F.get(c, F.lit(0))).alias("role"), t.unescape(x).alias("text")))))
    # Where each masked run starts: the sum of all runs before it.
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("runs"))
    spans = F.aggregate("loss_runs", nothing, lambda a, r: F.struct((a["at"] + r["chars"]).alias("at"), F.when(r["loss"], F.concat(a["runs"], F.array(F.struct((a["at"] + 1).alias("start"), r["chars"].alias("chars"))))).otherwise(a["runs"]).alias("runs")), lambda a: a["runs"])
    masked = F.transform(spans, lambda r: t.unescape(F.substring("formatted", r["start"], r["chars"])))
    return formatted.select(F.col(conv_col), "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
