"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its opening and closing mark and says whether its text is learned. The machine's
state is the role of the turn before; a table of allowed steps says whether a turn is in order. Each turn becomes three
segments (opening mark, text, closing mark), of which only the text of a learned role carries the loss flag. Control
strings inside texts and roles are escaped by a backslash after their first character, which reads back without loss. The
segments of a conversation become one text with spans of what is learned; it is read back by its marks alone.

Defined results: null text and null role are empty strings; a role without an own rule is formatted like any other, not
learned, and never in order. Turns are ordered by turn (null first), then role, then text, so repeated turns all stay.
Rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks and rules of a chat format; {role} in ``opening`` stands for the turn's role."""

    opening: tuple[str, str] = ("<|im_start|>", "\n")
    closing: str = "<|im_end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    #: Role before a turn ("" at the start) to the roles that may follow.
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Strings that no text may show as they are: the marks, and those of common tokenizers.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escaped(self, already: str = "") -> str:
        """A pattern for control strings: first character, ``already`` there, more backslashes, and the rest ahead."""
        one = "|".join(rf"(?<={re.escape(c[0])}){already}(?=\\*{re.escape(c[1:])})" for c in sorted(self.control))
        return one


def escape(text: Column, t: ChatTemplate) -> Column:
    """``text`` with one more backslash after the first character of each control string."""
    return F.regexp_replace(text, t.escaped(), r"\\")


def unescape(text: Column, t: ChatTemplate) -> Column:
    """``escape`` taken back: one backslash less after the first character of each control string."""
    return F.regexp_replace(text, t.escaped(r"\\"), "")


def _flat(role: Column) -> Column:
    """A role on one line: the opening mark ends at the first newline."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unflat(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """One row per turn: conv_id, step (from 0), in_order, and segments, an array of (text, loss)."""
    t = template or ChatTemplate()
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(F.col(conv_col), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy(conv_col).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"before": F.coalesce(F.lag("role").over(order), F.lit("")), "step": (F.row_number().over(order) - 1).cast("long")})
    allowed = F.lit(False)
    for state, following in t.steps.items():
        at_start = F.col("step") == 0 if state == "" else F.col("step") > 0
        allowed = allowed | (at_start & (F.col("before") == state) & F.col("role").isin(*following))
    learned = F.col("role").isin(*sorted(t.learned)) if t.learned else F.lit(False)
    segments = F.array(
        F.struct(F.concat(F.lit(t.opening[0]), escape(_flat(F.col("role")), t), F.lit(t.opening[1])).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text"), t).alias("text"), learned.alias("loss")),
        F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")),
    )
    return rows.select(conv_col, "step", allowed.alias("in_order"), segments.alias("segments"))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """``formatted`` turns with role, text (read from the joined segments) and learned (text under the loss flag)."""
    t = template or ChatTemplate()
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    shape = f"(?s)^{re.escape(t.opening[0])}(.*?){re.escape(t.opening[1])}(.*){re.escape(t.closing)}$"
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    out = formatted.withColumn("whole", whole)
    return out.select(
        *formatted.columns,
        F.char_length("whole").cast("long").alias("chars"),
        _unflat(unescape(F.regexp_extract("whole", shape, 1), t)).alias("role"),
        unescape(F.regexp_extract("whole", shape, 2), t).alias("text"),
        unescape(under, t).alias("learned"),
    )


def join_conversations(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of formatted turns: formatted (one text), spans (start and size in it of what is learned, in
    characters from 0) and in_order."""
    turns = formatted.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct("step", "segments"))).alias("turns"), F.bool_and("in_order").alias("in_order"))
    rows = turns.select(conv_col, "in_order", F.flatten(F.transform("turns", lambda x: x["segments"])).alias("segments"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, size: int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        size = F.char_length(x["text"])
        here = F.array(F.struct(s["at"].alias("start"), size.alias("size")))
        return F.struct((s["at"] + size).alias("at"), F.when(x["loss"], F.concat(s["spans"], here)).otherwise(s["spans"]).alias("spans"))

    return rows.select(conv_col, "in_order", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), F.aggregate("segments", start, step)["spans"].alias("spans"))


def parse_conversations(joined: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """``joined`` with roles, texts (found by the marks of the template alone) and learned (what the spans cover), unescaped."""
    t = template or ChatTemplate()
    # Texts and roles hold no mark as it is, so the next closing mark ends the turn.
    shape = f"(?s){re.escape(t.opening[0])}(.*?){re.escape(t.opening[1])}(.*?){re.escape(t.closing)}"
    found = lambda group: F.regexp_extract_all("formatted", F.lit(shape), F.lit(group))
    return joined.select(
        *joined.columns,
        F.transform(found(1), lambda x: _unflat(unescape(x, t))).alias("roles"),
        F.transform(found(2), lambda x: unescape(x, t)).alias("texts"),
        F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]), t)).alias("learned"),
    )


def conversation_digests(formatted: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its formatted text: n_turns, digests of all text and of the learned text, and lengths."""
    each = parse_conversations(join_conversations(formatted, conv_col), template)
    said = F.array_join(F.zip_with("roles", "texts", lambda r, x: F.concat(r, F.lit("\n"), x, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return each.select(conv_col, F.size("texts").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "in_order")
