"""Chat formatting: an event log is folded into messages, and messages are rendered as one training text a conversation.

Events (conv_id, message, seq, kind, role, text) name the message they belong to. ``open`` starts it with a role and a text, ``delta``
adds to its text, ``edit`` replaces the text and ``regenerate`` discards it, so that later deltas build it anew. Events of a message apply
by sequence number; of equal numbers replacements come first, then by text. Folding is associative, so a run of events becomes one
piece (does it replace what was before, and its text), and pieces are folded like events: one long-streamed message is spread over tasks.
A conversation is rendered in runs of messages likewise, which are then put together. The last text of a conversation is one value of one
row, so a conversation has to fit in a task; nothing else has to.

A template marks turns by control strings. Control strings inside a text, its own and those of other usual templates, get a
backslash after their first character (and those that have some get one more), which is undone on reading.

All of it is columns and aggregates. Null texts and roles are empty ones. Events of other kinds, and those of a message that no ``open`` starts,
count for nothing. Messages with one opening number follow each other by role and text; repeated rows are one message only if they
name the same one. Rows without a conv_id are one conversation, whose id is null. An empty log gives no conversation. Other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sequence numbers of events, and of opening events, that make a run.
EVENT_RUN = 4096
MESSAGE_RUN = 256

# Control strings of usual chat templates.
CONTROLS = ("<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
            "<s>", "</s>", "[INST]", "[/INST]")


@dataclass(frozen=True)
class Template:
    """Marks of a conversation and its turns; ``learned`` are the roles whose texts count for the loss."""

    begin: str = "<|begin_of_text|>"
    role_start: str = "<|start_header_id|>"
    role_end: str = "<|end_header_id|>\n\n"
    turn_end: str = "<|eot_id|>"
    learned: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        own = {m.strip() for m in (self.begin, self.role_start, self.role_end, self.turn_end)}
        return sorted(own | set(CONTROLS))


TEMPLATE = Template()


def _inner(template: Template) -> tuple[str, str]:
    """First characters of the control strings as a class, and the rests as alternatives."""
    names = template.controls()
    firsts = "".join(sorted({re.escape(c[0]) for c in names}))
    return f"([{firsts}])", "(" + "|".join(re.escape(c[1:]) for c in names) + ")"


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    first, rest = _inner(template)
    return F.regexp_replace(text, rf"{first}(\\*){rest}", r"$1\\$2$3")


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    first, rest = _inner(template)
    return F.regexp_replace(text, rf"{first}\\(\\*){rest}", "$1$2$3")


def _fold(pieces: Column) -> Column:
    """The text that sorted pieces (with ``replaces`` and ``text``) leave: that of the last replacement and all after it."""
    last = F.coalesce(F.array_max(F.transform(pieces, lambda x, i: F.when(x["replaces"], i + 1))), F.lit(1))
    return F.array_join(F.transform(F.slice(pieces, last, F.size(pieces)), lambda x: x["text"]), "")


def fold(log: DataFrame, *, run: int = EVENT_RUN) -> DataFrame:
    """(conv_id, message, seq, role, text): the messages that the events leave; ``seq`` is that of the first opening."""
    kind, text = F.col("kind"), F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit("")))
    events = log.where(kind.isin("open", "delta", "edit", "regenerate")).select(
        "conv_id", "message", "seq", (kind != "delta").alias("replaces"), text.alias("text"),
        F.when(kind == "open", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"))).alias("opened"))
    piece = F.struct("seq", (~F.col("replaces")).alias("adds"), "text", "replaces")
    runs = events.groupBy("conv_id", "message", F.floor(F.col("seq") / run).alias("run")).agg(
        F.sort_array(F.collect_list(piece)).alias("x"), F.min("opened").alias("opened"))
    runs = runs.select("conv_id", "message", "opened", F.struct("run", F.exists("x", lambda x: x["replaces"]).alias("replaces"), _fold(F.col("x")).alias("text")).alias("x"))
    whole = runs.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("x")).alias("x"), F.min("opened").alias("opened"))
    return whole.where(F.col("opened").isNotNull()).select("conv_id", "message", F.col("opened.seq").alias("seq"), F.col("opened.role").alias("role"), _fold(F.col("x")).alias("text"))


def render(messages: DataFrame, *, template: Template = TEMPLATE, run: int = MESSAGE_RUN) -> DataFrame:
    """(conv_id, formatted, turns): one text a conversation, and for each turn the code points before it (``at``), before its text
    (``start``), and how many of its text count for the loss (``loss``)."""
    head = F.concat(F.lit(template.role_start), escaped(F.col("role"), template), F.lit(template.role_end))
    body = escaped(F.col("text"), template)
    learned = F.col("role").isin(*template.learned)
    turn = messages.select("conv_id", "seq", "role", head.alias("head"), body.alias("body"), learned.alias("learned"))
    turn = turn.select("conv_id", F.floor(F.col("seq") / run).alias("run"), F.struct(
        "seq", "role", "body", F.concat("head", "body", F.lit(template.turn_end)).alias("piece"), F.char_length("head").alias("head"),
        F.when(F.col("learned"), F.char_length("body")).otherwise(0).alias("loss")).alias("x"))
    runs = turn.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("x")).alias("x"))
    # Places are running sums; the sums within a run and over the runs are made apart, so neither list is long.
    sizes = F.transform("x", lambda x: F.char_length(x["piece"]).cast("long"))
    part = runs.select("conv_id", F.struct("run", F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("text"), F.transform(
        F.arrays_zip(F.col("x").alias("x"), _before(sizes).alias("at")),
        lambda z: F.struct(z["at"].alias("at"), (z["at"] + z["x"]["head"]).alias("start"), z["x"]["loss"].cast("long").alias("loss"))).alias("turns")).alias("part"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    starts = _before(F.transform("parts", lambda p: F.char_length(p["text"]).cast("long")))
    first = len(template.begin)
    turns = F.flatten(F.transform(F.arrays_zip(F.col("parts").alias("p"), starts.alias("at")), lambda z: F.transform(z["p"]["turns"], lambda t: F.struct(
        (t["at"] + z["at"] + first).alias("at"), (t["start"] + z["at"] + first).alias("start"), t["loss"].alias("loss")))))
    return whole.select("conv_id", F.concat(F.lit(template.begin), F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("formatted"), turns.alias("turns"))


def _before(sizes: Column) -> Column:
    """Sums of the entries before each entry."""
    return F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda total, y: total + y))


def read_back(rendered: DataFrame, *, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, messages, learned): roles and texts of the turns, and all text under the loss mask, read from the formatted text."""
    body = F.substring("formatted", len(template.begin) + 1, 2**31 - 1)
    pieces = F.split(body, re.escape(template.turn_end))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # the last turn ends the text
    inner = F.transform(pieces, lambda p: F.split(F.substring(p, len(template.role_start) + 1, 2**31 - 1), re.escape(template.role_end), 2))
    read = rendered.select("conv_id", "formatted", "turns", pieces.alias("pieces"), inner.alias("inner"))
    messages = F.transform("inner", lambda x: F.struct(unescaped(x[0], template).alias("role"), unescaped(x[1], template).alias("text")))
    masked = F.transform(F.arrays_zip("pieces", "turns"), lambda z: F.substr(
        z["pieces"], (z["turns"]["start"] - z["turns"]["at"] + 1).cast("int"), z["turns"]["loss"].cast("int")))
    return read.select("conv_id", "formatted", messages.alias("messages"), F.array_join(F.transform(masked, lambda t: unescaped(t, template)), "").alias("learned"))
