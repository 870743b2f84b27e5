"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has events (conv, seq, kind, message, role, text). Events of a conversation count in the order of
seq; those of equal seq don't see each other. Kinds:

- open: message stands in the conversation, with this role (the last open of a message that counts decides);
- delta: text is appended to the message;
- edit: the message's text so far is replaced by text, later deltas are appended to it;
- regenerate: the message's text so far is dropped, its role stays; later messages that were opened
  before, by number, are dropped whole.

Others change nothing. Rendered messages stand in the order of their numbers: marks around role and text,
control strings inside either escaped by a backslash behind their first character (one more where
backslashes stand there already, so that it can be undone). The loss mask is a list of byte ranges of the
formatted string, one for each trained message's text.

What a later regeneration drops is found by chunks of `span` sequence numbers (least message over later
chunks, then inside the chunk), so that a conversation with a third of all events isn't one task's; messages
are put together by (conv, message). Only rendered texts meet by conversation, as one string holds them.

Cases: null text is empty; a null role is an empty one; null conv is a conversation of its own; events
without message form none; deltas and edits of a message that is never opened form one without role;
a null seq comes first; equal events count each, and text of equal seq is taken in the order of the text; a
text of any length is taken whole; an empty log gives an empty table; other columns of the log don't come out.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


class Template(NamedTuple):
    """Marks around a turn's role and text, other control strings that texts may not hold, and roles under the loss mask."""

    opens: str = "<|turn|>"
    between: str = "<|text|>"
    closes: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    trained: tuple[str, ...] = ("assistant",)

    def _parts(self) -> tuple[str, str]:
        """Patterns of first characters and of rests; a rest may hold no first character, so matches can't overlap."""
        every = [self.opens, self.between, self.closes, *self.controls]
        heads, rests = {c[0] for c in every}, [c[1:] for c in every]
        if any(not r or r[0] == "\\" or heads & set(r) for r in rests) or "\\" in heads:
            raise ValueError("a control string needs two characters or more, the first of which no other character of them equals")
        return "[" + "".join(re.escape(h) for h in sorted(heads)) + "]", "|".join(re.escape(r) for r in rests)

    def escaped(self, text: Column) -> Column:
        heads, rests = self._parts()
        return F.regexp_replace(text, rf"({heads})(\\*)({rests})", r"$1$2\\$3")

    def unescaped(self, text: Column) -> Column:
        heads, rests = self._parts()
        return F.regexp_replace(text, rf"({heads})\\(\\*)({rests})", "$1$2$3")


def folded(log: DataFrame, span: int = 4096) -> DataFrame:
    """(conv, message, role, text) of the messages that the events of log come to."""
    events = log.where("message IS NOT NULL").select(
        "conv", F.coalesce("seq", F.lit(-(2**62))).cast("long").alias("seq"), "kind", F.col("message").cast("long").alias("message"), "role", "text"
    )
    events = events.withColumn("chunk", F.floor(F.col("seq") / F.lit(span)).cast("long"))
    again = F.when(F.col("kind") == "regenerate", F.col("message"))
    later = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = events.groupBy("conv", "chunk").agg(F.min(again).alias("least")).withColumn("beyond", F.min("least").over(later))
    chunks = chunks.where("beyond IS NOT NULL").select(F.col("conv").alias("conv_"), F.col("chunk").alias("chunk_"), "beyond")
    met = events.join(chunks, F.equal_null("conv", "conv_") & (F.col("chunk") == F.col("chunk_")), "left").drop("conv_", "chunk_")
    inside = Window.partitionBy("conv", "chunk").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    cut = met.withColumn("cut", F.least(F.min(again).over(inside), "beyond"))
    opens = F.col("kind") == "open"
    kept = cut.where(F.col("cut").isNull() | (F.col("cut") > F.col("message")) | (opens & (F.col("cut") == F.col("message"))))
    edits = events.where("kind = 'edit'").groupBy(F.col("conv").alias("conv_"), F.col("message").alias("message_")).agg(F.max("seq").alias("edited"))
    kept = kept.join(edits, F.equal_null("conv", "conv_") & (F.col("message") == F.col("message_")), "left")
    says = (F.col("kind") == "delta") & (F.col("edited").isNull() | (F.col("seq") > F.col("edited"))) | (F.col("kind") == "edit") & (F.col("seq") == F.col("edited"))
    part = F.when(says & F.col("text").isNotNull(), F.struct("seq", (F.col("kind") == "delta").alias("appended"), "text"))
    whole = kept.where(opens | F.col("kind").isin("delta", "edit")).groupBy("conv", "message").agg(
        F.max(F.when(opens, F.struct("seq", "role")))["role"].alias("role"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    return whole.select("conv", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def rendered(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv, formatted, loss_spans): each conversation's string, and the byte ranges [start, stop) of its trained texts."""
    turns = messages.select(
        "conv", "message", F.col("role").isin(*template.trained).alias("trained"),
        F.concat(F.lit(template.opens), template.escaped(F.col("role")), F.lit(template.between)).alias("head"),
        F.concat(template.escaped(F.col("text")), F.lit(template.closes)).alias("tail"),
    )
    size = F.octet_length("head").cast("long") + F.octet_length("tail")
    sofar = F.sum(size).over(Window.partitionBy("conv").orderBy("message", "head", "tail").rowsBetween(Window.unboundedPreceding, 0))
    placed = turns.withColumn("stop", sofar - len(template.closes.encode()))
    start = F.col("stop") + len(template.closes.encode()) - F.octet_length("tail")
    rows = placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("stop", F.concat("head", "tail").alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct(start.alias("start"), "stop")))).alias("loss_spans"),
    )
    return rows.select("conv", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>>: the turns of a formatted string."""
    pieces = F.split(formatted, re.escape(template.closes))
    inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.split(p, re.escape(template.between), 2))
    return F.transform(inner, lambda p: F.struct(template.unescaped(F.substr(p[0], F.lit(len(template.opens) + 1))).alias("role"), template.unescaped(p[1]).alias("text")))


def trained_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, one range after the other."""
    data = formatted.cast("binary")
    cut = lambda s: F.substring(data, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")).cast("string")
    return F.array_join(F.transform(spans, lambda s: template.unescaped(cut(s))), "")


def log_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The log of finished conversations: for each row one open event and one delta for each line.

    Messages are numbered from 1 by turn (nulls first, ties by role, then text; equal rows are messages each).
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    numbered = own.withColumn("message", F.row_number().over(order).cast("long"))
    line = lambda text, at: F.struct(F.lit("delta").alias("kind"), (at + 1).cast("long").alias("at"), text.alias("line"))
    first = F.array(F.struct(F.lit("open").alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("line")))
    each = numbered.select("conv", "message", "role", F.explode(F.concat(first, F.transform(F.split("text", r"(?<=\n)"), line))).alias("e"))
    return each.select(
        "conv", (F.shiftleft("message", 32) + F.col("e.at")).alias("seq"), "e.kind", "message",
        F.when(F.col("e.kind") == "open", F.col("role")).alias("role"), F.col("e.line").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, whose texts are control strings, read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")), F.lit(odd))
    done = rendered(folded(log_of(rows.union(extra))))
    turns, said = read_back(F.col("formatted")), trained_text(F.col("formatted"), F.col("loss_spans"))
    back = done.select("conv", "formatted", turns.alias("turns"), said.alias("said"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(n)),
e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g')) + 23 AS size
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS said, sum(size) AS size
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(said) AS BIGINT) AS loss_chars, sha256(said) AS loss_sha256,
       CAST(size AS BIGINT) AS formatted_chars
FROM g
"""
