"""Caption files as tables of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import stamp_ms, unescape

SPEAKER = r"^(SPEAKER_\d+|Speaker \d+|user|assistant|system): "

def read_srt(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, start_ms, end_ms, speaker and line of every cue; blocks without a timing line are dropped."""
    blocks = files.select(key, F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("pos", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: x != "")
    timed = blocks.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)).where("at > 0")
    body = F.regexp_replace(F.array_join(F.expr("slice(lines, int(at) + 1, size(lines))"), " "), "<[^>]*>", "")
    stamps = timed.select(key, "pos", F.get("lines", F.col("at").cast("int") - 1).alias("stamp"), body.alias("body"))
    label = F.regexp_extract("body", SPEAKER, 1)
    return stamps.select(
        key, "pos", stamp_ms(F.col("stamp"), 1).alias("start_ms"), stamp_ms(F.col("stamp"), 2).alias("end_ms"),
        F.when(label != "", label).alias("speaker"), unescape(F.regexp_replace("body", SPEAKER, "")).alias("line"),
    )


def read_cues(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_ms, end_ms and body of every block with a timing line (its first); other blocks are dropped."""
    blocks = files.select(key, F.explode(F.split(text, r"\r?\n[ \t]*\r?\n")).alias("block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: x != "")
    timed = blocks.select(key, lines.alias("lines")).withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)).where("at > 0")
    stamp = F.get("lines", F.col("at").cast("int") - 1)
    body = F.array_join(F.expr("slice(lines, int(at) + 1, size(lines))"), " ")
    return timed.select(key, stamp_ms(stamp, 1).alias("start_ms"), stamp_ms(stamp, 2).alias("end_ms"), body.alias("body"))


def read_vtt(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_ms, end_ms, k, t, speaker and w: what stands before a cue's first word stamp and behind each one; blank ones are dropped."""
    cues = read_cues(files, key, text)
    voice = F.regexp_extract("body", r"<v(?:\.[^ >]*)? ([^>]*)>", 1)
    parts = F.split(F.regexp_replace("body", r"</?v[^>]*>", ""), r"(?=<\d{2}:\d{2}:\d{2}\.\d{3}>)")
    each = cues.select(key, "start_ms", "end_ms", F.when(voice != "", voice).alias("speaker"), F.posexplode(parts).alias("k", "part"))
    words = unescape(F.regexp_replace("part", "<[^>]*>", ""))
    return each.select(key, "start_ms", "end_ms", "k", F.coalesce(stamp_ms(F.col("part"), 1), "start_ms").alias("t"), "speaker", words.alias("w")).where(F.trim("w") != "")
