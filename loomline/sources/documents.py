"""Transcripts and edit lists as JSON documents: read by a schema, set apart where they aren't one, written with their version."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.edits import ENTRIES

SENTENCES = "array<struct<start:double,end:double,speaker:string,text:string>>"
FORMAT, VERSION = "edit-list", 1
LIST_SCHEMA = f"format string, version int, sources map<string,string>, names map<string,string>, content {ENTRIES}"


def read_transcripts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, audio, sentences) of documents (doc, path, json) that are an object with a list of sentences, and (doc, reason) of the others.

    audio is the recording beside the document: the folder of its path with the file name that the document names.
    """
    parsed = docs.withColumn("__p", F.from_json("json", f"audio string, sentences {SENTENCES}, __odd string", {"columnNameOfCorruptRecord": "__odd"}))
    reason = F.when(~F.coalesce(F.startswith(F.trim("json"), F.lit("{")), F.lit(False)), "no object").when(F.col("__p.__odd").isNotNull(), "no JSON, or fields of other kinds").when(F.col("__p.sentences").isNull(), "no list of sentences")
    p = parsed.withColumn("reason", reason)
    folder, name = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.regexp_extract("__p.audio", r"([^/]*)$", 1)
    good = p.where("reason IS NULL").select("doc", F.concat(folder, name).alias("audio"), F.col("__p.sentences").alias("sentences"))
    return good, p.where("reason IS NOT NULL").select("doc", "reason")


def write_edit_lists(entries: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, json) of edit lists: format, version, the sources (doc, source, path) that an item plays from, names (doc, label, name), content in order."""
    entry = F.struct("pos", F.struct(*[c for c in entries.columns if c not in ("doc", "pos")]).alias("e"))
    content = entries.groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("a"), F.collect_set(F.when(F.col("kind") == "item", F.col("source"))).alias("used"))
    pairs = lambda rows, a, b, name: rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(a, b))).alias(name))
    j = content.join(pairs(sources, "source", "path", "sources"), "doc", "left").join(pairs(names, "label", "name", "names"), "doc", "left")
    used = F.map_from_entries(F.filter("sources", lambda x: F.array_contains("used", x["source"])))
    doc = F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.coalesce(used, F.create_map().cast("map<string,string>")).alias("sources"), F.map_from_entries("names").alias("names"), F.transform("a", lambda x: x["e"]).alias("content"))
    return j.select("doc", F.to_json(doc).alias("json"))


def parsed_edit_lists(docs: DataFrame) -> DataFrame:
    """doc, sources, names, content of (doc, json), or reason and nothing else, where it is no edit list, or one of a later version."""
    p = docs.withColumn("__p", F.from_json("json", LIST_SCHEMA))
    reason = F.when(~F.equal_null("__p.format", F.lit(FORMAT)), "no edit list").when(F.col("__p.version").isNull() | F.col("__p.content").isNull(), "no version or content").when(F.col("__p.version") > VERSION, "a later version")
    return p.select("doc", *[F.when(reason.isNull(), F.col(f"__p.{c}")).alias(c) for c in ("sources", "names", "content")], reason.alias("reason"))


def read_edit_lists(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, sources, names, content) of (doc, json), and (doc, reason) of what is no edit list, or one of a later version."""
    p = parsed_edit_lists(docs)
    return p.where("reason IS NULL").drop("reason"), p.where("reason IS NOT NULL").select("doc", "reason")
