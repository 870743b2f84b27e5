"""Every registered query of the library, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_catalog, queries_chunks, queries_cues, queries_edits, queries_merges, queries_more, queries_recut, queries_review, queries_seams, queries_shape, queries_stats, queries_text, queries_time, queries_words

MODULES = [queries_time, queries_text, queries_catalog, queries_more, queries_shape, queries_stats, queries_seams, queries_chunks, queries_review, queries_recut, queries_edits, queries_merges, queries_words, queries_cues]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, query in m.Q.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.O.items()}
FLAGSHIP = "j3_label_sentences"
