"""The corpus pipeline: documents through five of the training-data operators.

Toxic documents go, one document of each group of near copies stays, passages of WORDS words or more that
stand more than once go from the texts, contaminated documents go, and what is left is encoded.
The stage simhash_near_dedup links what op5's SimHash index finds and exact shingle sets confirm; pairs of 0.8, mostly out of the reach of four bits, are found by bytes of MinHashes behind it.
SQL can't express it (a learned classifier, connected components, best-score segmentation).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.llm import decontamination, near_copies, piece_coding, suffix_dedup, toxicity


#: Repeated passages of so many words go; the strings compared are of WIDTH bytes (50 words of three letters take 199).
WORDS, WIDTH = 50, 160
#: Bytes of text whose repeated strings one task settles: strings of WIDTH bytes take more room each than op6's.
BUCKET_BYTES = 8 << 20


def _rows(docs: DataFrame) -> DataFrame:
    """row, doc_id and text, so that no result can clash with a column of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are scored toxic; a classifier of this run, learned from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    scored = toxicity.with_toxicity(_rows(docs), labels, toxicity.fifth(F.col("id")))
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of word 5-shingles: the one of smallest id."""
    return near_copies.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with texts that lack what strings of WIDTH bytes that stand more than once cover, where WORDS words or more begin in it."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    cut = suffix_dedup.remove_repeated_strings(docs.select(rest.alias("row"), "text"), WIDTH, least_words=WORDS, bucket_bytes=BUCKET_BYTES)
    return cut.select(*[F.col("kept_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that benchmark windows of 13 words cover by a twentieth or more."""
    judged = decontamination.judged(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("NOT contaminated").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with piece_ids, and whether they decode to the text."""
    import public_tokenizers

    return piece_coding.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), check_col="decodes")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece_coding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written in the shared folder and read by the next."""
    from loomline.llm.common import checkpointed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
