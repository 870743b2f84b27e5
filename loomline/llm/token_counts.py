"""Token counts by the whole-token shortcut.

Once, on the driver, every vocabulary string is merged alone; those that end as one token are
proved. A text is cut at its spaces into pre-tokens that no merge crosses. A pre-token that is
proved counts as one, and only the rest are merged.

Cases: null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives an
empty table; a column named like the result is replaced; other columns pass through unchanged.
Text of any length is held one row at a time, and no pre-token of over 64 characters is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import held, without
from .pieces import Counts, Vocabulary, whole_tokens


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """docs with out_col, the number of tokens of its text under the piece model at model_path.

    The vocabulary is read on the driver and broadcast: its size does not grow with docs.
    """
    vocabulary = Vocabulary.load(model_path)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = held("counts:" + model_path, lambda: Counts(*sent.value))
        for texts in batches:
            yield pd.Series([counts.of(t) for t in texts], dtype="int64")

    return without(docs, [out_col]).withColumn(out_col, counted(F.col(f"`{text_col}`")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )
