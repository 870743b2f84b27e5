"""Best-score piece encoding by an Aho-Corasick automaton, and decoding.

The automaton over all pieces reads a text once; at each position the pieces that end there, along
the output links, relax the best score so far (Viterbi). Pre-tokens are segmented apart, as no
piece crosses a space, and repeated ones are looked up.

What comes out is the best sum of the pieces' scores. For a unigram model that is the library's encoding; for a BPE model, whose
scores are the ranks of merges, the library merges instead, and its pieces are often others. Either decodes to the text.

Cases: null and empty texts have no ids and decode to the empty text; a character without a piece
is written as its UTF-8 bytes; a literal mark U+2581 counts as a space and decodes to one; repeated
rows are encoded each; a text of any length is taken whole; an empty table gives an empty table; columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import held, without
from .pieces import SPACE, Automaton, Decoded, Segments, Vocabulary


#: Texts that are coded at a time.
STEP = 200


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids", check_col: str | None = None) -> DataFrame:
    """docs with out_col, array<int>: the ids of the best-score segmentation of its text.

    With check_col, also whether decoding them gives the text back. The automaton is built from the
    vocabulary, which is broadcast; it does not grow with docs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    docs = without(docs, [out_col, *[check_col] * bool(check_col)])
    new = [T.StructField(out_col, T.ArrayType(T.IntegerType()))]
    if check_col:
        new.append(T.StructField(check_col, T.BooleanType()))
    schema = T.StructType([*docs.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, back = held("segments:" + model_path, lambda: (Segments(Automaton(sent.value), sent.value), Decoded(sent.value)))
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                texts = batch.column(text_col).to_pylist()
                coded = segments.of(texts)
                ends = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))]
                if check_col:
                    same = [back.of(np.frombuffer(x, "<i4")) == (t or "").replace(SPACE, " ").encode("utf-8", "surrogatepass") for x, t in zip(coded, texts)]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col, the text of its ids; null ids give the empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = without(rows, [out_col])
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = held(model_path + "-back", lambda: Decoded(sent.value))
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                texts = [back.of(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), check_col="decodes")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "decodes")
