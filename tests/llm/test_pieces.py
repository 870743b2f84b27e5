import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from loomline.llm import piece_coding
from loomline.llm.pieces import Automaton, Counts, Decoded, Segments, Vocabulary, merged, merged_long, pre_tokens, whole_tokens
from loomline.llm.token_counts import count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "▁a▁▁", "<s></s><unk><0x41>", "\x00a\n\n\tb\r", "中文字 ゼ", "😀é", "a" * 3000, " " * 500, "ab" * 900, "x́y"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(PATH)


def odd_texts(n=3000):
    rng = random.Random(1)
    letters = " ▁  abeth\n\t\r<s>éßñ中😀\x00-_\"'12[]{}"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_are_the_library_s(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    counts = Counts(vocabulary, whole_tokens(vocabulary), room=50)
    for text in odd_texts():
        assert counts.of(text) == len(library.encode(text)), text
    for text in ("abcabc" * 5, "thethethe", "中a" * 20):
        assert merged(text, vocabulary.scores) == merged_long(text, vocabulary.scores)


def test_whole_table_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + [None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_tokens string")
    got = count_tokens(docs, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(library.encode(t or "")) for t in texts]
    assert count_tokens(docs.limit(0), PATH).count() == 0


def best_score(text, vocabulary, unknown):
    score = [0.0] + [float("-inf")] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - 20), i):
            if (s := vocabulary.scores.get(text[j:i])) is not None:
                score[i] = max(score[i], score[j] + s)
        if text[i - 1] not in vocabulary.ids:
            score[i] = max(score[i], score[i - 1] + unknown)
    return score[-1]


def test_segmentation_has_the_best_score_and_decodes(vocabulary):
    automaton = Automaton(vocabulary)
    segments, back = Segments(automaton, vocabulary, room=100), Decoded(vocabulary)
    score = {i: vocabulary.scores[p] for p, i in vocabulary.ids.items()}
    texts = odd_texts(400)
    for text, ids in zip(texts, segments.of(texts)):
        ids = np.frombuffer(ids, "<i4")
        assert back.of(ids).decode() == text.replace("▁", " ")
    for text in {p for t in texts for p in pre_tokens(t) if len(p) < 200}:
        ids = np.frombuffer(automaton.segmented([text.encode()])[0], "<i4").tolist()
        chars = sum(c not in vocabulary.ids for c in text)
        total = sum(score[i] for i in ids if i in score) + chars * automaton.unknown
        assert abs(total - best_score(text, vocabulary, automaton.unknown)) < 1e-3, text


def test_round_trip_of_the_table(spark):
    rows = piece_coding.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.decodes for r in rows)
    docs = spark.createDataFrame([(1, None, 7), (2, "", 8), (None, "a  é\n", 9)], "doc_id long, text string, decoded int")
    got = piece_coding.decode(piece_coding.encode(docs, PATH), PATH).collect()
    assert [r.decoded for r in got] == ["", "", "a  é\n"]
    assert piece_coding.decode(piece_coding.encode(docs.limit(0), PATH), PATH).count() == 0
