import time
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomline.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_no_held_out_labels_learned(spark):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pandas()
    toxic = dict(zip(labels["doc_id"], labels["toxic"]))
    rows = X.query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(toxic[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in toxic]
    y, p, _ = map(np.array, zip(*held))
    assert ((y == 1) & (p == 1)).sum() / (y == 1).sum() > 0.85
    assert ((y == 0) & (p == 1)).sum() / (y == 0).sum() < 0.01
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_disguised_words_are_restored(spark):
    docs = spark.createDataFrame([("the word idiot and trash and other stupid things " * 20,)], "text string")
    decoder = X.Decoder(X.log_model(X.gram_counts(docs, "text")))
    for seen, meant in [("1d10t", "idiot"), ("s t u p i d", "stupid"), ("tr@sh", "trash"), ("st.up.id", "stupid"), ("idiiiiiot", "idiot")]:
        assert decoder[seen] == meant
    reader = X.Reader(decoder)
    assert "idiot" in X.restored_words("You 1d10t!", reader) and not X.restored_words(None, reader)
    assert "stupid" in X.restored_words("so s t u p i d, they say", reader) and "stupid" in X.restored_words("s-t u p i d", reader)


def test_letters_with_marks_count_as_their_base(spark):
    docs = spark.createDataFrame([("ein blödes großes mädchen und élève français " * 20,)], "text string")
    decoder = X.Decoder(X.log_model(X.gram_counts(docs, "text")))
    assert X.folded("BLÖDES Straße") == "blodes strase" and X.gram_counts(docs, "text")[X.EDGE, 1, 11, 14] == 20
    assert "blodes" in X.restored_words("bl0d3s Blöö0des", X.Reader(decoder)) and "eleve" in X.restored_words("él3ve", X.Reader(decoder))


def test_very_long_tokens_take_time_in_proportion(spark):
    docs = spark.createDataFrame([("the word idiot and other things " * 20,)], "text string")
    reader = X.Reader(X.Decoder(X.log_model(X.gram_counts(docs, "text"))))
    began = time.process_time()
    n = 1_000_000
    for text in ("abcdefghij" * (n // 10), "a" * n, "ab1" * (n // 3), "a.b" * (n // 3) + "1", "x " * (n // 2), "é" * n, "1" * n):
        assert X.restored_words(text, reader) or text[0] == "1"
    assert time.process_time() - began < 60
    far = "q" * 700 + "1d10t" + "q" * 700
    assert any("idiot" in w for w in X.restored_words(far, reader))


def test_viterbi_finds_the_best_of_all_paths(spark):
    rng = np.random.default_rng(1)
    model = X.log_model(rng.integers(0, 9, (X.SYMBOLS,) * 4).astype(float))
    decoder = X.Decoder(model)

    def score(path):
        state, total = (X.EDGE,) * 3, 0.0
        for x, cost in path:
            total += cost
            if x:
                total += float(model[state + (X.symbol(x),)])
                state = state[1:] + (X.symbol(x),)
        return total + float(model[state + (X.EDGE,)])

    for seen in ["1a", "a11", "aab", "4-1t", "aaa1"]:
        paths, before = [[]], ""
        for c in seen:
            ways = [(c, 0.0)] + [("", X.DROP_REPEAT)] * (c == before) if c.isalpha() else [(x, X.AS_SIGN) for x in X.STANDS_FOR.get(c, "")] + [("", X.DROP_SIGN if c in X.STANDS_FOR else X.DROP_GAP)]
            before = c
            paths = [p + [w] for p in paths for w in ways]
        best = max(paths, key=score)
        got = decoder.decode(seen)
        assert abs(score(best) - max(score(p) for p in paths if "".join(x for x, _ in p) == got)) < 1e-4


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, None), (None, 1)], "id long, toxic int")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "y")], "doc_id long, text string, SCORE string")
    got = X.with_toxicity(docs, labels, X.fifth(F.col("id")))
    assert got.columns == ["doc_id", "text", "score", "predicted"] and all(0 <= r.score < 1 for r in got.collect())
    assert X.with_toxicity(docs.limit(0), labels, F.lit(False)).count() == 0
