import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomline.llm.substring_dedup import ROWS, CountMin, added, remove_repeated_windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def result(spark, texts, width):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = remove_repeated_windows(docs, width).orderBy("doc_id").collect()
    return [(r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in rows]


@pytest.mark.parametrize("width", [3, 8, 35])
def test_small_cases(spark, width):
    texts = [
        None, "", " \n\t ", "one", "a " * 200, "b c " * 90, "x" * 5000 + " y" * 40, " ".join(map(str, range(80))),
        "z " + " ".join(map(str, range(80))), " ".join(map(str, range(80))), "é ü \x0b ñ " * 30, " ".join(map(str, range(40, 75))),
    ]
    assert result(spark, texts, width) == brute(texts, width)


def test_merged_sketches_never_estimate_less(spark):
    rng = np.random.default_rng(2)
    keys = rng.zipf(1.3, 20_000).astype(np.uint64)
    sketch = CountMin(20_000, 4)  # a narrow one, so that keys share cells
    shards = [sketch.sketch(part) for part in np.array_split(keys, 7)]
    total = [added([(c.astype(np.int64), n) for c, n in (s[row] for s in shards)]) for row in range(ROWS)]
    true = Counter(keys.tolist())
    every = np.array(list(true), np.uint64)
    estimate = np.minimum.reduce([total[row][sketch.cells(every, row).astype(np.int64)] for row in range(ROWS)])
    assert all(e >= true[k] for e, k in zip(estimate.tolist(), every.tolist())) and (estimate > [true[k] for k in every.tolist()]).any()


def test_whole_table(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    got = result(spark, texts, 35)
    assert got == brute(texts, 35)
    assert sum(x[1] for x in got) > 0


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b", 5, "s")], "doc_id long, text string, N_WORDS int, shard string")
    got = remove_repeated_windows(docs)
    assert got.columns == ["doc_id", "text", "shard", "kept_text", "n_words", "n_removed", "kept_sha256"]
    assert got.first().n_words == 2 and got.first().shard == "s"
