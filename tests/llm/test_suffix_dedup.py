import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomline.llm import suffix_dedup
from loomline.llm.induced_sort import _agree, suffix_order
from loomline.llm.suffix_dedup import remove_repeated_strings, repeated_starts


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, texts, width):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r) for r in remove_repeated_strings(docs, width).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


@pytest.mark.parametrize("letters,n,in_memory,popped", [(2, 300, 8, 5), (3, 2000, 100, 50), (200, 3000, 1 << 20, 1 << 10), (1, 50, 4, 3), (5, 900, 64, 300), (3, 1, 4, 4)])
def test_suffixes_and_common_prefixes(letters, n, in_memory, popped):
    data = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    data = np.concatenate([data, data[: n // 2]])
    raw = data.tobytes()
    order, prefix = suffix_order(data, 400, in_memory, popped)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    for a, b, k in zip(order[:-1].tolist(), order[1:].tolist(), prefix[1:].tolist()):
        assert raw[a : a + k] == raw[b : b + k] and (k == 400 or raw[a + k : a + k + 1] != raw[b + k : b + k + 1])


def test_queues_are_on_disk_and_recursion_goes_on():
    data = np.random.default_rng(5).integers(97, 101, 200_000).astype(np.uint8)
    data = np.concatenate([data, data[50_000:150_000]])
    seen = {}
    order, prefix = suffix_order(data, 400, 1000, 5000, seen)
    assert seen["spilled"] > 200_000 and seen["levels"] > 3 and isinstance(order.base, np.ndarray)
    usual = {}
    suffix_order(np.tile(data, 4), 400, stats=usual)
    assert usual["spilled"] > 0  # in the usual setting a text of 1.2 MB is on disk
    again, same = suffix_order(data, 400, 1 << 20)
    assert (order == again).all() and (prefix == same).all()


def test_crowded_keys_give_the_same(spark):
    rng = np.random.default_rng(4)
    line = "".join(rng.choice(list("abcdefgh "), 300))
    texts = ["".join(rng.choice(list("ijklmnop "), 200)) + line + "".join(rng.choice(list("ijklmnop "), 200)) for _ in range(60)]
    texts += [texts[0], "x" + texts[1][100:] + "y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for crowded in (0, 5, 4096):
        rows = remove_repeated_strings(docs, 350, crowded=crowded).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert [tuple(r) for r in rows] == brute(texts, 350)


def test_only_crowded_strings_are_hashed_whole(monkeypatch):
    """A crowded passage in a long text: its own strings are hashed, not the text around it."""
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = letters(350)
    table = pa.table({"text": [letters(3000) + line + letters(3000), None, line, "z" + line]})
    key = np.sort(suffix_dedup._runs(np.frombuffer(line.encode(), np.uint8), np.array([0, 350]), 350, False)[0])
    hashed, runs = [], suffix_dedup.runs
    monkeypatch.setattr(suffix_dedup, "runs", lambda x, k: hashed.append(len(x)) or runs(x, k))
    order, _, one, two, found = suffix_dedup._segments(table, key, np.ones(1, bool), 350)
    assert not order and sum(hashed) < 2 * 2000
    data, places = found[0][2], found[0][6]
    strings = [data[p : p + 350].tobytes() for p in places.tolist()]
    assert line.encode() in strings and len(set(zip(one.tolist(), two.tolist()))) == len(set(strings)) < len(strings) == len(one)


def test_short_runs_of_words_stay(spark):
    one, two = " ".join(f"wo{i}" for i in range(60)), " ".join(f"a-rather-long-word-{i}" for i in range(20))
    docs = spark.createDataFrame([(k, f"begin{k} {one} middle{k * 7} {two} end{k}") for k in range(3)], "doc_id long, text string")
    kept = [r.kept_text for r in remove_repeated_strings(docs, 160, least_words=50).orderBy("doc_id").collect()]
    assert all("wo30" not in t and two in t and f"begin{k}" in t for k, t in enumerate(kept))


def test_repeats_within_and_across_segments():
    segments = [b"abcabcabcabc", b"xxabcabyy", b"zzzz"]
    got = repeated_starts(segments, [1, 1, 2], 4)
    assert got[0].all() and got[1].tolist() == [False, False, True, True, False, False] and got[2].tolist() == [True]


def test_strings_of_near_copies_that_stand_once_are_not_sorted(monkeypatch):
    """Copies that differ in every 300th byte have no string of 400 in common, though the least grams of both halves often are."""
    rng = np.random.default_rng(8)
    data = rng.integers(97, 123, 30_000).astype(np.uint8)
    other = data.copy()
    other[::300] = 65
    same = rng.integers(97, 123, 1000).astype(np.uint8).tobytes()
    segments, sorted_bytes = [data.tobytes(), other.tobytes(), same + b"x", b"y" + same], []
    order = suffix_dedup.suffix_order
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda text, *a, **k: sorted_bytes.append(len(text)) or order(text, *a, **k))
    got = repeated_starts(segments, [1] * 4, 400)
    assert not got[0].any() and not got[1].any() and got[2].tolist() == [True] * 601 + [False] and got[3].tolist() == [False] + [True] * 601
    assert sorted_bytes == [2002]


@pytest.mark.parametrize("kind", [np.uint16, np.int32])
def test_agreement_of_suffixes(kind):
    rng = np.random.default_rng(6)
    t = np.concatenate([np.tile(rng.integers(1, 400, 90), 4), rng.integers(1, 3, 60), [0]]).astype(kind)
    a, b = rng.integers(0, len(t), (2, 4000))
    n = [next((k for k in range(50) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 50) for i, j in zip(a.tolist(), b.tolist())]
    assert _agree(t, a, b, 50).tolist() == n and max(n) == 50 and len(set(n)) > 10


@pytest.mark.parametrize("width", [20, 400])
def test_small_cases(spark, width):
    rng = np.random.default_rng(3)
    line = "".join(rng.choice(list("abcdefgh é"), 900))
    texts = [None, "", "short", "a" * 3000, "ab" * 900, line, "x" + line[100:700] + "y", line[:450] + "q" + line[450:], line, "é" * 500, line[:399]]
    assert result(spark, texts, width) == brute(texts, width)


def test_whole_table(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    got = result(spark, texts, 400)
    assert got == brute(texts, 400) and sum(x[1] for x in got) > 0


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 5, "s")], "doc_id long, text string, N_BYTES int, shard string")
    got = remove_repeated_strings(docs)
    assert got.columns == ["doc_id", "text", "shard", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and got.first().n_bytes == 3
    assert remove_repeated_strings(docs.limit(0)).count() == 0
