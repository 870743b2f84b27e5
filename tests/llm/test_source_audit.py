import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import perfect_hash, source_audit
from loomline.llm.hashing import buffers


def arrays(keys):
    data, at = buffers(pa.array(keys, pa.large_binary()))
    return data, at[:-1], at[1:]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4096])
def test_slots_are_minimal_and_strangers_are_told_apart(n):
    keys = [b"k%d" % i + b"x" * (i % 40) for i in range(n)]
    made = perfect_hash.build(*arrays(keys))
    shards = perfect_hash.Shards(1, [(0, made)])
    slots = shards.find(*arrays(keys))
    assert sorted(slots) == list(range(n))
    stored = [made.keys[a:b].tobytes() for a, b in zip(np.append(0, made.ends[:-1]), made.ends)]
    assert all(stored[s] == k for k, s in zip(keys, slots))
    assert set(shards.find(*arrays([b"q" + k for k in keys] + [b"", b"z" * 5000]))) == {-1}


def test_shards_that_are_not_there_hold_nothing():
    keys = [b"w%d" % i for i in range(900)]
    data, starts, ends = arrays(keys)
    shard = perfect_hash.dealt(data, starts, ends, 3)
    some = perfect_hash.Shards(3, [(s, perfect_hash.build(*arrays([k for k, o in zip(keys, shard) if o == s]))) for s in (2, 0)])
    found = some.find(data, starts, ends)
    assert ((found >= 0) == (shard != 1)).all() and len(set(found[found >= 0])) == (shard != 1).sum()


def brute_force(rows, least, ranks):
    """The contract, term by term."""
    docs = defaultdict(lambda: defaultdict(set))
    count, groups = defaultdict(Counter), defaultdict(set)
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for w in "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" "):
            if w:
                docs[lang][w].add(k)
                count[lang, source][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for w, ds in docs[lang].items() if len(ds) >= least]
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        q = p(sum((count[lang, s] for s in sources), Counter()))
        own = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            parts = {"pair": [(o, sum((own[s][w] - own[o][w]) ** 2 // own[o][w] for w in kept)) for o in sources if o != s]}
            parts["term"] = [(w, (own[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[lang, s][w] and own[s][w] > q[w]]
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < ranks]
    return sorted(out)


def rows_of(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "日本語", "ab-cd", "x1y", "don't", "w" * 300, " q"] + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    text = lambda: " ".join(r.choices(words, k=r.randrange(60))) if r.random() > 0.1 else r.choice([None, "", "12 34"])
    return [(text(), r.choice(["en", "en", "fr", None, "xx"]), "hot" if r.random() < 0.4 else r.choice(["s1", "s2", "é", None])) for _ in range(n)] + [("one two", "lonely", "s")]


@pytest.mark.parametrize("batch_bytes, per_shard, slots", [(32 << 20, 4096, 8 << 20), (3000, 64, 0)])
def test_rows_equal_brute_force(spark, monkeypatch, batch_bytes, per_shard, slots):
    monkeypatch.setattr(source_audit, "SLOTS", slots)
    rows = rows_of(3, 400)
    docs = spark.createDataFrame([(*x, "v") for x in rows], "text string, lang string, source string, value string").repartition(3)
    got = source_audit.audited(docs, ranks=20, batch_bytes=batch_bytes, per_shard=per_shard)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 3, 20)


def test_an_empty_table_and_texts_without_terms(spark):
    kind = "text string, lang string, source string"
    assert source_audit.audited(spark.createDataFrame([], kind)).collect() == []
    got = source_audit.audited(spark.createDataFrame([(None, None, None), ("1", None, "b"), ("x", "en", "a")], kind)).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_of_counts_beyond_32_bits():
    counts = np.array([0, 5, 10**13, 3 * 10**14])
    assert list(source_audit.shares(counts, 10**15, 7)) == [1 + 10**9 * (int(c) + 1) // (10**15 + 7) for c in counts]
