"""Word lists, content ids and splices at their edges."""

import hashlib

from pyspark.sql import functions as F

from loomline.functions import numbers as N, text as X
from loomline.sources import wordlists


def test_entries_are_taken_or_refused_by_name(spark):
    good = '[[entry]]\nname = "a"\nroman = ["Bull Shop", "f***"]\nscript = ["كتاب"]\n[[entry]]\nname = "b"\nroman = ["bullshop", "Straße"]\n'
    odd = '[[entry]]\nname = "c"\nroman = ["x"]\ncolour = 1\n[[entry]]\nroman = ["x"]\n[[entry]]\nname = "d"\n[[entry]]\nname = "e"\nroman = ["..."]\n[[entry]]\nname = "f"\nroman = ["a b c d"]\n[[entry]]\nname = "g"\nroman = ["late", "F***"]\n'
    files = [("one", 1, good), ("two", 2, odd), ("three", 3, "not = toml ="), ("four", 4, '[[word]]\nname = "a"\n'), ("five", 5, "")]
    words, refused = wordlists.load(spark.createDataFrame(files, "list string, place long, toml string"))
    assert {tuple(r) for r in words.collect()} == {("bull shop", "one:a"), ("bullshop", "one:a"), ("f***", "one:a"), ("کتاب", "one:a"), ("strasse", "one:b"), ("late", "two:g")}
    assert {tuple(r) for r in refused.collect()} == {
        ("two", "c", "unknown key colour"), ("two", None, "no name"), ("two", "d", "no spelling"), ("two", "e", "a spelling without letters"), ("two", "f", "a spelling of over three words"),
        ("three", None, "no TOML"), ("four", None, "no list of [[entry]] tables alone"), ("five", None, "no list of [[entry]] tables alone"),
    }


def test_content_ids_take_both_ends_only_of_what_is_longer(spark):
    rows = spark.createDataFrame([(bytearray(range(n)),) for n in (0, 7, 8, 9, 40)], "b binary").select("b", X.content_id(F.col("b"), 4).alias("i")).collect()
    for b, i in rows:
        ends = bytes(b) if len(b) <= 8 else bytes(b[:4] + b[-4:])
        assert i == f"{len(b)}-{hashlib.sha256(ends).hexdigest()}"


def test_ends_beyond_any_old_bound_and_the_tail_of_many_throws(spark):
    pairs = [("x" * 900 + "a" + "y" * 700, "x" * 900 + "b" + "y" * 700), ("", "abc"), ("aaa", "aa"), ("abc", "abc"), ("ab", "ba")]
    a, b = X.common_ends(F.col("a"), F.col("b"))
    got = [tuple(r) for r in spark.createDataFrame(pairs, "a string, b string").select(a, b).collect()]
    assert got == [(900, 700), (0, 0), (2, 0), (3, 0), (0, 0)]
    throws = [(0, 5), (5, 5), (3, 5), (700, 1400), (1000, 1900), (50_300, 100_000), (0, 4000), (600_000, 1_000_000)]
    tails = [r.p for r in spark.createDataFrame(throws, "w long, n long").select(N.sign_tail(F.col("w"), F.col("n")).alias("p")).collect()]
    from math import comb

    for (w, n), p in zip(throws[:5], tails):
        assert abs(p - sum(comb(n, k) for k in range(w, n + 1)) / 2**n) < 1e-10
    assert abs(tails[5] - 0.0290) < 2e-4 and tails[6] == 1.0 and tails[7] == 0.0
