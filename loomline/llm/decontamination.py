"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of `window` words (the whole item if it is shorter). All words of a
window must stand in a document, so its prefix is one word: the one that the fewest words of all
documents are. Documents are joined by their words with the prefixes; the word's place in the window
gives the only start (positional bound), which must leave room for the window (length bound); and
the words there are compared with the window's.

Where the prefixes' rows are small they are sent to all tasks and places are verified as they are met.
Beyond BROADCAST_BYTES the documents' (place, word) rows meet them by shuffle, without the text; what a
document met comes back to its text as one row, and is verified there. Words are counted the same way. A
word that very many windows hold is salted.

Cases: null texts have no words; items without words or with a null id take no part; an item that
stands twice in the benchmark counts once; equal documents are judged each; a text of any length is taken whole, its words as one array; a benchmark without
rows hits nothing; an empty table gives an empty table; columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import checkpointed, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, where A-Z are letters still.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = BETWEEN.replace("[", "[^", 1)
#: Benchmark rows are broadcast only up to this many bytes; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 24 << 20
#: Parts that each word's rows are dealt into where they meet by shuffle.
SALT = 16


def _split(text: Column) -> Column:
    """Words, with an empty string before or behind where the text begins or ends between words."""
    return F.split(text, BETWEEN)


def _fits(small: DataFrame, bytes_of: Column) -> bool:
    """Whether the rows of small together stay under the bound."""
    return small.agg(F.coalesce(F.sum(bytes_of + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES


def _by_word(many: DataFrame, small: DataFrame, fits: bool, how: str = "inner") -> DataFrame:
    """many joined with small by word: by broadcast if it fits, else by shuffle, each word's rows dealt out by a salt."""
    if fits:
        return many.join(F.broadcast(small), "word", how)
    salted = many.withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALT)))
    each = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    return salted.join(each, ["word", "salt"], how).drop("salt")


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(words, line, items): each distinct window with the ids of the items that have it."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    items = benchmark.select(F.col(id_col).alias("item"), F.filter(_split(lower), lambda w: w != "").alias("all")).where(
        F.col("item").isNotNull() & (F.size("all") > 0)
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    windows = items.select("item", "all", F.explode(starts).alias("start")).select(
        "item", F.slice("all", F.col("start"), F.lit(window)).alias("words")
    )
    return windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("line", F.array_join("words", " "))


def word_counts(docs: DataFrame, vocabulary: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents for the words of the vocabulary; words that none has are left out."""
    words = docs.select(F.explode(_split(F.col(text_col))).alias("w")).select(F.lower("w").alias("word"))
    if _fits(vocabulary, F.octet_length("word")):
        return words.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left_semi")


def with_prefix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, place, size, line, items): each window under its rarest word, the first place of equals.

    Windows with a word that no document has are dropped: they occur nowhere.
    """
    each = windows.select("line", F.posexplode("words").alias("place", "w")).select("line", "place", F.lower("w").alias("word"))
    ranked = _by_word(each, counts, _fits(counts, F.octet_length("word")), "left").groupBy("line").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "word")).alias("rarest"), F.count(F.lit(1)).alias("size")
    )
    return ranked.where("rarest.n > 0").join(windows, "line").select("rarest.word", "rarest.place", F.col("size").cast("int").alias("size"), "line", "items")


def occurrences(docs: DataFrame, prefixes: DataFrame, key: list[Column], text_col: str) -> DataFrame:
    """key, start, size, items: every place of a document where a window stands."""
    words = docs.select(*key, _split(F.col(text_col)).alias("parts"))
    names = words.columns[:-1]
    start = F.col("pos") - F.col("place")
    there = lambda parts, at, size: F.translate(F.array_join(F.slice(parts, F.greatest(at, F.lit(0)) + 1, size), " "), UPPER, LOWER)
    if _fits(prefixes, F.octet_length("line") + 8 * F.size("items")):
        each = words.select(*names, "parts", F.posexplode("parts").alias("pos", "w")).withColumn("word", F.lower("w"))
        inside = (start >= 0) & (start + F.col("size") <= F.size("parts"))
        met = _by_word(each, prefixes, True).where(inside & (there(F.col("parts"), start, F.col("size")) == F.col("line")))
        return met.select(*names, start.alias("start"), "size", "items")
    each = words.select(*names, F.size("parts").alias("n_parts"), F.posexplode("parts").alias("pos", "w")).select(*names, "n_parts", "pos", F.lower("w").alias("word"))
    lines = prefixes.select("word", "place", "size", F.xxhash64("line").alias("line"))
    met = _by_word(each, lines, False).where((start >= 0) & (start + F.col("size") <= F.col("n_parts")))
    found = met.groupBy(*names).agg(F.collect_list(F.struct(start.alias("start"), "size", "line")).alias("found"))
    found = found.select(*[F.col(c).alias(f"{c}_") for c in names], "found")
    on = [F.equal_null(F.col(c), F.col(f"{c}_")) for c in names]
    stands = F.filter("found", lambda x: F.xxhash64(there(F.col("parts"), x["start"], x["size"])) == x["line"])
    places = words.join(found, on).select(*names, "parts", F.explode(stands).alias("x"))
    line = there(F.col("parts"), F.col("x.start"), F.col("x.size"))  # the words themselves decide
    return places.select(*names, "x.start", "x.size", line.alias("line")).join(prefixes.select("line", "items"), "line").select(*names, "start", "size", "items")


def judged(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (share * n_hit >= n_words > 0 hit)."""
    windows = checkpointed(item_windows(benchmark, window, item_col, item_text))
    vocabulary = windows.select(F.explode("words").alias("w")).select(F.lower("w").alias("word")).distinct()
    counts = checkpointed(word_counts(docs, vocabulary, text_col))
    prefixes = checkpointed(with_prefix(windows, counts))
    own = [F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text")]
    met = checkpointed(occurrences(docs, prefixes, own, text_col))
    keys = ["__id", "__text"]
    places = met.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
    hits = places.groupBy(*keys, "at").count().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    items = met.select(*keys, F.explode("items").alias("item")).withColumn("item", F.col("item").cast("string")).distinct()
    items = items.groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = hits.join(items, [F.equal_null(hits[k], items[k]) for k in keys]).select(*[hits[k].alias(k) for k in keys], "n_hit", "items")
    found = checkpointed(found)
    found = F.broadcast(found) if _fits(found, F.octet_length(F.array_join("items", ",")) + F.lit(40)) else found
    results = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    base = without(docs, results).withColumn("n_words", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__own", F.xxhash64(text_col))
    joined = base.join(found, F.equal_null(F.col(id_col), F.col("__id")) & (F.col("__own") == F.col("__text")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        *base.columns[:-1],
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS line
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS line
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT dw.k, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, line)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM met) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""
