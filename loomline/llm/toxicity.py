"""Toxicity of texts after restoring disguised words (noisy-channel decoding), by a learned lexicon.

1. A character 4-gram model is counted over all documents.
2. Words that may be disguised (digits or signs among letters, letters set apart, letters repeated)
   are lattices: each observed character may stand for itself, for letters it is used for, for a
   repeat, or for nothing. Viterbi finds the restored word of greatest channel and model score.
   Letters with marks count as their base letters. A text is cut at white space once; each token is
   looked at in time linear in its length, and what is longer than PIECE is decoded in pieces that
   overlap, so that no text's length matters.
3. Restored words and their beginnings are weighed by their odds in toxic against other labelled
   rows (lower confidence bound), learned from one half of a bounded sample; a logistic curve over
   a text's strongest, summed and relative weights is fitted on the other half.

The sample is at most SAMPLE labelled rows of each class, those of least hash of the id. Everything
else covers all rows and whole texts.

Cases: null and empty texts get the score of a text without any weighty word; without labels of both
classes every score is 0; a document with several labels is toxic if any says so; equal rows get
equal scores; an empty table gives an empty table; columns named like results are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import held, let_go, without
from .hashing import buffers

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 6000
#: Letters a-z, marked or not, are 0 to 25; what parts words is EDGE; any other letter is OTHER.
EDGE, OTHER, SYMBOLS = 26, 27, 28
#: What signs stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "£": "l", "€": "e", "#": "h",
}
#: Log costs of the channel.
AS_SIGN, DROP_SIGN, DROP_GAP, DROP_REPEAT = -1.5, -4.0, -0.5, -1.0
SIGN = "[" + re.escape("".join(STANDS_FOR)) + "]"
AMONG_LETTERS = re.compile(rf"[a-z](?:{SIGN}|[.\-_*·]){{1,3}}[a-z]|^{SIGN}{{1,2}}[a-z]{{2,}}|([a-z])\1\1")
SET_APART = re.compile(rf"(?:(?:[^\W\d_]|{SIGN})[.\-_*·])*(?:[^\W\d_]|{SIGN})[.,;:?]?")
LONG_REPEAT = re.compile(r"([a-z])\1{3,}")
WORDS = re.compile(r"[^\W\d_]+")
#: Letters set apart in a row that may be a word; characters decoded at once, and of these seen again by the next piece.
APART, PIECE, OVERLAP = 4, 256, 64
#: Small letters with marks, as their base letters.
BASE = {c: b for c in range(0xDF, 0x180) if (b := {0xDF: "s", 0xE6: "a", 0xF8: "o", 0x153: "o"}.get(c, unicodedata.normalize("NFD", chr(c).lower())[0])) != chr(c) and "a" <= b <= "z"}


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.lower().translate(BASE)


def symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER if c.isalpha() else EDGE


_SYMBOL_OF_BYTE = np.full(256, EDGE, np.int64)
_SYMBOL_OF_BYTE[97:123] = _SYMBOL_OF_BYTE[65:91] = np.arange(26)
_SYMBOL_OF_BYTE[0xC0:] = OTHER
#: Of letters of two bytes that begin with 0xC3, by the second.
_SYMBOL_AFTER_C3 = np.array([symbol(folded(chr(b + 0x40))[0]) if 0x80 <= b < 0xC0 else OTHER for b in range(256)])
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True


#: Bytes of text whose symbols are counted at once; some fifty times as many are held meanwhile.
BLOCK = 1 << 19


def gram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of 4 consecutive symbols over all texts. As many cells as the alphabet allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            data, _ = buffers(batch.column(0))
            for i in range(0, len(data), BLOCK):
                part = data[max(i - 12, 0) : i + BLOCK]  # four symbols have up to 16 bytes
                at = np.flatnonzero(~_FOLLOWS[part])
                s = _SYMBOL_OF_BYTE[part[at]]
                two = np.flatnonzero((part[at] == 0xC3) & (at + 1 < len(part)))
                s[two] = _SYMBOL_AFTER_C3[part[at[two] + 1]]
                code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
                total += np.bincount(code, minlength=len(total))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**4)
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out.reshape((SYMBOLS,) * 4)


def log_model(counts: np.ndarray, weight: float = 8.0) -> np.ndarray:
    """log P(d | a, b, c), each order smoothed by the next lower one."""
    p = (counts.sum((0, 1, 2)) + 1) / (counts.sum() + SYMBOLS)
    for n in (counts.sum((0, 1)), counts.sum(0), counts):
        p = (n + weight * p) / (n.sum(-1, keepdims=True) + weight)
    return np.log(p).astype(np.float32)


class Decoder(dict):
    """Restored words by disguised one, decoded once when first met; at most `room` are held."""

    def __init__(self, model: np.ndarray, room: int = 20_000) -> None:
        super().__init__()
        self.model, self.room = model, room

    def __missing__(self, observed: str) -> str:
        found = self.decode(observed)
        if len(self) > self.room:
            self.clear()
        if len(observed) <= 64:
            self[observed] = found
        return found

    def decode(self, observed: str) -> str:
        """The best path through the lattice of one observed string."""
        model = self.model
        states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(EDGE, EDGE, EDGE): (0.0, None)}
        before = ""
        for c in observed:
            ways: list[tuple[str, float]] = []
            if c.isalpha():
                ways.append((c, 0.0))
                if c == before:
                    ways.append(("", DROP_REPEAT))
            else:
                ways += [(x, AS_SIGN) for x in STANDS_FOR.get(c, "")]
                ways.append(("", DROP_SIGN if c in STANDS_FOR else DROP_GAP))
            before = c
            after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for x, cost in ways:
                    if x:
                        to = (state[1], state[2], symbol(x))
                        new = score + cost + float(model[state + to[2:]])
                        link = (x, path)
                    else:
                        to, new, link = state, score + cost, path
                    if to not in after or new > after[to][0]:
                        after[to] = (new, link)
            states = after
        _, path = max(((s + float(model[k + (EDGE,)]), p) for k, (s, p) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))

    def pieces(self, observed: str) -> list[str]:
        """The restored words of an observed string of any length, in pieces that may be disguised."""
        observed = LONG_REPEAT.sub(r"\1\1\1", observed)  # no path keeps more
        if len(observed) <= PIECE:
            return [self[observed]]
        parts = (observed[i : i + PIECE] for i in range(0, len(observed) - OVERLAP, PIECE - OVERLAP))
        return [w for x in parts if " " in x or AMONG_LETTERS.search(x) for w in WORDS.findall(self[x])]


class Reader(dict):
    """By token its words, the restored ones among them, and how many letters it sets apart; at most `room` are held."""

    def __init__(self, decoder: Decoder, room: int = 50_000) -> None:
        super().__init__()
        self.decoder, self.room = decoder, room

    def __missing__(self, token: str) -> tuple[tuple[str, ...], int]:
        found = self.read(token)
        if len(self) > self.room:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found

    def read(self, token: str) -> tuple[tuple[str, ...], int]:
        own = folded(token)
        words = (own,) if own.isalpha() else tuple(WORDS.findall(own))
        if AMONG_LETTERS.search(own):
            words += tuple(self.decoder.pieces(own.strip(".,;:?")))
        single = len(words) != 1 or len(words[0]) == 1  # else letters stand together
        return words, (len(own) + 1) // 2 if single and SET_APART.fullmatch(own) else 0

    def apart(self, run: list[str]) -> list[str]:
        """The restored words of tokens that set letters apart."""
        return self.decoder.pieces(folded(" ".join(run)).strip(".,;:?"))


def apart_runs(tokens: list[str], apart: list[tuple[int, int]]) -> Iterator[list[str]]:
    """Tokens in a row that set APART letters or more apart together; apart: (place, letters) of such tokens."""
    i = 0
    while i < len(apart):
        j = i + 1
        while j < len(apart) and apart[j][0] == apart[j - 1][0] + 1:
            j += 1
        if j - i > 1 and sum(n for _, n in apart[i:j]) >= APART:
            yield tokens[apart[i][0] : apart[j - 1][0] + 1]
        i = j


def restored_words(text: str | None, reader: Reader) -> Counter:
    """Words of a text, folded, with the restored ones beside the disguised ones."""
    tokens = (text or "").split()
    read = [reader[t] for t in tokens]
    words = Counter(w for x, _ in read for w in x)
    for run in apart_runs(tokens, [(i, n) for i, (_, n) in enumerate(read) if n]):
        words.update(reader.apart(run))
    return words


def features(word: str) -> list[str]:
    """The word and its beginnings of 4 to 6 letters (marked)."""
    return [word, *[word[:k] + "+" for k in (4, 5, 6) if len(word) > k]]


#: What a token of one weightless word weighs.
PLAIN = (1, 0, 0.0, 0.0, 0)


class Weights(dict):
    """By token (words, weighty ones, their weights' sum and the greatest, letters set apart); at most `room` held.

    A word weighs as much as the weightiest of its features.
    """

    def __init__(self, lexicon: dict[str, float], reader: Reader, room: int = 150_000) -> None:
        super().__init__()
        self.lexicon, self.reader, self.room = lexicon, reader, room

    def of(self, words: Iterable[str], apart: int = 0) -> tuple[int, int, float, float, int]:
        get = self.lexicon.get
        every = [max([get(f, 0.0) for f in features(x)]) for x in words]
        found = [w for w in every if w > 0]
        return (len(every), len(found), sum(found), max(found), apart) if found else PLAIN if len(every) == 1 and not apart else (len(every), 0, 0.0, 0.0, apart)

    def __missing__(self, token: str) -> tuple[int, int, float, float, int]:
        found = self.of(*self.reader.read(token))
        if len(self) > self.room:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


def evidence(text: str | None, weights: Weights) -> tuple[float, float, float]:
    """Strongest weight, log of summed weights, share of weighty words."""
    tokens = (text or "").split()
    found = list(map(weights.__getitem__, tokens))
    n = found.count(PLAIN)
    if n == len(found):
        return 0.0, 0.0, 0.0
    odd = [x for x in found if x is not PLAIN]
    if any(x[4] for x in odd):
        odd += [weights.of(weights.reader.apart(run)) for run in apart_runs(tokens, [(i, x[4]) for i, x in enumerate(found) if x[4]])]
    n += sum(x[0] for x in odd)
    hits = sum(x[1] for x in odd)
    return (max(x[3] for x in odd), math.log1p(sum(x[2] for x in odd)), math.sqrt(hits / n)) if hits else (0.0, 0.0, 0.0)


def labelled(labels: DataFrame, held_out: Column) -> DataFrame:
    """(id, toxic, half): the bounded sample."""
    rows = labels.where(~held_out & F.col("id").isNotNull() & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("h", F.xxhash64("id"))
    sample = rows.where("toxic = 1").orderBy("h", "id").limit(SAMPLE).unionByName(rows.where("toxic = 0").orderBy("h", "id").limit(SAMPLE))
    return sample.select("id", "toxic", F.pmod(F.shiftright("h", 20), F.lit(2)).cast("int").alias("half"))


def learn_lexicon(sample: DataFrame, model, tag: str, least_rows: int = 4, least: float = 1.0) -> dict[str, float]:
    """Weights of features by their odds in toxic rows (text, toxic); lower bounds, only those of at least `least`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = held(tag + "-d", lambda: Reader(Decoder(model.value)))
        for rows in batches:
            seen = [Counter(), Counter()]
            for text, toxic in zip(rows["text"], rows["toxic"]):
                seen[toxic].update({f for w in restored_words(text, reader) for f in features(w)})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"feature": keys, "pos": [seen[1][k] for k in keys], "neg": [seen[0][k] for k in keys]})

    size = sample.groupBy().agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not size.p or not size.n:
        return {}
    rows = sample.mapInPandas(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (size.p + 1)) - F.log((F.col("n") + 0.5) / (size.n + 1))
    bound = odds - F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    kept = rows.where(F.col("p") >= least_rows).select("feature", bound.alias("w")).where(F.col("w") >= least)
    return {r.feature: float(r.w) for r in kept.toLocalIterator()}


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; classes weighted by their size as they are."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def with_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score and predicted. labels: (id, toxic); held_out: those never learned from."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(log_model(gram_counts(docs, text_col)))
    sample = labelled(labels, held_out)
    # at most 2 * SAMPLE ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "toxic", "half")
    tag = uuid.uuid4().hex  # a worker's decoder and weights are of this fit
    lexicon = learn_lexicon(texts.where("half = 0").select("text", "toxic"), model, tag)
    sent = spark.sparkContext.broadcast(lexicon)

    def weigh(series: pd.Series) -> list[tuple[float, float, float]]:
        weights = held(tag, lambda: Weights(sent.value, Reader(Decoder(model.value))))
        return [evidence(t, weights) for t in series]

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(*e, y) for e, y in zip(weigh(rows["text"]), rows["toxic"])], columns=["a", "b", "c", "y"])

    fit = texts.where("half = 1").select("text", "toxic").mapInPandas(weighed, "a double, b double, c double, y int").toPandas()
    both = len(set(fit["y"])) == 2 and bool(lexicon)
    curve = fit_curve(fit[["a", "b", "c"]].to_numpy(float), fit["y"].to_numpy(float)) if both else None

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            if curve is None:
                yield pd.Series(np.zeros(len(series)))
            else:
                x = np.array(weigh(series)).reshape(-1, 3)
                yield pd.Series(1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30))))

    base = without(docs, ["score", "predicted"]).withColumn("score", scored(F.col(f"`{text_col}`")))
    return base.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fifth(id_col: Column) -> Column:
    """Whether a row is held out: crc32 of its id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    out = with_toxicity(docs, labels, fifth(F.col("id")))
    return out.select("doc_id", fifth(F.col("doc_id")).alias("held_out"), "score", "predicted")
