"""Word lists: TOML files of [[entry]] tables, as spellings that are looked up and entries that are refused by name."""

from __future__ import annotations

import tomllib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Keys of an entry that hold spellings, and words that a spelling may have.
KEYS, WORDS = ("roman", "script", "disguised"), 3
#: Letters that are one in comparison, and short vowels that don't count.
ONE, VOWELS = str.maketrans("يكهىة", "یکہیہ"), {chr(c) for c in range(0x064B, 0x0653)}


def normal(text: str) -> str:
    """Compatibility forms and case folded, letter variants one; letters, marks, digits and * only."""
    folded = unicodedata.normalize("NFKC", text).casefold().translate(ONE)
    return "".join(c for c in folded if c not in VOWELS and (c == "*" or unicodedata.category(c)[0] in "LMN"))


def read_entries(toml: str) -> Iterator[tuple[int, int, str | None, list[str] | None, str | None]]:
    """(entry, place, name, words, reason) of each spelling of a file; with a reason, of what is refused. Entry -1 is the file."""
    try:
        tables = tomllib.loads(toml)
    except tomllib.TOMLDecodeError:
        yield -1, 0, None, None, "no TOML"
        return
    entries = tables.get("entry")
    if set(tables) - {"entry"} or not isinstance(entries, list) or not entries:
        yield -1, 0, None, None, "no list of [[entry]] tables alone"
        return
    for i, e in enumerate(entries):
        name = e.get("name") if isinstance(e, dict) else None
        if not isinstance(name, str) or not name:
            yield i, 0, None, None, "no name"
            continue
        spellings = [s for key in KEYS for s in e.get(key, [])]
        parts = [[p for p in map(normal, s.split()) if p] if isinstance(s, str) else [] for s in spellings]
        odd = sorted(set(e) - {"name", *KEYS})
        why = f"unknown key {odd[0]}" if odd else "no spelling" if not spellings else "a spelling without letters" if not all(parts) else "a spelling of over three words" if any(len(p) > WORDS for p in parts) else None
        if why:
            yield i, 0, name, None, why
        else:
            yield from ((i, k, name, p, None) for k, p in enumerate(parts))


def load(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spelling, entry) of files (list, place, toml), and (list, name, reason) of what is refused.

    entry is list:name. A phrase counts with spaces and run together. Of files, entries and spellings that have one, the first has it.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, place, toml in zip(part["list"], part["place"], part["toml"]):
                found = list(read_entries(toml or ""))
                yield pd.DataFrame([(name, place, *x) for x in found], columns=["list", "place", "entry", "k", "name", "words", "reason"])

    read = files.select("list", "place", "toml").mapInPandas(rows, "list string, place long, entry long, k long, name string, words array<string>, reason string")
    forms = F.array(F.struct(F.lit(0).alias("form"), F.array_join("words", " ").alias("spelling")), F.struct(F.lit(1).alias("form"), F.array_join("words", "").alias("spelling")))
    each = read.where("reason IS NULL").select("list", "place", "entry", "k", "name", F.explode(forms).alias("f"))
    first = F.min(F.struct("place", "entry", "k", "f.form", F.concat_ws(":", "list", "name").alias("of")))["of"]
    return each.groupBy("f.spelling").agg(first.alias("entry")), read.where("reason IS NOT NULL").select("list", "name", "reason")
