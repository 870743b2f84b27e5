"""Scalar text expressions of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters and digits, with one inner apostrophe.
WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_loop(tokens: Column) -> Column:
    """Over six words, of which at most max(2, a third) are distinct."""
    n = F.size(tokens)
    return (n > 6) & (F.size(F.array_distinct(tokens)) <= F.greatest(F.lit(2), F.floor(n / 3)))


def back_to_back(tokens: Column, phrase: Column) -> Column:
    """How often the phrase (an array of words) stands in tokens one right after the other at most, read from the left."""
    n = F.size(phrase)
    start = F.struct(F.lit(0).alias("free"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, i: Column) -> Column:
        here = F.slice(tokens, i + 1, n) == phrase
        run = F.when(i < a["free"], a["run"]).when(here, a["run"] + 1).otherwise(0)
        return F.struct(F.when((i >= a["free"]) & here, i + n).otherwise(a["free"]).alias("free"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.when((n > 0) & (F.size(tokens) >= n), F.aggregate(F.sequence(F.lit(0), F.size(tokens) - n), start, step, lambda a: a["best"])).otherwise(0)


def clock(ms: Column, sep: str = ",") -> Column:
    """hh:mm:ss and milliseconds; null where the time is unknown."""
    h, m, s = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d" + sep + "%03d", h, m, s, ms % 1000))


def short_clock(ms: Column) -> Column:
    """m:ss or h:mm:ss; --:-- where the time is unknown."""
    h, m, s = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    return F.when(ms.isNull(), "--:--").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def script_share(text: Column, script: str) -> Column:
    """Share of letters that are of a script (a character class); 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, f"[^{script}]", ""))
    return F.when(letters > 0, own / letters).otherwise(0.0)


def language_tag(share: Column, engine: Column) -> Column:
    """urdu from one half on; english by engine; mixed from a twentieth on; else english, null if unknown."""
    return F.when(share >= 0.5, "urdu").when(engine.isin("parakeet", "sherpa"), "english").when(share >= 0.05, "mixed").when(share.isNotNull(), "english")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def folded(text: Column) -> Column:
    """Arabic letter variants as one, marks gone, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, "يكهى", "یکہی"), r"\p{M}", ""))


def search_hit(haystack: Column, query: Column) -> Column:
    """Every word of the query stands in the folded haystack."""
    hay = folded(haystack)
    return F.forall(F.filter(F.split(folded(query), r"\s+"), lambda w: w != ""), lambda w: F.contains(hay, w))


def detect_format(text: Column) -> Column:
    """vtt, srt or json by content; null if none."""
    t = F.regexp_replace(text, "^[﻿\\s]+", "")
    stamp = r"\d{1,2}:\d{2}:\d{2},\d{3}\s*-->"
    return F.when(F.startswith(t, F.lit("WEBVTT")), "vtt").when(F.startswith(t, F.lit("{")), "json").when(F.rlike(t, F.lit(stamp)), "srt")


def stamp_ms(text: Column, at: int = 1) -> Column:
    """Milliseconds of the at-th hh:mm:ss,mmm (or .mmm) stamp of a line; hours may have any number of digits."""
    found = F.get(F.regexp_extract_all(text, F.lit(r"\d+:\d{2}:\d{2}[,.]\d{3}"), F.lit(0)), F.lit(at - 1))
    part = lambda k: F.regexp_extract(found, r"(\d+):(\d+):(\d+)[,.](\d+)", k).cast("long")
    return F.when(found.isNotNull(), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def common_ends(a: Column, b: Column) -> tuple[Column, Column]:
    """Lengths of the common beginning and end of two texts, which don't overlap in either; linear in the texts."""
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    n = F.least(F.size(x), F.size(y))
    first_odd = lambda p, q, m: F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(p, 1, m), F.slice(q, 1, m), lambda u, v: u == v), False), F.lit(0)) - 1, m)
    prefix = first_odd(x, y, n)
    return prefix, first_odd(F.reverse(x), F.reverse(y), n - prefix)


def content_id(data: Column, end: int = 1 << 20) -> Column:
    """Size and SHA-256 of the first and last `end` bytes of binary data; of all of it, if it isn't longer than both."""
    n = F.octet_length(data)
    ends = F.when(n <= 2 * end, data).otherwise(F.concat(F.substring(data, 1, end), F.substring(data, -end, end)))
    return F.concat(n.cast("string"), F.lit("-"), F.sha2(ends, 256))


def safe_name(text: Column) -> Column:
    """A file name: letters, digits, dots and dashes; others as one dash."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}._-]+", "-"), r"^-+|-+$", "")


def memory_failure(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit(r"out of memory|oom|cannot allocate|bad_alloc"))
