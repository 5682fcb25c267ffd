"""Text functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space of any script, in a form that Java and RE2 read alike.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# fixed value: where a sentence may end; what it matches is left out between two sentences
SENTENCE_BREAK = rf"""(?<=[.!?;:])["'”’)]*{SPACE}+(?=["'“‘(]?[A-Z0-9])"""


def rejoin_hyphens(text: Column) -> Column:
    """Words cut by a hyphen at a line end, made whole."""
    return F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of at least two letters of any alphabet; hyphenation undone; null gives an empty list."""
    return F.regexp_extract_all(F.lower(rejoin_hyphens(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}]{2,})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of runs without white space; null and empty texts have 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def mask_digits(line: Column) -> Column:
    """Lower case, trimmed, runs of digits as one ``#``."""
    return F.trim(F.regexp_replace(F.lower(line), r"[0-9]+", "#"))


def one_line(text: Column) -> Column:
    """Lines as one flow of text: words cut by a hyphen at a line's end made whole, line ends as one blank, trimmed.

    White space within a line stays as it is.
    """
    whole = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(whole, f"{SPACE}*\n{SPACE}*", " "), f"^{SPACE}+|{SPACE}+$", "")


def squash(text: Column) -> Column:
    """Only the letters a-z and digits, lower case: for matching quotations."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """Text in compatibility normal form (NFKC), which has no built-in function; ASCII texts stay as they are."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))


def squash_compatible(text: Column) -> Column:
    """``squash`` after compatibility normalisation."""
    return squash(compatible(text))


def sentences(text: Column, base: Column | None = None, longest: int = 120) -> Column:
    """``array<struct<text, start, end>>``: sentences in order, cleaned by ``one_line``, and where each stands in the text (0-based, plus ``base``).

    Nothing is cut within an open square bracket, unless what stands open has ``longest`` words. Null and blank texts have none.
    """
    # each break is marked on both sides, so that no character is lost and positions can be counted
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  ")
    marked = F.split(F.regexp_replace(plain, SENTENCE_BREAK, "\x01$0\x02"), "\x01")
    kind = "array<struct<raw: string, start: int, fin: int>>"

    def step(done: Column, part: Column) -> Column:
        gap = F.when(F.contains(part, F.lit("\x02")), F.instr(part, "\x02") - 1).otherwise(0)
        raw = F.substring(part, F.when(gap > 0, gap + 2).otherwise(1), F.length(part))
        last = F.try_element_at(done, F.lit(-1))
        bracket = F.size(F.split(last["raw"], r"\[")) > F.size(F.split(last["raw"], r"\]"))
        goes_on = (F.size(done) > 0) & bracket & (word_count(last["raw"]) < longest)
        longer = F.struct(F.concat(last["raw"], F.substring(part, F.lit(1), gap), raw).alias("raw"), last["start"].alias("start"), (last["fin"] + gap + F.length(raw)).cast("int").alias("fin"))
        start = F.coalesce(last["fin"], F.lit(0)) + gap
        fresh = F.struct(raw.alias("raw"), start.cast("int").alias("start"), (start + F.length(raw)).cast("int").alias("fin"))
        return F.when(goes_on, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(fresh)))

    found = F.aggregate(marked, F.array().cast(kind), step)
    offset = F.lit(0).cast("bigint") if base is None else base.cast("bigint")
    cleaned = F.transform(found, lambda x: F.struct(one_line(x["raw"]).alias("text"), (x["start"] + offset).alias("start"), (x["fin"] + offset).alias("end")))
    return F.filter(cleaned, lambda x: x["text"] != "")


def author_pair(a: Column, b: Column) -> Column:
    return F.concat_ws(" - ", F.least(a, b), F.greatest(a, b))
