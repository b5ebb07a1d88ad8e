"""Text normalisation, number parsing and group-name cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that a CSV reader takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def squeeze(text: Column) -> Column:
    """Trimmed, with every run of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def _likely(text: Column) -> Column:
    return F.ascii(text).between(9, 57) | F.ascii(text).isin(73, 105)


def number_of(text: Column) -> Column:
    """Text as double, NULL where it is not a number (Spark's cast alone would take '1d').

    The first character is looked at before the pattern, so prose costs next to nothing.
    """
    return F.when(_likely(text) & text.rlike(_NUMBER), text.try_cast("double"))


def integer_of(text: Column) -> Column:
    """Text as 64-bit integer, NULL where it is none or does not fit."""
    likely = F.ascii(text).between(9, 57)
    return F.when(likely & text.rlike(_INTEGER), text.try_cast("long"))


def is_integer(text: Column, number: Column) -> Column:
    """Whether a text whose number is known is written as an integer of 64 bits."""
    marks = F.contains(text, F.lit(".")) | F.contains(F.lower(text), F.lit("e")) | F.contains(
        F.lower(text), F.lit("n"))
    return number.isNotNull() & (F.abs(number) < F.lit(9.2e18)) & ~marks


def money_number_of(text: Column) -> Column:
    """Number behind thousands separators, ``$`` and ``%``; a percentage is not divided by 100.

    The first character is looked at before anything is replaced: it is one of a number or one that is left out.
    """
    return F.when(_likely(text), number_of(F.regexp_replace(text, r"[,$%]", "")))


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TOKENS), text)


def clean_group_name(name: Column) -> Column:
    """Title_Case name without punctuation, cut at 60 characters on a ``_``."""
    bare = F.trim(F.regexp_replace(name, r"(?U)[^\w\s-]", ""))
    joined = F.regexp_replace(bare, r"(?U)\s+", "_")
    parts = F.filter(F.split(joined, "_"), lambda w: w != "")
    titled = F.array_join(
        F.transform(parts, lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(F.substr(w, F.lit(2))))),
        "_",
    )
    cut = F.regexp_replace(F.substring(titled, 1, 60), r"_[^_]*$", "")
    short = F.when(F.char_length(titled) > 60, cut).otherwise(titled)
    return F.when(short == "", F.lit("Untitled_Group")).otherwise(short)
