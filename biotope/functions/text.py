"""Names, codes and tokens read from untyped tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as missing, and the category standing in for them.
MISSING_TOKENS = ("", "nan", "na", "null", "none")
MISSING_CATEGORY = "__MISSING__"


def _letter_folding() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility decomposition is one character with marks, and that character."""
    source, target = [], []
    for point in (*range(0x00A0, 0xD800), *range(0xF900, 0x10000)):
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != chr(point):
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _letter_folding()


def strip_marks(name: Column) -> Column:
    """Name without accents, written as one letter or as combining marks."""
    return F.regexp_replace(F.translate(name, ACCENTED, PLAIN), r"\p{M}+", "")


def fold_name(name: Column) -> Column:
    """Accent-free upper-case name with punctuation and runs of blanks reduced to one blank."""
    folded = F.upper(strip_marks(name))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[-/.()]", " "), r"\s+", " "))


def site_code(code: Column) -> Column:
    """Code without leading zeros; an empty code is ``0``."""
    bare = F.regexp_replace(F.trim(code.cast("string")), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def integer_code(code: Column) -> Column:
    """Code read as a nullable integer and written back as text."""
    return F.trim(code).try_cast("bigint").cast("string")


def decimal_comma(text: Column) -> Column:
    """Number with a decimal comma or point; anything else, NaN included, is NULL."""
    number = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def decimal_comma_int(text: Column) -> Column:
    """As ``decimal_comma``, rounded half-even to an integer."""
    return F.bround(decimal_comma(text), 0).cast("bigint")


def case_count(text: Column) -> Column:
    """Blank is 0; NULL marks a value that is not a whole number (see ``bad_case_count``)."""
    number = F.trim(text).try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("bigint"))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(whole)


def bad_case_count(text: Column) -> Column:
    return case_count(text).isNull()


def is_missing(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING_TOKENS)


def null_if_missing(text: Column) -> Column:
    return F.when(~is_missing(text), text)


def fill_category(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(MISSING_CATEGORY))


def key_slug(text: Column, lower: bool = False) -> Column:
    """Runs of other characters become one underscore; nothing left becomes ``unknown``."""
    slug = F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    slug = F.lower(slug) if lower else slug
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit("unknown")).otherwise(slug)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def code_order(code: Column) -> list[Column]:
    """Sort keys: numeric codes by value, then the others by text."""
    return [F.coalesce(code.try_cast("int"), F.lit(1_000_000_000)).asc(), code.asc()]
