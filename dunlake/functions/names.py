"""Person-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import ColumnLike, apply_each, drop_text, text

DIGITS = "0123456789"


def _replace_forms(col: Column, forms, letter: str) -> Column:
    return apply_each(col, forms, lambda c, form: F.replace(c, F.lit(form), F.lit(letter)))


def _strip_lead(col: Column) -> Column:
    return F.regexp_replace(col, r"^(A\s+| )+", "")


def _keep_letters(col: Column) -> Column:
    letters = apply_each(F.regexp_replace(col, "[^A-Z& ]", ""), fixed.CLIPPED_TITLES, drop_text)
    return _strip_lead(letters)


def _needs_cleaning(upper_name: Column) -> Column:
    """True unless no step but the last can change the name.

    Most names take this short way: one pattern instead of some forty passes.
    """
    return upper_name.rlike("SR|SEN|SEO|NNNNN|  |[^A-Z& ]")


def clean_name(name: ColumnLike) -> Column:
    """Upper-case name without titles, symbols and digits.

    Title patterns are regular expressions applied one after another, because an
    earlier removal can create a later match. Single characters have no such
    order and are removed together by ``translate``.
    """
    upper_name = F.upper(text(name))
    col = _replace_forms(upper_name, fixed.ENYE_FORMS, "N")
    col = apply_each(col, fixed.MOJIBAKE_LETTERS, lambda c, pair: _replace_forms(c, pair[:1], pair[1]))
    col = apply_each(col, fixed.TITLE_PATTERNS, lambda c, title: F.regexp_replace(c, title, ""))
    col = apply_each(F.translate(col, fixed.NAME_SYMBOLS, ""), fixed.COURTESY_TITLES, drop_text)
    col = F.translate(drop_text(col, fixed.NAME_QUESTION_MARKS), fixed.NAME_SYMBOLS_AFTER_TITLES, "")
    col = apply_each(col, [digit + " " for digit in DIGITS], drop_text)
    cleaned = _keep_letters(drop_text(F.translate(col, DIGITS, ""), "  "))
    return F.when(_needs_cleaning(upper_name), cleaned).otherwise(_strip_lead(upper_name))


def clean_name_literal(name: ColumnLike) -> Column:
    """Same cleaning with every title taken literally."""
    upper_name = F.upper(text(name))
    col = _replace_forms(upper_name, fixed.LITERAL_ENYE_FORMS, "N")
    col = apply_each(col, fixed.MOJIBAKE_LETTERS, lambda c, pair: _replace_forms(c, pair[:1], pair[1]))
    cleaned = _keep_letters(apply_each(col, fixed.LITERAL_NAME_PARTS, drop_text))
    return F.when(_needs_cleaning(upper_name), cleaned).otherwise(_strip_lead(upper_name))


def cleaned_or_original(cleaned: ColumnLike, original: ColumnLike) -> Column:
    """A cleaned name, or the original when fewer than seven letters remain.

    Put the cleaned name in a column of its own first, so it is computed once.
    """
    return F.when(F.length(text(cleaned)) < 7, text(original)).otherwise(text(cleaned))


def short_name(name: ColumnLike) -> Column:
    """First of the four leading words longer than two letters, else the second word."""
    words = F.split(text(name), " ")
    long_words = F.filter(F.slice(words, 1, 4), lambda word: F.length(word) > 2)
    return F.coalesce(F.get(long_words, F.lit(0)), F.get(words, F.lit(1)))


def given_names(name: ColumnLike) -> Column:
    """Leading half of the words; an odd count rounds up."""
    words = F.split(text(name), " ")
    half = F.ceil(F.size(words) / F.lit(2)).cast("int")
    return F.concat_ws(" ", F.slice(words, F.lit(1), half))


def surnames(name: ColumnLike) -> Column:
    """Words from the middle on; with an odd count the middle word is in both halves."""
    words = F.split(text(name), " ")
    start = F.floor(F.size(words) / F.lit(2)).cast("int") + 1
    return F.concat_ws(" ", F.slice(words, start, F.size(words)))
