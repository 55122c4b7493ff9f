"""Phone and e-mail expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlake.functions import fixed_values as fixed
from dunlake.functions.base import (
    ColumnLike,
    apply_each,
    as_column,
    contains_any,
    drop_text,
    first_match,
    is_blank,
    lookup,
    number,
    text,
    whole,
)

Range = tuple[int, int]


def in_ranges(contact: ColumnLike, *ranges: Range) -> Column:
    """True when the number of a contact text lies in one of the ranges; never null.

    All bounds have ten digits, so ten-digit texts compare like their numbers and
    need no cast. Other spellings (blanks, sign, leading zeros, fraction) are cut
    down to their ten digits first.
    """
    col = text(contact)

    def within(digits: Column) -> Column:
        found = F.lit(False)
        for low, high in ranges:
            found = found | digits.between(str(low), str(high))
        return found

    spelled = F.regexp_extract(col, r"^\s*\+?0*([1-9][0-9]{9})(\.[0-9]*)?\s*$", 1)
    usual = within(col) & col.rlike("^[0-9]+$")
    return F.coalesce(F.when(F.length(col) == 10, usual).otherwise(within(spelled)), F.lit(False))


def in_range(contact: ColumnLike, bounds: Range) -> Column:
    return in_ranges(contact, bounds)


def contact_filter(
    contact: ColumnLike,
    kind: str = "both",
    mobile: Range = fixed.MOBILE_RANGE,
    landline: Range = fixed.LANDLINE_RANGE,
) -> Column:
    """Valid contact of a kind: ``mobile``, ``landline``, ``email`` or ``both`` phones.

    Both phone ranges are one OR predicate, so the input is scanned once.
    """
    if kind == "mobile":
        return in_range(contact, mobile)
    if kind == "landline":
        return in_range(contact, landline)
    if kind == "email":
        return text(contact).contains("@")
    if kind == "both":
        return in_ranges(contact, mobile, landline)
    raise ValueError(f"unknown contact kind {kind!r}")


def clean_contact(contact: ColumnLike) -> Column:
    """E-mails stay; anything else keeps its digits without leading zeros."""
    col = text(contact)
    digits = F.regexp_replace(F.regexp_replace(col, "[^0-9]", ""), "^0+", "")
    return F.when(col.contains("@"), col).otherwise(digits)


def contact_type(contact: ColumnLike, cleaned: bool = True) -> Column:
    """email, movil, fijo or errado; ``cleaned`` strips non-digits first."""
    col = text(contact)
    digits = clean_contact(col) if cleaned else col
    ten = F.length(digits) == 10
    return first_match(
        [
            (col.contains("@") if cleaned else F.lit(False), F.lit("email")),
            (digits.startswith("3") & ten, F.lit("movil")),
            (digits.startswith("6") & ten, F.lit("fijo")),
            (col.contains("@"), F.lit("email")),
        ],
        F.lit("errado"),
    )


def area_digit(place: ColumnLike) -> Column:
    """Area digit of a place text; the first word before '/' decides, blank is the capital."""
    col = text(place)
    named = F.when(col.isNull() | (col == ""), F.lit(fixed.DEFAULT_PLACE)).otherwise(col)
    word = F.split_part(
        F.regexp_replace(F.split_part(named, F.lit("/"), F.lit(1)), "[^A-Z ]", ""), F.lit(" "), F.lit(1)
    )
    return lookup(F.upper(word), {place: digit for digit, places in fixed.AREA_BY_PLACE.items() for place in places})


def rebuild_landline(phone: ColumnLike, place: ColumnLike) -> Column:
    """Full landline of a 7 or 8 digit number; null when place or range does not fit.

    Seven digits get the area digit of the place, eight already have one.
    """
    digits = F.trim(text(phone))
    full = F.concat(F.lit("60"), F.right(F.concat(area_digit(place), digits), F.lit(8)))
    low, high = fixed.REBUILT_LANDLINE_RANGE
    return F.when(digits.rlike("^[0-9]{7,8}$") & full.between(str(low), str(high)), full)


def landline_from_pair(area: ColumnLike, phone: ColumnLike) -> Column:
    """Landline from an area column and a number column; null when neither rule fits."""

    def plain(value: ColumnLike) -> Column:
        as_whole = number(value).try_cast("bigint").cast("string")
        return F.coalesce(as_whole, F.trim(text(value)))

    code, digits = plain(area), plain(phone)
    size = F.length(digits)
    seven = F.when(code.isin("1", "601", ""), F.concat(F.lit("601"), digits)).when(
        code.rlike("^[2-9]"), F.concat(F.lit("60"), code, digits)
    )
    return F.when(size == 10, digits).when(size == 8, F.concat(F.lit("60"), digits)).when(size == 7, seven)


def line_type(phone: ColumnLike) -> Column:
    return F.when(whole(phone) < fixed.LANDLINE_FROM, F.lit("Celular")).otherwise(F.lit("Fijo"))


def with_country_code(phone: ColumnLike, code: str = fixed.COUNTRY_CODE) -> Column:
    return F.concat(F.lit(code), text(phone))


def slot_code(phone: ColumnLike) -> Column:
    """1 mobile, 2 landline, 3 empty: one character of the contact order key."""
    return F.when(is_blank(phone), F.lit("3")).when(
        whole(phone) <= fixed.MOBILE_RANGE[1], F.lit("1")
    ).otherwise(F.lit("2"))


def slot_signature(slots: list[ColumnLike]) -> Column:
    """Sort key of a slot row. Kept as text: twenty digits do not fit a long."""
    return F.array_join(F.transform(F.array(*[text(slot) for slot in slots]), slot_code), "")


def at_count(address: ColumnLike) -> Column:
    return F.length(F.regexp_replace(text(address), "[^@]", ""))


def email_channel(address: ColumnLike) -> Column:
    """EMAIL for exactly one '@', otherwise the cell holds several addresses."""
    return F.when(at_count(address) == 1, F.lit("EMAIL")).otherwise(F.lit("DELIMITAR"))


def clean_email(address: ColumnLike) -> Column:
    """Scrubbed address, '0' when it is not usable."""
    lowered = F.lower(text(address))
    blanked = F.when(
        lowered.contains("@") & ~lowered.rlike("|".join(fixed.BLANKED_EMAIL_PATTERNS)), lowered
    ).otherwise(F.lit("0"))
    phrase = F.replace(blanked, F.lit(fixed.BLANKED_EMAIL_PHRASE), F.lit("0"))
    return F.translate(drop_text(phrase, fixed.NAME_QUESTION_MARKS), fixed.STRIPPED_EMAIL_CHARACTERS, "")


def email_quality(address: ColumnLike) -> Column:
    """CORREO UNICO, CORREOS SIN DELIMITAR or ERRADO."""
    col = text(address)
    parts = F.size(F.split(col, "@"))
    shape = first_match(
        [
            (F.length(F.split_part(col, F.lit("@"), F.lit(1))) < 6, F.lit("ERRADO")),
            (parts == 2, F.lit("CORREO UNICO")),
            (parts >= 3, F.lit("CORREOS SIN DELIMITAR")),
        ],
        F.lit("ERRADO"),
    )
    return F.when(contains_any(F.lower(col), fixed.BAD_EMAIL_PARTS), F.lit("ERRADO")).otherwise(shape)


def exclusion_email(address: ColumnLike) -> Column:
    """Lower-case address of word characters, dot, dash and one '@'; else null."""
    kept = F.lower(F.regexp_replace(F.trim(text(address)), r"[^\w.\-@]", ""))
    return F.when(at_count(kept) == 1, kept)


def mark_placeholder(contact: ColumnLike) -> Column:
    """Replace the line markers VDK and VD by a number outside every range."""
    return apply_each(
        text(contact), ("VDK", "VD"), lambda col, mark: F.replace(col, F.lit(mark), F.lit("9999999999"))
    )


def strip_contact_key(value: ColumnLike, upper: bool = False) -> Column:
    """Drop the country prefix, capitals, '*', '-' and white space."""
    col = apply_each(text(value), ("57- ", "57-", "57 - "), drop_text)
    return F.regexp_replace(F.upper(col) if upper else col, r"[A-Z*\-\s]", "")


def exclusion_digits(value: ColumnLike, longest: int | None = None) -> Column:
    """Digits of a value with more than two and at most ``longest`` of them; else null."""
    digits = F.regexp_replace(text(value), "[^0-9]", "")
    size = F.length(digits)
    return F.when((size > 2) & ((size <= longest) if longest else F.lit(True)), digits)


def trimmed_list_cell(cell: ColumnLike) -> Column:
    """List cell without brackets, braces, quotes and white space."""
    return F.regexp_replace(as_column(cell), r'[\[\]{}"\s]', "")
