"""Normalizing span texts to numbers, shares, dates and booleans, as JVM expressions.

Each function maps a string column to a column and gives null where the text has no reading. The readings are a
grammar: the text is reduced to digits and separators, then the one shape it fits decides what the separators mean.
Decimal digits of any script count (``\\p{Nd}``); superscripts do not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Number words, months, words of yes and no, roman digits.
NUMBER_WORDS = {
    "null": 0, "kein": 0, "keine": 0, "keinen": 0, "keiner": 0, "none": 0, "nil": 0, "zero": 0,
    "ein": 1, "eins": 1, "eine": 1, "one": 1, "zwei": 2, "two": 2, "drei": 3, "three": 3, "vier": 4, "four": 4, "fünf": 5, "five": 5, "sechs": 6, "six": 6,
    "sieben": 7, "seven": 7, "acht": 8, "eight": 8, "neun": 9, "nine": 9, "zehn": 10, "ten": 10, "elf": 11, "eleven": 11, "zwölf": 12, "twelve": 12,
}
MONTHS = {
    "januar": 1, "january": 1, "jan": 1, "februar": 2, "february": 2, "feb": 2, "märz": 3, "march": 3, "mar": 3, "april": 4, "apr": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "oktober": 10, "october": 10, "oct": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "december": 12, "dez": 12, "dec": 12,
}
NO_WORDS, YES_WORDS = ("NEIN", "NICHT", "KEIN", "OHNE", "NO"), ("VORHANDEN", "JA", "MIT", "YES")
ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
FLOAT32_MAX = 3.4028235e38

_D = r"\p{Nd}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it. Without this an expression doubles with each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lookup(col: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def roman_to_float(col: Column) -> Column:
    """Value of a roman numeral: a digit before a larger one is subtracted; null if any other character occurs or nothing is there."""
    s = F.upper(col)
    values = F.transform(F.split(s, ""), lambda c: _lookup(c, ROMAN))
    pairs = F.zip_with(values, F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), lambda a, b: F.when(a < b, -a).otherwise(a))
    total = F.aggregate(pairs, F.lit(0).cast("int"), lambda acc, x: acc + x)
    return F.when(s.rlike("^[MDCLXVI]+$"), total.cast("double"))


def is_negative(col: Column) -> Column:
    """One minus sign or dash, a single trailing S, or a value in brackets."""
    dashes = F.length(F.regexp_replace(col, "[^-]", ""))
    long_dashes = F.length(F.regexp_replace(col, "[^–]", ""))
    esses = F.length(F.regexp_replace(col, "[^S]", ""))
    bare = F.regexp_replace(col, '[ "„+€–-]', "")
    return (dashes == 1) | (long_dashes == 1) | ((esses == 1) & col.endswith("S")) | bare.rlike(r"^\*?\(.+\)$")


def _plain(t: Column) -> Column:
    """Digits and separators with at most single gaps, from a trimmed text without its type's marks."""
    # Asterisk only closes a number, or opens one in brackets.
    t = F.when(t.rlike(r"^[^*]*\*$"), F.regexp_replace(t, r"\*$", "")).when(t.rlike(r"^\*\([^*]*\)$"), F.regexp_replace(t, r"^\*", "")).otherwise(t)
    t = F.regexp_replace(t, "[€$£\"'„“”‘’‚:;°|+=/()\\[\\]`´]", "")
    t = F.regexp_replace(t, r"^[\s–-]+|[\s–-]+$", "")
    return F.regexp_replace(t, r"([.,]) +", "$1")


def _value(t: Column) -> Column:
    """The number that a row of digits and separators means, by the one shape it fits."""
    digits = F.regexp_replace(t, r"[.,]", "")
    last = F.regexp_extract(t, r"(\p{Nd}+)$", 1)
    joined = F.concat(F.substring(digits, F.lit(1), F.length(digits) - F.length(last)), F.lit("."), last)
    grouped = rf"^{_D}{{1,3}}(?:[.,]{_D}{{3}})+"
    decimal = rf"^{_D}+[.,]{_D}+$|{grouped}[.,]{_D}{{1,2}}$|^{_D}+(?:,{_D}{{3,}})+\.{_D}{{1,2}}$|^{_D}+(?:\.{_D}{{3,}})+,{_D}{{1,2}}$"
    return F.when(t.rlike(rf"^{_D}+$"), t).when(t.rlike(rf"{grouped}[.,]?$") & ~t.rlike(rf"^0+[.,]{_D}{{3}}$"), digits).when(t.rlike(decimal), joined).try_cast("double")


def _spaced(t: Column) -> Column:
    """Three blanks part numbers; one or two are a separator."""
    joined = F.regexp_replace(t, r"^(\p{Nd}{1,3}) {1,2}(\p{Nd}{3}) {1,2}(\p{Nd}{1,2})$", "$1$2.$3")
    return F.when(~t.rlike(r"\S {3,}\S"), let(F.regexp_replace(joined, r"(\p{Nd}) {1,2}(\p{Nd})", "$1.$2"), _value))


def _magnitude(col: Column) -> Column:
    def read(s: Column) -> Column:
        words = _lookup(F.lower(s), NUMBER_WORDS).cast("double")
        millions = F.regexp_extract(s, rf"^({_D}(?:{_D}|[.,])*)\s?(?:Mio\.?|Mill?\.|Millionen|Million)$", 1)
        big = F.regexp_replace(millions, ",", ".").try_cast("double") * 1e6
        dash = s.rlike(r"^[-–]+([.,][-–]*)?$")
        # The letter O is a misread zero where no other letter stands; H and S after a digit mark the side of an account.
        bare = F.regexp_replace(s, r"(?<=\p{Nd})[SH]$", "")
        zeros = let(bare, lambda t: F.when(t.rlike(r"^[^A-NP-Za-z]*$"), F.translate(t, "O", "0")).otherwise(t))
        number = let(let(zeros, _plain), _spaced)
        return F.coalesce(F.when(dash, F.lit(0.0)), words, big, number, let(F.regexp_replace(s, " ", ""), roman_to_float))

    return let(let(F.trim(col), read), lambda v: F.when(v <= FLOAT32_MAX, v))


def to_positive_float(col: Column) -> Column:
    """The number in the text without its sign."""
    return _magnitude(col)


def to_float(col: Column) -> Column:
    """The number in the text, negative where its marks say so."""
    return let(_magnitude(col), lambda v: F.when(is_negative(col) & (v != 0), -v).otherwise(v))


def to_percentage(col: Column) -> Column:
    """A share: a per cent sign, or a value above 1, divides by 100; six decimals."""
    def read(s: Column) -> Column:
        return let(_magnitude(F.trim(F.regexp_replace(s, "%", ""))), lambda v: F.round(F.when(s.contains("%") | (v > 1), v / 100).otherwise(v), 6))

    bare = let(F.regexp_replace(col, '[+"„-]', ""), lambda s: F.when(F.length(s) > 1, F.regexp_replace(s, r"[.;,]$", "")).otherwise(s))
    return let(F.trim(bare), read)


def to_date(col: Column) -> Column:
    """ISO text of the date. Without a year the year is 0000, without a day the day is 01; impossible days up to 31 are kept.

    Two-digit years above 50 belong to the last century.
    """
    names = "|".join(sorted(MONTHS, key=len, reverse=True))

    def numbered(s: Column) -> Column:
        # A written month becomes a number between dots; "july 1 2019" gets its day in front.
        month = _lookup(F.regexp_extract(s, f"({names})", 1), MONTHS)
        rest = F.regexp_replace(s, f"^({names})\\.?(\\d{{1,2}})(\\d{{4}})$", "$2.$1.$3")
        return let(month, lambda m: F.when(m.isNotNull(), F.regexp_replace(rest, f"\\.?({names})\\.?", F.concat(F.lit("."), F.lpad(m.cast("string"), 2, "0"), F.lit(".")))).otherwise(s))

    s = let(F.lower(F.regexp_replace(col, r"[ :,\[();‚]", "")), numbered)
    s = F.regexp_replace(s, r"^\.(?=\d)", "")
    s = F.regexp_replace(s, r"^/(?=\d\d\.\d\d\.$)|(?<=^\d\d\.\d\d\.)/$", "")
    s = F.regexp_replace(s, r"^(\d\d\.\d\d\.)/\1$", "$1")
    s = F.regexp_replace(s, r"^(\d{4}-\d\d-\d\d)t?\d{4,6}$", "$1")

    def take(s: Column, p: str, d: int | None, m: int | None, y: int | None) -> Column:
        def part(g: int | None, empty: str) -> Column:
            return F.lit(empty) if g is None else F.regexp_extract(s, p, g)

        century = F.when(part(y, "0000").try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20"))
        year = F.concat(F.when(F.length(part(y, "0000")) == 2, century).otherwise(F.lit("")), part(y, "0000"))
        iso = F.concat_ws("-", year, F.lpad(part(m, "01"), 2, "0"), F.lpad(part(d, "01"), 2, "0"))
        return F.when(s.rlike(p), let(iso, valid))

    def valid(iso: Column) -> Column:
        year, mon, day = (F.split_part(iso, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
        return F.when(((year == 0) | ((year > 1900) & (year < 2100))) & (mon < 13) & (day < 32), iso)

    forms = [
        (r"^(\d{4})-(\d\d)-(\d\d)$", 3, 2, 1),
        (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 1, 2, 3), (r"^(\d\d)/(\d\d)/(\d{4})$", 1, 2, 3), (r"^(\d\d)-(\d\d)-(\d{4})$", 1, 2, 3),
        (r"^(\d{1,2})[./](\d{1,2})[./](\d\d)$", 1, 2, 3),
        (r"^(\d\d)\.?(\d\d)\.?(\d{4})$", 1, 2, 3), (r"^(\d\d)[./](\d{4})$", None, 1, 2), (r"^(\d\d)\.?(\d\d)\.?(\d\d)$", 1, 2, 3),
        (r"^(\d\d)\.(\d\d)\.?$", 1, 2, None), (r"^(\d\d)(\d\d)\.$", 1, 2, None),
        (r"^(\d\d)/(\d\d)$", None, 1, 2), (r"^(\d{4})$", None, None, 1),
    ]
    return let(s, lambda s: F.coalesce(*[take(s, *form) for form in forms]))


def to_bool(col: Column) -> Column:
    """Yes or no by the first of one or two words; a word of both kinds, or of none, has no reading."""
    words = F.filter(F.split(F.upper(F.trim(col)), r"\s+"), lambda w: w != "")
    first = F.get(words, F.lit(0))
    yes = reduce(lambda a, b: a | b, [first.contains(w) for w in YES_WORDS])
    no = reduce(lambda a, b: a | b, [first.contains(w) for w in NO_WORDS])
    return F.when(F.size(words).isin(1, 2), F.when(yes & ~no, True).when(no & ~yes, False))


def normalize(col: Column, data_type: str) -> Column:
    """Text form of the value by data type; unknown types give null."""
    kinds = {
        "Positive Number": to_positive_float, "float_positive": to_positive_float, "Number": to_float, "float": to_float, "Date": to_date, "date": to_date,
        "True/False": to_bool, "bool": to_bool, "Percentage": to_percentage, "percentage": to_percentage, "Text": lambda c: c, "str": lambda c: c,
    }
    return kinds[data_type](col).cast("string") if data_type in kinds else F.lit(None).cast("string")


def to_python_float(col: Column) -> Column:
    """Texts that a programming language reads as a number, 0 for all others and from the largest single-precision number on: blanks around
    it, single underscores between digits and an exponent may stand, words for infinity and no number too."""
    t = F.lower(F.regexp_replace(F.regexp_replace(col, r"^\s+", ""), r"\s+\z", ""))
    digits = r"[0-9](?:_?[0-9])*"
    number = t.rlike(rf"^[+-]?(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?\z")
    value = F.when(number, F.regexp_replace(t, "_", "").try_cast("double")).when(t.rlike(r"^-inf(?:inity)?\z"), F.lit(float("-inf")))
    return F.when(value < FLOAT32_MAX, value).otherwise(0.0)


def days_since_2010(col: Column, iso: Column | None = None) -> Column:
    """Days from 1 January 2010 to a date written with two dots or strokes (0 of them count as 1); 0 for other texts. ``iso``: the text's date, where it is known."""
    formed = (F.length(col) > 5) & (((F.substring(col, 3, 1) == ".") & (F.substring(col, 6, 1) == ".")) | ((F.substring(col, 3, 1) == "/") & (F.substring(col, 6, 1) == "/")))
    days = F.datediff((to_date(col) if iso is None else iso).try_cast("date"), F.lit("2010-01-01").cast("date"))
    return F.coalesce(F.when(formed, let(days, lambda d: F.when(d == 0, 1).otherwise(d))), F.lit(0))


def date_parts(col: Column, iso: Column | None = None) -> tuple[Column, Column, Column]:
    """Year, month and day of a date, 0 where there is none. ``iso``: the text's date, where it is known."""
    iso = to_date(col) if iso is None else iso
    return tuple(F.coalesce(F.substring(iso, a, n).try_cast("int"), F.lit(0)) for a, n in ((1, 4), (6, 2), (9, 2)))
