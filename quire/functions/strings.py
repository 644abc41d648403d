"""String features of spans, pattern synthesis and small text helpers, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented letters and their base.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Needles whose occurrences are counted, by the name of their feature.
NEEDLES = {
    "slash": "/", "percent": "%", "e": "e", "g": "g", "a": "a", "u": "u", "i": "i", "f": "f", "s": "s", "oe": "ö", "ae": "ä", "ue": "ü", "er": "er", "str": "str", "k": "k", "r": "r", "y": "y", "en": "en",
    "ch": "ch", "sch": "sch", "c": "c", "ei": "ei", "on": "on", "ohn": "ohn", "n": "n", "m": "m", "j": "j", "h": "h", "plus": "+", "minus": "-", "period": ".", "comma": ",",
}


def strip_accents(col: Column) -> Column:
    """Letters of the Latin range without their accents."""
    return F.translate(col, _ACCENTED, _BASE)


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("long")


def count_substring(col: Column, needle: str) -> Column:
    """Occurrences without overlap."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def vowel_count(col: Column) -> Column:
    return count_matches(F.lower(col), "[aeiou]")


def special_count(col: Column) -> Column:
    """Characters that are neither letters nor numbers."""
    return count_matches(col, r"[^\p{L}\p{N}]")


def space_count(col: Column) -> Column:
    """Blanks, a tab counting as four."""
    return count_substring(col, " ") + 4 * count_substring(col, "\t")


def digit_count(col: Column) -> Column:
    return count_matches(col, r"\p{Nd}")


def upper_count(col: Column) -> Column:
    return count_matches(col, r"\p{Lu}")


def unique_chars(col: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(col, ""), lambda c: c != ""))).cast("long")


def duplicate_chars(col: Column) -> Column:
    """Characters that occur more than once, each time counted."""
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    return F.aggregate(F.array_distinct(chars), F.lit(0).cast("long"), lambda acc, c: acc + F.when(F.size(F.filter(chars, lambda x: x == c)) > 1, F.size(F.filter(chars, lambda x: x == c))).otherwise(0))


def accented_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, f"[^{_ACCENTED}]", "")).cast("long")


def feature_columns(col: Column) -> dict[str, Column]:
    """All string features of a span, by name: counts over the text without accents, and the accented characters."""
    s = strip_accents(col)
    out = {
        "feat_vowel_len": vowel_count(s), "feat_special_len": special_count(s), "feat_space_len": space_count(s), "feat_digit_len": digit_count(s), "feat_len": F.length(s).cast("long"), "feat_upper_len": upper_count(s),
        "feat_unique_char_count": unique_chars(s), "feat_duplicate_count": duplicate_chars(s), "accented_char_count": accented_count(col),
        "feat_starts_with_plus": s.startswith("+").cast("int"), "feat_starts_with_minus": s.startswith("-").cast("int"), "feat_ends_with_plus": s.endswith("+").cast("int"), "feat_ends_with_minus": s.endswith("-").cast("int"),
    }
    low = F.lower(s)
    return out | {f"feat_substring_count_{name}": count_substring(low, needle) for name, needle in NEEDLES.items()}


def escape_pattern(col: Column) -> Column:
    """Regular expression metacharacters with a backslash before them."""
    return F.regexp_replace(col, r"([.^$*+?{}\[\]\\|()])", r"\\$1")


def suggest_pattern(col: Column) -> Column:
    """A pattern for texts like this one: runs of capitals, of small letters, digits and blanks become classes."""
    s = escape_pattern(col)
    s = F.regexp_replace(s, r"[A-ZÄÖÜ]+", "\u0001")
    s = F.regexp_replace(s, r"[a-zäöüß]+", "\u0002")
    s = F.regexp_replace(s, r"[0-9]", "\u0003")
    s = F.regexp_replace(s, r" {2,}", "\u0004")
    s = F.regexp_replace(s, r" ", "\u0005")
    for mark, text in (("\u0001", "[A-ZÄÖÜ]+"), ("\u0002", "[a-zäöüß]+"), ("\u0003", r"\d"), ("\u0004", "[ ]{2,}"), ("\u0005", "[ ]{1,2}")):
        s = F.replace(s, F.lit(mark), F.lit(text))
    return s


def merge_patterns(patterns: Column) -> Column:
    """An alternation of an array of patterns, the longest first."""
    ordered = F.array_sort(patterns, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.concat(F.lit("(?:"), F.array_join(ordered, "|"), F.lit(")"))


def is_blank_run(col: Column) -> Column:
    """Composed of spaces and tabs only (or empty)."""
    return col.rlike(r"^[ \t]*\z")


def slugify(col: Column) -> Column:
    """Lower case letters, digits and single hyphens."""
    s = F.lower(strip_accents(col))
    s = F.trim(F.regexp_replace(s, r"[^a-z0-9_\s-]", ""))
    return F.regexp_replace(s, r"[-\s]+", "-")


def fallback_name(col: Column) -> Column:
    """A category's name for matching in texts: lower case, without parts in brackets and double blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"\([^)]*\)", ""), r" {2,}", " "))
