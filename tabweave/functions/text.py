"""Column expressions that treat text as Python's string methods do. All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's str.strip and str.split: Unicode white space and the four separators below it.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(c: Column) -> Column:
    """str.strip(). Texts that begin and end with a visible ASCII character are left as they are without a pattern."""
    seen = lambda x: x.between("!", "~")
    plain = seen(F.substring(c, 1, 1)) & seen(F.right(c, F.lit(1)))
    return F.when(plain, c).otherwise(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", ""))


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+", "")


def squeeze(c: Column) -> Column:
    """' '.join(s.split())."""
    return strip(F.regexp_replace(c, rf"{BLANK}+", " "))


def leading_blanks(c: Column) -> Column:
    """The number of leading white space characters; 0 for null."""
    return F.coalesce(F.length(c) - F.length(lstrip(c)), F.lit(0))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def python_float(c: Column) -> Column:
    """float(s): null where Python would refuse. Digits may be grouped by single underscores; hex and type suffixes are not numbers."""
    s = strip(c)
    number = r"(?i)^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?\z"
    word = r"(?i)^[+-]?(?:inf|infinity|nan)\z"
    value = F.when(s.rlike(number), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    sign = F.when(F.startswith(s, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    named = F.when(F.lower(s).contains("nan"), F.lit("NaN")).otherwise(F.concat(sign, F.lit("Infinity")))
    return F.when(s.rlike(word), named.cast("double")).otherwise(value)


def float_repr(c: Column) -> Column:
    """repr(float): shortest digits; positional from 1e-4 up to 1e16, else with a two-digit exponent."""
    s = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    exponent = F.coalesce(F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    sign = F.when(c < 0, "-").otherwise("")
    whole = F.when(F.length(digits) <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), digits)
    exp_text = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    scientific = F.concat(sign, mantissa, F.lit("e"), exp_text)
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(c == float("inf"), F.lit("inf"))
        .when(c == float("-inf"), F.lit("-inf"))
        .when(~s.contains("E"), s)
        .when((exponent >= 0) & (exponent < 16), F.concat(sign, whole))
        .when((exponent < 0) & (exponent >= -4), F.concat(sign, small))
        .otherwise(scientific)
    )


def two_places(c: Column) -> Column:
    """f'{x:.2f}': half-even on the exact binary value."""
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit(""))


# Patterns that decide what a cell or header is.
NUMERIC = r"(?U)^-?[\d,]+(\.\d+)?%?$"
ISO_DATE = r"(?U)^\d{4}-\d{2}-\d{2}"
SLASH_DATE = r"(?U)^\d{1,2}/\d{1,2}/\d{2,4}"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SHORT_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
TEMPORAL = r"(?iU)(?:^|\b)(?:Q[1-4]|" + "|".join((*SHORT_MONTHS, *MONTHS)) + r"|\d{4}[-/]\d{1,2}|\d{4}|FY\s?\d{2,4}|H[12]|CY\s?\d{2,4})(?:\b|$)"
KEY_NAME = r"(?i)(?:^|_)(?:id|key|ref|fk|pk|code)(?:$|_)"
NUMBERED = r"(?U)^\s*\d+[.\-]"
# Words that are no tokens.
STOP_WORDS = ("a", "an", "and", "at", "by", "for", "from", "how", "in", "is", "many", "much", "of", "on", "the", "to", "what", "when", "where", "which", "who")


def is_numeric(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(NUMERIC), F.lit(False))


def looks_numeric(s: Column) -> Column:
    """is_numeric of a stripped text; plain whole numbers and decimals are told without a pattern."""
    rest = F.translate(s, "0123456789", "")
    digits = F.length(s) > F.length(rest)
    whole = digits & ((rest == "") | ((rest == "-") & F.startswith(s, F.lit("-"))))
    decimal = (rest == ".") & ~F.startswith(s, F.lit(".")) & ~F.endswith(s, F.lit("."))
    return F.when(whole | decimal, True).otherwise(s.rlike(NUMERIC))


def is_temporal(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(TEMPORAL), F.lit(False))


def is_key_name(c: Column) -> Column:
    return F.coalesce(c.rlike(KEY_NAME), F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of at least two characters, without stop words; null gives none."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def python_pattern(java: str) -> re.Pattern:
    """The same pattern for Python, where \\d and \\b are Unicode-aware already."""
    return re.compile(java.replace("(?iU)", "(?i)").replace("(?U)", ""))
