"""Expressions for cells of delimited text (numbers, money, percentages, dates, null spellings) and for scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reading rules.
NULL_TOKENS = ("na", "n/a", "null", "none", "nan", "nil", "-", "--", "?", "unknown")
CURRENCIES = "$€£¥₹₩₽"
MULTIPLIERS = (("l", 1e5), ("lakh", 1e5), ("lac", 1e5), ("cr", 1e7), ("crore", 1e7))
SERIAL_RANGE = (20000, 60000)
EXCEL_EPOCH = "1899-12-30"

#: A cell that is a number as it stands, whatever the decimal sign of its column.
PLAIN = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"
_SPACES = " \t\u00a0\u202f"
_AMOUNT = r"^([+-]?[0-9.,\s\u00a0\u202f]*(?:[eE][+-]?[0-9]+)?)\s*((?i:lakh|lac|l|crore|cr))?\s*(%)?$"
_ISO = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T].*)?$"
_SEPARATED = r"^([0-9]{1,4})([./-])([0-9]{1,2})\2([0-9]{2,4})$"
_TURNABLE = r"^([0-9]{1,3})([./-])([0-9]{1,2})\2([0-9]{2,4})$"


def strip(x: Column) -> Column:
    """Without white space at either end, no-break spaces and tabs included."""
    return F.regexp_replace(x, r"^[\s  ]+|[\s  ]+$", "")


def is_null_token(x: Column) -> Column:
    return F.lower(x).isin(*NULL_TOKENS)


def is_candidate(x: Column) -> Column:
    """Neither blank nor a spelling of null."""
    return F.coalesce((x != "") & ~is_null_token(x), F.lit(False))


def currency_of(x: Column) -> Column:
    """The currency sign in the text, the last in the fixed order if there are several; null if none."""
    return F.coalesce(*[F.when(x.contains(c), F.lit(c)) for c in reversed(CURRENCIES)])


def currency_bit(x: Column) -> Column:
    """currency_of() as a bit, which counts add up to a set; 0 if none."""
    return F.coalesce(*[F.when(x.contains(c), F.lit(1 << i)) for i, c in reversed([*enumerate(CURRENCIES)])], F.lit(0))


def currencies_of(bits: int) -> list[str]:
    return [c for i, c in enumerate(CURRENCIES) if bits >> i & 1]


def _bare(x: Column) -> Column:
    """Without currency signs and outer space."""
    return strip(F.translate(x, CURRENCIES, ""))


def is_amount(x: Column) -> Column:
    """Whether a text has the shape of a number, a sum of money or a percentage."""
    return _bare(x).rlike(_AMOUNT)


def has_multiplier(x: Column) -> Column:
    return currency_of(x).isNotNull() & (F.regexp_extract(_bare(x), _AMOUNT, 2) != "")


def parse_number(x: Column, decimal: str = ".") -> Column:
    """Number of a cell or null: currency signs go, lakh and crore multiply if there was one (and are no number without),
    % divides by 100, grouping goes. The decimal separator is the column's, not the cell's."""
    part = lambda k: F.regexp_extract(_bare(x), _AMOUNT, k)
    plain = F.translate(F.translate(part(1), "." + _SPACES, ""), ",", ".") if decimal == "," else F.translate(part(1), "," + _SPACES, "")
    suffix = F.lower(part(2))
    factor = F.when(suffix == "", F.lit(1.0))
    for value in (1e5, 1e7):
        names = [n for n, v in MULTIPLIERS if v == value]
        factor = factor.when(suffix.isin(*names) & x.rlike(f"[{CURRENCIES}]"), F.lit(value))
    value = plain.try_cast("double") * factor / F.when(x.rlike(r"%\s*$"), F.lit(100.0)).otherwise(F.lit(1.0))
    return F.when(x.rlike(PLAIN), (F.translate(x, ".", "") if decimal == "," else x).try_cast("double")).otherwise(value)


def _int(x: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(x, pattern, k).try_cast("int")


def is_date(x: Column) -> Column:
    """Whether a text has the shape of a date."""
    return x.rlike(_ISO) | x.rlike(_SEPARATED)


def day_and_month(x: Column) -> tuple[Column, Column, Column]:
    """Whether the order of day and month is open (separated, no year in front), and the two numbers."""
    return x.rlike(_TURNABLE), _int(x, _TURNABLE, 1), _int(x, _TURNABLE, 3)


def parse_date(x: Column, day_first: bool) -> Column:
    """Timestamp without zone, at midnight; null for what is no date. Dates with the year in front ignore the order."""
    zero = F.lit(0)
    make = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, zero, zero, zero)
    written = F.regexp_extract(x, _TURNABLE, 4)
    year = written.try_cast("int") + F.when(F.length(written) > 2, 0).when(written < "70", 2000).otherwise(1900)
    first, second = _int(x, _TURNABLE, 1), _int(x, _TURNABLE, 3)
    return (
        F.when(x.rlike(_ISO), make(_int(x, _ISO, 1), _int(x, _ISO, 2), _int(x, _ISO, 3)))
        .when(x.rlike(_TURNABLE), make(year, second, first) if day_first else make(year, first, second))
        .when(x.rlike(_SEPARATED), make(_int(x, _SEPARATED, 1), _int(x, _SEPARATED, 3), _int(x, _SEPARATED, 4)))
    )


def is_serial(x: Column) -> Column:
    n = F.when(x.rlike("^[0-9]{1,9}$"), x.try_cast("int"))
    return F.coalesce(n.between(*SERIAL_RANGE), F.lit(False))


def parse_serial(x: Column) -> Column:
    """Spreadsheet day number to timestamp."""
    n = F.when(is_serial(x), x.try_cast("int"))
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), n).cast("timestamp_ntz")


def clean_name(x: Column) -> Column:
    """Letters and digits in lower case, other characters an underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))


def risk_band(p: Column) -> Column:
    return F.when(p >= 0.66, "High").when(p >= 0.33, "Medium").when(p.isNotNull(), "Low")
