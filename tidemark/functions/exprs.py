"""Column expressions shared by all operators.

They fix the places where engines differ: division by zero gives NULL, a bad
date gives NULL, and rounding of doubles is half away from zero by formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"


def proper_first(text: str | Column) -> Column:
    """First letter upper case, the rest lower case, outer blanks removed."""
    t = F.trim(_col(text))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))


def strip_all(text: str | Column) -> Column:
    """Remove leading and trailing white space of any kind (tabs and newlines too)."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def title_words(text: str | Column, exceptions: dict[str, str] | None = None) -> Column:
    """Upper-case each letter that follows a non-letter, with named spellings put back."""
    lowered = F.lower(strip_all(text))
    # a letter run starts at the front or after anything that is not a letter
    spaced = F.initcap(F.regexp_replace(lowered, r"(?<=[^\p{L}\s])(?=\p{L})", "\u0001 "))
    titled = F.replace(spaced, F.lit("\u0001 "), F.lit(""))
    for wrong, right in (exceptions or {}).items():
        titled = F.when(titled == wrong, F.lit(right)).otherwise(titled)
    return titled


def blank_to(text: str | Column, default: str) -> Column:
    """``default`` where the text is missing or only blanks; trimmed text otherwise."""
    return F.coalesce(F.nullif(F.trim(_col(text)), F.lit("")), F.lit(default))


def iso_date(text: str | Column) -> Column:
    """DATE from ISO text, with or without a time after it; NULL, never an error, for anything else.

    A cast parses much faster than a pattern but also takes shortened dates,
    so the places of the two dashes are checked first.
    """
    t = _col(text)
    dashed = (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    whole = (F.length(t) == 10) | F.substring(t, 11, 1).isin("T", " ")
    return F.when(dashed & whole, t.try_cast("date"))


def month_key(day: str | Column) -> Column:
    """``YYYY-MM`` text of a DATE."""
    return F.substring(_col(day).cast("string"), 1, 7)


def month_number(key: str | Column) -> Column:
    """Months since year 0 for a ``YYYY-MM`` key, so that differences count months."""
    k = _col(key)
    return F.substring(k, 1, 4).cast("int") * 12 + F.substring(k, 6, 2).cast("int")


def round_away(x: str | Column, places: int = 0) -> Column:
    """Round a double half away from zero; ``+ 0.0`` turns a negative zero into zero."""
    v, f = _col(x).cast("double"), F.lit(float(10**places))
    return F.signum(v) * F.floor(F.abs(v) * f + F.lit(0.5)) / f + F.lit(0.0)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, NULL when b is zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def percent(part: str | Column, whole: str | Column, places: int = 1) -> Column:
    """100 * part / whole, rounded."""
    return round_away(F.try_divide(F.lit(100.0) * _col(part).cast("double"), _col(whole).cast("double")), places)


def rows() -> Column:
    return F.count(F.lit(1))


def portable(df: DataFrame) -> DataFrame:
    """Result types every reader agrees on: bigint, double, text and boolean; dates as ISO text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
