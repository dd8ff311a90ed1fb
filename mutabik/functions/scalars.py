"""Column functions: parsing, keys, money arithmetic. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mutabik.config import DAY_US, FEE_BAND_BP, TOLERANCE_DIVISOR


def norm_ref(ref: Column) -> Column:
    """The Latin letters and digits of a reference in upper case; null gives ''."""
    return F.upper(F.regexp_replace(F.coalesce(ref, F.lit("")), "[^A-Za-z0-9]", ""))


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but spaces."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def trimmed(c: Column) -> Column:
    """Without spaces around; null becomes ''."""
    return F.trim(F.coalesce(c, F.lit("")))


def parse_kurus(c: Column) -> Column:
    """Strict base-10 64-bit integer with a sign and spaces around allowed; null if it is none."""
    t = F.trim(c)
    short = F.regexp_replace(t, "^([+-]?)0+(?=[0-9])", "$1")
    return F.when(t.rlike("^[+-]?[0-9]+$"), short.try_cast("bigint"))


def parse_day(c: Column) -> Column:
    """Midnight UTC of a real day written yyyy-MM-dd, spaces around allowed; else null."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def dedup_key(source: Column, ref: Column, amount: Column, at: Column, direction: Column) -> Column:
    """Content key of a record; the counterparty is not part of it."""
    day = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.sha2(F.concat_ws("|", source, F.coalesce(ref, F.lit("")), amount.cast("string"), day, direction), 256)


def occurrence_key(key: Column, n: Column) -> Column:
    """Key of the n-th equal record of one file; the first keeps its own key."""
    return F.when(n <= 1, key).otherwise(F.sha2(F.concat(key, F.lit("#"), n.cast("string")), 256))


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero, exact over all 64-bit integers."""
    b = b if isinstance(b, Column) else F.lit(b)
    q = a.cast("decimal(38,0)") - a.cast("decimal(38,0)") % b.cast("decimal(20,0)")
    return (q / b.cast("decimal(20,0)")).cast("decimal(38,0)").cast("bigint")


def basis_points(part: Column, whole: Column) -> Column:
    """part * 10000 div whole without overflow; null where whole is 0."""
    p, w = part.cast("decimal(19,0)"), whole.cast("decimal(19,0)")
    return F.when(whole != 0, F.floor(p * F.lit(10000).cast("decimal(5,0)") / w)).cast("bigint")


def tolerant_limit(amount: Column) -> Column:
    """Largest accepted difference from an expected amount."""
    return div(amount, TOLERANCE_DIVISOR)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def whole_days(us_a: Column, us_b: Column) -> Column:
    """Whole days between two instants in microseconds."""
    return F.floor(F.abs(us_a - us_b) / F.lit(DAY_US)).cast("bigint")


def shortfall_type(short: Column, whole: Column) -> Column:
    """'commission' inside the fee band, else 'partial'."""
    bp = basis_points(short, whole)
    return F.when(bp.between(*FEE_BAND_BP), "commission").otherwise("partial")


def format_try(amount: Column) -> Column:
    """[-]units,cc with a decimal comma and no grouping."""
    a = F.abs(amount.cast("decimal(38,0)"))
    cents = a % 100
    units = ((a - cents) / 100).cast("decimal(38,0)")
    return F.concat(F.when(amount < 0, "-").otherwise(""), units.cast("string"), F.lit(","), F.lpad(cents.cast("decimal(3,0)").cast("string"), 2, "0"))


def reason_class(reason: Column) -> Column:
    """The text before the first quote or colon."""
    return F.regexp_extract(reason, '^[^":]*', 0)
