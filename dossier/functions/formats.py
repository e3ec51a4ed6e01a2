"""Number, plural, size, duration and date formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plural(rule: str, n: Column) -> Column:
    """Plural category of a whole number under a rule: east_slavic, polish, arabic, hebrew, one or one_zero."""
    ten, hundred = n % 10, n % 100
    if rule == "east_slavic":
        return F.when((ten == 1) & (hundred != 11), "one").when(ten.between(2, 4) & ~hundred.between(12, 14), "few").otherwise("many")
    if rule == "polish":
        return F.when(n == 1, "one").when(ten.between(2, 4) & ~hundred.between(12, 14), "few").otherwise("many")
    if rule == "arabic":
        return F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(hundred.between(3, 10), "few").when(hundred.between(11, 99), "many").otherwise("other")
    if rule == "hebrew":
        return F.when(n == 1, "one").when(n == 2, "two").otherwise("other")
    if rule == "one_zero":
        return F.when(n <= 1, "one").otherwise("other")
    if rule == "one":
        return F.when(n == 1, "one").otherwise("other")
    raise ValueError(f"unknown plural rule {rule!r}")


def grouped(n: Column, mark: str = ",", least: int = 1) -> Column:
    """Digits in threes; with ``least`` 2, four digits stay together."""
    text = F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", mark)
    return F.when(F.abs(n) < 10 ** (3 + least - 1), n.cast("string")).otherwise(text)


def human_bytes(n: Column) -> Column:
    """Size in steps of 1024, one decimal beyond bytes."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        limit = 1024 ** (k + 1)
        text = F.concat(F.format_number(F.round(n / F.lit(float(1024**k)), 1), "0.0"), F.lit(f" {unit}"))
        out = out.when(n < limit, text) if k < 3 else out.otherwise(text)
    return out


def human_seconds(s: Column) -> Column:
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(" h "), F.floor(s % 3600 / 60).cast("string"), F.lit(" min")))


def parse_size(text: Column) -> Column:
    """'5GB' or '300 k' to bytes; null where it is no size."""
    number = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 2)
    power = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).when(unit == "T", 1024**4).otherwise(1)
    return F.when(number != "", (F.nullif(number, F.lit("")).cast("double") * power).cast("bigint"))


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSS+HH'mm' to ISO 8601; anything else passes as it is."""
    p = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:([+-])(\d{2})'(\d{2})'?|Z)?$"
    part = lambda k: F.regexp_extract(value, p, k)
    zone = F.when(part(7) == "", F.lit("Z")).otherwise(F.concat(part(7), part(8), F.lit(":"), part(9)))
    return F.when(value.rlike(p), F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit("T"), F.concat_ws(":", part(4), part(5), part(6)), zone)).otherwise(value)
