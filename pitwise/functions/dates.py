"""Calendar days and keys as column expressions. Days are whole numbers since 1970-01-01, so range frames apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(stamp: Column) -> Column:
    return F.datediff(F.to_date(stamp), F.lit("1970-01-01").cast("date")).cast("bigint")


def monday_number(day: Column) -> Column:
    """Day number of the Monday of the week of ``day`` (1970-01-01 was a Thursday)."""
    return (day - F.pmod(day + 3, F.lit(7))).cast("bigint")


def week_key(date: Column) -> Column:
    """ISO year and week as YYYY-WW."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def season_flags(date: Column) -> dict[str, Column]:
    """Clay (April to June), grass (June and July) and indoor (October to February) seasons."""
    month = F.month(date)
    return {"clay_season": month.between(4, 6).cast("int"), "grass_season": month.between(6, 7).cast("int"), "indoor_season": ((month >= 10) | (month <= 2)).cast("int")}


def parsed_date(text: Column, formats: tuple[str, ...] = ("yyyyMMdd", "yyyy-MM-dd", "d MMM, yy", "ddMMMyy", "M/d/yy h:mm a")) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
