"""Scalar expressions on flow columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostweave.sources.schema import BOT_MARK, TIME_FORMAT


def scenario_of(path: Column) -> Column:
    """Name of the log up to its first dot; the log is a file, a folder of part files, or such a folder of a scenario.

    Cut at slashes and dots: it is worked out for every row, and a search by pattern tries every place of the path.
    """
    upto_dot = lambda segment: F.substring_index(F.ltrim(segment, F.lit(".")), ".", 1)
    last = F.substring_index(path, "/", -1)
    above = F.when(F.contains(path, F.lit("/")), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise("")
    name = F.when(last.startswith("part-") & (upto_dot(above) != ""), upto_dot(above)).otherwise(upto_dot(last))
    return F.when(name.startswith("scenario="), F.substring_index(name, "scenario=", -1)).otherwise(name)


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970, as a double."""
    return F.unix_seconds(time).cast("double")


def port_number(text: Column) -> Column:
    """Port written in decimal or as 0x hexadecimal, of any length; anything else is null."""
    digits = F.regexp_extract(text, "^0[xX]0*([0-9a-fA-F]+)$", 1)
    # a number of more than 15 hexadecimal digits is no port, and would not fit
    hexadecimal = F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).cast("double"))
    return F.when(digits != "", hexadecimal).otherwise(text.try_cast("double"))


def bare_host(text: Column) -> Column:
    """Host text without the square brackets some exports put around it."""
    return F.regexp_replace(text, r"[\[\]]", "")


def is_bot(label: Column) -> Column:
    return label.contains(BOT_MARK)


def is_bot_like(label: Column) -> Column:
    """Any spelling of a bot or malicious label."""
    return label.contains("otnet") | label.contains("alicious")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def as_number(column: Column, kind: str) -> Column:
    """Numeric value of an attribute; null for text attributes."""
    if kind == "time":
        return epoch_seconds(column)
    if kind == "port":
        return port_number(column)
    if kind == "number":
        return column.cast("double")
    return F.lit(None).cast("double")
