"""Scalar functions on columns: AS numbers, query types, times, names, paths, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ASN = (1 << 32) - 1


def parse_asn(text: Column) -> Column:
    """The number of an AS, with or without AS before it; null if it is none or not 32 bits."""
    digits = F.regexp_extract(F.trim(text), r"^(?i:AS)?(\d{1,10})$", 1)
    number = digits.try_cast("bigint")
    return F.when(number <= MOST_ASN, number)


def query_type(text: Column) -> Column:
    """asn, prefix or name: what an input asks about."""
    trimmed = F.trim(text)
    address = trimmed.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (trimmed.contains(":") & trimmed.rlike(r"^[0-9A-Fa-f:.]+$"))
    return F.when(parse_asn(text).isNotNull(), "asn").when(trimmed.contains("/") | address, "prefix").otherwise("name")


def parse_time(text: Column) -> Column:
    """An instant of Unix seconds or of date text (a date alone is its midnight, UTC); null if it is neither."""
    trimmed = F.trim(text)
    seconds = F.when(trimmed.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(trimmed.try_cast("decimal(20,6)")))
    zoned = F.when(trimmed.rlike(r"(Z|[+-]\d\d:?\d\d)$"), trimmed).otherwise(F.concat(trimmed, F.when(trimmed.rlike(r"^\d{4}-\d\d-\d\d$"), F.lit(" 00:00:00+00:00")).otherwise(F.lit("+00:00"))))
    return F.coalesce(seconds, zoned.try_cast("timestamp"))


def unix_seconds(instant: Column) -> Column:
    return F.unix_micros(instant) / 1_000_000


def rfc3339(instant: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def truncated_name(name: Column, most: int) -> Column:
    """A name of more than most characters cut to fit with three dots."""
    return F.when(F.char_length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, max(0, most - 3)), F.lit("...")))


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)))


def path_asns(path: Column) -> Column:
    """The numbers of a path's tokens in order; braces and other tokens are dropped."""
    tokens = F.split(F.trim(path), r"\s+")
    return F.filter(F.transform(tokens, lambda t: F.when(t.rlike(r"^\d{1,10}$"), t.try_cast("bigint"))), lambda a: a.isNotNull() & (a <= MOST_ASN))


def path_origin(path: Column) -> Column:
    asns = path_asns(path)
    return F.when(F.size(asns) > 0, F.element_at(asns, -1))


def origin_code(letter: Column) -> Column:
    return F.when(letter == "i", "IGP").when(letter == "e", "EGP").when(letter == "?", "INCOMPLETE")


def asns_text(asns: Column) -> Column:
    return F.array_join(asns.cast("array<string>"), " ")


def text_asns(text: Column) -> Column:
    return path_asns(text)


def preferred_name(aka: Column, name_long: Column, peeringdb: Column, org: Column, as2org: Column, core: Column) -> Column:
    """The first that is not empty, from the most particular to the registry's; the last may be empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (aka, name_long, peeringdb, org, as2org)], core)


def time_of_path(path: Column) -> Column:
    """The time in a file's name: YYYY-MM-DD-HHMM, else YYYY.MM.DD, which is its noon; null if neither is a time. No time zone: UTC."""
    exact = F.regexp_extract(path, r"(?:^|\D)(\d{4}-\d{2}-\d{2}-\d{4})", 1)
    day = F.regexp_extract(path, r"(\d{4}\.\d{2}\.\d{2})", 1)
    first = F.try_to_timestamp(F.nullif(exact, F.lit("")), F.lit("yyyy-MM-dd-HHmm"))
    second = F.try_to_timestamp(F.nullif(F.concat(day, F.lit(" 12")), F.lit(" 12")), F.lit("yyyy.MM.dd HH"))
    return F.coalesce(first, second).cast("timestamp_ntz")
