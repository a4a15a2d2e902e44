"""IP prefixes as equality keys: family, two signed 64-bit halves of the network address, length.

Host bits are masked; the text of a prefix stays with its row. IPv4 uses the low half only, and a
family never matches the other. Text that is not CIDR notation has a null key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("family", "hi", "lo", "len")
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V6 = r"^(?=[0-9A-Fa-f:]{2,39}$)(?!.*::.*::)(?!.*:::)(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?::(([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})?)$"
WIDTH = {4: 32, 6: 128}


def is_v6(text: Column) -> Column:
    return text.contains(":")


def address_text(prefix: Column) -> Column:
    return F.element_at(F.split(prefix, "/"), 1)


def prefix_length(prefix: Column) -> Column:
    """The length after the stroke; null if there is none or it is no number."""
    return F.when(F.size(F.split(prefix, "/")) == 2, F.element_at(F.split(prefix, "/"), 2).try_cast("int"))


def host_prefix(text: Column) -> Column:
    """An address without a length as a prefix of full length; text with a length as it is."""
    text = F.trim(text)
    return F.when(text.contains("/"), text).when(is_v6(text), F.concat(text, F.lit("/128"))).otherwise(F.concat(text, F.lit("/32")))


def _v4_number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return total


def _v6_hex(address: Column) -> Column:
    """All 32 digits: the groups left and right of a double colon with zeros between."""
    sides = F.split(address, "::")

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), "")


def _top(bits: Column) -> Column:
    """A 64-bit mask of so many leading ones; shifts by 64 would not shift."""
    bits = F.least(F.greatest(bits, F.lit(0)), F.lit(64))
    return F.when(bits == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"), 64 - bits))


def masked(family: Column, hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    v4 = _top(length + 32)
    return hi.bitwiseAND(_top(length)), lo.bitwiseAND(F.when(family == 4, v4).otherwise(_top(length - 64)))


def prefix_key(prefix: Column) -> Column:
    """struct(family, hi, lo, len) of CIDR text; null for anything else, IPv4 embedded in IPv6 included."""
    address, length = address_text(prefix), prefix_length(prefix)
    family = F.when(address.rlike(_V4), F.lit(4)).when(address.rlike(_V6), F.lit(6)).cast("tinyint")
    digits = _v6_hex(address)
    hi = F.when(family == 4, F.lit(0).cast("bigint")).otherwise(F.conv(F.substring(digits, 1, 16), 16, -10).try_cast("bigint"))
    lo = F.when(family == 4, _v4_number(address)).otherwise(F.conv(F.substring(digits, 17, 16), 16, -10).try_cast("bigint"))
    hi, lo = masked(family, hi, lo, length)
    good = family.isNotNull() & length.isNotNull() & (length >= 0) & (length <= F.when(family == 4, 32).otherwise(128))
    return F.when(good, F.struct(family.alias("family"), hi.alias("hi"), lo.alias("lo"), length.alias("len")))


def with_key(df: DataFrame, prefix: str = "prefix", into: str = "key") -> DataFrame:
    """df with the four parts of the prefix's key as columns into_family and so on; rows without a key are dropped.

    The same as prefix_key(), in steps, so that each part of the text is read once for each row. Its parts come by an explode of
    one element, past which the optimizer moves no condition: it would repeat the expression that prefix may be in each of them.
    """
    p, a, f, o, h, low, n = (f"__{into}_{x}" for x in ("parts", "address", "family", "octets", "hi", "lo", "len"))
    rows = df.select("*", F.explode(F.array(F.split(prefix, "/"))).alias(p))
    rows = rows.withColumns({a: F.get(p, F.lit(0)), n: F.when(F.size(p) == 2, F.get(p, F.lit(1)).try_cast("int"))})
    rows = rows.withColumn(f, F.when(F.col(a).rlike(_V4), F.lit(4)).when(F.col(a).rlike(_V6), F.lit(6)).cast("tinyint"))
    rows = rows.where(F.col(f).isNotNull() & (F.col(n) >= 0) & (F.col(n) <= F.when(F.col(f) == 4, 32).otherwise(128)))
    rows = rows.withColumns({o: F.when(F.col(f) == 4, F.split(a, r"\.").cast("array<bigint>")), a: F.when(F.col(f) == 6, _v6_hex(F.col(a)))})
    number = sum((F.get(o, F.lit(i)) * 256 ** (3 - i) for i in range(1, 4)), F.get(o, F.lit(0)) * 256**3)
    hi = F.when(F.col(f) == 4, F.lit(0).cast("bigint")).otherwise(F.conv(F.substring(a, 1, 16), 16, -10).try_cast("bigint"))
    lo = F.when(F.col(f) == 4, number).otherwise(F.conv(F.substring(a, 17, 16), 16, -10).try_cast("bigint"))
    rows = rows.withColumns({h: hi, low: lo})
    hi, lo = masked(F.col(f), F.col(h), F.col(low), F.col(n))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f).alias(f"{into}_family"), hi.alias(f"{into}_hi"), lo.alias(f"{into}_lo"), F.col(n).alias(f"{into}_len"))


def ancestors(into: str | Column, lengths: Iterable[tuple[int, int]]) -> Column:
    """Keys of all prefixes of the given (family, length) pairs that contain the key (a struct, or columns into_family and so on), itself included."""
    lengths = sorted(set(lengths))
    family, hi, lo, own = (F.col(f"{into}_{k}") if isinstance(into, str) else into[k] for k in KEY)
    found = None
    for f in (4, 6):
        of = [n for g, n in lengths if g == f]
        if not of:
            continue

        def key(n: Column) -> Column:
            h, low = masked(family, hi, lo, n)
            return F.struct(family.alias("family"), h.alias("hi"), low.alias("lo"), n.alias("len"))

        keys = F.transform(F.filter(F.array(*[F.lit(n) for n in of]), lambda n: n <= own), key)
        found = F.when(family == f, keys) if found is None else found.when(family == f, keys)
    return found if found is not None else F.expr("CAST(array() AS array<struct<family:tinyint,hi:bigint,lo:bigint,len:int>>)")


def lengths_present(df: DataFrame, prefix: str = "prefix") -> list[tuple[int, int]]:
    """The distinct (family, length) pairs of a column of prefixes, 162 at most; the text is split and not parsed."""
    rows = df.select(F.when(is_v6(F.col(prefix)), 6).otherwise(4).alias("f"), prefix_length(F.col(prefix)).alias("n")).distinct()
    return sorted((r["f"], r["n"]) for r in rows.where("n IS NOT NULL").collect() if 0 <= r["n"] <= WIDTH[r["f"]])


#: Every (family, length) pair there can be.
ALL_LENGTHS = [(f, n) for f, width in WIDTH.items() for n in range(width + 1)]
