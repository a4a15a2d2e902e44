"""Prefix matching between DataFrames: exact, longest, covering, covered, and sets as filters.

Containment is an equality join: the longer side is exploded to its ancestors of the lengths that the
other side has, so that every match is a hash match.
"""

from __future__ import annotations

import ipaddress
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.prefix import ALL_LENGTHS, KEY, WIDTH, ancestors, lengths_present, masked, with_key


def _same(left: str, right: str):
    both = None
    for k in KEY:
        equal = F.col(f"{left}_{k}") == F.col(f"{right}_{k}")
        both = equal if both is None else both & equal
    return both


def _exploded(keyed: DataFrame, into: str, lengths: list[tuple[int, int]], out: str) -> DataFrame:
    rows = keyed.withColumn("__a", F.explode(ancestors(into, lengths)))
    return rows.select("*", *[F.col(f"__a.{k}").alias(f"{out}_{k}") for k in KEY]).drop("__a")


def _sides(queries: DataFrame, table: DataFrame, query: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """queries keyed as q, and table keyed as t with its prefix as matched_prefix."""
    t = table.withColumnRenamed(prefix, "matched_prefix")
    return with_key(queries, query, "q"), with_key(t, "matched_prefix", "t")


def _bare(df: DataFrame) -> DataFrame:
    return df.drop(*[f"{s}_{k}" for s in ("q", "t", "a") for k in KEY])


def exact(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix") -> DataFrame:
    q, t = _sides(queries, table, query, prefix)
    return _bare(q.join(t, _same("q", "t")))


def covering(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix", keep_length: bool = False) -> DataFrame:
    """Each query with every row of table whose prefix contains it, itself included."""
    q, t = _sides(queries, table, query, prefix)
    found = _exploded(q, "q", lengths_present(table, prefix), "a").join(t, _same("a", "t"))
    return _bare(found.withColumn("matched_len", F.col("t_len")) if keep_length else found)


def longest(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix") -> DataFrame:
    """Each query with the rows of the longest prefix that contains it; several rows of one prefix all stay."""
    found = covering(queries, table, query, prefix, keep_length=True)
    order = Window.partitionBy(*queries.columns).orderBy(F.col("matched_len").desc())
    return found.withColumn("__r", F.rank().over(order)).where("__r = 1").drop("__r", "matched_len")


def covered(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix") -> DataFrame:
    """Each query with every row of table whose prefix lies in it, itself included."""
    q, t = _sides(queries, table, query, prefix)
    return _bare(_exploded(t, "t", lengths_present(queries, query), "a").join(q, _same("a", "q")))


def grouped(matches: DataFrame, query: str = "query", asn: str = "origin_asn") -> DataFrame:
    """The origins of each matched prefix of each query, in order."""
    return matches.groupBy(query, "matched_prefix").agg(F.sort_array(F.collect_set(asn)).alias("origin_asns"))


def search_union(queries: DataFrame, table: DataFrame, query: str = "query", prefix: str = "prefix", asn: str = "origin_asn") -> DataFrame:
    """Longest, covering and covered matches together; a (query, prefix, origin) keeps its first label in this order."""
    parts = None
    for rank, (label, match) in enumerate((("longest", longest), ("super", covering), ("sub", covered))):
        part = match(queries, table, query, prefix).select(query, "matched_prefix", asn, F.lit(rank).alias("rank"), F.lit(label).alias("match_type"))
        parts = part if parts is None else parts.unionByName(part)
    first = parts.groupBy(query, "matched_prefix", asn).agg(F.min_by("match_type", "rank").alias("match_type"))
    return first


def _parts(text: str) -> tuple[int, int, int]:
    """(family, address as a number, length) of a prefix, host bits cleared."""
    net = ipaddress.ip_network(text, strict=False)
    return net.version, int(net.network_address), net.prefixlen


def _halves(family: int, number: int) -> tuple[int, int]:
    """The signed 64-bit halves of a key."""
    if family == 4:
        return 0, number
    return tuple(x - (1 << 64) if x >> 63 else x for x in (number >> 64, number & (1 << 64) - 1))


def _among(family: int, hi: Column, lo: Column, numbers: set[int]) -> Column:
    """Whether (hi, lo) is the key of one of the numbers, all network addresses of a family."""
    by_hi: dict[int, list[int]] = {}
    for h, low in sorted(_halves(family, n) for n in numbers):
        by_hi.setdefault(h, []).append(low)
    parts = [lo.isin(lows) if family == 4 else (hi == h) & lo.isin(lows) for h, lows in by_hi.items()]
    return reduce(Column.__or__, parts)


def listed_prefixes(rows: DataFrame, wanted: list[str], include_super: bool = False, include_sub: bool = False, negated: bool = False, prefix: str = "prefix") -> DataFrame:
    """filter_prefixes() for a list that someone typed: a predicate on the row's key, so that no row is moved."""
    keyed = with_key(rows.withColumn("__row_prefix", F.col(prefix)), "__row_prefix", "r").drop("__row_prefix")
    same: dict[tuple[int, int], set[int]] = {}
    below: dict[tuple[int, int], set[int]] = {}
    for f, number, n in {_parts(w) for w in wanted}:
        for k in range(n + 1) if include_super else [n]:
            same.setdefault((f, k), set()).add(number >> WIDTH[f] - k << WIDTH[f] - k)
        if include_sub:
            below.setdefault((f, n), set()).add(number)

    def hit(key: Column) -> Column:
        family, hi, lo, length = (key[k] for k in KEY)
        hits = [(family == f) & (length == k) & _among(f, hi, lo, numbers) for (f, k), numbers in sorted(same.items())]
        for (f, n), numbers in sorted(below.items()):
            high, low = masked(family, hi, lo, F.lit(n))
            hits.append((family == f) & (length >= n) & _among(f, high, low, numbers))
        return reduce(Column.__or__, hits)

    # the key is bound once; as columns its expression would be repeated for each of the conditions
    found = F.exists(F.array(F.struct(*[F.col(f"r_{k}").alias(k) for k in KEY])), hit)
    return keyed.where(~found if negated else found).select(*[F.col(f"`{c}`") for c in rows.columns])


#: Bits of the bitmap of a list's keys, and the bits that each key sets; 512 KB, whatever the list.
FILTER_BITS, FILTER_WORDS = 22, 1 << 16


def _positions(key: list[Column]) -> list[Column]:
    h = F.xxhash64(*key)
    mask = F.lit((1 << FILTER_BITS) - 1).cast("bigint")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(mask)]


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def key_bitmap(keys: DataFrame, into: str) -> Column:
    """A bitmap of the keys in columns into_family and so on, as a literal: its words, FILTER_WORDS at most, come to the driver and go out with the tasks."""
    places = keys.select(F.explode(F.array(*_positions([F.col(f"{into}_{k}") for k in KEY]))).alias("p"))
    words = [0] * FILTER_WORDS
    for r in places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    # as text, since a literal array would be put together element by element; it is read once, when the plan is made
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _maybe(bitmap: Column, key: list[Column]) -> Column:
    """Whether a key may be among those of a bitmap; false for sure, true but for one in so many others."""
    hits = [F.get(bitmap, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0 for p in _positions(key)]
    return hits[0] & hits[1]


def filter_prefixes(rows: DataFrame, wanted: DataFrame, include_super: bool = False, include_sub: bool = False, negated: bool = False, prefix: str = "prefix") -> DataFrame:
    """The rows whose prefix is in wanted (column prefix), is a super-prefix of one there, or a sub-prefix, as asked; or no such row, negated.

    A bitmap of the list's keys is the first predicate; only rows that pass it are joined with the list, the others don't move. Rows
    whose own prefix has no key are left out either way.
    """
    table = rows.withColumn("__row_prefix", F.col(prefix))
    keyed = with_key(table, "__row_prefix", "r").drop("__row_prefix")
    w = with_key(wanted.select(F.col("prefix").alias("__w")), "__w", "w").drop("__w").distinct()
    if include_super:
        supers = _exploded(w, "w", ALL_LENGTHS, "s").select(*[F.col(f"s_{k}").alias(f"w_{k}") for k in KEY])
        up = w.unionByName(supers).distinct()
    else:
        up = w
    upper = key_bitmap(up, "w")
    lengths, listed = (lengths_present(wanted), key_bitmap(w, "w")) if include_sub else ([], None)

    def may_hit(key: Column) -> Column:
        hit = _maybe(upper, [key[k] for k in KEY])
        return hit | F.exists(ancestors(key, lengths), lambda a: _maybe(listed, [a[k] for k in KEY])) if include_sub else hit

    # the key is bound once; as columns its expression would be repeated for each of the conditions
    maybe = F.exists(F.array(F.struct(*[F.col(f"r_{k}").alias(k) for k in KEY])), may_hit)
    passed = keyed.where(maybe)
    flagged = passed.join(up.select(*[F.col(f"w_{k}").alias(f"u_{k}") for k in KEY], F.lit(True).alias("__up")), _same("r", "u"), "left").drop(*[f"u_{k}" for k in KEY])
    hit = F.coalesce("__up", F.lit(False))
    if include_sub:
        pairs = _exploded(passed.select(*[f"r_{k}" for k in KEY]).distinct(), "r", lengths, "a")
        below = pairs.join(w, _same("a", "w"), "left_semi").select(*[F.col(f"r_{k}").alias(f"b_{k}") for k in KEY]).distinct().withColumn("__down", F.lit(True))
        flagged = flagged.join(below, _same("r", "b"), "left").drop(*[f"b_{k}" for k in KEY])
        hit = hit | F.coalesce("__down", F.lit(False))
    kept = flagged.where(~hit if negated else hit).select(*rows.columns)
    return kept.unionByName(keyed.where(~maybe).select(*rows.columns)) if negated else kept
