"""Filters on route elements.

Values of one dimension are alternatives, dimensions are conditions together, and ! before every
value of a dimension negates it; signs can't be mixed. Checks raise ValueError on the driver.
"""

from __future__ import annotations

import ipaddress
import json
import re
from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .match import filter_prefixes, listed_prefixes

#: Prefixes up to this many are a predicate; longer lists become a table for joins. AS numbers of a country up to this many are one too.
INLINE, INLINE_ASNS = 1000, 1000
# Seconds of the units that a duration may name.
UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800}
# The fields of an element in their order, and peers that send a whole table of IPv4 or IPv6.
FIELDS = ("type", "timestamp", "peer_ip", "peer_asn", "prefix", "path_id", "as_path", "origin_asns", "origin", "next_hop", "local_pref", "med", "communities", "atomic", "aggr_asn", "aggr_ip", "collector")
FULL_FEED_V4, FULL_FEED_V6 = 800_000, 100_000
DEFAULT_FIELDS = tuple(f for f in FIELDS if f not in ("path_id", "origin_asns", "collector"))


def signed(values: list[str], what: str) -> tuple[list[str], bool]:
    """The values without their signs, and whether they are negated."""
    marks = {v.startswith("!") for v in values}
    if len(marks) > 1:
        raise ValueError(f"{what}: negated and plain values can't be mixed")
    return [v.removeprefix("!") for v in values], marks == {True}


def check_asn(value: str) -> int:
    if not re.fullmatch(r"\+?\d+", value) or int(value) >= 1 << 32:
        raise ValueError(f"invalid ASN {value!r}: not an unsigned 32-bit number")
    return int(value)


def check_prefix(value: str) -> str:
    if "/" not in value:
        raise ValueError(f"invalid prefix {value!r}: not CIDR notation")
    ipaddress.ip_network(value, strict=False)
    return value


def check_community(value: str) -> str:
    parts = value.split(":")
    most = {2: 65535, 3: (1 << 32) - 1}.get(len(parts))
    if most is None or not all(p == "*" or (re.fullmatch(r"\+?\d+", p) and int(p) <= most) for p in parts):
        raise ValueError(f"invalid community {value!r}: A:B of 16 bits or A:B:C of 32 bits, * for any part")
    return value


def community_matches(patterns: list[str], communities: str = "communities") -> Column:
    """Whether any of the communities is one of the patterns, part by part; a part is a number or *, for any number."""
    wanted = [[None if p == "*" else int(p) for p in check_community(v).split(":")] for v in patterns]

    def one(text: Column) -> Column:
        parts = F.split(text, ":")
        numbers = F.transform(parts, lambda p: p.try_cast("bigint"))
        hits = [(F.size(parts) == len(w)) & F.forall(numbers, lambda n: n.isNotNull()) & reduce(Column.__and__, [F.lit(True), *(F.get(numbers, F.lit(i)) == n for i, n in enumerate(w) if n is not None)]) for w in wanted]
        return reduce(Column.__or__, hits)

    return F.coalesce(F.exists(communities, one), F.lit(False))


def seconds(text: str) -> float:
    """Unix seconds of a time in text; UTC if it names no zone."""
    text = text.strip()
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text)
    try:
        when = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"invalid time {text!r}: Unix seconds or RFC 3339") from None
    return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp()


def duration_seconds(text: str) -> int:
    parts = re.findall(r"(\d+)\s*([a-z]+)", text.strip().lower())
    if not parts or re.sub(r"\d+\s*[a-z]+", "", text.strip().lower()).strip() or any(u not in UNITS for _, u in parts):
        raise ValueError(f"invalid duration {text!r}")
    return sum(int(n) * UNITS[u] for n, u in parts)


def instant(value: float, kind: T.DataType) -> Column:
    """A literal instant of a column's own type, so that the comparison reaches the scan."""
    text = datetime.fromtimestamp(value, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.lit(text + "+00:00").cast("timestamp")
    return F.lit(value)


@dataclass(frozen=True)
class RouteFilters:
    prefixes: list[str] = field(default_factory=list)
    origin_asns: list[str] = field(default_factory=list)
    peer_asns: list[str] = field(default_factory=list)
    peer_ips: list[str] = field(default_factory=list)
    communities: list[str] = field(default_factory=list)
    as_path_regex: str | None = None
    elem_type: str | None = None
    include_super: bool = False
    include_sub: bool = False
    start_ts: str | None = None
    end_ts: str | None = None
    duration: str | None = None

    def validate(self) -> RouteFilters:
        for v in signed([str(x) for x in self.origin_asns], "origin ASN")[0] + signed([str(x) for x in self.peer_asns], "peer ASN")[0]:
            check_asn(v)
        for v in signed(self.prefixes, "prefix")[0]:
            check_prefix(v)
        for v in self.peer_ips:
            ipaddress.ip_address(v)
        if self.communities:
            for v in signed(self.communities, "community")[0]:
                check_community(v)
        if self.elem_type is not None and self.elem_type.lower() not in ("a", "w"):
            raise ValueError(f"invalid element type {self.elem_type!r}: a or w")
        if self.as_path_regex and re.search(r"\(\?[=!<]", self.as_path_regex):
            raise ValueError("as_path_regex: look-around is not supported")
        self.time_range()
        return self

    def time_range(self) -> tuple[float | None, float | None]:
        """Both bounds inclusive; two of start, end and duration, or one bound alone."""
        start = None if self.start_ts is None else seconds(self.start_ts)
        end = None if self.end_ts is None else seconds(self.end_ts)
        if self.duration is not None:
            length = duration_seconds(self.duration)
            if (start is None) == (end is None):
                raise ValueError("a duration needs a start or an end, not both")
            start, end = (start, start + length) if end is None else (end - length, end)
        if start is not None and end is not None and start > end:
            raise ValueError("the start is after the end")
        return start, end

    def merged(self, other: RouteFilters) -> RouteFilters:
        """Lists join (each value once), single values keep this one's, flags are either's."""
        out = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            out[f.name] = list(dict.fromkeys([*a, *b])) if isinstance(a, list) else a or b if isinstance(a, bool) else b if a is None else a
        return replace(self, **out)

    @classmethod
    def from_json(cls, text: str) -> RouteFilters:
        """A filter file's object: any of the fields, no others."""
        given = json.loads(text)
        if not isinstance(given, dict) or (unknown := set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown fields: {sorted(unknown) if isinstance(given, dict) else given!r}")
        lists = {f.name for f in fields(cls) if f.name in ("prefixes", "origin_asns", "peer_asns", "peer_ips", "communities")}
        for k, v in given.items():
            wanted = list if k in lists else bool if k.startswith("include_") else str
            if not isinstance(v, wanted) and not (v is None and wanted is str):
                raise ValueError(f"{k}: {v!r} is no {wanted.__name__}")
        return cls(**given)

    # --- predicates -------------------------------------------------------------------------------

    def origin_predicate(self) -> Column | None:
        """An absent origin passes a negated filter and no plain one."""
        if not self.origin_asns:
            return None
        values, negated = signed([str(x) for x in self.origin_asns], "origin ASN")
        hit = F.coalesce(F.arrays_overlap("origin_asns", F.array(*[F.lit(check_asn(v)).cast("bigint") for v in values])), F.lit(False))
        return ~hit if negated else hit

    def peer_asn_predicate(self) -> Column | None:
        if not self.peer_asns:
            return None
        values, negated = signed([str(x) for x in self.peer_asns], "peer ASN")
        hit = F.col("peer_asn").isin([check_asn(v) for v in values])
        return ~hit if negated else hit

    def peer_ip_predicate(self) -> Column | None:
        return F.lower("peer_ip").isin([str(ipaddress.ip_address(v)) for v in self.peer_ips]) if self.peer_ips else None

    def community_predicate(self) -> Column | None:
        """Any community matches; negated, none does, and elements without communities pass."""
        if not self.communities:
            return None
        values, negated = signed(self.communities, "community")
        hit = community_matches(values)
        return ~hit if negated else hit

    def type_predicate(self) -> Column | None:
        return F.col("elem_type") == self.elem_type.upper() if self.elem_type else None

    def path_predicate(self) -> Column | None:
        """An absent path is matched as empty text."""
        return F.coalesce("as_path", F.lit("")).rlike(self.as_path_regex) if self.as_path_regex else None

    def time_predicate(self, rows: DataFrame) -> Column | None:
        start, end = self.time_range()
        if start is None and end is None:
            return None
        kind = rows.schema["ts"].dataType
        parts = [F.col("ts") >= instant(start, kind)] if start is not None else []
        parts += [F.col("ts") <= instant(end, kind)] if end is not None else []
        return reduce(Column.__and__, parts)

    def apply_prefixes(self, rows: DataFrame) -> DataFrame:
        if not self.prefixes:
            return rows
        values, negated = signed(self.prefixes, "prefix")
        values = [check_prefix(v) for v in values]
        if len(values) <= INLINE:
            return listed_prefixes(rows, values, self.include_super, self.include_sub, negated)
        wanted = rows.sparkSession.createDataFrame([(v,) for v in values], "prefix string")
        return filter_prefixes(rows, wanted, self.include_super, self.include_sub, negated)

    def apply(self, elems: DataFrame, data_type: str = "updates") -> DataFrame:
        """elems that pass every dimension; a routing-table dump (rib) has no time filter, as its rows carry old times."""
        self.validate()
        parts = [self.peer_asn_predicate(), self.peer_ip_predicate(), self.type_predicate(), None if data_type == "rib" else self.time_predicate(elems)]
        parts += [self.path_predicate(), self.origin_predicate(), self.community_predicate()]
        parts = [p for p in parts if p is not None]
        return self.apply_prefixes(elems.where(reduce(Column.__and__, parts)) if parts else elems)

    def safe(self, rows: DataFrame, time: bool = False) -> DataFrame:
        """Only what may be dropped before a replay: other prefixes and peers, and other times of updates."""
        parts = [self.peer_asn_predicate(), self.time_predicate(rows) if time else None]
        parts = [p for p in parts if p is not None]
        return self.apply_prefixes(rows.where(reduce(Column.__and__, parts)) if parts else rows)

    def announce_predicate(self) -> Column:
        """Whether an announcement matches what may not be dropped before a replay: origin and path."""
        parts = [p for p in (self.origin_predicate(), self.path_predicate()) if p is not None]
        return reduce(Column.__and__, parts) if parts else F.lit(True)


def full_feed_peers(peers: DataFrame, least_v4: int = FULL_FEED_V4, least_v6: int = FULL_FEED_V6) -> DataFrame:
    """Peers that send (nearly) a whole table of either family."""
    return peers.where((F.col("num_v4_pfxs") >= least_v4) | (F.col("num_v6_pfxs") >= least_v6)).select("collector", "peer_ip", "peer_asn").distinct()


def full_feed_only(elems: DataFrame, peers: DataFrame) -> DataFrame:
    return elems.join(full_feed_peers(peers), ["collector", "peer_ip", "peer_asn"], "left_semi")


def country_flag(elems: DataFrame, asinfo: DataFrame, country: str, out: str = "in_country") -> DataFrame:
    """elems with a flag: any origin is registered in the country. Elements stay one row each.

    The country's AS numbers are a predicate, no element being moved; of a table that gives it more than INLINE_ASNS they are joined to the distinct sets of origins.
    """
    asns = asinfo.where(F.upper("country") == country.upper()).select(F.col("asn").alias("__asn")).distinct()
    known = [r["__asn"] for r in asns.limit(INLINE_ASNS + 1).collect()]
    if len(known) <= INLINE_ASNS:
        return elems.withColumn(out, F.coalesce(F.exists("origin_asns", lambda o: o.isin(known)), F.lit(False)) if known else F.lit(False))
    sets = elems.select(F.col("origin_asns").alias("__set")).where("__set IS NOT NULL").distinct()
    sets = sets.withColumn("__o", F.explode("__set")).join(asns, F.col("__o") == F.col("__asn"), "left_semi").select("__set").distinct().withColumn(out, F.lit(True))
    return elems.join(sets, F.col("origin_asns") == F.col("__set"), "left").drop("__set").withColumn(out, F.coalesce(out, F.lit(False)))


def in_country(elems: DataFrame, asinfo: DataFrame, country: str) -> DataFrame:
    return country_flag(elems, asinfo, country, "__in").where("__in").drop("__in")


def parse_fields(text: str | None, with_collector: bool = False) -> list[str]:
    """Field names of a comma-separated list, in order; the default set if there is none; ValueError for an unknown name."""
    if not text:
        return [*DEFAULT_FIELDS, "collector"] if with_collector else list(DEFAULT_FIELDS)
    names = [n.strip() for n in text.split(",") if n.strip()]
    if unknown := [n for n in names if n not in FIELDS]:
        raise ValueError(f"unknown fields {unknown}; there are {', '.join(FIELDS)}")
    return names


def rendered(elems: DataFrame, names: list[str]) -> DataFrame:
    """The named fields as text: lists joined by spaces, nothing for null."""
    source = {"type": "elem_type", "timestamp": "ts"}
    out = []
    for n in names:
        c = source.get(n, n)
        if c not in elems.columns:
            out.append(F.lit("").alias(n))
            continue
        kind = elems.schema[c].dataType
        text = F.array_join(F.col(c).cast("array<string>"), " ") if isinstance(kind, T.ArrayType) else F.col(c).cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(n))
    return elems.select(*out)
