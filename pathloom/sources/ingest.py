"""Readers and writers of routing data: explicit schemas, bad rows dropped where the source says so.

Elements, dumps and datasets arrive as files of text, JSON or Parquet; every reader gives a
DataFrame, so filters and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.prefix import prefix_key
from pathloom.functions.scalars import origin_code, path_asns, time_of_path
from pathloom.operators import rov

# The fields of each data format.
ELEM_SCHEMA = (
    "timestamp double, elem_type string, collector string, peer_ip string, peer_asn bigint, prefix string, path_id bigint, next_hop string, as_path string,"
    " origin_asns array<bigint>, origin string, local_pref bigint, med bigint, communities array<string>, atomic boolean, aggr_asn bigint, aggr_ip string"
)
ASINFO_SCHEMA = (
    "asn bigint, name string, country string, as2org struct<country:string,name:string,org_id:string,org_name:string>,"
    " peeringdb struct<aka:string,asn:bigint,irr_as_set:string,name:string,name_long:string,website:string>, hegemony struct<asn:bigint,ipv4:double,ipv6:double>,"
    " population struct<percent_country:double,percent_global:double,sample_count:bigint,user_count:bigint>"
)
AS2REL_SCHEMA = "asn1 bigint, asn2 bigint, paths_count bigint, peers_count bigint, rel int"
ROA_SCHEMA = "prefix string, max_length int, origin_asn bigint, ta string"
ASPA_SCHEMA = "customer_asn bigint, provider_asns array<bigint>"
PFX2AS_SCHEMA = "prefix string, origin_asn bigint"
# Sources of dated ROA tables, and whether they come by collector.
ROA_SOURCES = {"ripe": False, "rpkiviews": True, "rpkispools": True}
DEFAULT_ROA_SOURCE, DEFAULT_ROA_COLLECTOR = "rpkispools", "sobornost"


# --- elements -----------------------------------------------------------------------------------


def read_elems(spark: SparkSession, paths: list[str], form: str = "parquet") -> DataFrame:
    """Elements of many files as one table, with ts in UTC and the file they come from.

    form is parquet, json (a line each) or psv (columns of ELEM_SCHEMA with | between, lists by spaces).
    place numbers a file's elements in their order, through the row numbers that Parquet keeps, or else
    by block of the file and row in it.
    """
    if form == "psv":
        flat = ELEM_SCHEMA.replace("array<bigint>", "string").replace("array<string>", "string")
        rows = spark.read.schema(flat).csv(paths, sep="|")
        rows = rows.withColumn("origin_asns", F.when(F.col("origin_asns") != "", path_asns(F.col("origin_asns")))).withColumn("communities", F.when(F.col("communities") != "", F.split("communities", " ")))
    else:
        rows = spark.read.schema(ELEM_SCHEMA).format(form).load(paths)
    row = F.col("_metadata.row_index") if form == "parquet" else F.monotonically_increasing_id()
    place = F.struct((F.lit(0) if form == "parquet" else F.col("_metadata.file_block_start")).cast("bigint").alias("block"), row.alias("row"))
    return rows.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint"))).withColumns({"file": F.col("_metadata.file_path"), "place": place})


def write_elems(elems: DataFrame, path: str) -> None:
    """The element table: partitions by collector and day, whole origins and microseconds kept."""
    elems.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("collector", "day").parquet(path)


def write_snapshot(path: str, routes: DataFrame, updates: DataFrame | None = None) -> None:
    """Routes with rib_ts, and the updates that lead to them, as two tables by rib_ts."""
    routes.write.mode("overwrite").partitionBy("rib_ts").parquet(f"{path}/ribs")
    if updates is not None:
        updates.write.mode("overwrite").partitionBy("rib_ts").parquet(f"{path}/updates")


def write_rows(rows: DataFrame, path: str, form: str = "psv") -> None:
    """Rendered rows as psv (| between), or as JSON lines."""
    if form == "psv":
        rows.write.mode("overwrite").csv(path, sep="|", emptyValue="", nullValue="")
    elif form in ("json", "json-line"):
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown form {form!r}: psv, json or json-line")


# --- text routing tables ----------------------------------------------------------------------------


def _word_place(line: Column, word: str) -> Column:
    return F.instr(line, word)


def read_text_dump(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Routes of fixed-width routing-table dumps: elements of type A, with a line number as seq.

    The header row of each file gives the places of its columns. A blank prefix repeats the last one,
    and a prefix too long for its column stands on a line of its own, after which places are one to the
    left. Without a preamble the peer is 0.0.0.0 and AS 0. A file without a header row gives no
    rows; text_dump_headers() tells which those are. Braces of AS sets are dropped, as are tokens that
    are no numbers. The time is that in the file's name, else null.
    """
    lines = _numbered(spark, paths)
    header = _headers(lines).where("c_next IS NOT NULL")
    rows = lines.join(header, "file").where(F.col("seq") > F.col("h_line"))
    routes = rows.withColumn("r", F.coalesce(_route(F.col("line"), 0), _route(F.col("line"), 1)))
    # a wrapped prefix stands alone after the status marks, whether or not it runs into the next column
    alone = F.trim(F.expr("substring(line, 4)"))
    own = F.when(F.col("r").isNotNull(), F.nullif(F.col("r.prefix"), F.lit(""))).when(prefix_key(alone).isNotNull(), alone)
    found = _carried(routes, own, "prefix").where(F.col("r").isNotNull() & prefix_key(F.col("prefix")).isNotNull())
    tokens = F.filter(F.split(F.col("r.path"), r"\s+"), lambda t: t != "")
    code = origin_code(F.when(F.size(tokens) > 0, F.element_at(tokens, -1)))
    asns = path_asns(F.when(code.isNotNull(), F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")).otherwise(F.array_join(tokens, " ")))
    return found.select(
        "file", F.col("seq").cast("bigint").alias("seq"), time_of_path(F.col("file")).alias("ts"), F.lit("A").alias("elem_type"), "peer_ip", "peer_asn", "prefix", F.col("r.next_hop").alias("next_hop"),
        F.array_join(asns.cast("array<string>"), " ").alias("as_path"), F.when(F.size(asns) > 0, F.array(F.element_at(asns, -1))).alias("origin_asns"), code.alias("origin"),
        F.col("r.local_pref").alias("local_pref"), F.col("r.med").alias("med"),
    )


def _numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, seq, line): lines of text files with their numbers. A file is read in blocks, by as many tasks; only the numbers of lines of blocks are summed over it."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__at"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"))
    blocks = lines.groupBy(F.col("file").alias("__file"), F.col("block").alias("__block")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a block's lines are neighbours in their task, so that their numbers follow one another
    joined = lines.join(blocks.withColumn("__before", before), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.select("file", "block", (F.col("__before") + F.col("__at") - F.col("__first")).alias("seq"), "line")


def _carried(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """rows with the last value that isn't null at or before each line of its file: within its block, or else of the blocks before."""
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__value", value)
    ends = rows.where("__value IS NOT NULL").groupBy("file", "block").agg(F.max_by("__value", "seq").alias("__end"))
    every = rows.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    earlier = F.last("__end", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    every = every.select(F.col("file").alias("__file"), F.col("block").alias("__block"), earlier.alias("__earlier"))
    joined = rows.withColumn("__own", own).join(every, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.withColumn(out, F.coalesce("__own", "__earlier")).drop("__value", "__own", "__earlier", "__file", "__block")


def _headers(lines: DataFrame) -> DataFrame:
    """The first header row of each file among its first 64 lines: its place and columns, and the peer of the preamble."""
    # The words of a dump's header and preamble.
    names = (("c_next", "Next Hop"), ("c_metric", "Metric"), ("c_pref", "LocPrf"), ("c_weight", "Weight"), ("c_path", "Path"))
    places = lines.where("seq < 64").withColumns({c: _word_place(F.col("line"), n) for c, n in names})
    is_header = F.col("line").rlike(r"(^|\s)Next Hop(\s|$)") & (F.col("c_next") > 0) & (F.col("c_next") < F.col("c_metric")) & (F.col("c_metric") < F.col("c_pref")) & (F.col("c_pref") < F.col("c_weight")) & (F.col("c_weight") < F.col("c_path"))
    first = F.min(F.when(is_header, F.struct(F.col("seq").alias("h_line"), *[c for c, _ in names])))
    router = F.max(F.regexp_extract("line", r"^BGP table version is [^,]*, local router ID is ([^,]+),", 1))
    local = F.max(F.regexp_extract("line", r"^Default local pref.*local AS (\d+)", 1).try_cast("bigint"))
    found = places.groupBy("file").agg(first.alias("h"), F.coalesce(F.nullif(router, F.lit("")), F.lit("0.0.0.0")).alias("peer_ip"), F.coalesce(local, F.lit(0)).alias("peer_asn"))
    return found.select("file", "h.*", "peer_ip", "peer_asn")


def text_dump_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, has_header) of each text dump."""
    lines = _numbered(spark, paths)
    return _headers(lines).select("file", F.col("c_next").isNotNull().alias("has_header"))


def _route(line: Column, shift: int) -> Column:
    """A struct of the parts of a route line, null if no address begins in the column of the next hop."""

    def part(start: str, end: str | None) -> Column:
        return F.trim(F.expr(f"substring(line, {start} - {shift}, {end} - {start})" if end else f"substring(line, {start} - {shift})"))

    next_hop = part("c_next", "c_metric")
    good = prefix_key(F.concat(next_hop, F.when(next_hop.contains(":"), F.lit("/128")).otherwise(F.lit("/32")))).isNotNull() & F.expr(f"substring(line, c_next - {shift} - 1, 1) = ' '") & ~F.ltrim(line).startswith("Displayed")
    own = F.trim(F.expr(f"substring(line, 4, c_next - {shift} - 4)"))
    return F.when(good, F.struct(own.alias("prefix"), next_hop.alias("next_hop"), part("c_metric", "c_pref").try_cast("bigint").alias("med"), part("c_pref", "c_weight").try_cast("bigint").alias("local_pref"), part("c_path", None).alias("path")))


# --- datasets ---------------------------------------------------------------------------------------


def read_asinfo(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """AS information of JSON lines as five tables by asn; lines that are no records are dropped."""
    rows = spark.read.schema(ASINFO_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("asn IS NOT NULL")
    tables = {"core": rows.select("asn", "name", "country")}
    for part in ("as2org", "peeringdb", "hegemony", "population"):
        fields = [f for f in rows.schema[part].dataType.fieldNames() if f != "asn"]
        tables[part] = rows.where(F.col(part).isNotNull()).select("asn", *[F.col(f"{part}.{f}").alias(f) for f in fields])
    return tables


def _json_form(spark: SparkSession, path: str) -> str:
    """array if the first text that isn't blank begins with a bracket, else lines."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.ltrim("value").substr(1, 1).alias("c")).limit(1).collect()
    return "array" if first and first[0]["c"] == "[" else "lines"


def read_json(spark: SparkSession, path: str, schema: str, form: str | None = None) -> DataFrame:
    """Records of a JSON array, on however many lines, or of JSON lines; form says which, else the first text does. Lines that are no records are dropped."""
    form = form or _json_form(spark, path)
    if form not in ("array", "lines"):
        raise ValueError(f"unknown form {form!r}: array or lines")
    return spark.read.schema(schema).option("multiLine", form == "array").option("mode", "DROPMALFORMED").json(path)


def read_as2rel(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """AS relationships of a JSON array or of JSON lines; the key (asn1, asn2, rel) comes once, with its largest counts."""
    rows = read_json(spark, path, AS2REL_SCHEMA, form).where("asn1 IS NOT NULL AND asn2 IS NOT NULL")
    return rows.groupBy("asn1", "asn2", "rel").agg(F.max("paths_count").alias("paths_count"), F.max("peers_count").alias("peers_count"))


def read_pfx2as(spark: SparkSession, path: str) -> DataFrame:
    """Prefixes and origins of JSON, without default routes and text that is no prefix, labelled unknown."""
    rows = read_json(spark, path, PFX2AS_SCHEMA)
    return rows.where(~F.col("prefix").endswith("/0") & prefix_key(F.col("prefix")).isNotNull()).withColumn("validation", F.lit("unknown"))


def with_validation(pfx2as: DataFrame, roas: DataFrame) -> DataFrame:
    """pfx2as with its label set by origin validation; not found is unknown."""
    states = rov.validated(pfx2as.drop("validation"), roas)
    return states.withColumn("validation", F.when(F.col("state") == "not_found", "unknown").otherwise(F.col("state"))).drop("state")


def read_roas(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json(spark, path, ROA_SCHEMA)
    return rows.where(prefix_key(F.col("prefix")).isNotNull())


def read_aspas(spark: SparkSession, path: str) -> DataFrame:
    """One row for each customer and provider."""
    rows = read_json(spark, path, ASPA_SCHEMA)
    return rows.select("customer_asn", F.explode("provider_asns").alias("provider_asn")).distinct()


def roa_snapshot(roas: DataFrame, date: str | None = None, source: str | None = None, collector: str | None = None) -> DataFrame:
    """ROAs of a table by date, source and collector: of one day, or without a date the latest of the source, if one is named, or of all."""
    if date is None:
        rows = roas if source is None else roas.where(F.col("source") == source.lower())
        rows = rows if collector is None else rows.where(F.col("collector") == collector)
        return rows.where(F.col("date") == F.lit(rows.agg(F.max("date")).first()[0]))
    source = (source or DEFAULT_ROA_SOURCE).lower()
    if source not in ROA_SOURCES:
        raise ValueError(f"unknown ROA source {source!r}: {', '.join(ROA_SOURCES)}")
    rows = roas.where((F.col("date") == date) & (F.col("source") == source))
    if ROA_SOURCES[source]:
        return rows.where(F.col("collector") == (collector or DEFAULT_ROA_COLLECTOR))
    if collector:
        raise ValueError(f"{source} has no collectors")
    return rows


def read_prefix_list(spark: SparkSession, path: str) -> DataFrame:
    """Prefixes of a text file, one a line; what follows # and blank lines are skipped; ValueError if none is left or one is no prefix."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("prefix")).where("prefix <> ''")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no prefix")
    if bad := rows.where(prefix_key(F.col("prefix")).isNull()).limit(1).collect():
        raise ValueError(f"{path}: {bad[0]['prefix']!r} is no prefix")
    return rows.distinct()


def store_pfx2as(rows: DataFrame, path: str) -> dict[str, int]:
    """Write prefixes and origins in place of those before, each (prefix, origin_asn) once and ordered by address, so that a reader prunes by it; how many records and prefixes there are."""
    key = prefix_key(F.col("prefix"))
    table = rows.withColumn("__k", key).where("__k IS NOT NULL")
    values = [c for c in rows.columns if c not in ("prefix", "origin_asn")]
    table = table.groupBy("prefix", "origin_asn", "__k").agg(*[F.max(c).alias(c) for c in values]) if values else table.distinct()
    table = table.select("prefix", "origin_asn", *values, F.col("__k.family").alias("family"), F.col("__k.hi").alias("net_hi"), F.col("__k.lo").alias("net_lo"), F.col("__k.len").alias("net_len"))
    table.repartitionByRange("family", "net_hi", "net_lo", "net_len").sortWithinPartitions("family", "net_hi", "net_lo", "net_len").write.mode("overwrite").parquet(path)
    counts = rows.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("prefix").alias("prefixes")).first()
    return counts.asDict()


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """A dataset written whole in place of the one before."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def first_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    return df if most is None else df.limit(most)
