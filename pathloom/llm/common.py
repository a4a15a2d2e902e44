"""What the operators share: shared-folder checkpoints, byte views of texts, row identity."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time.
SLICE_BYTES = 4 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that spark.checkpoint.dir names; one is set only where there is none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: for tables too wide or long for a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of intermediate tables deleted when the driver's JVM ends, in whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables written between stages."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or _local_folder(spark)


_LOCAL: list[str] = []


def _local_folder(spark: SparkSession) -> str:
    """A folder of this process where Spark is local, gone with the process."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="pathloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def text_digest(column: str = "text") -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is held out, as it can't be assigned."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def doc_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in runs of rows whose texts hold at most limit bytes together; a longer text comes alone."""
    for batch in batches:
        lengths = [n or 0 for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                part = batch.slice(start, i - start)
                yield part, doc_bytes(part.column(column))
                start, total = i, 0
            total += n
        if start < len(lengths):
            part = batch.slice(start)
            yield part, doc_bytes(part.column(column))


def with_ordinal(df: DataFrame, *order: Column) -> DataFrame:
    """df with a column ordinal: 0, 1, 2, ... in this order, which must tell rows apart for reruns to agree.

    The sort is by ranges; only the number of rows of each range is summed, in a table of as many rows as there are ranges.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    # one row for each range, far below any limit of a broadcast
    return ordered.join(F.broadcast(offsets), part == F.col("__part")).withColumn("ordinal", place).drop("__at", "__part", "__before")


#: Words of 64 bits of a filter of members; 512 KB, whatever it holds.
FILTER_WORDS = 1 << 16


def member_filter(members: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that every value of a column passes, and but a few other values do: for rows that a join would move only to drop them.

    It is a bitmap of two bits for each value, whose words, FILTER_WORDS at most, come to the driver and go out with the tasks.
    """
    bits = 6 + FILTER_WORDS.bit_length() - 1

    def places(value: Column) -> list[Column]:
        h = F.xxhash64(value)
        mask = F.lit((1 << bits) - 1).cast("long")
        return [h.bitwiseAND(mask), F.shiftrightunsigned(h, bits).bitwiseAND(mask)]

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))

    words = [0] * FILTER_WORDS
    rows = members.select(F.explode(F.array(*places(F.col(column)))).alias("p"))
    for r in rows.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit(F.col("p"))).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    # as text, since a literal array would be put together element by element; it is read once, when the plan is made
    bitmap = F.from_json(F.lit(json.dumps(words)), "array<long>")

    def passes(value: Column) -> Column:
        first, second = (F.get(bitmap, F.shiftright(p, 6).cast("int")).bitwiseAND(bit(p)) != 0 for p in places(value))
        return first & second

    return passes


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """Each row as one struct beside its identity, so that no column name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), text_digest(text).alias("__sha"))


def _same_row() -> Column:
    return F.col("__sha").eqNullSafe(F.col("__ksha")) & F.col("__id").eqNullSafe(F.col("__kid"))


def keep_rows(docs: DataFrame, decisions: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose (doc_id, text digest) is among decisions; rows pass whole and unchanged.

    decisions has columns doc_id and text_sha256. The join is on both, null ids included, so that
    rows that share an id but not a text are judged apart. No column is added or renamed.
    """
    right = decisions.select(F.col("doc_id").alias("__kid"), F.col("text_sha256").alias("__ksha"))
    return _packed(docs, text).join(right, _same_row(), "left_semi").select("__row.*")


def keep_one_row_each(docs: DataFrame, decisions: DataFrame, text: str = "text") -> DataFrame:
    """Like keep_rows(), but of rows that share both doc_id and text one stays, the one whose columns hash lowest.

    decisions has a row for each row of docs that it means. Only rows that repeat are grouped, by partial aggregation, so
    that any number of them can share an id, or have none.
    """
    counted = checkpointed(decisions.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")))
    repeated = counted.where("n > 1")
    if repeated.isEmpty():
        return keep_rows(docs, counted, text)
    right = repeated.select(F.col("doc_id").alias("__kid"), F.col("text_sha256").alias("__ksha"))
    rows = _packed(docs, text).join(right, _same_row(), "left_semi")
    single = rows.groupBy("__id", "__sha").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row.*")
    return keep_rows(docs, counted.where("n = 1"), text).unionByName(single)


def repeat_rows(docs: DataFrame, times: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs as often as times says (doc_id, text_sha256, n, slot; once for each pair), rows in the order of slot, those that come again after; rows that it hasn't go."""
    right = times.select(F.col("doc_id").alias("__kid"), F.col("text_sha256").alias("__ksha"), F.col("n").alias("__n"), F.col("slot").alias("__slot"))
    joined = _packed(docs, text).join(right.where("__n > 0"), _same_row())
    laps = joined.select("__row", "__slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))).alias("__lap"))
    return laps.repartitionByRange("__lap", "__slot").sortWithinPartitions("__lap", "__slot").select("__row.*")
