"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Points of the golden-ratio sequence, one for each slot, fall through the cumulative target shares to
sources; the slots of a source are ranked in order. The documents of a source, shuffled by a hash and
laid end to end, are cut into blocks of equal tokens, twice over; the slot of rank r takes block r.
After the schedule each source is settled to its rounded target: the last block is taken in part, blocks that
the slots left out are added, and those beyond the target go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, repeat_rows, text_digest, with_ordinal

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_TOKENS = 64
#: Parts of a source's shuffled stream whose sums are carried on, of [0, 1), and of the slots.
BUCKETS, CELLS, RUN = 4096, 4096, 1 << 16
GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


def ordinals(df: DataFrame, column: str) -> DataFrame:
    """df, of distinct values, with a column ordinal: 0 for the least, in code point order, null last."""
    return with_ordinal(df, F.col(column).asc_nulls_last())


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target: share of all sizes dealt by weight, no target above most times its source.

    The excess of stopped sources is dealt again by weight until none is above. Only sums come to the driver.
    """
    rows = checkpointed(ordinals(sizes, "source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    cap = F.col("source_size") * float(most)
    while True:
        stopped = F.col("weight") * level >= cap
        free, held = rows.agg(F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, cap))).first()
        after = (total - (held or 0.0)) / free if free else level
        if not free or after <= level * (1 + 1e-12):
            break
        level = after
    return rows.select("source", "source_size", "weight", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def schedule(goal: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, sid, rank): each slot's source and how many of that source's slots came before it; goal has sid and target.

    Slots and shares meet in cells of [0, 1), so that a source with much of the weight has its slots in
    many cells; ranks come from counts of runs of slots and positions in a run.
    """
    spark = goal.sparkSession
    total = goal.agg(F.sum("target")).first()[0] or 0.0
    if not total:
        return spark.createDataFrame([], "slot long, sid long, rank long")
    shares = _running(goal.select("sid", "target"), "target", "sid").select("sid", (F.col("before") / total).alias("low"), ((F.col("before") + F.col("target")) / total).alias("high")).where("high > low")
    pieces = shares.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    step, high = 1 << 20, GOLDEN * (1 << 20) % 1.0
    point = F.pmod(F.pmod(F.floor(F.col("id") / step) * F.lit(high), F.lit(1.0)) + (F.col("id") % step) * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(int(math.ceil(total / block))).select(F.col("id").alias("slot"), point.alias("point")).withColumn("at", F.floor(F.col("point") * CELLS))
    dealt = slots.join(pieces, (F.col("at") == F.col("cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "sid")
    dealt = dealt.withColumn("run", F.floor(F.col("slot") / RUN))
    runs = dealt.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select(F.col("sid").alias("__sid"), F.col("run").alias("__run"), F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    return ranked.join(runs, (F.col("sid") == F.col("__sid")) & (F.col("run") == F.col("__run"))).select("slot", "sid", (F.col("earlier") + F.col("own")).alias("rank"))


def settled(goal: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(sid, rank, slot): the scheduled blocks, and after them those that a source still lacks for its rounded target.

    A source's slots differ from its share by few, so few blocks are added to any source; their slots follow all others, by rank.
    """
    slots = checkpointed(schedule(goal, block).select("sid", "rank", "slot"))
    dealt = slots.groupBy(F.col("sid").alias("__sid")).agg((F.max("rank") + 1).alias("__dealt"))
    last = int(math.ceil((goal.agg(F.sum("target")).first()[0] or 0.0) / block))
    wanted = goal.select("sid", F.ceil(F.round("target") / block).cast("long").alias("wanted")).join(dealt, F.col("sid") == F.col("__sid"), "left").withColumn("from", F.coalesce("__dealt", F.lit(0)).cast("long"))
    added = wanted.where("from < wanted").select("sid", "from", F.explode(F.sequence(F.col("from"), F.col("wanted") - 1)).alias("rank"))
    return slots.union(added.select("sid", "rank", F.lit(last) + F.col("rank") - F.col("from")))


def _running(rows: DataFrame, value: str, by: str) -> DataFrame:
    """rows with before: the sum of value over the rows with a smaller by (distinct, from 0 on), through sums of runs."""
    rows = rows.withColumn("__run", F.floor(F.col(by) / 1024))
    runs = rows.groupBy(F.col("__run").alias("__r")).agg(F.sum(value).alias("__s"))
    runs = runs.withColumn("__top", F.floor(F.col("__r") / 1024))
    tops = runs.groupBy(F.col("__top").alias("__t")).agg(F.sum("__s").alias("__ts")).withColumn("__tb", F.coalesce(F.sum("__ts").over(Window.partitionBy(F.floor(F.col("__t") / (1 << 40))).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.join(tops, F.col("__top") == F.col("__t")).withColumn("__b", F.col("__tb") + F.coalesce(F.sum("__s").over(Window.partitionBy("__top").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__r", "__b")
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__run").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(runs, F.col("__run") == F.col("__r")).withColumn("before", F.col("__b") + F.col("__own")).drop("__run", "__own", "__r", "__b")


def streams(docs: DataFrame) -> DataFrame:
    """docs (sid, doc_id, text_sha256, size) with start: where each document with words begins in its source's shuffled stream.

    The order is that of a hash of id and text. A source is summed in BUCKETS ranges of the hash, then within each.
    """
    key = F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(1 << 40))
    rows = docs.where("size > 0").withColumn("__key", key).withColumn("__bucket", F.floor(F.col("__key") / ((1 << 40) // BUCKETS)))
    buckets = rows.groupBy(F.col("sid").alias("__sid"), F.col("__bucket").alias("__b")).agg(F.sum("size").alias("__s"))
    buckets = buckets.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy("__sid").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "__bucket").orderBy("__key", "doc_id", "text_sha256").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("__own", own).join(buckets, (F.col("sid") == F.col("__sid")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("start", F.col("__before") + F.col("__own")).select(*docs.columns, "start")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, size, source_size, target, taken, first_slot.

    size counts words, 0 for a null text; source_size and target belong to the row's source, null
    sources being one source, the last. taken is how many of the row's words the settled blocks
    hold, repeats counted: at most most times its size, as a stream is laid out most times and each
    block is taken once. Over the rows of a source it adds up to the target, rounded. The order of a stream depends on ids and texts alone, so reruns agree; rows
    that repeat both are told apart by nothing and share the same words of the stream's order. A row
    without words takes none; without any words every target is 0, and an empty table gives no rows. first_slot is the first
    slot of the schedule that takes of the row, null if none does: the order of the mixed stream.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), text_digest().alias("text_sha256"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = checkpointed(rows)
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = checkpointed(ordinals(goal, "source").withColumnRenamed("ordinal", "sid"))
    names = goal.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("__source")), "left")
    laid = checkpointed(streams(rows.select("sid", "doc_id", "text_sha256", "size", "source_size", "target")))
    pieces = laid.select("sid", "start", "size", "source_size", F.round("target").cast("long").alias("goal"), F.explode(F.array(*[F.lit(i) for i in range(most)])).alias("lap")).withColumn("from", F.col("start") + F.col("lap") * F.col("source_size"))
    pieces = pieces.where(F.col("from") < F.col("goal")).withColumn("to", F.least(F.col("from") + F.col("size"), "goal")).withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    overlap = F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)
    slots = settled(goal.select("sid", "target"), block).select(F.col("sid").alias("__sid"), F.col("rank").alias("__rank"), "slot")
    held = pieces.select("sid", "start", "block", overlap.alias("words")).join(slots, (F.col("sid") == F.col("__sid")) & (F.col("block") == F.col("__rank")))
    taken = held.groupBy(F.col("sid").alias("__sid"), F.col("start").alias("__start")).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    mixed = laid.join(taken, (F.col("sid") == F.col("__sid")) & (F.col("start") == F.col("__start")), "left").select("doc_id", "text_sha256", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    empty = rows.where("size = 0").select("doc_id", "text_sha256", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return mixed.union(empty)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as its taken words fill it, rounded to whole documents; columns as in docs.

    Partitions and their rows are in the order of the schedule's slots, so that reading them in turn reads the mixed stream.
    A row taken twice comes again half a stream later. Rows that share id and text, null ids included, are taken alike; nulls in other columns pass.
    """
    found = mix(docs)
    filled = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.nullif(F.col("size"), F.lit(0)))))
    times = found.withColumn("n", filled).groupBy("doc_id", "text_sha256").agg(F.max("n").alias("n"), F.min("first_slot").alias("slot"))
    return repeat_rows(docs, times)
