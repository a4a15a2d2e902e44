"""Exact document deduplication over content-defined chunk recipes.

Every text is cut where a rolling hash of its bytes says so, and is its ordered list of chunk identifiers, its
recipe; recipes are stored once. Identifiers that occur more than once are verified: only chunks under
these move, and are compared byte for byte; if one identifier stands for two byte strings, longer ones
are taken. Then only recipes are grouped and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ID_BYTES, cuts, identify, in_slots, slots_of, unverified
from .common import checkpointed, keep_one_row_each, sliced, stored, text_digest

CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST = 10, 256, 8192


def recipe_table(docs: DataFrame, id_bytes: int) -> DataFrame:
    """(doc_id, text_sha256, recipe): a row for each document; the recipe is its identifiers in order."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            recipes = []
            for text, ends in zip(texts, cuts(texts, CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST), strict=True):
                recipes.append([identify(text[a:b], id_bytes) for a, b in zip([0, *ends], ends, strict=False)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_sha256"), pa.array(recipes, pa.list_(pa.binary()))], names=["doc_id", "text_sha256", "recipe"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("text_sha256"), "text")
    return rows.mapInArrow(emit, "doc_id long, text_sha256 string, recipe array<binary>")


def repeated_slots(recipes: DataFrame) -> dict[int, bytes]:
    """A bitmap of the identifiers that occur more than once."""
    return slots_of(recipes.select(F.explode("recipe").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def compared_chunks(docs: DataFrame, id_bytes: int, slots: dict[int, bytes]) -> DataFrame:
    """(id, chunk) of the chunks whose identifiers may occur more than once; copies within a slice of a batch come once."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for _, texts in sliced(batches):
            found = {}
            for text, ends in zip(texts, cuts(texts, CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST), strict=True):
                for a, b in zip([0, *ends], ends, strict=False):
                    found[text[a:b]] = None
            ids = [identify(c, id_bytes) for c in found]
            some = [(i, c) for i, c, hit in zip(ids, found, in_slots(ids, slots), strict=True) if hit]
            yield pa.record_batch([pa.array([i for i, _ in some], pa.binary()), pa.array([c for _, c in some], pa.binary())], names=["id", "chunk"])

    return docs.select("text").mapInArrow(emit, "id binary, chunk binary")


def verified_recipes(docs: DataFrame, id_sizes: tuple[int, ...] = ID_BYTES) -> DataFrame:
    """recipe_table() of the first size at which every identifier that occurs more than once stands for one byte string, stored."""
    for size in id_sizes:
        recipes = stored(recipe_table(docs, size))
        slots = repeated_slots(recipes)
        if not slots or unverified(compared_chunks(docs, size, slots)).isEmpty():
            return recipes
    raise ValueError(f"identifiers of {id_sizes[-1]} bytes still stand for different bytes")


def exact_duplicates(docs: DataFrame, id_sizes: tuple[int, ...] = ID_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty, so null and empty texts form one
    group. Of a group the row with the largest doc_id stays; null ids rank below all others. Rows
    that share both id and text are one document stated again: each carries the same decision, and
    group_size counts rows. In a group without any id every row is kept. An empty table gives an
    empty result; other columns are not looked at.
    """
    recipes = verified_recipes(docs, id_sizes)
    groups = recipes.groupBy(F.col("recipe").alias("__recipe")).agg(F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    # only groups of several rows are joined; as a table of their own, so that a join of a huge group can be split
    joined = recipes.join(checkpointed(groups.where("__size > 1")), F.col("recipe") == F.col("__recipe"), "left")
    single = F.col("__size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("__keep"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, whole and unchanged: that with the largest doc_id.

    Of rows that share id and text, or that have no id, one stays.
    """
    return keep_one_row_each(docs, exact_duplicates(docs).where("kept"))
