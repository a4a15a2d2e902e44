"""Removal of repeated runs of lines, over content-defined line chunks.

A text is its list of line identifiers. A rolling hash over the hashes of its lines says where a chunk of lines
ends, so that boundaries move with the content. Chunks of several lines that stand at several places go but
at the first. What such chunks leave of a repeated run, its first and last lines and runs too short to hold
a whole chunk, is found by extending matches line by line: every two neighbouring lines outside the
chunks that went, and every long line, are looked up likewise. Bytes are compared under every
identifier that anything is removed by; if one stands for two lines, longer ones are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ID_BYTES, identify, in_slots, slots_of, unverified
from .common import checkpointed, sliced, stored, text_digest

#: Lines that the rolling hash spans, one in how many places ends a chunk, lines of a chunk at most.
SPAN_LINES, ONE_IN, MOST_LINES = 2, 4, 32
#: A single line of more words than this is a run of its own.
LONG_LINE_WORDS = 50
MASK = (1 << 64) - 1
#: What the words byte of a line says.
SOME, LONG = 1, 2


def chunk_bounds(ids: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk of lines with these identifiers; together they are all lines."""
    hashes = [int.from_bytes(i[:8], "big") for i in ids]
    out, start = [], 0
    for i in range(len(hashes)):
        rolled = 0
        for h in hashes[max(0, i - SPAN_LINES + 1) : i + 1]:
            rolled = ((rolled << 1 | rolled >> 63) & MASK) ^ h
        # the top bits, as short identifiers fill only these
        if (rolled ^ rolled >> 31) % ONE_IN == 0 or i + 1 - start == MOST_LINES or i + 1 == len(hashes):
            out.append((start, i + 1))
            start = i + 1
    return out


def _sha() -> Column:
    """Sixteen bytes of the text's digest."""
    return F.substring(F.unhex(text_digest()), 1, 16)


def line_table(docs: DataFrame, id_bytes: int) -> DataFrame:
    """(doc_id, sha, ids, words) of each row: its lines' identifiers end to end, and for each line whether it has a word (SOME) and more than LONG_LINE_WORDS (LONG)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            ids, words = [], []
            for text in texts:
                lines = text.split(b"\n")
                ids.append(b"".join([identify(x, id_bytes) for x in lines]))
                words.append(bytes([(SOME if (n := len(x.split(None, LONG_LINE_WORDS))) else 0) | (LONG if n > LONG_LINE_WORDS else 0) for x in lines]))
            yield pa.record_batch([batch.column("doc_id"), batch.column("sha"), pa.array(ids, pa.binary()), pa.array(words, pa.binary())], names=["doc_id", "sha", "ids", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _sha().alias("sha"), "text").mapInArrow(emit, f"doc_id {kind}, sha binary, ids binary, words binary")


def _cut_ids(ids: bytes, size: int) -> list[bytes]:
    return [ids[i : i + size] for i in range(0, len(ids), size)]


def chunk_places(lines: DataFrame, size: int) -> DataFrame:
    """(doc_id, sha, place, id) of each chunk of several lines with a word; id joins its lines' own."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, chunk = [], [], []
            for i, (ids, words) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                for a, b in chunk_bounds(_cut_ids(ids, size)):
                    if b - a > 1 and any(words[a:b]):
                        doc.append(i)
                        place.append(a)
                        chunk.append(ids[a * size : b * size])
            index = pa.array(doc, pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(index), batch.column("sha").take(index), pa.array(place, pa.int32()), pa.array(chunk, pa.binary())], names=["doc_id", "sha", "place", "id"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.mapInArrow(emit, f"doc_id {kind}, sha binary, place int, id binary")


def _repeated(found: DataFrame) -> DataFrame:
    """(of, first): the runs that stand at several places, and their first one.

    It is a table of its own, so that the join of a run that stands in very many documents can be split.
    """
    place = F.struct("doc_id", "sha", "place")
    ends = found.groupBy(F.col("id").alias("of")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return checkpointed(ends.where(~F.col("first").eqNullSafe(F.col("last"))).select("of", "first"))


def _by_text(places: DataFrame, value: Column) -> DataFrame:
    return places.groupBy(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).agg(F.collect_set(value).alias("places"))


def _same_text() -> Column:
    return F.col("sha").eqNullSafe(F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id"))


def run_places(lines: DataFrame, size: int) -> DataFrame:
    """(doc_id, sha, place, id, gone) of every two neighbouring lines with a word and every long line.

    lines has places, those of its chunks that go: pairs within these have no id and are gone; so each such
    chunk is counted at its first place alone.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, run = [], [], []
            for i, (ids, words, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "words", "places")), strict=True)):
                inside: set[int] = set()
                if places:
                    wanted = set(places)
                    for a, b in chunk_bounds(_cut_ids(ids, size)):
                        if a in wanted:
                            inside.update(range(a, b - 1))
                last = len(words) - 1
                for a, w in enumerate(words):
                    if w & LONG and a not in inside and a - 1 not in inside:
                        doc.append(i)
                        place.append(2 * a)
                        run.append(ids[a * size : (a + 1) * size])
                    if a < last and (w or words[a + 1]):
                        doc.append(i)
                        place.append(2 * a + 1)
                        run.append(None if a in inside else ids[a * size : (a + 2) * size])
            index = pa.array(doc, pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(index), batch.column("sha").take(index), pa.array(place, pa.int64()), pa.array(run, pa.binary())], names=["doc_id", "sha", "code", "id"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    rows = lines.mapInArrow(emit, f"doc_id {kind}, sha binary, code long, id binary")
    return rows.select("doc_id", "sha", F.shiftright("code", 1).cast("int").alias("place"), "code", "id")


def compared_lines(docs: DataFrame, id_bytes: int, slots: dict[int, bytes]) -> DataFrame:
    """(id, chunk) of the lines whose identifiers may be among those of slots, copies within a slice of a batch once."""
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in sliced(batches):
            lines = list({x for t in texts for x in t.split(b"\n")})
            ids = [identify(x, id_bytes) for x in lines]
            some = [(i, x) for i, x, hit in zip(ids, lines, in_slots(ids, shared.value), strict=True) if hit]
            yield pa.record_batch([pa.array([i for i, _ in some], pa.binary()), pa.array([x for _, x in some], pa.binary())], names=["id", "chunk"])

    return docs.select("text").mapInArrow(emit, "id binary, chunk binary")


def _line_ids(runs: DataFrame, size: int) -> DataFrame:
    """The identifiers of the lines of runs (column of)."""
    return runs.select(F.explode(F.transform(F.sequence(F.lit(0), (F.length("of") / size - 1).cast("int")), lambda i: F.substring(F.col("of"), (i * size + 1).cast("int"), F.lit(size)))).alias("id"))


def repeated_places(docs: DataFrame, size: int) -> tuple[DataFrame, bool]:
    """((__id, __sha, places) of each text that loses lines, whether every identifier that decided it stands for one line); places are those of pairs, doubled and 1 more, and of single lines, doubled."""
    lines = stored(line_table(docs, size))
    chunks = chunk_places(lines, size)
    chunk_runs = _repeated(chunks)
    later = chunks.join(chunk_runs, F.col("id") == F.col("of")).where(~F.struct("doc_id", "sha", "place").eqNullSafe(F.col("first")))
    rest = stored(lines.join(_by_text(later, F.col("place")), _same_text(), "left").drop("__id", "__sha"))
    found = run_places(rest, size)
    runs = _repeated(found.where("id IS NOT NULL"))
    long = (F.length("id") / size).cast("int")
    overlaps = F.struct("doc_id", "sha").eqNullSafe(F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.sha").alias("sha"))) & (F.col("place") - F.col("first.place") < long)
    gone = found.join(runs, F.col("id") == F.col("of")).where(~overlaps).select("doc_id", "sha", "code").union(found.where("id IS NULL").select("doc_id", "sha", "code"))
    slots = slots_of(_line_ids(chunk_runs.select("of").union(runs.select("of")), size))
    return _by_text(gone, F.col("code")), not slots or unverified(compared_lines(docs, size, slots)).isEmpty()


def remove_repeated_runs(docs: DataFrame, id_sizes: tuple[int, ...] = ID_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, removed_lines, text (what is left of it).

    A line goes if it, being long, or it and a neighbour stand at an earlier place too: so of a run of two
    or more lines all go but at its first place, however the lines around it differ. Places are in
    the order of doc_id (null before all), the text's digest and the line; places that overlap the
    first one are no repeats. Two neighbours without a word are no run. The first place of every line
    stays. A null or empty text is one empty line and loses nothing; a line of any length is one line. Rows that repeat
    both id and text lose the same lines; an empty table gives no rows.
    """
    for size in id_sizes:
        places, sure = repeated_places(docs, size)
        if sure:
            return cut(docs, places)
    raise ValueError(f"identifiers of {id_sizes[-1]} bytes still stand for different lines")


def cut(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed_lines, text) of each row of docs without the lines of its places."""
    rows = docs.select("doc_id", _sha().alias("sha"), "text")
    joined = rows.join(places, _same_text(), "left").select("doc_id", "text", "places")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches):
            left, lines_of, removed = [], [], []
            for text, codes in zip(texts, batch.column("places").to_pylist(), strict=True):
                lines = text.split(b"\n")
                lines_of.append(len(lines))
                out = {a for c in codes or () for a in range(c >> 1, (c >> 1) + (c & 1) + 1)}
                removed.append(len(out))
                left.append(b"\n".join([x for a, x in enumerate(lines) if a not in out]) if out else text)
            yield pa.record_batch([batch.column("doc_id"), pa.array(lines_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "removed_lines", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(emit, f"doc_id {kind}, n_lines long, removed_lines long, text string")
