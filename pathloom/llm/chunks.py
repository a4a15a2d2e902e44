"""Content-defined cuts of byte strings, and identifiers that stand for verified bytes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A 32-bit number for each byte, by rule.
GEAR = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)
#: Bytes that the rolling hash looks back; no cut comes earlier in a text.
WINDOW = 16
#: Lengths in bytes of the identifiers that are tried in turn.
ID_BYTES = (16, 32, 64)
#: Bits of a map of identifiers, 16 MB at most.
SLOTS = 1 << 27


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the WINDOW bytes that end there, by doubling the window."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cuts(texts: list[bytes], bits: int, least: int, most: int) -> list[list[int]]:
    """For each text the ends of its chunks: where the top bits of the rolling hash are zero, within least and most bytes.

    What precedes a text in the batch can't reach its cuts, as the first one comes after WINDOW bytes.
    """
    least = max(least, WINDOW)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    found = np.flatnonzero(rolling(data) >> np.uint32(32 - bits) == 0) + 1
    out, begin, k = [], 0, 0
    positions = found.tolist()
    for text in texts:
        end, last, ends = begin + len(text), begin, []
        while k < len(positions) and positions[k] < end:
            at = positions[k]
            while at - last > most:
                last += most
                ends.append(last - begin)
            if at - last >= least and at > begin + WINDOW:
                ends.append(at - begin)
                last = at
            k += 1
        while end - last > most:
            last += most
            ends.append(last - begin)
        if end > last:
            ends.append(end - begin)
        while k < len(positions) and positions[k] <= end:
            k += 1
        out.append(ends)
        begin = end
    return out


def identify(chunk: bytes, size: int) -> bytes:
    """An identifier of size bytes: XXH3 up to 16, SHA-512 beyond."""
    return xxhash.xxh3_128_digest(chunk)[:size] if size <= 16 else hashlib.sha512(chunk).digest()[:size]


def unverified(chunks: DataFrame) -> DataFrame:
    """The identifiers that stand for more than one byte string; chunks has columns id and chunk.

    Each distinct (id, chunk) moves once, after removal of copies on the map side.
    """
    return chunks.select("id", "chunk").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def slot_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)) + 1


def slots_of(ids: DataFrame) -> dict[int, bytes]:
    """A bitmap over hashes of ids (column id, repeats allowed), of bounded size, so that tasks can hold it.

    Other identifiers may share a bit, the more the fuller it is: then more bytes are compared than need be.
    """
    slots = ids.select(slot_of("id").alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    return {r["bucket"]: bytes(r["bits"]) for r in bits.collect()}


def in_slots(ids: list[bytes], slots: dict[int, bytes]) -> list[bool]:
    """Whether each id's bit is set; the hash is that of slot_of()."""
    out = []
    for i in ids:
        p = xxhash.xxh64_intdigest(i, 42)
        p = (p if p < 1 << 63 else p - (1 << 64)) % SLOTS
        bits = slots.get(p // 32768 + 1)
        out.append(bool(bits and bits[p % 32768 // 8] >> p % 8 & 1))
    return out
