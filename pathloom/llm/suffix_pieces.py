"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct words of a batch are laid end to end and indexed by a suffix array. Every piece of the
vocabulary is searched for by bisection, which gives the range of its occurrences; these are the
edges of all words' lattices at once. Sorted by word, merge rank and position they are relaxed: in each
round every word takes its best edge that joins just two symbols, until no edge does. So the ids
are those that the model itself gives, and decoding gives the text back byte for byte.

The one difference: the model reads the sign U+2581 in a text as a space, which couldn't be decoded;
here it takes byte pieces, as other characters without a piece do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_digest

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids a task keeps, bytes of one index, and bytes of a word that is relaxed along with others; longer ones have a heap each.
KEPT_WORDS, INDEX_BYTES, TOGETHER = 500_000, 1 << 18, 48
#: Bytes of a word that are relaxed at once where pieces cross each of its places.
RUN_BYTES = 1 << 14
#: A word: spaces and what follows them, or a sign that no piece holds. No piece has a space behind another character.
WORD = re.compile(rb"[\n\t]| +[^ \n\t]*|[^ \n\t]+")
MARK = "▁".encode()


def vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray]:
    """(pieces by merge rank, their ids, each id's bytes, ids of the 256 bytes); the mark of a space is a space here."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found, of_id, of_byte = [], [], np.zeros(256, dtype=np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
            of_id.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            of_id.append(b"")
        else:
            of_id.append(piece.replace("▁", " ").encode())
            found.append((-model.get_score(i), i))
    ids = [i for _, i in sorted(found)]
    pieces = [of_id[i] for i in ids]
    if any(WORD.fullmatch(p) is None or p in (b"\n", b"\t") for p in pieces):
        raise ValueError(f"{path} has pieces that cross words")
    return pieces, np.array(ids, dtype=np.int32), of_id, of_byte


class Index:
    """A suffix array of data, sorted by the first eight bytes and, where a longer piece begins so, by all that pieces need."""

    def __init__(self, data: bytes):
        self.data = data
        padded = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
        key = np.zeros(len(data), dtype=np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + len(data)]
        self.array = np.argsort(key)
        self.first = key[self.array]


class Encoder:
    """Encodes many words at once; the ids of words met before are kept, up to KEPT_WORDS."""

    def __init__(self, pieces: list[bytes], ids: np.ndarray, of_id: list[bytes], of_byte: np.ndarray):
        self.pieces, self.ids, self.of_id, self.of_byte = pieces, ids, of_id, of_byte
        self.lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.depth = int(self.lengths.max(initial=1))
        short = np.flatnonzero(self.lengths <= 8)
        self.short = short
        self.low, self.high = (np.array([int.from_bytes(pieces[i].ljust(8, f), "big") for i in short.tolist()], dtype=np.uint64) for f in (b"\0", b"\xff"))
        begins: dict[int, list[int]] = {}
        for i in np.flatnonzero(self.lengths > 8).tolist():
            begins.setdefault(int.from_bytes(pieces[i][:8], "big"), []).append(i)
        self.long = list(begins.values())
        self.long_first = np.array(list(begins), dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.fronts: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece."""
        index = Index(data)
        a, b = np.searchsorted(index.first, self.low, side="left"), np.searchsorted(index.first, self.high, side="right")
        hit = np.flatnonzero(b > a)
        n = (b - a)[hit]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts, found = [index.array[np.repeat(a[hit], n) + inside]], [np.repeat(self.short[hit], n)]
        a, b = np.searchsorted(index.first, self.long_first, side="left"), np.searchsorted(index.first, self.long_first, side="right")
        for i in np.flatnonzero(b > a).tolist():
            places = sorted((data[p : p + self.depth], p) for p in index.array[a[i] : b[i]].tolist())
            for piece in self.long[i]:
                wanted = self.pieces[piece]
                lo = hi = bisect_left(places, (wanted,))
                while hi < len(places) and places[hi][0].startswith(wanted):
                    hi += 1
                if hi > lo:
                    starts.append(np.array([p for _, p in places[lo:hi]], dtype=np.int64))
                    found.append(np.full(hi - lo, piece, dtype=np.int64))
        return np.concatenate(starts), np.concatenate(found)

    def parts(self, word: bytes) -> list[bytes]:
        """A word cut where its segmentation has a boundary: where no piece could cross, and in long runs without such a place by sure_cuts()."""
        out, at, run = [], 0, None
        while at < len(word):
            data = word[at : at + INDEX_BYTES]
            if data == run and at + len(data) < len(word):
                own, used = self.sure_cuts(word, at, len(word), len(data))
                out += own
                at += used
                continue
            start, piece = self.edges(data)
            crossed = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(crossed, start + 1, 1)
            np.add.at(crossed, start + self.lengths[piece], -1)
            whole = at + len(data) == len(word)
            last = len(data) if whole else len(data) - self.depth
            lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
            free = (np.cumsum(crossed)[: len(data)] == 0) & lead
            cuts = np.flatnonzero(free)
            cuts = cuts[(cuts > 0) & (cuts <= last)]
            ends = [*cuts.tolist(), len(data)] if whole else cuts.tolist()
            if not ends:
                # nothing is free here: the run goes on, at most to the end of the word
                run = data
                own, used = self.sure_cuts(word, at, len(word), len(data))
                out += own
                at += used
                continue
            for i, j in zip([0, *ends], ends, strict=False):
                out += [data[i:j]] if j - i <= RUN_BYTES else self.sure_cuts(data[i:j], 0, j - i, j - i)[0]
            at += ends[-1]
        return out

    def sure_cuts(self, data: bytes, begin: int, end: int, least: int) -> tuple[list[bytes], int]:
        """(parts, bytes used): data from begin cut at boundaries of its segmentation, least bytes or until end at which a boundary is known."""
        out, at, window = [], begin, RUN_BYTES
        while at < end and at - begin < least:
            part = data[at : min(end, at + window)]
            if at + len(part) == end:
                used = len(part)
            else:
                if part not in self.fronts:
                    if len(self.fronts) >= 64:
                        self.fronts.clear()
                    self.fronts[part] = self.front(part)
                used = self.fronts[part]
            if used:
                out.append(part[:used])
                at, window = at + used, RUN_BYTES
            else:
                window *= 2
        return out, at - begin

    def front(self, data: bytes) -> int:
        """A place up to which data is segmented in the same way whatever follows it, and a boundary then; 0 if none is known.

        What follows is unknown from the front on, but for the least end of the symbol there, as symbols only grow. A symbol next to the front may be joined
        with what is behind it as soon as its turn comes by the best piece that begins with it and reaches that end or further; if it still
        stands there by then, the front moves before it. Joins before the front are sure.
        """
        start, piece = self.edges(data)
        stop = start + self.lengths[piece]
        lead = np.flatnonzero(np.append((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80, True))
        places = lead[lead <= len(data) - self.depth].tolist()
        if len(places) < 2:
            return 0
        front = places[-1]
        least = int(lead[len(places)])
        rank: dict[tuple[int, int], int] = {}
        reach: dict[int, list[tuple[int, int]]] = {}
        early = start < front
        for s, e, r in zip(start[early].tolist(), stop[early].tolist(), piece[early].tolist(), strict=True):
            rank[s, e] = r
            reach.setdefault(s, []).append((e, r))
        following = dict(zip(places, places[1:], strict=False))
        before = dict(zip(places[1:], places, strict=False))
        queue = [(r, s, e, False) for (s, e), r in rank.items() if following.get(following[s]) == e]

        def watch(s: int, e: int) -> None:
            """The symbol from s to e stands at the front."""
            further = min((r for x, r in reach.get(s, ()) if x >= least), default=None)
            if further is not None:
                heappush(queue, (further, s, e, True))

        heapify(queue)
        watch(before[front], front)
        while queue:
            r, s, e, open_end = heappop(queue)
            if open_end:
                if front == e and following.get(s) == e:
                    front, least = s, e
                    if not s:
                        return 0
                    watch(before[s], s)
                continue
            middle = following.get(s)
            if middle is None or e > front or following.get(middle) != e:
                continue
            del following[middle]
            following[s], before[e] = e, s
            for x, y in ((before.get(s), e), (s, following.get(e))):
                if x is not None and y is not None and y <= front and (x, y) in rank:
                    heappush(queue, (rank[x, y], x, y, False))
            if e == front:
                watch(s, e)
        return front

    def _best(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        joined = b"".join(words)
        data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        cut = np.append((data & 0xC0) != 0x80, True)
        cut[begins] = True
        places = np.flatnonzero(cut)
        after = np.zeros(len(data) + 1, dtype=np.int64)
        after[places[:-1]] = places[1:]
        start, piece = self.edges(joined)
        stop = start + self.lengths[piece]
        fits = (stop <= ends[word[start]]) & cut[start]
        start, piece, stop = start[fits], piece[fits], stop[fits]
        token = np.full(len(data), -1, dtype=np.int64)
        single = stop == after[start]
        token[start[single]] = piece[single]
        start, piece, stop = start[~single], piece[~single], stop[~single]
        owner = word[start]
        order = np.argsort((owner << 40) | (piece << 20) | np.minimum(start - begins[owner], (1 << 20) - 1), kind="stable")
        start, piece, stop, owner = start[order], piece[order], stop[order], owner[order]
        for w in np.flatnonzero(sizes > TOGETHER).tolist():
            i, j = np.searchsorted(owner, [w, w + 1])
            _relax_alone(start[i:j], stop[i:j], piece[i:j], cut, after, token, int(begins[w]), int(ends[w]))
        together = sizes[owner] <= TOGETHER
        start, piece, stop, owner = start[together], piece[together], stop[together], owner[together]
        active = np.zeros(len(words), dtype=bool)
        while len(start):
            middle = after[start]
            alive = cut[start] & cut[stop] & (middle != stop)
            start, piece, stop, owner = start[alive], piece[alive], stop[alive], owner[alive]
            ready = np.flatnonzero(after[after[start]] == stop)
            if not len(ready):
                break
            of = owner[ready]
            best = ready[np.r_[True, of[1:] != of[:-1]]]
            cut[after[start[best]]] = False
            after[start[best]] = stop[best]
            token[start[best]] = piece[best]
            active[:] = False
            active[of] = True
            going = active[owner]
            start, piece, stop, owner = start[going], piece[going], stop[going], owner[going]
        heads = np.flatnonzero(cut[:-1])
        kind = token[heads]
        count = np.where(kind >= 0, 1, after[heads] - heads)
        stops = np.cumsum(count)
        out = np.empty(int(stops[-1]), dtype=np.int32)
        known = kind >= 0
        out[(stops - count)[known]] = self.ids[kind[known]]
        n = count[~known]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((stops - count)[~known], n) + step] = self.of_byte[data[np.repeat(heads[~known], n) + step]]
        per_word = np.add.reduceat(count, np.searchsorted(heads, begins))
        return out, per_word

    def learn(self, words: list[bytes]) -> None:
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if not fresh:
            return
        number: dict[bytes, int] = {}
        part_of, parts_each = [], []
        for w in fresh:
            own = [w] if len(w) <= TOGETHER else self.parts(w)
            part_of += [number.setdefault(x, len(number)) for x in own]
            parts_each.append(len(own))
        parts, found, counts, i = list(number), [], [], 0
        while i < len(parts):
            j, total = i, 0
            while j < len(parts) and (j == i or total + len(parts[j]) <= INDEX_BYTES):
                total += len(parts[j])
                j += 1
            ids, n = self._best(parts[i:j])
            found.append(ids)
            counts.append(n)
            i = j
        for w in fresh:
            self.known[w] = len(self.known)
        # parts that repeat were relaxed once
        n = np.concatenate(counts)
        begins, order = np.cumsum(n) - n, np.array(part_of)
        n, begins = n[order], begins[order]
        ends = np.cumsum(n)
        self.flat = np.concatenate([self.flat, np.concatenate(found)[np.repeat(begins - (ends - n), n) + np.arange(int(n.sum()))]])
        total = np.add.reduceat(n, np.cumsum([0, *parts_each[:-1]]))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(total)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text; no ids for an empty one."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        words, counts = [], []
        for text in texts:
            own = WORD.findall(b" " + text) if text else []
            words += own
            counts.append(len(own))
        self.learn(words)
        index = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        a, n = self.starts[index], self.starts[index + 1] - self.starts[index]
        stops = np.cumsum(n)
        flat = self.flat[np.repeat(a - (stops - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], stops])[np.cumsum(counts)]
        return np.split(flat, ends[:-1]) if counts else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The text whose ids these are; the space before the first word is not part of it."""
        return b"".join(map(self.of_id.__getitem__, ids.tolist()))[1:]


def _relax_alone(start: np.ndarray, stop: np.ndarray, piece: np.ndarray, cut: np.ndarray, after: np.ndarray, token: np.ndarray, begin: int, end: int) -> None:
    """Relax one long word from begin to end by a heap of the edges that join two symbols; cut, after and token are changed in place."""
    rank = dict(zip(zip(start.tolist(), stop.tolist(), strict=True), piece.tolist(), strict=True))
    places = (np.flatnonzero(cut[begin:end]) + begin).tolist()
    following = dict(zip(places, [*places[1:], end], strict=True))
    before = dict(zip([*places[1:], end], places, strict=True))
    queue = [(r, s, e) for (s, e), r in rank.items() if following.get(following[s]) == e]
    heapify(queue)
    while queue:
        r, s, e = heappop(queue)
        middle = following.get(s)
        if middle is None or following.get(middle) != e:
            continue
        del following[middle]
        following[s], before[e] = e, s
        cut[middle] = False
        after[s], token[s] = e, r
        for x, y in ((before.get(s), e), (s, following.get(e))):
            if x is not None and y is not None and (x, y) in rank:
                heappush(queue, (rank[x, y], x, y))


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(vocabulary(path))


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs; null and empty texts have no ids."""
    shared = _shared(docs, path)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch, texts in sliced(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(encoder.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; no ids give the empty text, and so do null ids."""
    shared = _shared(encoded, path)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id = shared.value[2]
        for batch in batches:
            texts = [b"".join(map(of_id.__getitem__, ids or []))[1:].decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(emit, f"doc_id {kind}, text string")


def token_digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, n_chars, n_tokens, ids_xxh64, decoded_sha256.

    ids_xxh64 is the XXH64 (hex) of the ids as 32-bit little-endian numbers; decoded_sha256 that of the
    text decoded from them. Null counts as empty: no tokens. Repeated rows come each time, an empty
    table gives no rows, and no column but doc_id and text is read. A text without spaces is cut where its segmentation is
    sure to have a boundary, every RUN_BYTES or so, so that an index stays small whatever the text; what repeats is relaxed once. Ids and texts themselves come from encode() and decode().
    """
    import hashlib

    shared = _shared(docs, path)
    rows = docs.select("doc_id", text_digest().alias("text_sha256"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch, texts in sliced(batches):
            ids = encoder.encode(texts)
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("text_sha256"), batch.column("n_chars"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([xxhash.xxh64_hexdigest(x.astype("<i4").tobytes()) for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "text_sha256", "n_chars", "n_tokens", "ids_xxh64", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"doc_id {kind}, text_sha256 string, n_chars long, n_tokens long, ids_xxh64 string, decoded_sha256 string")
