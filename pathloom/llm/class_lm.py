"""Language-model scores by Brown's class-based bigrams.

Every training word has a class. The most frequent words, the seeds, are exchanged one by one between classes as
long as the bigram likelihood rises; every other word then moves to the class under which its
neighbours, of all its occurrences, are most likely. Texts are coded once: words of a head of bounded
size by number, the others, the tail, by name. The head is what a task can hold and nothing else: tail
words have classes of their own choice too, found and met with the texts by shuffles of their occurrences.
A text's probability is a product of class transitions and word emissions, mixed with the smoothed unigram.
An unseen word has the probability that a word seen once has behind the same class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sliced, stored

DELTA = 0.1
#: Words that tasks hold by number, about; seeds; classes; sweeps of the seeds and of the rest of the head.
HEAD, SEEDS, CLASSES, SEED_SWEEPS, SWEEPS = 131_072, 1024, 48, 12, 2
#: Share of the class model in the mixture with the unigram, and smoothing of transitions.
SHARE, ALPHA = 0.95, 0.5
#: Tokens that a task works on at a time, if no text is longer.
TOKENS = 1 << 19
#: Bits of a head word's number.
NUMBER_BITS = 22
#: The end of a text, which no word can be.
END = b"\n"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end of each counted as a token."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in sliced(batches, limit=16 << 20):
            found = Counter(b" ".join(part).lower().split())
            found[END] = len(part)
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(emit, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> tuple[list[bytes], np.ndarray]:
    """About the most most frequent words and their counts, by falling count; all, where there are fewer.

    Counts are compared in steps of a sixteenth of an octave; of the step that would exceed most, a part by hash is taken.
    """
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 16)
    sizes = sorted(((r["b"], r["w"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("w")).collect()), reverse=True)
    total, border, share = 0, -1, 0.0
    for b, w in sizes:
        if total + w > most:
            border, share = b, (most - total) / w
            break
        total += w
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = counts.where((F.col("word") != END) & ((bucket > border) | ((bucket == border) & part))).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return [bytes(w) for w in rows["word"]], rows["n"].to_numpy(dtype=np.int64)


def code(docs: DataFrame, head: list[bytes]) -> DataFrame:
    """(row, doc_id, held_out, ids, tails) of each row, stored: head words by their numbers, then the end, and tail words numbered within the text."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        number = dict(zip(head, range(len(head)), strict=True))
        size = len(head)
        end = np.array([size], dtype=np.int32)
        for batch, texts in sliced(batches):
            flat, ends, tails, total = [], [], [], 0
            for text in texts:
                words = words_of(text)
                ids = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                own: dict[bytes, int] = {}
                for i in np.flatnonzero(ids < 0).tolist():
                    ids[i] = size + 1 + own.setdefault(words[i], len(own))
                tails.append(list(own))
                flat += (ids, end)
                total += len(ids) + 1
                ends.append(total)
            coded = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), coded, pa.array(tails, pa.list_(pa.binary()))], names=["doc_id", "held_out", "ids", "tails"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "text").mapInArrow(emit, f"doc_id {kind}, held_out boolean, ids array<int>, tails array<binary>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id())).withColumn("head", F.lit(len(head)))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about TOKENS tokens together: the rows, their ids and the place of each row's first one."""
    for batch in batches:
        lengths = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // TOKENS
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:
                rows = batch.slice(a, b - a)
                ids = rows.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield rows, ids, np.cumsum(lengths[a:b]) - lengths[a:b]


def pair_counts(coded: DataFrame, symbols: np.ndarray, size: int) -> np.ndarray:
    """How often one symbol follows another in the training rows; symbols has that of each head word, of the end and, last, of any tail word.

    A pair with a symbol below zero isn't counted. What comes to the driver is at most the square of size.
    """
    shared = coded.sparkSession.sparkContext.broadcast(symbols)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value
        total = np.zeros(size * size, dtype=np.int64)
        for _, ids, starts in _tokens(batches):
            now = symbols[np.minimum(ids, len(symbols) - 1)]
            before = np.r_[symbols[-2], now[:-1]]
            before[starts] = symbols[-2]
            both = (now >= 0) & (before >= 0)
            total += np.bincount(before[both] * size + now[both], minlength=size * size)
        pair = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pair, pa.int64()), pa.array(total[pair], pa.int64())], names=["pair", "n"])

    rows = coded.where("NOT held_out").select("ids").mapInArrow(emit, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """A class for each symbol of pairs; the last two keep classes of their own, numbered classes and classes + 1.

    Symbols come by falling count and start in turn in the classes. Each is moved to the class that
    raises the likelihood of the pairs most, for so many sweeps or until one moves none.
    """
    n = len(pairs)
    of = np.r_[np.arange(n - 2) % classes, classes, classes + 1]
    k = classes + 2
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    out_sum, in_sum = pairs.sum(axis=1), pairs.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n - 2):
            if not out_sum[w] + in_sum[w]:
                continue
            own = of[w]
            right = np.bincount(of, weights=pairs[w], minlength=k)
            left = np.bincount(of, weights=pairs[:, w], minlength=k)
            loop = pairs[w, w]
            right[own] -= loop
            left[own] -= loop
            base = table.copy()
            base[own, :] -= right
            base[:, own] -= left
            base[own, own] -= loop
            out_total, in_total = base.sum(axis=1), base.sum(axis=0)
            # for each target class: its row and column grow by right and left, their crossing also by the loop
            gain = (_xlogx(base[:classes] + right) - _xlogx(base[:classes])).sum(axis=1) + (_xlogx(base[:, :classes] + left[:, None]) - _xlogx(base[:, :classes])).sum(axis=0)
            cross = np.diag(base)[:classes]
            gain += _xlogx(cross + right[:classes] + left[:classes] + loop) - _xlogx(cross + right[:classes]) - _xlogx(cross + left[:classes]) + _xlogx(cross)
            gain -= _xlogx(out_total[:classes] + out_sum[w]) - _xlogx(out_total[:classes]) + _xlogx(in_total[:classes] + in_sum[w]) - _xlogx(in_total[:classes])
            best = int(np.argmax(gain))
            if best != own and gain[best] <= gain[own] + 1e-9 * abs(gain[own]):
                best = int(own)
            moved += best != own
            of[w] = best
            base[best, :] += right
            base[:, best] += left
            base[best, best] += loop
            table = base
        if not moved:
            break
    return of


def class_gains(table: np.ndarray, classes: int) -> np.ndarray:
    """What one neighbour of each kind, of its class on the left or on the right, adds to the log likelihood of a word in each class.

    table counts pairs of classes, the end and words without a class yet being the last two. Rows are left classes, then right ones.
    """
    smooth = table + ALPHA
    left = np.log(smooth / smooth.sum(axis=0, keepdims=True))[:, :classes]
    right = np.log(smooth / smooth.sum(axis=1, keepdims=True))[:classes].T
    return np.vstack([left, right])


def choose_classes(contexts: DataFrame, gains: np.ndarray, read) -> DataFrame:
    """(word, class, n): the best class of each word by its neighbours, and how many left ones it has.

    contexts has rows of a word, as many as there are, and is partitioned by word; read(batch) gives how many kinds of neighbour
    each row has, these kinds and how often each. Rows are sorted by word within partitions and added up as they
    come, so that a word of any number of rows takes the memory of one.
    """
    shared = contexts.sparkSession.sparkContext.broadcast(gains)
    kind = contexts.schema["word"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        size = len(gains)
        held, carry = None, np.zeros((1, size))

        def answer(words: list, sums: np.ndarray) -> pa.RecordBatch:
            best = (sums @ gains).argmax(axis=1)
            return pa.record_batch([pa.array(words, pa.int64() if kind.simpleString() == "bigint" else pa.binary()), pa.array(best, pa.int32()), pa.array(sums[:, : size // 2].sum(axis=1), pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            new = np.fromiter((a != b for a, b in zip(words, [held, *words[:-1]], strict=True)), dtype=bool, count=len(words))
            run = np.cumsum(new)
            lengths, place, times = read(batch)
            sums = np.bincount(np.repeat(run, lengths) * size + place, weights=times, minlength=(int(run[-1]) + 1) * size).astype(float).reshape(-1, size)
            sums[0] += carry[0]
            names = [held, *[w for w, x in zip(words, new.tolist(), strict=True) if x]]
            first = 0 if held is not None else 1
            if len(names) - 1 > first:
                yield answer(names[first:-1], sums[first:-1])
            held, carry = names[-1], sums[-1:]
        if held is not None:
            yield answer([held], carry)

    return contexts.sortWithinPartitions("word").mapInArrow(fold, f"word {kind.simpleString()}, class int, n long")


def head_contexts(coded: DataFrame, classes_of: np.ndarray, classes: int, first: int) -> DataFrame:
    """(word, slots, times): the neighbours' classes of each head word numbered first or more, a row for each task that has it."""
    shared = coded.sparkSession.sparkContext.broadcast(classes_of)
    size = 2 * (classes + 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        head = len(of) - 2
        total = np.zeros((head - first) * size, dtype=np.int32)
        for _, ids, starts in _tokens(batches):
            cls = of[np.minimum(ids, head + 1)]
            before = np.r_[classes, cls[:-1]]
            before[starts] = classes
            at = np.flatnonzero((ids >= first) & (ids < head))
            place = (ids[at] - first) * size
            np.add.at(total, place + before[at], 1)
            np.add.at(total, place + size // 2 + cls[at + 1], 1)
        for a in range(0, head - first, 4096):
            part = total[a * size : (a + 4096) * size]
            place = np.flatnonzero(part)
            if len(place):
                words, start = np.unique(place // size, return_index=True)
                ends = np.append(start[1:], len(place))
                slots, times = (place % size).astype(np.uint8), part[place].astype("<i4")
                yield pa.record_batch([pa.array(words + a + first, pa.int64()), _binaries(slots, start, ends), _binaries(times, start, ends)], names=["word", "slots", "times"])

    return coded.where("NOT held_out").select("ids").mapInArrow(emit, "word long, slots binary, times binary").repartition("word")


def _read_binaries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slots = batch.column("slots")
    return pa.compute.binary_length(slots).to_numpy(zero_copy_only=False).astype(np.int64), np.frombuffer(b"".join(slots.to_pylist()), dtype=np.uint8), np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<i4")


def _binaries(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values from each start to its end, these being in turn, as binaries."""
    offsets = np.append(starts, ends[-1]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word on the left, of that on the right, whether the text trains) of near; numbers are below zero for tail words."""
    return (near >> NUMBER_BITS + 1) - 1, (near >> 1 & (1 << NUMBER_BITS) - 1) - 1, near & 1


def tail_occurrences(coded: DataFrame) -> DataFrame:
    """(word, row, place, near): each tail word of each text, partitioned by word; near holds its neighbours, see _unpacked()."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, starts in _tokens(batches):
            head = rows.column("head")[0].as_py()
            at = np.flatnonzero(ids > head)
            if not len(at):
                continue
            before = np.r_[head, ids[:-1]]
            before[starts] = head
            row = np.searchsorted(starts, at, side="right") - 1
            tails = rows.column("tails")
            first = np.r_[0, np.cumsum(tails.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            words = tails.flatten().take(pa.array(first[row] + ids[at] - head - 1))
            left, right = (np.where(x > head, 0, x + 1) for x in (before[at], ids[at + 1]))
            train = ~np.array(rows.column("held_out").to_pylist())[row]
            near = (left << NUMBER_BITS | right) << 1 | train
            yield pa.record_batch([words, rows.column("row").take(pa.array(row)), pa.array(at - starts[row], pa.int32()), pa.array(near, pa.int64())], names=["word", "row", "place", "near"])

    return coded.select("row", "held_out", "head", "ids", "tails").mapInArrow(emit, "word binary, row long, place int, near long").repartition("word")


def resolved_tails(occurrences: DataFrame, gains: np.ndarray, once: np.ndarray, classes_of: np.ndarray) -> DataFrame:
    """(row, train, before, symbol, n, after) of each occurrence, stored.

    symbol is the word's class times 2, 1 more if it was seen once, and below zero if never; before is that of the word on the left.
    """
    shared = occurrences.sparkSession.sparkContext.broadcast((once, classes_of))
    half = len(gains) // 2

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right, train = _unpacked(batch.column("near").to_numpy())
        # the last of classes_of is that of tail words, and so is number -1
        kinds = np.stack([shared.value[1][left], half + shared.value[1][right]], axis=1)[train == 1]
        return 2 * train, kinds.ravel(), np.ones(kinds.size)

    chosen = choose_classes(occurrences, gains, read).where("n > 0").select(F.col("word").alias("of"), "class", F.col("n").alias("times_seen"))
    joined = occurrences.join(chosen, F.col("word") == F.col("of"), "left")
    symbol = F.coalesce(F.col("class") * 2 + (F.col("times_seen") == 1).cast("int"), F.lit(-1))
    rows = joined.select("row", "place", "near", symbol.alias("symbol"), F.coalesce("times_seen", F.lit(0)).cast("long").alias("n"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, classes_of = shared.value
        last = -1
        for batch in batches:
            symbol = batch.column("symbol").to_numpy()
            if not len(symbol):
                continue
            left, right, train = _unpacked(batch.column("near").to_numpy())
            # a tail word on the left is the row before, as rows are sorted by text and place
            known = np.where(left >= 0, classes_of[left] * 2 + once[left], np.r_[last, symbol[:-1]])
            last = int(symbol[-1])
            yield pa.record_batch(
                [batch.column("row"), pa.array(train == 1), pa.array(known, pa.int32()), batch.column("symbol"), batch.column("n"), pa.array(right, pa.int32())],
                names=["row", "train", "before", "symbol", "n", "after"],
            )

    sorted_rows = rows.repartition("row").sortWithinPartitions("row", "place")
    return stored(sorted_rows.mapInArrow(resolve, "row long, train boolean, before int, symbol int, n long, after int"))


def _tail_pairs(tails: DataFrame, symbols: np.ndarray, size: int) -> np.ndarray:
    """How often one symbol follows another in training rows where either is a tail word's."""
    right = F.col("after").cast("int")
    first = tails.where("train AND before >= 0").groupBy("before", "symbol").agg(F.count(F.lit(1)).alias("n"))
    shared = tails.sparkSession.sparkContext.broadcast(symbols)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value
        for batch in batches:
            after = symbols[batch.column("after").to_numpy()]
            pair, n = np.unique(batch.column("symbol").to_numpy().astype(np.int64) * size + after, return_counts=True)
            yield pa.record_batch([pa.array(pair // size, pa.int32()), pa.array(pair % size, pa.int32()), pa.array(n, pa.int64())], names=["before", "symbol", "n"])

    second = tails.where((F.col("train")) & (right >= 0)).select("symbol", "after").mapInArrow(emit, "before int, symbol int, n long")
    out = np.zeros((size, size))
    for r in first.union(second).groupBy("before", "symbol").agg(F.sum("n").alias("n")).collect():
        out[r["before"], r["symbol"]] += r["n"]
    return out


class Model:
    """What scoring needs, in arrays of bounded size: of classes, and of the head's words."""

    def __init__(self, pairs: np.ndarray, classes_of: np.ndarray, counts: np.ndarray, total: int, distinct: int, classes: int):
        """pairs is of symbols, class times 2 plus 1 for words seen once; counts is of the head's words and, last, the end."""
        k = classes + 1
        table = pairs.reshape(k, 2, k, 2)
        once_before, by_class = table[:, 1].sum(axis=0), table.sum(axis=1)
        both = np.vstack([by_class, once_before[None]])
        followed, once = both.sum(axis=2), both[:, :, 1].sum(axis=1)
        smooth = followed + ALPHA
        #: Rows: class on the left, last an unseen word; what words seen once have behind them stands for it.
        self.transition = smooth / smooth.sum(axis=1, keepdims=True)
        self.unseen = (once + ALPHA) / (followed.sum(axis=1) + 2 * ALPHA)
        self.class_total = np.maximum(by_class.sum(axis=(0, 2)), 1.0)
        self.classes_of, self.counts, self.classes = classes_of, counts, classes
        self.base = total + DELTA * (distinct + 1)
        self.total = total

    @classmethod
    def of(cls, plain: dict) -> Model:
        """The model of these attributes."""
        model = cls.__new__(cls)
        model.__dict__.update(plain)
        return model

    def log10(self, before: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, log10 unigram) of words of these classes and counts behind these classes; an unseen word has count 0, and class classes + 1 when it stands before."""
        single = (n + DELTA) / self.base
        seen = (1 - self.unseen[before]) * self.transition[before, np.minimum(cls, self.classes)] * n / self.class_total[np.minimum(cls, self.classes)]
        whole = SHARE * np.where(n > 0, seen, self.unseen[before]) + (1 - SHARE) * single
        return np.log10(whole), np.log10(single)


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, Model]:
    """(coded texts, resolved tail words, model); the model is of the rows of docs that are not held out, the tables are of all."""
    counts = stored(word_counts(docs.where(~held_out("doc_id", 10, 0))))
    row = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("e")).first()
    total, distinct, ends = int(row["n"] or 0), int(row["v"]), int(row["e"] or 0)
    head, n = head_words(counts)
    size, k = len(head), CLASSES
    coded = code(docs, head)
    seeds = min(SEEDS, size)
    symbols = np.r_[np.minimum(np.arange(size), seeds + 1), seeds, seeds + 1]
    symbols[seeds:size] = seeds + 1
    classes_of = exchange(pair_counts(coded, symbols, seeds + 2), k)[symbols]
    for _ in range(SWEEPS if seeds < size else 0):
        gains = class_gains(pair_counts(coded, classes_of, k + 2), k)
        for r in choose_classes(head_contexts(coded, classes_of, k, seeds), gains, _read_binaries).collect():
            classes_of[r["word"]] = r["class"]
    gains = class_gains(pair_counts(coded, classes_of, k + 2), k)
    once = np.r_[n == 1, False, False].astype(np.int64)
    tails = resolved_tails(tail_occurrences(coded), gains, once, classes_of)
    symbols = classes_of * 2 + once
    symbols[-1] = -1
    pairs = pair_counts(coded, symbols, 2 * (k + 1)) + _tail_pairs(tails, symbols, 2 * (k + 1))
    return coded, tails, Model(pairs, classes_of, np.r_[n, ends], total, distinct, k)


def score(coded: DataFrame, tails: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each coded row; see class_scores()."""
    # a broadcast goes without its class, which executors need not have; tasks bring that along
    shared = coded.sparkSession.sparkContext.broadcast(vars(model))

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(shared.value)
        end = len(m.counts) - 1
        for rows, ids, starts in _tokens(batches):
            before = np.r_[end, ids[:-1]]
            before[starts] = end
            head, both = ids <= end, (ids <= end) & (before <= end)
            own = np.minimum(ids, end)
            likely, single = m.log10(m.classes_of[np.minimum(before, end)], m.classes_of[own], m.counts[own])
            sums = np.add.reduceat(np.vstack([np.where(both, likely, 0.0), np.where(head, single, 0.0), head & (m.counts[own] > 0)]), starts, axis=1)
            sizes = rows.column("ids").value_lengths().cast(pa.int64())
            yield pa.record_batch([rows.column("row"), rows.column("doc_id"), rows.column("held_out"), sizes, pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "likely"])

    def of_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(shared.value)
        for batch in batches:
            before, symbol, after = (batch.column(c).to_numpy().astype(np.int64) for c in ("before", "symbol", "after"))
            n = batch.column("n").to_numpy()
            left, own = np.where(before < 0, m.classes + 1, before >> 1), np.where(symbol < 0, m.classes + 1, symbol >> 1)
            likely, single = m.log10(left, own, n)
            right = np.maximum(after, 0)
            # an unseen word stands before like the words seen once
            likely = likely + np.where(after >= 0, m.log10(own, m.classes_of[right], m.counts[right])[0], 0.0)
            yield pa.record_batch([batch.column("row"), pa.array((n > 0).astype(np.int64)), pa.array(single), pa.array(likely)], names=["of", "tail_known", "tail_base", "tail_likely"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    heads = coded.select("row", "doc_id", "held_out", "ids").mapInArrow(of_heads, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, likely double")
    sums = tails.select("row", "before", "symbol", "after", "n").mapInArrow(of_tails, "of long, tail_known long, tail_base double, tail_likely double")
    sums = sums.groupBy("of").agg(F.sum("tail_known").alias("tail_known"), F.sum("tail_base").alias("tail_base"), F.sum("tail_likely").alias("tail_likely"))
    return heads.join(sums, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), (F.col("likely") + F.coalesce("tail_likely", F.lit(0.0))).alias("score"),
    )


def class_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id leaves 0 modulo 10, and rows without an id, are held out; all others
    train. A null or empty text is one token, the end, and a text of any length is one row. With nothing to train on,
    no token is known and both scores come from smoothing alone. Repeated rows count, and are scored, each time; an
    empty table gives no rows. Words that tie in count are ordered by their bytes, classes that tie by number.
    """
    return score(*train(docs))
