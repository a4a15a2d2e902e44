"""Piece lattices of many words at once, as numpy arrays, and sums over all their paths.

Sums are kept as numbers and, for words of many bytes, logarithms of a scale beside them, so that a word
of any length is summed whole. A very long word is read by windows, the sums at the last nodes being carried on.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Offset from which sums are scaled anew, every so many bytes, and the size that the largest gets then.
FREE, EVERY, HEIGHT = 32, 8, 1e200
#: Bytes of a window of a very long word; shorter words are read at once.
WINDOW = 1 << 14
#: Bytes of one lattice, if no word alone is longer.
LATTICE_BYTES = 1 << 17


@dataclass
class Trie:
    """Byte transitions of a set of pieces; state 0 is the root and the dead end alike."""

    byte_class: np.ndarray
    step: np.ndarray
    piece: np.ndarray
    depth: int
    size: int

    def plain(self) -> tuple:
        """The fields without this class and with the sparse transitions packed, for a small broadcast."""
        return self.byte_class, zlib.compress(self.step.tobytes(), 6), self.step.shape, self.step.dtype.str, self.piece, self.depth, self.size

    @classmethod
    def of(cls, fields: tuple) -> Trie:
        byte_class, packed, shape, kind, piece, depth, size = fields
        return cls(byte_class, np.frombuffer(zlib.decompress(packed), dtype=kind).reshape(shape), piece, depth, size)


def build_trie(pieces: list[bytes]) -> Trie:
    used = sorted({b for p in pieces for b in p})
    byte_class = np.zeros(256, dtype=np.int64)
    byte_class[used] = np.arange(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    ends = {}
    for i, p in enumerate(pieces):
        at = 0
        for b in p:
            c = int(byte_class[b])
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
            at = children[at][c]
        ends[at] = i
    step = np.zeros((len(children), len(used) + 1), dtype=np.uint16 if len(children) < 65536 else np.uint32)
    for state, to in enumerate(children):
        for c, t in to.items():
            step[state, c] = t
    piece = np.full(len(children), -1, dtype=np.int32)
    for state, i in ends.items():
        piece[state] = i
    return Trie(byte_class, step, piece, max(map(len, pieces), default=0), len(pieces))


@dataclass
class Lattice:
    """Edges sorted by the offset of their end in the word, then by end node; one node more than bytes for each word."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    reach: np.ndarray
    first: np.ndarray
    last: np.ndarray
    nodes: int


def build_lattice(trie: Trie, words: list[bytes]) -> Lattice:
    """Words are not empty. Each byte also has an edge of piece number trie.size, so that a path always exists."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    word = np.repeat(np.arange(len(words)), lengths)
    stop = ends[word]
    cls = trie.byte_class[data]
    at = np.arange(len(data))
    state = trie.step[0, cls]
    starts, sizes, found = [np.arange(len(data))], [np.ones(len(data), dtype=np.int64)], [np.full(len(data), trie.size, dtype=np.int32)]
    for depth in range(1, trie.depth + 1):
        alive = state != 0
        at, state = at[alive], state[alive]
        if not len(at):
            break
        p = trie.piece[state]
        hit = p >= 0
        starts.append(at[hit])
        sizes.append(np.full(len(starts[-1]), depth, dtype=np.int64))
        found.append(p[hit])
        inside = at + depth < stop[at]
        at, state = at[inside], state[inside]
        state = trie.step[state, cls[at + depth]]
    start, size = np.concatenate(starts), np.concatenate(sizes)
    begin = ends - lengths
    w = word[start]
    reach = start + size - begin[w]
    nodes = len(data) + len(words)
    source = start + w
    target = source + size
    order = np.argsort(reach * nodes + target, kind="stable")
    first = begin + np.arange(len(words))
    return Lattice(source[order], target[order], np.concatenate(found)[order], reach[order], first, first + lengths, nodes)


def forward(lattice: Lattice, weights: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, scales): over all paths into each node, a sum is sums * exp(scales); weights has a row for each edge and a column for each model.

    begin gives sums that nodes have already, instead of one at the start of each word.
    """
    models = weights.shape[1]
    total = np.zeros((lattice.nodes, models)) if begin is None else begin
    ahead = 0 if begin is None else int(np.flatnonzero(begin.any(axis=1)).max(initial=0))
    if begin is None:
        total[lattice.first] = 1.0
    scale = np.zeros((lattice.nodes, models))
    sizes = lattice.last - lattice.first
    running = np.zeros((len(sizes), models))
    most = int(lattice.reach[-1]) if len(lattice.reach) else 0
    back = int((lattice.target - lattice.source).max(initial=1))
    bounds = np.searchsorted(lattice.reach, np.arange(1, most + 2))
    for offset, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 1):
        if b > a:
            target = lattice.target[a:b]
            heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            total[target[heads]] += np.add.reduceat(total[lattice.source[a:b]] * weights[a:b], heads, axis=0)
        if offset >= FREE and offset % EVERY == 0:
            going = np.flatnonzero(sizes > offset)
            if len(going):
                # begin may have sums for nodes ahead
                near = np.minimum(lattice.first[going][:, None] + np.arange(max(0, offset - back), offset + 1 + (0 if begin is None else ahead)), lattice.last[going][:, None])
                block = total[near]
                top = block.max(axis=1)
                shift = np.log(top) - np.log(HEIGHT)
                total[near] = block / top[:, None] * HEIGHT
                running[going] += shift
                scale[near] += shift[:, None]
                later = lattice.first[going][:, None] + np.arange(offset + 1, offset + max(EVERY, back) + 1)
                inside = later <= lattice.last[going][:, None]
                scale[later[inside]] = np.broadcast_to(running[going][:, None], (*later.shape, models))[inside]
    return total, scale


def groups(words: list[bytes]) -> list[tuple[int, int]]:
    """Bounds of runs of words that have at most LATTICE_BYTES bytes together; a longer word comes alone."""
    out, start, total = [], 0, 0
    for i, w in enumerate(words):
        if total and total + len(w) > LATTICE_BYTES:
            out.append((start, i))
            start, total = i, 0
        total += len(w)
    return [*out, (start, len(words))] if words else []


def mirrored(lattice: Lattice) -> tuple[Lattice, np.ndarray, np.ndarray]:
    """The lattice of the words read backwards, where its edges are in lattice, and where each node is."""
    word = np.searchsorted(lattice.first, np.arange(lattice.nodes), side="right") - 1
    node = lattice.first[word] + lattice.last[word] - np.arange(lattice.nodes)
    source, target = node[lattice.target], node[lattice.source]
    reach = target - lattice.first[word[lattice.source]]
    order = np.argsort(reach * lattice.nodes + target, kind="stable")
    return Lattice(source[order], target[order], lattice.piece[order], reach[order], lattice.first, lattice.last, lattice.nodes), order, node


def backward(lattice: Lattice, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, scales) over all paths from each node to the end of its word."""
    other, order, node = mirrored(lattice)
    total, scale = forward(other, weights[order])
    return total[node], scale[node]


def log_sums(trie: Trie, words: list[bytes], probability: np.ndarray) -> np.ndarray:
    """The logarithm of each word's sum over all segmentations, a column for each model; words are not empty."""
    out = np.zeros((len(words), probability.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= WINDOW]
    if short:
        lattice = build_lattice(trie, [words[i] for i in short])
        total, scale = forward(lattice, probability[lattice.piece])
        out[short] = np.log(total[lattice.last]) + scale[lattice.last]
    for i, w in enumerate(words):
        if len(w) > WINDOW:
            out[i] = _by_windows(trie, w, probability)
    return out


def _by_windows(trie: Trie, word: bytes, probability: np.ndarray) -> np.ndarray:
    carried, done = np.zeros((1, probability.shape[1])), np.zeros(probability.shape[1])
    carried[0] = 1.0
    for at in range(0, len(word), WINDOW):
        part = word[at : at + WINDOW + trie.depth]
        step = min(WINDOW, len(word) - at)
        lattice = build_lattice(trie, [part])
        own = lattice.source < step
        lattice = Lattice(lattice.source[own], lattice.target[own], lattice.piece[own], lattice.reach[own], lattice.first, lattice.last, lattice.nodes)
        begin = np.zeros((lattice.nodes, probability.shape[1]))
        begin[: len(carried)] = carried[: lattice.nodes]
        total, scale = forward(lattice, probability[lattice.piece], begin)
        # nodes ahead may have sums in other scales; all come to that of the window's last node
        carried = total[step:] * np.exp(np.minimum(scale[step:] - scale[step], 700.0))
        top = carried[0].copy()
        carried /= top
        done += np.log(top) + scale[step]
    return done
