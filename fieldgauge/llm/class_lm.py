"""Class-based n-gram language model: exchange clustering of words, class transitions, word emissions.

P(word | word before) = P(class | class before) * P(word | class). Every word seen `LEAST` times or more is assigned to a class
by exchange; the classes grow with the cube root of their number. A step adds up, over the counts of all adjacent word pairs, how
often each word meets each class before and after it, and moves words to the class that raises the likelihood of the class
bigrams most. A sweep weighs every word once, in groups that move in turn, so that two words do not swap places for ever; sweeps
go on until one raises the likelihood by less than `STILL` of the rise so far. If one overshoots instead, smaller groups go on
from the best assignment, which is the one kept. Rarer words form a class of their own, the text border another. Transitions
are interpolated with class frequencies, emissions of the rare class have one added to every count, so every text has a
probability.

Words are numbered by the order of their 64-bit keys, which differ (else others are tried). Keys, counts and classes are shards
in the shared folder, written by tasks; workers map the keys and hold two bytes a word for the classes. What words
meet is a table of their neighbours, very frequent words in several rows. A word that training has not seen is taken for another
with a probability of one in 2^64 a clustered word.

Word counts cover all training texts and grow with them; they stay a table. Tasks know the `head` most frequent words (each
at most 64 bytes, longer ones are named by a digest), which settles nearly all tokens in place, and look others up in the shards;
the tokens left, of unclustered words, are joined with the word table, which is exact and has no hot key. What the driver
holds is bounded by `head` and the square of the classes.

Edge cases: a null or empty text is its end token. Without training texts every token is unknown. Rows are scored one by one:
ids may be null or repeated. Ties in frequency go to the smaller word. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructType

from .files import place, put
from .fingerprints import mix, slices
from .tables import workspace, written

HEAD, LEAST, LEAST_CLASSES = 65_536, 3, 64
GROUPS, MOST_GROUPS, STILL = 2, 16, 0.05
SHARD, CHUNK = 1 << 15, 1 << 14
WEIGHT = 0.9
LONGEST = 64
FLUSH = 300_000
# What words meet that is weighed at once.
BLOCK = 1 << 14
# Counts up to which gains are kept.
USUAL = 16
TASKS_A_CORE = 4
END = b"\n"
TAIL = ArrayType(StructType().add("word", BinaryType()).add("k", LongType()))
_LOWER = bytes(range(256)).lower()
_STEP = np.uint64(0x9E3779B97F4A7C15)
# The first k bytes of eight.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; white space is ASCII's. Long words are named by a digest."""
    return [_named(w) for w in (text or "").encode().translate(_LOWER).split()]


def _named(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b"\n" + hashlib.md5(word).digest()


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """`tokens` of a run of texts at once: the different words, which of them each token is, and each text's first token (at last their number)."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = solid[heads]
    letters = np.frombuffer(_LOWER, np.uint8)[data[solid]]
    bounds = np.append(np.flatnonzero(begins[solid]), len(letters)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    words = coded.dictionary
    if (pc.max(pc.binary_length(words)).as_py() or 0) > LONGEST:
        words = pa.array([_named(w) for w in words.to_pylist()], pa.binary())
    return words, coded.indices.to_numpy(), np.searchsorted(np.flatnonzero(begins), offsets)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Slices of the batches, with the words of their texts."""
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(column)):
            yield batch.slice(first, last - first), *_words(data, offsets)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def merged() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.RecordBatch.from_arrays([table[c].combine_chunks() for c in ("word", "n_sum")], names=["word", "n"])

    for part, words, codes, _ in _texts(batches, 0):
        ends = pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(part)], pa.int64())], names=["word", "n"])
        held += [pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"]), ends]
        size += len(words) + 1
        if size > 2 * FLUSH:
            held = [merged()]
            size = len(held[0])
            if size > FLUSH:
                yield held[0]
                held, size = [], 0
    if held:
        yield merged()


def _opened(address: str, kind: type) -> np.ndarray:
    where, path = place(address)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with where.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind)


@dataclass
class Index:
    """The clustered words in the shared folder: shards by the first bits of the words' keys, sorted by key."""

    folder: str
    bits: int
    salt: int
    shards: list[int]
    starts: np.ndarray  # number of each shard's first word; at last the number of words

    _keys = {}  # by folder and shard
    _classes = None  # of the last assignment asked for

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def keys(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """64 bits of each word, mixed eight bytes at a time."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        if not len(words):
            return np.zeros(0, np.uint64)
        _, offsets, letters = words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.zeros(bounds[-1] + 8, np.uint8)
        data[:-8] = np.frombuffer(letters, np.uint8, bounds[-1]) if letters is not None else 0
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        at, left = bounds[:-1], np.diff(bounds)
        with np.errstate(over="ignore"):
            keys = mix(left.astype(np.uint64) + np.uint64(self.salt) * _STEP)
            on = np.arange(len(words))
            while len(on := on[left[on] > 0]):
                eight = eights[at[on]] & _BYTES[np.minimum(left[on], 8)]
                keys[on] = mix((keys[on] + _STEP) * _STEP ^ mix(eight + _STEP))
                at, left = at + 8, left - 8
        return keys

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def column(self, name: str, shard: int, kind: type) -> np.ndarray:
        at = (self.folder, name, shard)
        if at not in Index._keys:
            Index._keys[at] = _opened(f"{self.folder}/{name}-{shard}", kind)
        return Index._keys[at]

    def find(self, words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word; -1 and 0 where it is not clustered."""
        numbers, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        keys = self.keys(words)
        of = self.shard(keys)
        order = np.argsort(of, kind="stable")
        for k, shard in enumerate(self.shards):
            mine = order[slice(*np.searchsorted(of[order], [shard, shard + 1]))]
            if len(mine):
                there = self.column("keys", shard, np.uint64)
                at = np.minimum(np.searchsorted(there, keys[mine]), len(there) - 1)
                hit = there[at] == keys[mine]
                numbers[mine[hit]] = self.starts[k] + at[hit]
                counts[mine[hit]] = self.column("counts", shard, np.int64)[at[hit]]
        return numbers, counts

    def classes(self, steps: list[int], classes: int) -> np.ndarray:
        """The class of each number; past the words the rare class and the border."""
        at = (self.folder, tuple(steps))
        if Index._classes is None or Index._classes[0] != at:
            parts = [_opened(f"{self.folder}/classes-{step}-{shard}", np.uint16) for step, shard in zip(steps, self.shards)]
            Index._classes = (at, np.concatenate([*parts, np.array([classes, classes + 1], np.uint16)]))
        return Index._classes[1]


def build_index(words: DataFrame, n_words: int, classes: int, folder: str) -> Index:
    """Shards of (word, n), with the first classes by key."""
    bits = max(0, (n_words // SHARD).bit_length())
    for salt in itertools.count():
        index = Index(f"{folder}/index-{salt}", bits, salt, [], np.zeros(1, np.int64))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = index.keys(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(index.shard(keys)), pa.array(keys.view(np.int64)), batch.column(1)], names=["shard", "key", "n"])

        def stored(frame: pd.DataFrame) -> pd.DataFrame:
            keys, shard = frame["key"].to_numpy(np.int64).view(np.uint64), int(frame["shard"].iloc[0])
            order = np.argsort(keys)
            put(index.folder, f"keys-{shard}", keys[order].tobytes())
            put(index.folder, f"counts-{shard}", frame["n"].to_numpy(np.int64)[order].tobytes())
            put(index.folder, f"classes-0-{shard}", (keys[order] % np.uint64(classes)).astype(np.uint16).tobytes())
            return pd.DataFrame({"shard": [shard], "n": [len(keys)], "different": [len(np.unique(keys))]})

        made = words.select("word", "n").mapInArrow(keyed, "shard long, key long, n long").groupBy("shard")
        made = sorted(tuple(r) for r in made.applyInPandas(stored, "shard long, n long, different long").collect())
        if all(n == different for _, n, different in made):
            index.shards, index.starts = [r[0] for r in made], np.cumsum([0, *(r[1] for r in made)])
            return index


@dataclass
class Model:
    """Counts of the frequent words and the class model over them."""

    words: list[bytes]  # the head, by frequency
    counts: np.ndarray
    total: int  # tokens
    different: int
    classes: np.ndarray  # of the head words; the last two classes: rare words and text border
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) of head words
    rare_total: int
    rare_different: int
    index: Index  # of all clustered words
    steps: list[int]  # of their classes, by shard
    in_class: np.ndarray  # tokens of each class


def _flat(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their values. Where a key and a value fit into 63 bits, they are sorted as one number."""
    bits = int(values.max(initial=0)).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits < 64:
        both = keys.astype(np.int64)
        both <<= bits
        both |= values.astype(np.int64, copy=False)
        both.sort()
        keys = both >> bits
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        both &= (1 << bits) - 1
        return keys[first], np.add.reduceat(both, first) if len(first) else both
    unique, back = np.unique(keys, return_inverse=True)
    return unique, np.bincount(back, values, len(unique)).astype(np.int64)


def _places(words: pa.Array, head: pa.Array) -> np.ndarray:
    """Where each word is in the head; -1 where it is not."""
    return pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _links(batches: Iterator[pa.RecordBatch], index: Index, head: pa.Array, numbers_of_head: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What words meet: 2 * number of a word after it, 2 * number + 1 of one before it, and counts. Borders stand before and after
    each text. Of the rare class and the border only what they meet of each other is kept, the rest is said by the words."""
    rare, border = index.size, index.size + 1
    width, held, size = border + 1, [], 0
    numbered = np.append(numbers_of_head, -1)

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _flat(*(np.concatenate(x) for x in zip(*held)))

    def rows(keys: np.ndarray, counts: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        # Numbers are of 32 bits, as stored, which halves what a worker holds; the arrays are put in order one after the other.
        a, b = (keys // width).astype(np.uint32), (keys % width).astype(np.uint32)
        n = np.tile(counts.astype(np.uint32) if counts.max(initial=0) <= MOST else counts, 2)
        w, to = np.concatenate([a, b]), np.concatenate([2 * b, 2 * a + 1])
        keep = (w < rare) | ((to >= 2 * rare) & (to % 2 == 0))
        w, to, n = w[keep], to[keep], n[keep]
        chunk = (to >> 1) % many[w]
        order = np.lexsort((chunk, w))
        w, chunk = w[order], chunk[order]
        to, n = to[order], n[order]
        first = np.flatnonzero(np.append(True, (np.diff(w) != 0) | (np.diff(chunk) != 0))[: len(w)])
        offsets = pa.array(np.append(first, len(w)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (to, n)]
        names = [pa.array(x.astype(np.int64)) for x in (w[first], chunk[first], many[w[first]])]
        return pa.RecordBatch.from_arrays([*names, *lists], names=["w", "chunk", "chunks", "to", "n"])

    # Rows that a word's links are cut into, by its count.
    many = np.concatenate([*((1 + 2 * index.column("counts", shard, np.int64) // CHUNK).astype(np.uint32) for shard in index.shards), np.ones(2, np.uint32)])
    for part, words, codes, begins in _texts(batches, 0):
        at = _places(words, head)
        others = np.flatnonzero(at < 0)
        numbers = numbered[at]
        numbers[others] = index.find(words.take(pa.array(others)))[0]
        numbers[numbers < 0] = rare
        ids = np.full(len(codes) + len(part) + 1, border)
        ids[np.arange(1, len(codes) + 1) + np.repeat(np.arange(len(part)), np.diff(begins))] = numbers[codes]
        unique, counts = np.unique(ids[:-1] * width + ids[1:], return_counts=True)
        held.append((unique, counts))
        size += len(unique)
        if size > 2 * FLUSH:
            unique, counts = merged()
            if len(unique) > FLUSH:
                yield rows(unique, counts, many)
                held, size = [], 0
            else:
                held, size = [(unique, counts)], len(unique)
    if held:
        yield rows(*merged(), many)


# As sent to the words' tasks: neighbours and counts in turn, as little-endian 32-bit numbers.
LINKS = "w long, chunk long, chunks long, pairs binary"
# As stored and read in every step: neighbours and counts as little-endian 32-bit numbers, which the JVM passes on as they are. A count
# past `MOST` is stored as several of its neighbour.
MOST = (1 << 32) - 1
STORED_LINKS = "w long, chunk long, chunks long, to binary, n binary"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of 32-bit numbers as bytes."""
    buffers = [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(values.astype("<u4", copy=False))]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, from 0, and all their numbers."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    data = column.buffers()[2]
    numbers = np.frombuffer(data, "<u4", int(ends[-1])) if data is not None else np.zeros(0, np.uint32)
    return ends - ends[0], numbers[ends[0] :].astype(np.int64)


def _links_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, neighbours and counts of all links of stored rows."""
    offsets, to = _unpacked(batch.column("to"))
    return np.repeat(batch.column("w").to_numpy(), np.diff(offsets)), to, _unpacked(batch.column("n"))[1]


def _cut(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many stored counts each count is, and those."""
    times = (counts - 1) // MOST + 1
    left = np.repeat(counts, times)
    return times, np.minimum(MOST, left - MOST * (np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)))


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists with their lists as bytes: half the size, and the JVM passes them on as they are."""
    for batch in batches:
        to, n = (batch.column(c).flatten().to_numpy() for c in ("to", "n"))
        ends = batch.column("to").offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        if n.max(initial=0) > MOST:
            times, n = _cut(n)
            to, ends = np.repeat(to, times), np.append(0, np.cumsum(times))[ends]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(np.stack([to, n], 1).ravel(), 2 * ends)], names=["w", "chunk", "chunks", "pairs"])


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What tasks sent of a row, one behind the other, as one row of lists again. A batch's last row waits for what the next one has of it."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ends, numbers = _unpacked(batch.column("pairs"))
        first = np.flatnonzero(_begins(batch))
        offsets = pa.array(np.append(ends[first], ends[-1]) // 2, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(numbers[k::2])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in batch.columns[:3]), *lists], names=["w", "chunk", "chunks", "to", "n"])

    held = []
    for batch in batches:
        if batch.num_rows:
            last = int(np.flatnonzero(_begins(batch))[-1])
            if last or held and [held[-1][c][0] for c in ("w", "chunk")] != [batch[c][0] for c in ("w", "chunk")]:
                yield joined([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
    if held:
        yield joined(held)


def _begins(batch: pa.RecordBatch) -> np.ndarray:
    """Whether a row is of another word or chunk than the row before it."""
    w, chunk = (batch.column(c).to_numpy() for c in ("w", "chunk"))
    return np.append(True, (w[1:] != w[:-1]) | (chunk[1:] != chunk[:-1]))[: len(w)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every neighbour of a row once, as stored."""
    for batch in batches:
        to, n = batch.column("to"), batch.column("n")
        row, to = np.repeat(np.arange(batch.num_rows), np.diff(to.offsets.to_numpy())), to.flatten().to_numpy()
        bits = int(to.max(initial=0)).bit_length()
        keys, counts = _flat(row << bits | to, n.flatten().to_numpy())
        if counts.max(initial=0) > MOST:
            times, counts = _cut(counts)
            keys = np.repeat(keys, times)
        ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) << bits)
        packed = [_packed(x, ends) for x in (keys & ((1 << bits) - 1), counts)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed], names=["w", "chunk", "chunks", "to", "n"])


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What the class bigrams add to the log likelihood; the rest does not depend on the classes."""
    return float(_phi(matrix).sum() - _phi(matrix.sum(axis=1)).sum() - _phi(matrix.sum(axis=0)).sum())


def exchange_gains(
    own: int, after: np.ndarray, before: np.ndarray, itself: float, matrix: np.ndarray, classes: int, sums: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Change of the likelihood if a word of class `own` is put into each of the first `classes` classes. Only classes that the
    word meets are looked at. `sums` are the matrix's over rows' and columns' cells."""
    by_row, by_column = sums or (matrix.sum(axis=1), matrix.sum(axis=0))
    met, came = np.flatnonzero(after), np.flatnonzero(before)
    # What is left of the matrix without the word. Pairs of the word with itself move with it and are counted at the diagonal.
    rows, columns = matrix[:classes, met], matrix[came, :classes].T
    rows[own] -= after[met]
    rows[:, met == own] -= before[:classes, None]
    columns[own] -= before[came]
    columns[:, came == own] -= after[:classes, None]
    rows[own, met == own] += itself
    columns[own, came == own] += itself
    k = np.arange(classes)
    cell = matrix[k, k]
    cell[own] -= after[own] + before[own] - itself
    out, into = by_row[:classes] - before[:classes], by_column[:classes] - after[:classes]
    out[own] -= after.sum() - itself
    into[own] -= before.sum() - itself
    after, before = after.copy(), before.copy()
    after[own] -= itself
    before[own] -= itself
    gain = (_phi(rows + after[met]) - _phi(rows)).sum(axis=1) + (_phi(columns + before[came]) - _phi(columns)).sum(axis=1)
    gain -= _phi(cell + after[k]) - _phi(cell) + _phi(cell + before[k]) - _phi(cell)
    gain += _phi(cell + after[k] + before[k] + itself) - _phi(cell)
    # Pairs with the word on their other side count in a class's sums wherever the word goes.
    out, into = out + before[:classes], into + after[:classes]
    gain -= _phi(out + after.sum() + itself) - _phi(out) + _phi(into + before.sum() + itself) - _phi(into)
    return gain - gain[own]


class Gains:
    """What numbers gain by a rise, a row each for rises of a few up to `USUAL`, which are worked out once, and others as they come."""

    def __init__(self, numbers: np.ndarray, usual: int, kind: type):
        self.numbers, self.kind = numbers, kind
        self.usual = np.stack([self._worked(slice(None), k) for k in range(usual + 1)])

    def _worked(self, rows: slice | np.ndarray, rise: int | np.ndarray) -> np.ndarray:
        there = self.numbers[rows]
        return (_phi(there + rise) - _phi(there)).astype(self.kind)

    def of(self, rows: np.ndarray, rises: np.ndarray) -> np.ndarray:
        seldom = np.flatnonzero(rises >= len(self.usual))
        out = self.usual[np.where(rises < len(self.usual), rises, 0), rows]
        if len(seldom):
            kinds, back = np.unique(rows[seldom] * (int(rises.max()) + 1) + rises[seldom], return_index=True, return_inverse=True)[1:]
            out[seldom] = self._worked(rows[seldom][kinds], rises[seldom][kinds].astype(np.float64)[:, None])[back]
        return out


def gains_of(matrix: np.ndarray, classes: int, sums: tuple[np.ndarray, np.ndarray]) -> tuple[Gains, ...]:
    """Of the cells with a class after and before, and of the sums over rows and columns."""
    cells = np.concatenate([matrix[:classes].T, matrix[:, :classes]])
    return Gains(cells, USUAL, np.float32), *(Gains(total[None, :classes], 4 * USUAL, np.float64) for total in sums)


def _added(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin there, none empty: all first rows, then all second ones, and so on. Most runs are short."""
    length = np.diff(np.append(begins, len(rows)))
    order = np.argsort(-length, kind="stable")
    longer, out = -length[order], rows[begins[order]]
    for k in range(1, int(length.max(initial=0))):
        n = int(np.searchsorted(longer, -k))
        out[:n] += rows[begins[order[:n]] + k]
    out[order] = out.copy()
    return out


def batch_gains(
    own: np.ndarray,
    begins: np.ndarray,
    at: np.ndarray,
    n: np.ndarray,
    matrix: np.ndarray,
    classes: int,
    sums: tuple[np.ndarray, np.ndarray],
    gains: tuple[Gains, ...] | None = None,
) -> np.ndarray:
    """`exchange_gains` of many words at once, a row each: word k meets `n` times what `at` names from begins[k] on; `at` is a class after
    the word, or the width plus a class before it, each once a word.

    Cells that would change by the word's row and by its column (those of its own and the new class with each other) are taken as if
    changed by one after the other, which is off by terms of second order; the likelihood itself is exact, and decides on assignments.
    `gains` are `gains_of` the matrix.
    """
    width, k = len(matrix), np.arange(len(own))
    by_cell, *by_sum = gains or gains_of(matrix, classes, sums)
    cells = by_cell.numbers
    # What a class gains by a cell's rise is the same for all words that meet the cell as often.
    gain = _added(by_cell.of(at, n), begins).astype(np.float64)
    mine = cells[at, np.repeat(own, np.diff(np.append(begins, len(at))))]
    gain -= np.add.reduceat(_phi(mine) - _phi(mine - n), begins)[:, None]
    for total, by, side in zip(sums, by_sum, (at < width, at >= width)):
        # A class's sum over the words after it, then before it.
        moved = np.add.reduceat(np.where(side, n, 0), begins)
        gain -= by.of(np.zeros(len(own), np.int64), moved)
        gain += (_phi(total[own]) - _phi(total[own] - moved))[:, None]
    gain[k, own] = 0.0
    return gain


def _in_few_tasks(rows: DataFrame) -> DataFrame:
    """A few tasks a core, however many partitions there are: what a task hands on by class is as much for a small partition as for a large one,
    and every file a task writes to a local folder makes the executor start other programs."""
    return rows.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def _matrix(links: DataFrame, index: Index, steps: list[int], classes: int) -> np.ndarray:
    width, size = classes + 2, index.size

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = index.classes(steps, classes).astype(np.int64), np.zeros(width * width)
        for batch in batches:
            w, to, n = _links_of(batch)
            # A pair is counted where its first word is, or, if that has no row, where its second is.
            before = to % 2 == 1
            after, alone = np.flatnonzero(~before), np.flatnonzero(before & (to >= 2 * size))
            total += np.bincount(of[w[after]] * width + of[to[after] >> 1], n[after], width * width)
            total += np.bincount(of[to[alone] >> 1] * width + of[w[alone]], n[alone], width * width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    out = np.zeros(width * width)
    cells = _in_few_tasks(links).select("w", "to", "n").mapInArrow(added, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in _in_few_tasks(cells).collect():
        out[r["at"]] = r["n"]
    return out.reshape(width, width)


def _moved(links: DataFrame, index: Index, steps: list[int], step: int, matrix: np.ndarray, classes: int, group: int, groups: int) -> list[int]:
    """Move the words of a group; the steps of the shards after it."""
    width, shared = classes + 2, links.sparkSession.sparkContext.broadcast(matrix)

    def met(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the batch's words meet: the word, a class after it or (width +) before it, and how often, in order, each once."""
        words, to, n = _links_of(batch)
        at = (to % 2) * width + index.classes(steps, classes)[to >> 1]
        keys, counts = _flat(words * (2 * width) + at, n)
        return keys // (2 * width), keys % (2 * width), counts

    def weighed() -> tuple[tuple[np.ndarray, np.ndarray], tuple[Gains, ...]]:
        sums = (shared.value.sum(axis=1), shared.value.sum(axis=0))
        return sums, gains_of(shared.value, classes, sums)

    def better(words: np.ndarray, at: np.ndarray, n: np.ndarray, sums: tuple[np.ndarray, np.ndarray], by: tuple[Gains, ...]) -> Iterator[pa.RecordBatch]:
        """The words that another class suits better, in blocks of bounded size."""
        counts, of = shared.value, index.classes(steps, classes)
        begins = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
        ends, first = np.append(begins[1:], len(words)), 0
        while first < len(begins):
            last = max(first + 1, int(np.searchsorted(ends, begins[first] + BLOCK, "right")))
            part = slice(begins[first], ends[last - 1])
            w = words[begins[first:last]]
            gains = batch_gains(of[w].astype(np.int64), begins[first:last] - begins[first], at[part], n[part], counts, classes, sums, by)
            best = gains.argmax(axis=1)
            good = gains[np.arange(len(w)), best] > 1e-6
            w, c = w[good], best[good]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(index.starts, w, "right") - 1), pa.array(w), pa.array(c)], names=["at", "w", "c"])
            first = last

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = weighed()
        for batch in batches:
            if batch.num_rows:
                yield from better(*met(batch), *by)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _flat(*(np.concatenate(x) for x in zip(*held)))

        def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys // (2 * width), keys % (2 * width), counts)], names=["w", "at", "n"])

        for batch in batches:
            words, at, n = met(batch)
            held.append((words * (2 * width) + at, n))
            size += len(words)
            if size > 2 * FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*merged())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = weighed()
        for batch in batches:
            if batch.num_rows:
                lists = [batch.column(c) for c in ("at", "n")]
                words = np.repeat(batch.column("w").to_numpy(), np.diff(lists[0].offsets.to_numpy()))
                yield from better(words, *(x.flatten().to_numpy() for x in lists), *by)

    def stored(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["at"].iloc[0])
        now = np.array(_opened(f"{index.folder}/classes-{steps[k]}-{index.shards[k]}", np.uint16))
        now[frame["w"].to_numpy(np.int64) - index.starts[k]] = frame["c"]
        put(index.folder, f"classes-{step}-{index.shards[k]}", now.tobytes())
        return pd.DataFrame({"at": [k]})

    mine = links.where((F.col("w") < index.size) & (F.pmod(F.xxhash64("w"), F.lit(groups)) == group))
    moves = _in_few_tasks(mine.where("chunks = 1")).select("w", "to", "n").mapInArrow(whole, "at long, w long, c long")
    # A very frequent word's rows are added up by what they meet, which is at most twice the classes, in each task and then over all.
    cut = _in_few_tasks(mine.where("chunks > 1")).select("w", "to", "n").mapInArrow(parts, "w long, at long, n long").repartition("w")
    cut = cut.groupBy("w", "at").agg(F.sum("n").alias("n"))
    cut = cut.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("met")).select("w", "met.at", "met.n")
    moves = moves.unionByName(_in_few_tasks(cut).mapInArrow(joined, "at long, w long, c long"))
    out = list(steps)
    for r in _in_few_tasks(moves.groupBy("at").applyInPandas(stored, "at long")).collect():
        out[r["at"]] = step
    shared.destroy()
    return out


def cluster(links: DataFrame, index: Index, classes: int, rounds: int | None = None) -> tuple[list[int], np.ndarray]:
    """(steps of the shards' classes, class bigram counts), after `rounds` steps or when the likelihood has stopped rising."""
    steps, best, groups, group = [0] * len(index.shards), None, GROUPS, 0
    for step in itertools.count():
        matrix = _matrix(links, index, steps, classes)
        value = likelihood(matrix)
        if best is None:
            first = swept = value
        if best is None or value > best[0]:
            best = (value, steps, matrix)
        if step == rounds or not index.size:
            break
        if rounds is None and step and group == 0:
            if best[0] - swept <= STILL * (best[0] - first):
                if value >= best[0] or groups >= MOST_GROUPS:
                    break
                groups *= 2
                _, steps, matrix = best
            swept = best[0]
        steps = _moved(links, index, steps, step + 1, matrix, classes, group, groups)
        group = (group + 1) % groups
    return best[1], best[2]


def _most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """The `head` most frequent words. Powers of two of the counts tell first which words can be among them, so that tasks
    do not each send `head` words to the driver."""
    power = F.floor(F.log2("n"))
    sizes = {r["p"]: r["count"] for r in counts.groupBy(power.alias("p")).count().collect()}
    least, found = 0, 0
    for p in sorted(sizes, reverse=True):
        least, found = p, found + sizes[p]
        if found >= head:
            break
    return counts.where(power >= least).orderBy(F.desc("n"), "word").limit(head)


def train(
    documents: DataFrame, text: str = "text", head: int = HEAD, clustered: int | None = None, classes: int | None = None, rounds: int | None = None
) -> tuple[Model, DataFrame]:
    """The model, and the table of all words' counts (word, n). `clustered`, `classes` and `rounds` replace what the texts tell."""
    folder = workspace(documents, "class-lm")
    texts = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(_in_few_tasks(counts), f"{folder}/counts")
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    named = counts.where(F.col("word") != END)
    top = _most_frequent(named, head).collect()
    words, frequency = [bytes(r["word"]) for r in top], np.array([r["n"] for r in top], np.int64)
    chosen = named.where(F.col("n") >= LEAST) if clustered is None else _most_frequent(named, clustered)
    n_words = chosen.count()
    classes = classes or max(LEAST_CLASSES, round(2 * n_words ** (1 / 3)))
    index = build_index(chosen, n_words, classes, folder)
    numbers = index.find(words)[0]
    shared = documents.sparkSession.sparkContext.broadcast((pa.array(words, pa.binary()), numbers))
    # Sorted rows need no more memory than a sort has, while lists collected by word take an executor's heap. The table is kept on the executors'
    # disks for the steps below; those of very frequent words come last, so that a step passes over batches of the other kind.
    links = texts.mapInArrow(lambda it: _sent(_links(it, index, *shared.value)), LINKS).repartition("w", "chunk")
    links = links.sortWithinPartitions("chunks", "w", "chunk").mapInArrow(lambda it: _merged(_received(it)), STORED_LINKS).persist(StorageLevel.DISK_ONLY)
    try:
        steps, matrix = cluster(links, index, classes, rounds)
    finally:
        links.unpersist()

    seen, arrived = matrix.sum(axis=1, keepdims=True), matrix.sum(axis=0)
    even = (arrived + 1) / (arrived.sum() + len(arrived))
    share = np.divide(matrix, seen, out=np.tile(even, (len(matrix), 1)), where=seen > 0)
    transition = np.log10(WEIGHT * share + (1 - WEIGHT) * even)
    # Each token is followed by one, so the rows' sums are the tokens of each class.
    in_class, ends = matrix.sum(axis=1), int(arrived[classes + 1])
    of = np.where(numbers >= 0, index.classes(steps, classes)[numbers], classes).astype(np.int64)
    rare_total, rare_different = int(in_class[classes]), max(0, int(different) - n_words - (ends > 0))
    rare = np.log10((frequency + 1) / (rare_total + rare_different + 1))
    emission = np.where(of < classes, np.log10(frequency / np.maximum(in_class[of], 1)), rare)
    return Model(words, frequency, int(total), int(different), of, transition, emission, rare_total, rare_different, index, steps, in_class), counts


def score(documents: DataFrame, model: Model, counts: DataFrame, carry: dict[str, Column], text: str = "text") -> DataFrame:
    """The carried columns (struct `row`), n_tokens, n_known, train_tokens, base_score, score and perplexity of every text."""
    folder = workspace(documents, "class-lm-score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(
        F.monotonically_increasing_id().alias("at"), F.struct(*[c.alias(name) for name, c in carry.items()]).alias("row"), F.col(text).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n_head, border, rare = len(m.words), len(m.transition) - 1, len(m.transition) - 2
        head = pa.array(m.words, pa.binary())
        whole = m.total + m.different + 1
        base = np.append(np.log10((m.counts + 1) / whole), 0.0)
        emission, of = np.append(m.emission, 0.0), np.append(m.classes, rare)
        classes = m.index.classes(m.steps, rare)
        for part, words, codes, begins in _texts(batches, 2):
            # Clustered words past the head follow the head's for this part.
            of_words = _places(words, head)
            others = np.flatnonzero(of_words < 0)
            at, n = m.index.find(words.take(pa.array(others)))
            hit = np.flatnonzero(at >= 0)
            of_words[others] = n_head
            of_words[others[hit]] = n_head + 1 + np.arange(len(hit))
            of_all = np.append(of, classes[at[hit]])
            base_all = np.append(base, np.log10((n[hit] + 1) / whole))
            emission_all = np.append(emission, np.log10(n[hit] / m.in_class[of_all[n_head + 1 :]]))
            ids, out = of_words[codes], []
            for own in np.split(ids, begins[1:-1]):
                path = np.concatenate([[border], of_all[own], [border]])
                out.append((base_all[own].sum(), m.transition[path[:-1], path[1:]].sum() + emission_all[own].sum()))
            low, high = zip(*out)
            # The words left to the table of all words, each once a text.
            left = np.flatnonzero(ids == n_head)
            row, of_row = np.arange(len(part)), np.searchsorted(begins, left, "right") - 1
            pairs, k = np.unique(of_row * (len(words) + 1) + codes[left], return_counts=True)
            named = pa.StructArray.from_arrays([words.take(pa.array(pairs % (len(words) + 1))), pa.array(k)], ["word", "k"])
            ends = np.searchsorted(pairs, np.append(row, len(part)) * (len(words) + 1))
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named)
            n = np.diff(begins)
            known = n - np.bincount(of_row, minlength=len(part))
            columns = [pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, tails], names=["at", "row", "n_tokens", "n_known", "base", "steps", "tail"])

    schema = rows.drop("text").schema
    for name, kind in (("n_tokens", LongType()), ("n_known", LongType()), ("base", DoubleType()), ("steps", DoubleType()), ("tail", TAIL)):
        schema = schema.add(name, kind)
    placed = written(_in_few_tasks(rows.mapInArrow(run, schema)), f"{folder}/placed")

    whole, rare = model.total + model.different + 1, model.rare_total + model.rare_different + 1
    left = placed.select("at", F.explode("tail").alias("t")).select("at", "t.word", "t.k").join(counts, "word", "left")
    seen = F.coalesce("n", F.lit(0))
    left = left.groupBy("at").agg(
        F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10((seen + 1) / whole)).alias("more_base"),
        F.sum(F.col("k") * F.log10((seen + 1) / rare)).alias("more_steps"),
    )
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    end_base = float(np.log10((ends + 1) / whole))
    total = F.col("steps") + F.coalesce("more_steps", F.lit(0.0))
    scored = placed.drop("tail").join(left, "at", "left").select(
        "row",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
    return _in_few_tasks(scored)
