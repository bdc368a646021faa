"""Exact token counts of every prefix of a text under a byte-level byte-pair vocabulary, by dynamic programming.

The library's pre-tokenizer cuts a text into parts that are encoded alone. Within a part, the encoding of a prefix is
fixed by its last token (see `bpe`): going through the places, the one token that ends there and is compatible with the
last token before it gives count[place] = count[start] + 1. All new parts of a batch go through the places together;
token lookups use rolling hashes, confirmed by the bytes. Parts are computed once per worker.

A text's table has the count of every prefix, four bytes per character: its last entry is the text's count, and truncation or
budget questions read entries; nothing is encoded again. A cut inside a part can change how its characters are pre-tokenized
(a space joins the run before it while nothing follows, part of a contraction is none), so such prefixes follow the rule for
a text that ends there.

Edge cases: a null or empty text has no bytes and no tokens. The added special string is one token, as the library's
default has it, and its prefixes are ordinary text. Repeated rows agree. Extra columns are not read. Texts of any length are
counted whole; parts of thousands of characters take the same steps, one part at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import PairRules
from .fingerprints import mix, slices
from .shipping import ship

# Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The endings the pattern cuts off first.
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
CACHED_PARTS = 400_000
# Parts longer than this many bytes are worked on alone, place by place.
LONG_PART = 64
_BASE, _BACK = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens numbered by merge rank, bytes first."""

    loaded: dict[str, "Vocabulary"] = {}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        spell = lambda text: bytes(letters[c] for c in text)
        number = {bytes([b]): b for b in range(256)}
        self.rules = PairRules(256 + len(merges))
        for a, b in merges:
            a, b = spell(a), spell(b)
            token = number.setdefault(a + b, len(number))
            self.rules.add(number[a], number[b], token)
        self.rules.freeze()
        self.number = number
        self.longest = max(map(len, number))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        # Per length: sorted hashes of the tokens' bytes, their numbers and bytes.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        powers = _BASE ** np.arange(self.longest, dtype=np.uint64)
        lengths: dict[int, list[bytes]] = {}
        for t in number:
            lengths.setdefault(len(t), []).append(t)
        with np.errstate(over="ignore"):
            for n, tokens in lengths.items():
                grid = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, n)
                hashes = mix(((grid.astype(np.uint64) + np.uint64(1)) * powers[:n]).sum(axis=1, dtype=np.uint64))
                order = np.argsort(hashes)
                self.by_length[n] = (hashes[order], np.array([number[t] for t in tokens])[order], grid[order])
        # part -> (counts at its characters, as bytes; its count; its characters)
        self.parts: dict[str, tuple[bytes, int, int]] = {}
        # part -> its count, where only whole texts are asked for
        self.totals: dict[str, int] = {}
        self.start()

    def start(self) -> None:
        """Added special strings are one token."""
        for s in self.specials:
            self.parts[s] = (np.ones(len(s), "<i4").tobytes(), 1, len(s))
            self.totals[s] = 1


def prefix_counts(parts: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Token count of every byte prefix of each part (the first is 0)."""
    count, first, lengths = counts_at_places(parts, vocabulary)
    return [count[f : f + n + 1] for f, n in zip(first, lengths)]


def counts_at_places(parts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all prefixes of all parts in one array, where each part begins in it, and the parts' lengths; the parts are worked on
    place by place together."""
    lengths = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    data = np.zeros(int((lengths + 1).sum()), np.uint8)
    inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(parts)), lengths)
    data[inside] = np.frombuffer(b"".join(parts), np.uint8)
    with np.errstate(over="ignore"):
        powers = np.full(len(data) + 1, _BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(len(data) + 1, _BACK)
        back[0] = 1
        back = np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    last, count = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
    by_size = np.argsort(-lengths, kind="stable")
    sizes = lengths[by_size]
    known = sorted(vocabulary.by_length, reverse=True)
    for place in range(1, int(lengths.max(initial=0)) + 1):
        # Places of the parts that are long enough; each is settled by the longest token that fits.
        open_ends = first[by_size[: np.searchsorted(-sizes, -place, "right")]] + place
        for n in known:
            if n > place:
                continue
            start = open_ends - n
            with np.errstate(over="ignore"):
                hashes = mix((sums[open_ends] - sums[start]) * back[start])
            table, numbers, spelled = vocabulary.by_length[n]
            at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            found = np.flatnonzero(table[at] == hashes)
            if not len(found):
                continue
            start, token = start[found], numbers[at[found]]
            right = (data[start[:, None] + np.arange(n)] == spelled[at[found]]).all(axis=1)
            if place > n:
                right[right] = vocabulary.rules.compatible(last[start[right]], token[right])
            found, start, token = found[right], start[right], token[right]
            end = open_ends[found]
            last[end], count[end] = token, count[start] + 1
            rest = np.ones(len(open_ends), bool)
            rest[found] = False
            open_ends = open_ends[rest]
            if not len(open_ends):
                break
    return count, first, lengths


def _long_counts(part: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The same for one long part."""
    last, count = [-1] * (len(part) + 1), np.zeros(len(part) + 1, np.int64)
    number, fits = vocabulary.number, vocabulary.rules.compatible_one
    seen: dict[tuple[int, int], bool] = {}
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            token = number.get(part[start:end])
            if token is None:
                continue
            pair = (last[start], token)
            if start and pair not in seen:
                seen[pair] = fits(*pair)
            if not start or seen[pair]:
                last[end], count[end] = token, count[start] + 1
                break
    return count


def _at_characters(text: str, counts: np.ndarray) -> np.ndarray:
    """Counts at the ends of a part's characters."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(np.append((data[1:] & 0xC0) != 0x80, True)) + 1
    return counts[ends]


def _fill(parts: set[str], vocabulary: Vocabulary) -> None:
    """Compute the parts that are not known yet."""
    cache = vocabulary.parts
    encoded = [(t, t.encode()) for t in parts if t not in cache]
    short = [(t, b) for t, b in encoded if len(b) <= LONG_PART]
    for first in range(0, len(short), 50_000):
        group = short[first : first + 50_000]
        for (t, _), counts in zip(group, prefix_counts([b for _, b in group], vocabulary)):
            cache[t] = (_at_characters(t, counts).astype("<i4").tobytes(), int(counts[-1]), len(t))
    for t, b in encoded:
        if len(b) > LONG_PART:
            counts = _long_counts(b, vocabulary)
            cache[t] = (_at_characters(t, counts).astype("<i4").tobytes(), int(counts[-1]), len(t))
    # A prefix of a contraction is not a contraction; it is cut like any other text.
    for t in CONTRACTIONS & parts:
        inner = _cut_counts("", t, vocabulary)
        cache[t] = (np.array([*inner, cache[t][1]], "<i4").tobytes(), cache[t][1], len(t))


def _fill_totals(parts: set[str], vocabulary: Vocabulary) -> None:
    """Compute the counts of whole parts: of every prefix's, the last."""
    cache = vocabulary.totals
    new = [t for t in parts if t not in cache]
    short = [t for t in new if len(t) * 4 <= LONG_PART or len(t.encode()) <= LONG_PART]
    for first in range(0, len(short), 50_000):
        group = short[first : first + 50_000]
        count, begins, lengths = counts_at_places([t.encode() for t in group], vocabulary)
        cache.update(zip(group, count[begins + lengths].tolist()))
    for t in set(new).difference(short):
        cache[t] = int(_long_counts(t.encode(), vocabulary)[-1])


def _count(part: str, vocabulary: Vocabulary) -> int:
    if part not in vocabulary.parts:
        _fill({part}, vocabulary)
    return vocabulary.parts[part][1]


def _cut_counts(before: str, part: str, vocabulary: Vocabulary) -> list[int]:
    """Tokens added by each proper prefix of a part, behind the part before it, as if the text ended there."""
    base = _count(before, vocabulary) if before else 0
    return [sum(_count(p, vocabulary) for p in PATTERN.findall(before + part[:n])) - base for n in range(1, len(part))]


def split_parts(text: str, vocabulary: Vocabulary) -> list[str]:
    """Parts as the library cuts them, added special strings apart."""
    if not any(s in text for s in vocabulary.specials):
        return PATTERN.findall(text)
    out, at = [], 0
    for m in vocabulary.special.finditer(text):
        out += [*PATTERN.findall(text[at : m.start()]), m[0]]
        at = m.end()
    return out + PATTERN.findall(text[at:])


def prefix_table(text: str, parts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Token count of every prefix of the text, by characters; the first entry is of one character."""
    found = [vocabulary.parts[p] for p in parts]
    inner, counts, lengths = zip(*found)
    table = np.frombuffer(b"".join(inner), "<i4").copy()
    lengths, before = np.array(lengths), np.cumsum((0, *counts[:-1]))
    table += np.repeat(before, lengths).astype(np.int32)
    # White space behind white space belongs to the run in front of it while nothing follows.
    if _DOUBLE_SPACE.search(text):
        at = np.cumsum(lengths) - lengths
        for k in range(1, len(parts)):
            if parts[k][0].isspace() and parts[k - 1].isspace():
                run = parts[k - 1] + parts[k][0]
                table[at[k]] = before[k - 1] + sum(_count(p, vocabulary) for p in PATTERN.findall(run))
    if any(s in text for s in vocabulary.specials):
        at = np.cumsum(lengths) - lengths
        for k in (k for k, p in enumerate(parts) if p in vocabulary.specials):
            # A cut special string is ordinary text, and its signs may join those in front.
            front = parts[k - 1] if k and parts[k - 1] not in vocabulary.specials else ""
            table[at[k] : at[k] + lengths[k] - 1] = before[k] + np.array(_cut_counts(front, parts[k], vocabulary))
    return table


_DOUBLE_SPACE = regex.compile(r"\s\s")


def count_documents(
    documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", store: bool = False
) -> DataFrame:
    """(<doc_id>, n_bytes, n_tokens) and, if `store`, prefix_counts: the table as little-endian 32-bit numbers."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            for first, last, _, offsets in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                split = [split_parts(t, vocabulary) for t in texts]
                if max(len(vocabulary.parts), len(vocabulary.totals)) > CACHED_PARTS:
                    vocabulary.parts.clear()
                    vocabulary.totals.clear()
                    vocabulary.start()
                if store:
                    _fill(set().union(*split), vocabulary)
                    tables = [prefix_table(t, p, vocabulary) if p else np.zeros(0, np.int32) for t, p in zip(texts, split)]
                    totals = [int(t[-1]) if len(t) else 0 for t in tables]
                else:
                    # The table's last entry alone: parts are cut as the whole text has them.
                    _fill_totals(set().union(*split), vocabulary)
                    totals = [sum(map(vocabulary.totals.__getitem__, p)) for p in split]
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(totals, pa.int64())]
                if store:
                    columns.append(pa.array([t.astype("<i4").tobytes() for t in tables], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens", "prefix_counts"][: len(columns)])

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long" + ", prefix_counts binary" * store)
    return out.withColumnRenamed("id", doc_id)


def _entry(table: Column, n: Column) -> Column:
    """Entry n (from 1) of a stored table; the empty prefix has none."""
    # Little-endian bytes, read in reverse as one hexadecimal number.
    byte = lambda k: F.hex(F.substring(table, (n - 1) * 4 + k, F.lit(1)))
    return F.when(n <= 0, 0).otherwise(F.conv(F.concat(*[byte(k) for k in (4, 3, 2, 1)]), 16, 10).cast("int"))


def tokens_of_prefix(table: Column, n_chars: Column) -> Column:
    """Tokens of the first n characters, from a stored table; all characters if the text is shorter."""
    return _entry(table, F.least(n_chars, F.floor(F.octet_length(table) / 4)))


def longest_prefix_within(counted: DataFrame, budget: int, table: str = "prefix_counts") -> DataFrame:
    """Adds `n_chars`: the most characters that can be kept so that the kept text has at most `budget` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [np.frombuffer(t, "<i4") for t in batch.column(table).to_pylist()]
            # Counts may fall when a character completes a longer token, so the last fitting place is taken.
            kept = [int(np.flatnonzero(t <= budget)[-1]) + 1 if (t <= budget).any() else 0 for t in tables]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.int64())], names=[*batch.schema.names, "n_chars"])

    return counted.mapInArrow(run, StructType(list(counted.schema.fields)).add("n_chars", "long"))
