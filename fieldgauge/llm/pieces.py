"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary file names pieces and scores; text is encoded as its library does for a byte-pair model: a space
before the text, spaces written as U+2581, best-scored merges first, leftmost among equals, unknown characters as bytes. Every
merge stays within a word (a run of U+2581 and the characters up to the next), since no piece has U+2581 after another
character; words are therefore encoded once per worker.

The new words of a batch are concatenated and indexed by a suffix array, sorted by as many characters as the longest
piece has. Each piece finds its occurrences as one range by binary search, all pieces in step. The occurrences are
edges from start to end; sorted by end, they are relaxed place by place over all words at once: the one edge whose
piece is compatible with the last piece before it (see `bpe`) gives the place's last piece. Reading back from a word's
end gives its pieces.

Edge cases: null and empty texts have no pieces and decode to the empty text. U+2581 inside a text is read as a space, as
the library does, so only such texts do not come back whole; `exact` says so. Repeated rows agree. Extra columns are not
read. Texts of any length are encoded whole; words of thousands of characters are relaxed one place after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairRules
from .fingerprints import slices
from .shipping import ship

SPACE = "▁"
# Characters indexed at once.
INDEX_CHARS = 400_000
# When so many words are known, they are kept for one more turn, in which those that occur again go on.
CACHED_WORDS = 200_000
# Longer words are relaxed alone.
LONG_WORD = 96
END = 0x110000


class Vocabulary:
    """Pieces numbered by merge rank, with the ids of the model file. One number past them stands for an unknown character."""

    loaded: dict[str, "Vocabulary"] = {}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # Single characters are not merged from anything; they come before all merges.
        plain.sort(key=lambda i: (len(model.id_to_piece(i)) > 1, -model.get_score(i), i))
        texts = [model.id_to_piece(i) for i in plain]
        rank = {t: k for k, t in enumerate(texts)}
        self.unknown = len(texts)
        self.ids = np.array([*plain, -1], np.int32)
        self.bytes = {model.id_to_piece(i): i for i in range(model.vocab_size()) if model.is_byte(i)}
        self.byte_ids = np.array([self.bytes[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        # What each id stands for when decoded.
        self.spelled = [b""] * model.vocab_size()
        for i, t in zip(plain, texts):
            self.spelled[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.spelled[i] = bytes([b])
        self.rules = PairRules(len(texts) + 1)
        reachable = np.ones(len(texts), bool)
        # Merges in rank order: a piece is made of the two pieces whose border no earlier merge crosses.
        for k, text in enumerate(texts):
            if len(text) == 1:
                continue
            for cut in range(len(text) - 1, 0, -1):
                a, b = rank.get(text[:cut], k), rank.get(text[cut:], k)
                if a < k and b < k and reachable[a] and reachable[b] and self.rules.compatible_one(a, b):
                    self.rules.add(a, b, k)
                    break
            else:
                reachable[k] = False
        self.rules.freeze()
        usable = [k for k in range(len(texts)) if reachable[k]]
        self.ranks = np.array(usable, np.int64)
        self.lengths = np.array([len(texts[k]) for k in usable], np.int64)
        self.longest = int(self.lengths.max())
        # Rows of code points plus one; zero pads, and sorts before every character.
        self.table = np.zeros((len(usable), self.longest), np.int64)
        for row, k in enumerate(usable):
            self.table[row, : self.lengths[row]] = [ord(c) + 1 for c in texts[k]]
        # word -> its piece ids as little-endian 32-bit numbers; those of this turn and of the one before
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the text that begins there, compared over at least `depth` codes, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < depth:
        second = np.zeros(n, np.int64)
        second[:-reach] = rank[reach:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        reach *= 2
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of suffixes that begin with each piece: binary search, all pieces in step, a character at a time."""
    n, width = len(codes), table.shape[1]
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(table), np.int64), np.full(len(table), n)
        while True:
            open_rows = np.flatnonzero(low < high)
            if not len(open_rows):
                break
            middle = (low[open_rows] + high[open_rows]) // 2
            start = order[middle]
            sign = np.zeros(len(open_rows), np.int64)
            for k in range(width):
                live = np.flatnonzero((sign == 0) & (lengths[open_rows] > k))
                if not len(live):
                    break
                sign[live] = np.sign(padded[start[live] + k] - table[open_rows[live], k])
            right = sign <= 0 if upper else sign < 0
            low[open_rows[right]] = middle[right] + 1
            high[open_rows[~right]] = middle[~right]
        bounds.append(low)
    return bounds[0], bounds[1]


def edges_of(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each word, then start, end and piece of every edge); unknown characters get edges too."""
    lengths = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    codes = np.full(int((lengths + 1).sum()), END + 1, np.int64)
    inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(words)), lengths)
    codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    order = suffix_array(codes, vocabulary.longest)
    low, high = occurrences(codes, order, vocabulary.table, vocabulary.lengths)
    n_found = high - low
    piece = np.repeat(np.arange(len(low)), n_found)
    at = order[np.arange(len(piece)) - np.repeat(np.cumsum(n_found) - n_found, n_found) + low[piece]]
    known = np.zeros(len(codes), bool)
    single = vocabulary.lengths[piece] == 1
    known[at[single]] = True
    stray = inside[~known[inside]]
    start = np.concatenate([at, stray])
    end = np.concatenate([at + vocabulary.lengths[piece], stray + 1])
    token = np.concatenate([vocabulary.ranks[piece], np.full(len(stray), vocabulary.unknown)])
    return first, start, end, token


def encode_words(words: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Piece ids of each word."""
    first, start, end, token = edges_of(words, vocabulary)
    lengths = np.array([len(w) for w in words], np.int64)
    n_places = int(first[-1] + lengths[-1]) + 1
    word = np.repeat(np.arange(len(words)), lengths + 1)[start]
    last, came = np.full(n_places + 1, -1, np.int64), np.zeros(n_places + 1, np.int64)
    begins = np.zeros(n_places + 1, bool)
    begins[first] = True

    def relax(edges: np.ndarray) -> None:
        """Edges that end at different places: those that fit set the last piece of their end."""
        u, t = last[start[edges]], token[edges]
        fits = begins[start[edges]] | (u == vocabulary.unknown) | (t == vocabulary.unknown)
        test = np.flatnonzero(~fits & (u >= 0))
        fits[test] = vocabulary.rules.compatible(u[test], t[test])
        good = edges[fits]
        last[end[good]], came[end[good]] = token[good], start[good]

    # Sorted by place in the word, then longest first; each step has one edge per word at most.
    place, long = end - first[word], lengths[word] > LONG_WORD
    order = np.lexsort((start - end, place))
    order = order[~long[order]]
    marks = place[order] * (vocabulary.longest + 1) + (vocabulary.longest - (end - start)[order])
    for run in np.split(order, np.flatnonzero(np.diff(marks)) + 1) if len(order) else []:
        relax(run[last[end[run]] < 0])
    by_end = np.flatnonzero(long)
    for edge in by_end[np.lexsort((start[by_end] - end[by_end], end[by_end]))].tolist():
        s, e, t = start[edge], end[edge], int(token[edge])
        if last[e] < 0:
            u = int(last[s])
            if begins[s] or vocabulary.unknown in (u, t) or (u >= 0 and vocabulary.rules.compatible_one(u, t)):
                last[e], came[e] = t, s
    # Back from all words' ends at once.
    place, number, steps = first + lengths, np.arange(len(words)), []
    while len(place):
        steps.append((number, last[place], came[place]))
        place = came[place]
        going = place > first[number]
        place, number = place[going], number[going]
    number, ranks, at = (np.concatenate(x) for x in zip(*steps))
    back = np.lexsort((at, number))
    number, ranks, at = number[back], ranks[back], at[back]
    ids, cuts = vocabulary.ids[ranks], np.searchsorted(number, np.arange(len(words) + 1))
    out = [ids[cuts[k] : cuts[k + 1]] for k in range(len(words))]
    for k in np.unique(number[ranks == vocabulary.unknown]):
        parts = []
        for r, i, p in zip(ranks[cuts[k] : cuts[k + 1]], out[k], at[cuts[k] : cuts[k + 1]] - first[k]):
            parts.append(vocabulary.byte_ids[list(words[k][p].encode())] if r == vocabulary.unknown else np.array([i]))
        out[k] = np.concatenate(parts).astype(np.int32)
    return out


def split_pieces(text: str) -> list[str]:
    """Words of the text as it is encoded: each begins with its run of spaces."""
    parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:]
    words, spaces = [], ""
    for part in parts:
        spaces += SPACE
        if part:
            words.append(spaces + part)
            spaces = ""
    return [*words, spaces] if spaces else words


def encode_texts(texts: list[str | None], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Piece ids of each text; new words are encoded in groups of bounded size."""
    split = [split_pieces(t) if t else [] for t in texts]
    if len(vocabulary.words) > CACHED_WORDS:
        vocabulary.earlier, vocabulary.words = vocabulary.words, {}
    cache, earlier = vocabulary.words, vocabulary.earlier
    new = []
    for word in {w: None for words in split for w in words if w not in cache}:
        known = earlier.get(word)
        if known is None:
            new.append(word)
        else:
            cache[word] = known
    done = 0
    while done < len(new):
        size, upto = 0, done
        while upto < len(new) and (upto == done or size + len(new[upto]) <= INDEX_CHARS):
            size += len(new[upto]) + 1
            upto += 1
        for word, ids in zip(new[done:upto], encode_words(new[done:upto], vocabulary)):
            cache[word] = ids.astype("<i4").tobytes()
        done = upto
    for words in split:
        yield np.frombuffer(b"".join(map(cache.__getitem__, words)), "<i4")


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of piece ids: bytes are joined to characters, U+2581 is a space, the leading one goes."""
    text = b"".join(map(vocabulary.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_documents(documents: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(<doc_id>, n_tokens, token_ids, ids_sha256, decoded_sha256, exact): ids, and what decoding them gives.

    `exact` says that the decoded text is the text; ids_sha256 is over the ids as little-endian
    32-bit numbers.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(model_path)
        for batch in batches:
            # Slices of bounded size, so that the words and ids of many long texts are not all held at once.
            for first, last, *_ in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                texts = part.column(1).to_pylist()
                counts, ids, of_ids, of_text, exact = [], [], [], [], []
                for text, found in zip(texts, encode_texts(texts, vocabulary)):
                    decoded = decode(found, vocabulary)
                    counts.append(len(found))
                    ids.append(found)
                    of_ids.append(hashlib.sha256(found.tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                    exact.append(decoded == (text or ""))
                ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
                columns = [part.column(0), pa.array(counts, pa.int64()), lists, pa.array(of_ids), pa.array(of_text), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "exact"])

    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string, exact boolean")
    return out.withColumnRenamed("id", doc_id)


def decode_documents(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", token_ids: str = "token_ids") -> DataFrame:
    """(<doc_id>, text): the texts of token ids; null decodes to the empty text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(model_path)
        for batch in batches:
            texts = [decode(np.array(ids or [], np.int32), vocabulary) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(doc_id).alias("id"), F.col(token_ids).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", doc_id)
