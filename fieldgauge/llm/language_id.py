"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of orders 0 to 3 with symbol counts over all labelled training texts. A
byte is coded in the longest known context; an unseen symbol costs an escape (method C: a context with n
occurrences of d different symbols escapes with d / (n + d)) and is coded one order lower, at last evenly over 256
values. Statistics are frozen after training, so a byte's code length is a function of the byte and the three before it.
A text gets the language that codes it in the fewest bits; the score is that language's share of the likelihoods.

Counting is one pass: tasks count four-byte windows per language and combine them before the shuffle. Every context and every
label is kept, so the model, which the driver builds and each worker holds, takes four bytes for each different window and label.
Classifying is map-only: a binary search of each slice's different windows.

Edge cases: null, empty and letterless texts are `und` with score 0, as is everything when nothing could be learned.
Rows are judged one by one, so repeated rows and ids agree; ties go to the alphabetically first language. A null
label trains nothing. Extra columns are not read, `keep_known` returns them. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import slices
from .shipping import ship
from .tables import workspace, written

ORDER = 3
UNKNOWN = "und"
DEVIATIONS = 6.0
FLUSH = 1_000_000


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four bytes that end at each byte; a text begins after three line breaks."""
    lengths = np.diff(offsets)
    padded = np.full(len(data) + ORDER * len(lengths), 0x0A, np.uint32)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = data
    out = padded[at]
    for k in range(1, ORDER + 1):
        out |= padded[at - k] << np.uint32(8 * k)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    keys, counts = [], []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        unique, back = np.unique(all_keys, return_inverse=True)
        return unique, np.bincount(back, all_counts, len(unique)).astype(np.int64)

    def rows(unique: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        spelled = pa.array(list(names), pa.string())
        langs = spelled.take(pa.array(unique >> 32))
        return pa.RecordBatch.from_arrays([langs, pa.array(unique & 0xFFFFFFFF), pa.array(total)], names=["lang", "window", "n"])

    for batch in batches:
        labels = batch.column(1).to_pylist()
        codes = np.array([names.setdefault(x, len(names)) for x in labels], np.int64)
        for first, last, data, offsets in slices(batch.column(0)):
            key = np.repeat(codes[first:last] << 32, np.diff(offsets)) | _windows(data, offsets)
            unique, n = np.unique(key, return_counts=True)
            keys.append(unique)
            counts.append(n)
            if sum(map(len, keys)) > FLUSH:
                unique, n = merged()
                keys, counts = [unique], [n]
                if len(unique) > FLUSH // 2:
                    yield rows(unique, n)
                    keys, counts = [], []
    if keys:
        yield rows(*merged())


@dataclass
class Model:
    """Code lengths in bits for every language, (rows, languages) each."""

    languages: list[str]
    contexts: np.ndarray  # trigrams that are contexts of order three, as 24-bit numbers
    escape3: np.ndarray
    windows: np.ndarray  # seen four-byte windows of those contexts
    bits3: np.ndarray
    trigrams: np.ndarray
    bits2: np.ndarray
    escape2: np.ndarray
    bits1: np.ndarray
    limits: dict[str, float] | None = None  # most bits per byte of a text, by language
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


def _level(counts: np.ndarray, context: np.ndarray, n_contexts: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each row, escape bits of each context) of one order; unseen symbols escape to `lower`."""
    languages = counts.shape[1]
    total, different = np.zeros((n_contexts, languages)), np.zeros((n_contexts, languages))
    for k in range(languages):
        total[:, k] = np.bincount(context, counts[:, k], n_contexts)
        different[:, k] = np.bincount(context, counts[:, k] > 0, n_contexts)
    whole = total + different
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(different / whole), 0.0)
        bits = np.where(counts > 0, -np.log2(counts / whole[context]), escape[context] + lower)
    return bits, escape


def _matrix(rows, key: str, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(rows[key].to_numpy(np.int64), return_inverse=True)
    out = np.zeros((len(unique), len(languages)))
    out[at, rows["code"].to_numpy(np.int64)] = rows["n"]
    return unique, out


def train(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count windows over all rows with text and label, and turn the counts into code lengths."""
    folder = workspace(documents, "language-id")
    labelled = documents.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.mapInArrow(_counted, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    counts = written(counts, f"{folder}/counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    codes = documents.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, code long")
    counts = counts.join(F.broadcast(codes), "lang")
    order2 = counts.groupBy("code", F.expr("window & 16777215").alias("trigram")).agg(F.sum("n").alias("n")).toPandas()
    order3 = counts.select("code", "window", "n").toPandas()
    return _model(languages, order2, order3)


def _model(languages: list[str], order2, order3) -> Model:
    trigrams, counts2 = _matrix(order2, "trigram", languages)
    width = len(languages)
    counts1, counts0 = np.zeros((1 << 16, width)), np.zeros((256, width))
    np.add.at(counts1, trigrams & 0xFFFF, counts2)
    np.add.at(counts0, trigrams & 0xFF, counts2)
    bits0, _ = _level(counts0, np.zeros(256, np.int64), 1, np.full((256, width), 8.0))
    pairs = np.arange(1 << 16)
    bits1, _ = _level(counts1, pairs >> 8, 256, bits0[pairs & 0xFF])
    bits2, escape2 = _level(counts2, trigrams >> 8, 1 << 16, bits1[trigrams & 0xFFFF])
    windows, counts3 = _matrix(order3, "window", languages)
    contexts, of = np.unique(windows >> 8, return_inverse=True)
    lower = bits2[np.searchsorted(trigrams, windows & 0xFFFFFF)] if len(windows) else np.zeros((0, width))
    bits3, escape3 = _level(counts3, of, len(contexts), lower)
    small = lambda x: x.astype(np.float32)
    return Model(languages, contexts, small(escape3), windows, small(bits3), trigrams, small(bits2), small(escape2), small(bits1))


def window_bits(m: Model, windows: np.ndarray) -> np.ndarray:
    """Code length of each window's last byte under each language. Every different window is looked up once, by binary search in
    the model's sorted arrays, so a worker holds the model and nothing beside it."""
    different, back = np.unique(windows, return_inverse=True)
    different = different.astype(np.int64)
    out = np.zeros((len(different), len(m.languages)), np.float32)
    row, seen = _place(m.windows, different)
    out[seen] = m.bits3[row[seen]]
    left = different[~seen]
    if len(left):
        node, known = _place(m.contexts, left >> 8)
        tri, met = _place(m.trigrams, left & 0xFFFFFF)
        low = m.escape2[(left >> 8) & 0xFFFF] + m.bits1[left & 0xFFFF]
        low[met] = m.bits2[tri[met]]
        low[known] += m.escape3[node[known]]
        out[~seen] = low
    return out[back]


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def text_bits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code length of each text under each language."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(offsets))
    if len(full) and len(model.languages):
        bits = window_bits(model, _windows(data, offsets))
        for k in range(out.shape[1]):
            out[full, k] = np.add.reduceat(bits[:, k], offsets[full], dtype=np.float64)
    return out


def classify(documents: DataFrame, model: Model, carry: dict[str, Column], text: str = "text") -> DataFrame:
    """The carried columns with `lang_pred` and `score`; nothing but the text enters a prediction."""
    return _judged(documents, model, carry, text).drop("rate")


def _judged(documents: DataFrame, model: Model, carry: dict[str, Column], text: str) -> DataFrame:
    """As `classify`, with the bits per byte under the predicted language as `rate`."""
    ship(documents.sparkSession)
    has_letter = F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")
    rows = documents.select(
        F.struct(*[c.alias(name) for name, c in carry.items()]).alias("row"), F.when(has_letter, F.col(text)).alias("text")
    )
    shared = documents.sparkSession.sparkContext.broadcast(model)
    width = len(model.languages)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            best, score, rate = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
            for first, last, data, offsets in slices(batch.column(1)):
                bits = text_bits(shared.value, data, offsets)
                empty = np.diff(offsets) == 0
                if width:
                    best.append(np.where(empty, width, bits.argmin(axis=1)))
                    score.append(np.where(empty, 0.0, 1.0 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)))
                    rate.append(bits.min(axis=1) / np.maximum(np.diff(offsets), 1))
                else:
                    best.append(np.zeros(last - first, int))
                    score.append(np.zeros(last - first))
                    rate.append(np.zeros(last - first))
            found = names[np.concatenate(best)]
            columns = [batch.column(0), pa.array(found, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rate))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "rate"])

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("rate", "double")
    return rows.mapInArrow(judged, schema)


def learned(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all labelled texts, with its limits: bits per byte that a text of each language may take.

    The limits are `DEVIATIONS` standard deviations (a tenth of the mean at least, for few texts) above the mean of texts that the model
    they are judged by has not seen: each half of the labelled texts is judged by a model of the other half. A language none of
    whose texts was told apart so takes the limit of all languages' texts together.
    """
    half = F.pmod(F.xxhash64(F.col(text)), F.lit(2))
    known = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rates = None
    for k in (0, 1):
        judged = _judged(known.where(half == k), train(known.where(half != k), text, lang), {"lang": F.col(lang).cast("string")}, text)
        judged = judged.where("row.lang = lang_pred").select("lang_pred", "rate")
        rates = judged if rates is None else rates.unionByName(judged)
    sums = rates.groupBy("lang_pred").agg(F.count("*").alias("n"), F.sum("rate").alias("s"), F.sum(F.col("rate") * F.col("rate")).alias("ss")).collect()
    limits = {r["lang_pred"]: _limit(r["n"], r["s"], r["ss"]) for r in sums}
    pooled = _limit(*(sum(r[c] for r in sums) for c in ("n", "s", "ss"))) if sums else float("inf")
    model = train(documents, text, lang)
    return replace(model, limits={name: limits.get(name, pooled) for name in model.languages})


def _limit(n: int, total: float, squares: float) -> float:
    mean = total / n
    return mean + DEVIATIONS * max(max(0.0, squares / n - mean * mean) ** 0.5, mean / 10)


def keep_known(documents: DataFrame, model: Model, least_score: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with a recognised language, with their columns. The score only compares languages; the limits of a `learned` model
    reject also what fits none of them. Where no language was learned nothing can be told apart, and all documents stay."""
    if not model.languages:
        return documents
    judged = _judged(documents, model, {c: F.col(f"`{c}`") for c in documents.columns}, text)
    judged = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    if model.limits is not None:
        limit = F.lit(float("inf"))
        for name, top in model.limits.items():
            limit = F.when(F.col("lang_pred") == name, top).otherwise(limit)
        judged = judged.where(F.col("rate") <= limit)
    return judged.select("row.*")
