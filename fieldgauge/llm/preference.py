"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's strength is a weighted sum of measures of its text. The weights maximise the likelihood of preference pairs, each a
document labelled good and one labelled bad: the logistic loss of the difference of their measures, by Newton steps whose gradient and
curvature are summed over all pairs in Spark. The threshold is the quantile of the learned documents' strengths at the share of bad
ones; the score is the logistic function of strength less threshold.

All labelled rows given take part, without a sample. Every document of the more frequent label is paired `PAIRS_EACH` times, with
documents of the other label dealt round-robin, so pairs grow with the labels and no label's rows meet in one group.

Measures are computed once a text, in Arrow batches, from its words, lines and bytes; they and not the texts are joined and kept.

Edge cases: a null text is measured as an empty one. Documents without an id are scored and never learned from; a document with several
labels counts once for each of its rows and labels. Labels other than 0 and 1 are left out. With rows of one label only, or none,
there is no pair: all strengths are equal and the score is the share of good rows (one half without rows). Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import workspace, written

PAIRS_EACH = 2
# Weight of the squared weights beside the mean loss of a pair; measures are in standard deviations.
RIDGE = 1e-3
MAX_STEPS, LEAST_GAIN = 25, 1e-6
WINDOW = 5

MEASURES = (
    ["words", "word_length", "long_words", "short_words", "line_words", "different_words", "commonest_word", "repeated_windows", "duplicate_lines"]
    + ["letters", "capitals", "digits", "blanks", "stops", "exclamations", "symbols", "other_marks", "high_bytes", "marked_words", "lone_marks", "sentence_words"]
)
# Kinds of ASCII bytes by what they do in prose.
_KINDS = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "blanks": b" \t\n\x0b\x0c\r", "stops": b".,;:?", "exclamations": b"!", "symbols": b"#*$%&|<>"}
_MARKED = re.compile(r"[#*$%&|<>!]+(?=\s|$)")
_LONE = re.compile(r"(?:^|\s)[^\w\s]+(?=\s|$)")


def measures(text: str | None) -> list[float]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n_bytes = max(1, int(raw.sum()))
    share = {kind: float(raw[list(members)].sum()) / n_bytes for kind, members in _KINDS.items()}
    share["high_bytes"] = float(raw[128:].sum()) / n_bytes
    share["letters"] = float(raw[65:91].sum() + raw[97:123].sum()) / n_bytes
    share["other_marks"] = max(0.0, 1 - share["letters"] - sum(share[k] for k in ("digits", "blanks", "stops", "exclamations", "symbols", "high_bytes")))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lengths = [len(w) for w in words]
    windows = max(0, len(words) - WINDOW + 1)
    different = len(set(zip(*[words[k:] for k in range(WINDOW)]))) if windows else 0
    lines = [line for line in text.split("\n") if line.strip()]
    # Shares of different words and windows fall with the length of any text; the logarithms make that a straight line.
    values = {
        "words": math.log1p(len(words)),
        "word_length": sum(lengths) / n,
        "long_words": sum(k > 15 for k in lengths) / n,
        "short_words": sum(k < 3 for k in lengths) / n,
        "line_words": math.log1p(len(words) / max(1, len(lines))),
        "different_words": math.log1p(len(counts)),
        "commonest_word": max(counts.values(), default=0) / n,
        "repeated_windows": 1 - different / windows if windows else 0.0,
        "duplicate_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "marked_words": len(_MARKED.findall(text)) / n,
        "lone_marks": len(_LONE.findall(text)) / n,
        "sentence_words": math.log1p(len(words) / (1 + float(raw[list(b".?!")].sum()))),
    } | share
    return [values[m] for m in MEASURES]


def measured(documents: DataFrame, columns: dict[str, Column], folder: str) -> DataFrame:
    """`row`, a struct of `columns`, and `x`, the measures of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([measures(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), x], names=["row", "x"])

    rows = documents.select(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("row"), "text")
    return written(rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, x array<double>"), f"{folder}/measures")


def _indexed(rows: DataFrame) -> DataFrame:
    """`index` 0, 1, ... over rows with `at`, the number of their task and of the row in it: this plus the tasks before."""
    part = F.shiftright("at", 33)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", (before - F.col("begin")).alias("shift"))
    return rows.withColumn("part", part).join(parts, "part").select("x", (F.col("at") + F.col("shift")).alias("index"))


def _pairs(good: DataFrame, bad: DataFrame, n_good: int, n_bad: int, folder: str) -> DataFrame:
    """`good` and `bad` measures of the preference pairs: each row of the larger side against PAIRS_EACH of the other, in turn."""
    good, bad = (written(rows.withColumn("at", F.monotonically_increasing_id()), f"{folder}/{name}") for rows, name in ((good, "good"), (bad, "bad")))
    many, few, n = (good, bad, n_bad) if n_good >= n_bad else (bad, good, n_good)
    names = ("good", "bad") if n_good >= n_bad else ("bad", "good")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(PAIRS_EACH - 1))).alias("round")
    dealt = _indexed(many).select(F.col("x").alias(names[0]), "index", rounds)
    # The next rounds start half a deal on, so that a row meets different rows.
    step = max(1, n // PAIRS_EACH)
    dealt = dealt.select(names[0], ((F.col("index") + F.col("round") * step) % n).alias("index"))
    return dealt.join(_indexed(few).select("index", F.col("x").alias(names[1])), "index").select("good", "bad")


def _summed(pairs: DataFrame, weights: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Loss, gradient, curvature and number of all pairs; each task adds up its own."""
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + k + k * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            good, bad = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in ("good", "bad"))
            d = (good - bad) / scale
            margin = d @ weights
            lost = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
            total += np.concatenate([[np.logaddexp(0, -margin).sum(), len(d)], -(d * lost[:, None]).sum(0), ((d * (lost * (1 - lost))[:, None]).T @ d).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "value"])

    sums = pairs.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(2 + k + k * k)
    total[sums["at"].to_numpy()] = sums["value"].to_numpy()
    return float(total[0]), total[2 : 2 + k], total[2 + k :].reshape(k, k), int(total[1])


def learn(labelled: DataFrame, folder: str) -> tuple[list[float], float]:
    """Weights of the measures and the threshold, from rows (x, quality)."""
    labelled = written(labelled.where("quality in (0, 1)").select("x", F.col("quality").cast("int").alias("quality")), f"{folder}/labelled")
    k = len(MEASURES)
    spread = [F.stddev_pop(F.col("x")[i]) for i in range(k)]
    n, n_good, *scale = labelled.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0)), *spread).first()
    n_bad = n - n_good
    if not n_good or not n_bad:
        share = (n_good + 0.5) / (n + 1) if n else 0.5
        return [0.0] * k, -math.log(share / (1 - share))
    scale = np.array([s if s and s > 1e-12 else 1.0 for s in scale])
    pairs = written(_pairs(labelled.where("quality = 1").select("x"), labelled.where("quality = 0").select("x"), n_good, n_bad, folder), f"{folder}/pairs")
    weights, loss = np.zeros(k), math.inf
    for _ in range(MAX_STEPS):
        total, gradient, curvature, n_pairs = _summed(pairs, weights, scale)
        now = total / n_pairs + RIDGE / 2 * float(weights @ weights)
        if loss - now < LEAST_GAIN:
            break
        loss = now
        weights = weights - np.linalg.solve(curvature / n_pairs + RIDGE * np.eye(k), gradient / n_pairs + RIDGE * weights)
    weights = weights / scale
    # Between the strengths on both sides of the share of bad rows.
    strengths = labelled.select(_strength(weights.tolist()).alias("s"))
    low, high = strengths.agg(F.percentile_approx("s", [n_bad / n, min(1.0, (n_bad + 1) / n)], 1_000_000)).first()[0]
    return weights.tolist(), (low + high) / 2


def _strength(weights: list[float]) -> Column:
    return F.aggregate(F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)


def score(rows: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    """`row`'s columns with score (0 to 1) and predicted (1 from one half on)."""
    value = 1 / (1 + F.exp(-(_strength(weights) - F.lit(threshold))))
    return rows.select("row.*", value.alias("score")).select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rank_quality(documents: DataFrame, labels: DataFrame, learn_from: Column, columns: dict[str, Column]) -> DataFrame:
    """`columns`, score and predicted for every document; labels count for documents whose `learn_from` holds."""
    folder = workspace(documents, "preference")
    rows = measured(documents, columns | {"_id": F.col("doc_id"), "_learn": learn_from}, folder)
    taught = rows.where(F.col("row._learn") & F.col("row._id").isNotNull()).select(F.col("row._id").alias("doc_id"), "x")
    weights, threshold = learn(taught.join(labels.select("doc_id", "quality"), "doc_id"), folder)
    return score(rows, weights, threshold).drop("_id", "_learn")
