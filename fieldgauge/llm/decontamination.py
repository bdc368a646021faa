"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is 13 consecutive words of an item, or the whole of a shorter item. It is contained in a document only if
each of its five-word shingles is, so one necessary shingle per window is joined: the rarest one over all documents
(the prefix of a full containment join). A match at a position gives the place the window would have; it must lie
inside the document (length and positional bounds), and there the words are compared one by one.

Two passes over the documents explode positions and hash them inside one stage. The first counts the benchmark's shingles, combined
before the shuffle, so that only their counts leave it; they rank the shingles of each window. The second probes the prefix
shingles alone; what leaves it is a row per document and the occurrences of prefixes, with the few words around each. The
probed hashes are broadcast while there are at most `broadcast_rows` of them; beyond that Spark shuffles positions by hash.

Edge cases: null and empty texts have no words and no hits. Empty items have no window. Items of fewer than five
words are looked up by shingles of their own length. Rows that repeat both id and text count once; a null id is a
document of its own. Equal windows of several items count once as hits, and each item is listed. Extra columns are
not read. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lower_ascii, split_words
from .tables import workspace, written

WINDOW, SHINGLE = 13, 5
# Fixed value: everything ASCII but digits and letters separates words; texts are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A broadcast row holds a hash: about 50 bytes in the hash table.
BROADCAST_ROWS = 1_000_000


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def _shingle(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + k) for k in range(length)])


def _windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, window): the windows of every item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), item_words(F.col(text)).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(1)))
    return items.select("item", "words", F.explode(starts).alias("start")).select(
        "item", F.slice("words", F.col("start"), WINDOW).alias("window")
    )


def _window_shingles(windows: DataFrame) -> DataFrame:
    """(window, offset, length, hash) of each different window's shingles."""
    distinct = windows.select("window").distinct().withColumn("length", F.least(F.size("window"), F.lit(SHINGLE)))
    offsets = F.sequence(F.lit(0), F.size("window") - F.col("length"))
    rows = distinct.select("window", "length", F.explode(offsets).alias("offset"))
    hashed = F.coalesce(*[F.when(F.col("length") == k, _shingle(F.col("window"), F.col("offset"), k)) for k in range(1, SHINGLE + 1)])
    return rows.withColumn("hash", hashed)


def _positions(documents: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per shingle of a document, plus one at position -1 that stands for the document."""
    n = F.size("words")
    rows = documents.withColumn("at", F.explode(F.sequence(F.lit(-1), n - 1)))
    words, at = F.col("words"), F.col("at")
    if len(lengths) == 1:
        k = lengths[0]
        return rows.where((at < 0) | (at + k <= n)).withColumn("hash", F.when(at >= 0, _shingle(words, at, k)))
    hashes = [F.when((at >= 0) & (at + k <= n), _shingle(words, at, k)) for k in lengths]
    return rows.withColumn("hash", F.explode(F.when(at < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array_compact(F.array(*hashes)))))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per document: its id, n_words, n_hit, the benchmark items found, and the hit spans (start, length).

    Columns: <doc_id>, text_hash, n_words, n_hit, items (sorted strings), spans.
    """
    folder = workspace(documents, "decontamination")
    # Benchmark tables are written once: both passes read them, and their sizes decide the joins.
    windows = written(_windows(benchmark, item_id, item_text), f"{folder}/windows")
    shingles = written(_window_shingles(windows), f"{folder}/shingles")
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect()) or [SHINGLE]
    small = shingles.count() <= broadcast_rows
    bounded = F.broadcast if small else lambda frame: frame

    value = F.col("value")
    worded = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("value")).select(
        "id", F.xxhash64(value).alias("text_hash"), item_words(value).alias("words")
    )
    key = ["id", "text_hash"]
    # Rarity of a shingle: its occurrences in all documents. The rarest one of a window is its prefix.
    known = bounded(shingles.select("hash").distinct())
    rarity = _positions(worded, lengths).join(known, "hash").groupBy("hash").count()
    ranked = shingles.join(rarity, "hash", "left").select("window", "offset", "hash", F.coalesce("count", F.lit(0)).alias("count"))
    first = F.min_by(F.struct("hash", "offset"), F.struct("count", "offset"))
    prefixes = ranked.groupBy("window").agg(first.alias("p")).select("window", F.col("p.hash").alias("hash"), F.col("p.offset").alias("offset"))
    prefixes = written(prefixes, f"{folder}/prefixes")
    # Every occurrence of a prefix, with the words around it that any of its windows can need, and a row per document.
    probed = bounded(prefixes.select("hash").distinct().withColumn("known", F.lit(True)))
    around = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    found = _positions(worded, lengths).join(probed, "hash", "left").where("at < 0 OR known")
    found = found.select(
        *key,
        F.size("words").alias("n_words"),
        "at",
        "hash",
        F.when(F.col("at") >= 0, around).alias("from"),
        F.when(F.col("at") >= 0, F.slice("words", around + 1, 2 * WINDOW)).alias("near"),
    )
    found = written(found, f"{folder}/found")

    start, length = F.col("at") - F.col("offset"), F.size("window")
    placed = (start >= 0) & (start + length <= F.col("n_words"))
    exact = F.slice("near", start - F.col("from") + 1, length) == F.col("window")
    inside = found.where("at >= 0").join(prefixes, "hash").where(placed).where(exact)
    inside = inside.select(*key, start.alias("start"), length.alias("length"), "window")
    inside = written(inside, f"{folder}/hits")
    spans = inside.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    items = inside.select(*key, "window").distinct().join(windows.distinct(), "window")
    items = items.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])
    base = found.where("at < 0").select(*key, "n_words").distinct()
    out = base.join(spans, same(base, spans), "left").select(base["id"], base["text_hash"], "n_words", "spans")
    out = out.join(items, same(out, items), "left").select(out["id"], out["text_hash"], "n_words", "spans", "items")
    # Spans are in order of their starts: each adds what reaches past the ones before.
    seen = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    reach = lambda s: s["start"] + s["length"]
    union = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")),
        seen,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], reach(s)).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), reach(s) - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return out.select(
        F.col("id").alias(doc_id),
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        union.cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
    )


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one hit word, and hits make up a twentieth of the document."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    judged = contamination(documents, benchmark, doc_id, text, **options)
    bad = judged.where(is_contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col(doc_id).alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    match = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce(F.col(f"row.`{text}`"), F.lit(""))) == F.col("bad_hash"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(bad, match, "left_anti").select("row.*")

