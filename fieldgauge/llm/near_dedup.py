"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures, banding, exact check of multiset overlap.

A document is the multiset of its five-word shingles. Signature: every shingle owns Poisson processes on dyadic
weight intervals (0,1], (1,2], (2,4], ...; a point has a time, a slot and a weight level, found by descending the
interval, and counts if the level is within the shingle's weight. A slot keeps its earliest point. Two signatures
agree in a slot with a probability equal to the weighted Jaccard similarity, sum of minima over sum of maxima.
Points later than a document's latest slot cannot matter, so work per document hardly depends on its length.

Bands of the signature make buckets. Exact copies are folded first (by digest); each other member of a bucket is
compared with the bucket's least id, and links of at least `similarity` are joined to classes. In buckets that still
hold several classes, members outside the bucket's largest class are compared with one member of it, anew in each of a few
rounds: near copies that miss one such member meet another. What is still apart is compared in blocks of fixed size, members
outside the largest class with all members of other classes, so no link between bucket mates is lost and no bucket is ever
gathered in one task. At similarity 0.8, 24 bands of 4 slots miss a pair with a probability of 3 in a million; for a lower one bands
are shorter and more.

Edge cases: null and empty texts, and texts of white space only, are equal to texts of the same bytes alone (null
counts as empty). Texts of fewer than five words are one shingle. Rows with a null id are kept and get a null class.
Rows that share an id are one document. Ties cannot occur: a class is named by its least id, which is the one kept.
Ids are whole numbers. Extra columns are not read. An empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import mix, shingle_counts, slices
from .tables import connected, workspace, written

SIMILARITY = 0.8
# Slots of a signature; a pair of the least similarity may share no bucket with at most this probability.
SLOTS, MISSED = 96, 1e-5
# Rounds against one member of the largest class, before blocks.
ROUNDS = 2
# Members of one side of a block, and shingles of them together, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
BROADCAST_IDS = 2_000_000

_STREAM = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def banding(similarity: float) -> tuple[int, int]:
    """(bands, slots each) of a signature: the longest bands that still miss a pair of that similarity with a probability of
    at most `MISSED`; at 0.8 these are 24 bands of 4."""
    for rows in (4, 3, 2):
        if (1 - similarity**rows) ** (SLOTS // rows) <= MISSED:
            return SLOTS // rows, rows
    return SLOTS, 1


def least_agreement(similarity: float, slots: int) -> float:
    """The share of agreeing slots below which a pair cannot be similar: five standard deviations under the similarity."""
    return similarity - 5 * (similarity * (1 - similarity) / slots) ** 0.5


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(text: np.ndarray, prints: np.ndarray, weights: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """BagMinHash of each text: the identities of the earliest points, (n_texts, slots), 0 where a text is empty."""
    times, points = np.full(n_texts * slots, np.inf), np.zeros(n_texts * slots, np.uint64)
    rows = times.reshape(n_texts, slots)
    # One process per shingle and dyadic interval that begins below its weight.
    parts = []
    for k in range(int(weights.max(initial=0)).bit_length() + 1):
        low, length = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        of = np.flatnonzero(weights > low)
        if not len(of):
            break
        parts.append((text[of], mix(prints[of] + np.uint64(k) * _STREAM[3]), weights[of] - low, np.full(len(of), length)))
    if not parts:
        return points.reshape(n_texts, slots)
    doc, seed, inside, length = (np.concatenate(x) for x in zip(*parts))
    time, step = np.zeros(len(doc)), 0
    with np.errstate(over="ignore"):
        while len(doc):
            step += 1
            point = mix(seed + np.uint64(step) * _STREAM[0])
            time = time - np.log(_uniform(mix(point + _STREAM[1]))) / (slots * length)
            limit = rows.max(axis=1)[doc] if len(doc) > n_texts else rows[doc].max(axis=1)
            live = time < limit
            doc, seed, inside, length, time, point = (x[live] for x in (doc, seed, inside, length, time, point))
            # The weight level of the point within the interval, by binary descent: the leading bits choose halves.
            level = np.ceil(_uniform(mix(point + _STREAM[2])) * length)
            hit = level <= inside
            at = doc[hit] * slots + (point[hit] % np.uint64(slots)).astype(np.int64)
            np.minimum.at(times, at, time[hit])
            won = times[at] == time[hit]
            points[at[won]] = point[hit][won]
    return points.reshape(n_texts, slots)


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    slots = bands * rows
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1)):
            text, prints, counts = shingle_counts(data, offsets)
            n = last - first
            points = signatures(text, prints, counts, n, slots)
            totals = np.bincount(text, counts, n).astype(np.int64)
            with np.errstate(over="ignore"):
                keys = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _STREAM[0]
                for r in range(rows):
                    keys = mix(keys + points.reshape(n, bands, rows)[:, :, r] * _STREAM[1])
            short = (points >> np.uint64(48)).astype("<u2")
            full = totals > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n),
                    batch.column(2).slice(first, n),
                    pa.array(totals),
                    pa.array([k if ok else [] for k, ok in zip(keys.view(np.int64), full)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ],
                names=["id", "digest", "size", "keys", "signature"],
            )


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints of a text's shingles; the k-th repeat of one has a fingerprint of its own."""
    for batch in batches:
        for first, last, data, offsets in slices(batch.column(1)):
            text, prints, counts = shingle_counts(data, offsets)
            repeat = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                each = mix(np.repeat(prints, counts) + repeat.astype(np.uint64) * _STREAM[2]).view(np.int64)
            ends = np.append(0, np.cumsum(np.bincount(text, counts, last - first).astype(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(each))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], names=["id", "prints"])


def _agreeing(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(len(batch), -1) for k in ("sa", "sb"))
        likely = (a == b).mean(axis=1) >= least_agreement(similarity, a.shape[1]) if len(batch) else np.zeros(0, bool)
        yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(likely))


def _likely(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, and their classes ca, cb) whose sizes and signatures allow the similarity."""
    for side in "ab":
        pairs = pairs.join(signed.select(F.col("id").alias(side), F.col("size").alias(f"n{side}"), F.col("signature").alias(f"s{side}")), side)
    pairs = pairs.where(f"least(na, nb) >= {similarity} * greatest(na, nb)").select("a", "b", "ca", "cb", "sa", "sb")
    return pairs.mapInArrow(lambda it: _agreeing(it, similarity), "a long, b long, ca long, cb long")


def _similar(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the classes of pairs whose multisets overlap enough."""
    for side in "ab":
        pairs = pairs.join(prints.select(F.col("id").alias(side), F.col("prints").alias(f"p{side}")), side)
    both = F.size(F.array_intersect("pa", "pb"))
    return pairs.where(both >= similarity * (F.size("pa") + F.size("pb") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _open_buckets(placed: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes; `outside` are those not of the largest class, `main`."""
    sizes = placed.groupBy("key", "class_id").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(
        F.max_by("class_id", F.struct("n", -F.col("class_id"))).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_outside")
    )
    rows = placed.select("key", "id", "class_id").join(main.where("n_outside > 0"), "key")
    return rows.withColumn("outside", F.col("class_id") != F.col("main"))


def _block_links(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between members of different classes in one block, one per pair of classes that proves them joined."""
    group = group.drop_duplicates(["id", "first"])
    one, two = group[group["first"]], group[~group["first"]]
    if one.empty or two.empty:
        return pd.DataFrame([], columns=["a", "b"], dtype="int64")
    found, parent = [], {c: c for c in group["class_id"]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bits = [np.frombuffer(b"".join(side["signature"]), "<u2").reshape(len(side), -1) for side in (one, two)]
    classes, prints = two["class_id"].to_numpy(), two["prints"].to_list()
    for own, own_bits, own_prints in zip(one["class_id"], bits[0], one["prints"]):
        likely = (bits[1] == own_bits).mean(axis=1) >= least_agreement(similarity, len(own_bits))
        for j in np.flatnonzero(likely & (classes != own)):
            a, b = root(own), root(classes[j])
            if a != b:
                both = len(np.intersect1d(own_prints, prints[j], assume_unique=True))
                if both >= similarity * (len(own_prints) + len(prints[j]) - both):
                    found.append((a, b))
                    parent[max(a, b)] = min(a, b)
    return pd.DataFrame(found, columns=["a", "b"])


def near_duplicate_classes(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int | None = None,
    rows: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(<doc_id>, class_id): one row per id, class_id the least id of its class. Without `bands` and `rows` they follow the similarity."""
    if bands is None or rows is None:
        bands, rows = banding(similarity)
    folder = workspace(documents, "near-dedup")
    value = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), value.alias("text"), F.unhex(F.md5(value)).alias("digest"))
    signed = texts.where("id IS NOT NULL").mapInArrow(
        lambda it: _signed(it, bands, rows), "id long, digest binary, size long, keys array<long>, signature binary"
    )
    signed = written(signed, f"{folder}/signed")

    copies = signed.groupBy("digest").agg(F.min("id").alias("first"))
    copies = written(signed.select("id", "digest").join(copies, "digest").select("id", "first"), f"{folder}/copies")
    single = copies.select(F.col("first").alias("id")).distinct()
    single = written(signed.join(single, "id", "left_semi").drop("digest"), f"{folder}/single")

    keyed = single.select("id", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("n"))
    members = keyed.join(leaders.where("leader < last").drop("last"), "key")
    members = written(members, f"{folder}/members")

    # Every member against its bucket's leader.
    half = single.select("id", "size", "signature")
    pairs = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    likely = written(_likely(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), half, similarity), f"{folder}/likely")
    prints = written(_prints_of(texts, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()), f"{folder}/prints")
    links = _similar(likely, prints, similarity)
    links = written(links.unionByName(copies.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))), f"{folder}/links")
    classes = connected(links, f"{folder}/classes")

    # Buckets that still hold several classes.
    placed = members.where("n > 2").select("key", "id").join(classes.withColumnRenamed("node", "id"), "id", "left")
    placed = written(placed.withColumn("class_id", F.coalesce("class_id", "id")), f"{folder}/placed-0")
    rest = written(_open_buckets(placed), f"{folder}/rest-0")
    if rest.isEmpty():
        final = classes
    else:
        detail = _prints_of(texts, rest.select("id").distinct()).join(half, "id")
        detail = written(detail, f"{folder}/detail")
        joins = classes.where("node <> class_id").select(F.col("class_id").alias("a"), F.col("node").alias("b"))
        # Members outside the largest class against one member of it. All buckets prefer the same ids, so that most pairs coincide.
        for k in range(1, ROUNDS + 1):
            guides = rest.where("NOT outside").groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(k))).alias("a"))
            pairs = rest.where("outside").join(guides, "key").select("a", F.col("id").alias("b"), F.col("main").alias("ca"), F.col("class_id").alias("cb")).distinct()
            found = written(_similar(_likely(pairs, detail, similarity), detail, similarity).distinct(), f"{folder}/found-{k}")
            if found.isEmpty():
                break
            joins = joins.unionByName(found)
            renamed = connected(found, f"{folder}/renamed-{k}").select(F.col("node").alias("class_id"), F.col("class_id").alias("new"))
            placed = rest.select("key", "id", "class_id").join(renamed, "class_id", "left").select("key", "id", F.coalesce("new", "class_id").alias("class_id"))
            rest = written(_open_buckets(written(placed, f"{folder}/placed-{k}")), f"{folder}/rest-{k}")

        # Members outside the largest class against all members of other classes, in blocks.
        weight = F.least(F.col("size"), F.lit(BLOCK_SHINGLES))
        sized = rest.join(detail.select("id", weight.alias("weight")), "id")
        loads = sized.groupBy("key").agg(F.sum("weight").alias("load"), F.sum(F.when(F.col("outside"), F.col("weight"))).alias("load_outside"))
        rest = rest.join(loads, "key")

        def n_chunks(n: str, load: str) -> Column:
            return F.ceil(F.greatest(F.col(n) / block, F.col(load) / BLOCK_SHINGLES)).cast("int")

        chunks = {"ca": n_chunks("n_outside", "load_outside"), "cb": n_chunks("n", "load")}

        def dealt(side: str, other: str, rows: DataFrame) -> DataFrame:
            """Each member in a chunk of its side, once per chunk of the other side."""
            own = F.pmod(F.xxhash64("id"), chunks[side].cast("long")).cast("int")
            rows = rows.select("key", "id", "class_id", own.alias(side), F.explode(F.sequence(F.lit(0), chunks[other] - 1)).alias(other))
            return rows.select("key", "ca", "cb", "id", "class_id", F.lit(side == "ca").alias("first"))

        both_sides = dealt("ca", "cb", rest.where("outside")).unionByName(dealt("cb", "ca", rest))
        more = both_sides.join(detail.drop("size"), "id").groupBy("key", "ca", "cb").applyInPandas(lambda g: _block_links(g, similarity), "a long, b long")
        more = written(more.distinct(), f"{folder}/more")
        final = connected(joins.unionByName(more), f"{folder}/final")
    named = copies.select("id").distinct().join(final.withColumnRenamed("node", "id"), "id", "left")
    named = named.select(F.col("id").alias(doc_id), F.coalesce("class_id", "id").alias("class_id"))
    lone = documents.where(F.col(doc_id).isNull()).select(F.col(doc_id).cast("long").alias(doc_id), F.lit(None).cast("long").alias("class_id"))
    return named.unionByName(lone)


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to look documents up by: broadcast while few, so that no text is shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _prints_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, prints) of the named documents."""
    return texts.join(_sent(ids), "id", "left_semi").select("id", "text").mapInArrow(_printed, "id long, prints array<long>")


def drop_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the least id of their class, with their columns."""
    classes = near_duplicate_classes(documents, doc_id, text, **options)
    gone = classes.where(F.col(doc_id) != F.col("class_id")).select(F.col(doc_id).alias("gone_id"))
    gone = _sent(written(gone, f"{workspace(documents, 'near-dedup')}/gone"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(gone, F.col(f"row.`{doc_id}`") == F.col("gone_id"), "left_anti").select("row.*")
