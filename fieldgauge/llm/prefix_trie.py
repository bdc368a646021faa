"""Prefix trie of conversations: which first turns conversations share, and what sharing them would save.

Turns become 128-bit ids. Conversations are cut into bands of 64 turns, equal bands under equal prefixes are one row, and the
rows are dealt by range of (band, prefix, turn ids), so a shard holds neighbours of the trie. A shard is a padded matrix of
turn ids: lexsort orders it, change masks OR-accumulated over the columns mark where each depth's nodes start, and reduceat sums
members, children, leaves and saved tokens of every depth. Nodes on the path of a shard's first or last row may go on in the next
shard: these boundary nodes, at most 128 a shard, are recombined by their keys. What lies in later bands is added to the
nodes above through one member conversation of each band's subtree, all bands at once.

Saved tokens of a node are (members - 1) times the UTF-8 bytes of its last text.

Edge cases: null roles and texts are empty. Turns are in order of turn, nulls first, then role, then the digest of role and text; repeated
rows are repeated turns. Rows without a conversation id belong to none. Ids must be integers. A conversation may be rebuilt to no
turn at all; it is a member of the root. An empty table has no nodes. Extra columns are not read. Turns are told apart by MD5
of role and text, prefixes of 64 turns and more by two sums of 64-bit hashes of their bands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import group_key, numbered, placed, run_digests
from .tables import workspace, written

BAND = 64
SHARD_ROWS = 8192
ROOT = "0/0"
# Fixed value: the digest of nothing.
NO_IDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
ID_LENGTH = 32

_NODE = pa.schema(
    [("key", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv", pa.int64()), ("bytes", pa.int64())]
    + [(c, pa.int64()) for c in ("children", "leaves", "saved")]
    + [("continues", pa.bool_()), ("edge", pa.bool_()), ("parent_conv", pa.int64()), ("above", pa.list_(pa.string()))]
)
_NODE_DDL = (
    "key string, parent string, depth long, n_convs long, conv long, bytes long, children long, leaves long, saved long, "
    "continues boolean, edge boolean, parent_conv long, above array<string>"
)


def conversation_turns(rows: DataFrame, folder: str) -> DataFrame:
    """Ordered turns as (key, conv_id, place, said, n_bytes); texts stay behind, ids and sizes go on."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    conv = F.col("conv_id").cast("long")
    turns = rows.where("conv_id is not null").select(group_key(conv).alias("key"), conv.alias("conv_id"), "turn", role.alias("role"), said.alias("said"), F.octet_length(text).cast("long").alias("n_bytes"))
    return placed(turns, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")], f"{folder}/turns").drop("turn", "role")


def rebuilt(rows: DataFrame, folder: str, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first `head` turns of conversation `base`, then go on with their own after as many.

    Gives (conv_id) of all and (conv_id, depth, said, n_bytes) of their turns. At most `head` turns of a base are joined.
    """
    turns = conversation_turns(rows, folder)
    sizes = written(turns.groupBy("key", "conv_id").agg(F.count("*").alias("size")), f"{folder}/sizes")
    convs = sizes.select("key", "conv_id", head.alias("h"), group_key(base).alias("base"))
    bases = sizes.select(F.col("key").alias("base"), "size")
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("size", F.lit(0)))).drop("size")
    convs = written(convs, f"{folder}/convs")
    turns = written(numbered(turns, convs.select("key", "h", "taken")), f"{folder}/numbered")
    own = turns.where("index >= h").select("conv_id", (F.col("taken") + F.col("index") - F.col("h") + 1).alias("depth"), "said", "n_bytes")
    longest = convs.agg(F.max("h")).first()[0] or 0
    heads = turns.where(F.col("index") < longest).select(F.col("key").alias("base"), "index", "said", "n_bytes")
    heads = convs.where("taken > 0").join(heads, "base").where("index < h")
    heads = heads.select("conv_id", (F.col("index") + 1).alias("depth"), "said", "n_bytes")
    return convs.select("conv_id"), heads.unionByName(own)


def _bands(turns: DataFrame, folder: str) -> DataFrame:
    """(conv_id, band, prefix, ending, turns, sizes, n, continues): a conversation's turns, 64 a row. `prefix` names all turns before
    the band, `ending` all up to its end."""
    band = F.expr(f"(depth - 1) div {BAND}")
    rows = turns.groupBy("conv_id", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct("depth", "said", "n_bytes"))).alias("rows"))
    rows = rows.select("conv_id", "band", F.array_join("rows.said", "").alias("turns"), F.col("rows.n_bytes").alias("sizes"))
    ordered = Window.partitionBy("conv_id").orderBy("band")
    hashes = [F.xxhash64(F.lit(seed), "band", "turns").cast("decimal(38,0)") for seed in (1, 2)]
    name = lambda end: F.concat_ws("/", *[F.coalesce(F.sum(h).over(ordered.rowsBetween(Window.unboundedPreceding, end)).cast("decimal(38,0)"), F.lit(0)).cast("string") for h in hashes])
    rows = rows.select("*", name(-1).alias("prefix"), name(0).alias("ending"), F.lead("band").over(ordered).isNotNull().alias("continues"))
    return written(rows, f"{folder}/bands")


def node_key(prefix: Column, turns: Column, ending: Column, depth: Column) -> Column:
    """Names a node within its band: all turns before the band and those in it."""
    return F.when(depth == BAND, ending).otherwise(F.md5(F.concat(prefix, F.lit("|"), F.substring(turns, F.lit(1), depth * ID_LENGTH))))


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard; sums leave out what boundary nodes themselves add."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    shard = pa.Table.from_batches(batches)
    groups = list(zip(shard.column("band").to_pylist(), shard.column("prefix").to_pylist()))
    turns = shard.column("turns").to_pylist()
    lengths = np.array([len(t) // ID_LENGTH for t in turns])
    n_rows, width = len(turns), int(lengths.max())
    place = np.arange(width) < lengths[:, None]
    matrix = np.zeros((n_rows, width + 1), np.int64)
    number = {g: k for k, g in enumerate(sorted(set(groups)))}
    matrix[:, 0] = [number[g] for g in groups]
    ids = np.frombuffer("".join(turns).encode(), f"S{ID_LENGTH}")
    matrix[:, 1:][place] = np.unique(ids, return_inverse=True)[1] + 1
    sizes = np.zeros((n_rows, width + 1), np.int64)
    sizes[:, 1:][place] = np.concatenate([np.asarray(s) for s in shard.column("sizes").to_pylist()])

    order = np.lexsort(matrix.T[::-1])
    matrix, sizes = matrix[order], sizes[order]
    members, conv, continues = (shard.column(c).to_numpy(zero_copy_only=False)[order] for c in ("n_convs", "conv", "continues"))
    lengths, turns, groups = lengths[order], [turns[i] for i in order], [groups[i] for i in order]
    endings = shard.column("ending").to_pylist()
    endings = [endings[i] for i in order]

    # Where a column or any before it changes, a node of that depth starts, or its padding.
    started = np.ones((n_rows, width + 1), bool)
    started[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    real = matrix > 0
    real[:, 0] = False
    starts = started & real
    begins = [np.flatnonzero(started[:, d]) for d in range(width + 1)]
    count = np.zeros((n_rows, width + 1), np.int64)
    least = np.zeros((n_rows, width + 1), np.int64)
    edge = np.zeros((n_rows, width + 1), bool)
    goes_on = np.zeros((n_rows, width + 1), bool)
    for d in range(1, width + 1):
        at = begins[d]
        count[at, d] = np.add.reduceat(members, at)
        least[at, d] = np.minimum.reduceat(conv, at)
        goes_on[at, d] = np.logical_or.reduceat(continues & (lengths == d), at)
        edge[[0, at[-1]], d] = True
    edge &= starts
    inner = starts & ~edge
    children = np.zeros_like(count)
    for d in range(1, width):
        children[begins[d], d] = np.add.reduceat(inner[:, d + 1].astype(np.int64), begins[d])
    saved = np.where(inner, (count - 1) * sizes, 0)
    leaf = np.where(inner & (children == 0) & ~goes_on, 1, 0)
    below_saved, below_leaf = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (saved, leaf))

    # Keys of the nodes that start in a row; a node's parent started in this row or before.
    keys = np.empty((n_rows, width + 1), object)
    latest: list = [None] * (width + 1)
    owner = [0] * (width + 1)
    out: list[tuple] = []
    sums = {d: (dict(zip(begins[d].tolist(), np.add.reduceat(below_leaf[:, d], begins[d]).tolist())), dict(zip(begins[d].tolist(), np.add.reduceat(below_saved[:, d], begins[d]).tolist()))) for d in range(1, width + 1)}
    for i in range(n_rows):
        band, prefix = groups[i]
        own = np.flatnonzero(starts[i])
        if own.size and own[0] == 1:
            latest[0] = prefix
        for d in own.tolist():
            key = endings[i] if d == BAND else hashlib.md5(f"{prefix}|{turns[i][: ID_LENGTH * d]}".encode()).hexdigest()
            keys[i, d], latest[d], owner[d] = key, key, i
            on_edge = bool(edge[i, d])
            above = owner[d - 1]
            known = int(least[above, d - 1]) if d > 1 and not edge[above, d - 1] else None
            out.append(
                (key, latest[d - 1], BAND * band + d, int(count[i, d]), int(least[i, d]), int(sizes[i, d]), int(children[i, d]), sums[d][0][i], sums[d][1][i])
                + (bool(goes_on[i, d]), on_edge, known, latest[1 : d + 1] if on_edge else None)
            )
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODE)], schema=_NODE)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODE)], schema=_NODE)


def _recombined(nodes: DataFrame) -> DataFrame:
    """All nodes of `_shard_nodes`, those at shard boundaries made whole."""
    edges = nodes.where("edge").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "bytes", "above")],
        *[F.sum(c).alias(c) for c in ("n_convs", "children", "leaves", "saved")],
        F.min("conv").alias("conv"),
        F.max("continues").alias("continues"),
    )
    more = edges.where((F.col("depth") - 1) % BAND > 0).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    edges = edges.join(more, "key", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    own = edges.select(
        F.explode("above").alias("key"),
        ((F.col("children") == 0) & ~F.col("continues")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("gain"),
    )
    own = own.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    edges = edges.join(own, "key").withColumns({"leaves": F.col("leaves") + F.col("leaf"), "saved": F.col("saved") + F.col("gain"), "edge": F.lit(True), "parent_conv": F.lit(None).cast("long")})
    columns = ["key", "parent", "depth", "n_convs", "conv", "children", "leaves", "saved", "edge", "parent_conv"]
    return nodes.where("not edge").select(columns).unionByName(edges.select(columns))


def _with_later_bands(nodes: DataFrame, bands: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds what lies in later bands: children to the nodes at a band's end, leaves and savings to all nodes above."""
    tops = nodes.where((F.col("depth") > BAND) & ((F.col("depth") - 1) % BAND == 0)).groupBy(F.col("parent").alias("prefix"))
    tops = tops.agg(F.count("*").alias("tops"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.min("conv").alias("conv_id"))
    below = bands.join(tops, ["prefix", "conv_id"], "left").select("conv_id", "band", "prefix", "ending", "more_leaves", "more_saved")
    later = Window.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("prefix", "ending", F.sum("more_leaves").over(later).alias("more_leaves"), F.sum("more_saved").over(later).alias("more_saved"))
    below = below.where("more_leaves is not null").groupBy("prefix", "ending").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    depths = F.sequence(F.lit(1), F.lit(BAND))
    keys = F.transform(depths, lambda d: node_key(F.col("prefix"), F.col("turns"), F.col("ending"), d))
    gains = paths.where("continues").join(below, ["prefix", "ending"]).select(F.explode(keys).alias("key"), "more_leaves", "more_saved")
    gains = gains.groupBy("key").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    nodes = nodes.join(gains, "key", "left").join(tops.select(F.col("prefix").alias("key"), "tops"), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    added = {"leaves": F.col("leaves") + zero("more_leaves"), "saved": F.col("saved") + zero("more_saved"), "children": F.col("children") + zero("tops")}
    return nodes.withColumns(added).drop("more_leaves", "more_saved", "tops")


def prefix_trie(convs: DataFrame, turns: DataFrame, folder: str) -> DataFrame:
    """One row per node, the root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `convs` has each conv_id once, `turns` (conv_id, depth, said, n_bytes) with depths from 1 on.
    """
    bands = _bands(turns, folder)
    paths = bands.groupBy("band", "prefix", "ending").agg(
        *[F.first(c).alias(c) for c in ("turns", "sizes")], F.count("*").alias("n_convs"), F.min("conv_id").alias("conv"), F.max("continues").alias("continues")
    )
    paths = written(paths, f"{folder}/paths")
    n_paths, last_band = paths.agg(F.count("*"), F.max("band")).first()
    sharded = paths.repartitionByRange(-(-n_paths // SHARD_ROWS) or 1, "band", "prefix", "turns")
    nodes = written(sharded.mapInArrow(_shard_nodes, _NODE_DDL), f"{folder}/shards")
    nodes = written(_recombined(nodes), f"{folder}/nodes")
    if last_band:
        nodes = written(_with_later_bands(nodes, bands, paths), f"{folder}/whole")

    last = bands.where("not continues").select("conv_id", node_key(F.col("prefix"), F.col("turns"), F.col("ending"), F.size("sizes")).alias("key"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id", F.col("conv_id").cast("string").alias("piece"))
    ends = run_digests(ends, ["conv_id"], f"{folder}/ends", joiner=b",")

    # Members from the conversations, the rest from the nodes below: sums over two tables, not a join.
    zero = F.lit(0).cast("long")
    of_convs = convs.select(F.lit(1).cast("long").alias("n_convs"), F.col("conv_id").alias("conv"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
    of_nodes = nodes.where("depth = 1").select(zero.alias("n_convs"), F.lit(None).cast("long").alias("conv"), F.lit(1).cast("long").alias("children"), "leaves", "saved")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "children", "leaves", "saved")]
    root = of_convs.unionByName(of_nodes).agg(*sums, F.min("conv").alias("conv")).where("n_convs > 0")
    leaves = F.greatest("leaves", F.lit(1))
    root = root.select(F.lit(ROOT).alias("key"), zero.alias("depth"), "n_convs", "conv", "children", leaves.alias("leaves"), "saved", F.lit(None).cast("long").alias("parent_conv"))
    # Parents at a boundary or in the band before are looked up; all others were known in their shard.
    parents = nodes.where(F.col("edge") | (F.col("depth") % BAND == 0)).select(F.col("key").alias("parent"), F.col("conv").alias("found"))
    parents = parents.unionByName(root.select(F.col("key").alias("parent"), F.col("conv").alias("found")))
    looked_up = nodes.where("parent_conv is null").join(parents, "parent").withColumn("parent_conv", F.col("found"))
    nodes = nodes.where("parent_conv is not null").select(root.columns).unionByName(looked_up.select(root.columns)).unionByName(root)
    return nodes.join(ends, "key", "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def rebuilt_trie(rows: DataFrame, head: Column, base: Column) -> DataFrame:
    """The trie of `rebuilt` conversations; `head` and `base` are columns over conv_id."""
    folder = workspace(rows, "trie")
    convs, turns = rebuilt(rows, folder, head, base)
    return prefix_trie(convs, turns, folder)
