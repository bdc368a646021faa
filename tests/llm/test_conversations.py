"""Conversation repair and the prefix trie against plain searches, chunks and shards of few rows included."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import prefix_trie, repair, runs

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def shown(value):
    return " " if value is None else str(value)


def cheapest(rows):
    """The report of one conversation by a best-first search over (cost, audit)."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACES)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest
        steps = [(3, "I", i, role, (f"{role}:",)) for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((4, "D", i + 1, None, ()))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                steps.append((extra, "K", i + 1, role, (f"{role}:{text}",)))
                steps += [(3 + extra, "R", i + 1, new, (f"{new}:{text}",)) for new in ("user", "assistant")]
        for more, letter, j, role, line in steps:
            after = state if role is None else role[:1]
            if role is None or (state, after) in FOLLOWS:
                heapq.heappush(heap, (cost + more, audit + letter, j, after, lines + line))


def repaired(rows):
    conversations = {row[0]: [] for row in rows}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else shown(role), shown(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        conversations[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    order = lambda row: (row[0] is not None, row[0] or 0, row[1], row[2])
    return [(conv, *cheapest(sorted(turns, key=order))) for conv, turns in conversations.items()]


def trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    said = {conv: [(role, text) for _, _, role, _, text in sorted(t)] for conv, t in turns.items()}
    nodes, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for conv in said:
        h, base = zlib.crc32(str(conv).encode()) % 9, int(conv / 5) * 5
        path = tuple(said.get(base, [])[:h] + said[conv][h:])
        ends[path].append(conv)
        for depth in range(len(path) + 1):
            nodes[path[:depth]].append(conv)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        if path:
            children[path[:-1]].append(path)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(ends[p])) for p, m in nodes.items()
    ]


def awkward(seed):
    """Nulls in every column, repeated turns and rows, unknown and empty roles, blank texts."""
    pick = random.Random(seed)
    texts = ["Hi.", "Hi.", "ok", " ", "", "yes!", "what? ", "a.b", None, "Done.\n", "é\U0001f642."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [
        (conv, pick.choice([t, t, t, t + 1, None]), pick.choice(roles), pick.choice(texts))
        for conv in [*range(-8, 30), None]
        for t in range(pick.randint(1, 9))
    ]
    return rows + rows[:5] + [(77, None, None, None)]


def long_rows():
    """Conversations of one to four bands that part at, before and behind the ends of bands."""
    pick = random.Random(3)
    return [
        (conv, t, "user" if t % 2 == 0 else "assistant", "x." if t < pick.choice([60, 64, 65, 128, 140]) else f"{pick.randint(0, 1)}")
        for conv in range(25)
        for t in range(pick.choice([3, 130, 64, 72, 128, 200]))
    ]


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def trie_of(frame):
    return collected(prefix_trie.rebuilt_trie(frame, F.crc32(F.col("conv_id").cast("string")) % 9, F.col("conv_id") - F.col("conv_id") % 5))


@pytest.mark.parametrize("chunk_bits", [12, 1])
def test_repair_equals_a_search(spark, monkeypatch, chunk_bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", chunk_bits)
    rows = awkward(1) + ([row for row in long_rows() if row[0] < 4] if chunk_bits == 1 else [])
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "place": F.lit(1), "kind": F.lit(None)})
    assert collected(repair.repair(repair.damaged(frame), frame)) == sorted(repaired(rows), key=repr)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty, empty).collect() == []
    gone = repair.repair(empty, spark.createDataFrame([(5,), (None,)], "conv_id long"))
    assert collected(gone) == [(5, 0, 0, 0, 0, 0, 0, "", repair.NO_TEXT), (None, 0, 0, 0, 0, 0, 0, "", repair.NO_TEXT)]


def test_least_weights_compare_cost_before_audit():
    # A system message alone: deleting it (4) is cheaper than two insertions behind it.
    assert repair.least_weights([0])[0] == (4, "D")
    assert repair.least_weights([0])[1] == (0, "K")
    # u u a: inserting an answer (3) and changing either role (3 + more) differ in cost, not in letters.
    assert repair.least_weights([1, 1, 2])[3] == (3, "KIKK")
    # Two user messages: rerole the second or insert twice; D < I < K < R decides among equals.
    assert repair.least_weights([1, 1])[3] == (3, "KR")
    assert repair.packed("DIKR") == 0o1234 and repair.unpacked(0o123400, 6) == "DIKR"


@pytest.mark.parametrize("shard_rows", [8192, 5])
@pytest.mark.parametrize("rows", [awkward(2), long_rows()], ids=["awkward", "long"])
def test_trie_equals_nested_prefixes(spark, monkeypatch, rows, shard_rows):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "depth": F.lit(1), "band": F.lit(None)})
    assert trie_of(frame) == sorted(trie(rows), key=repr)


def test_trie_of_nothing(spark):
    assert trie_of(spark.createDataFrame([], SCHEMA)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_a_long_run_is_digested_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_BYTES", 64)
    rows = [("a", i, f"piece {i}") for i in range(300)] + [("b", 1, "one"), ("c", 1, "x"), ("c", 2, "")]
    frame = spark.createDataFrame(rows, "key string, at long, piece string").repartition(7)
    found = dict(collected(runs.run_digests(frame, ["at"], str(tmp_path / "blocks"), joiner=b",")))
    want = {k: hashlib.sha256(",".join(p for key, _, p in rows if key == k).encode()).hexdigest() for k in "abc"}
    assert found == want
    # Nothing but blocks of a bounded size is kept of the long run, by as many tasks as its range was dealt to.
    blocks = spark.read.parquet(str(tmp_path / "blocks")).where("key = 'a' and block is not null")
    assert blocks.count() > 20 and blocks.agg(F.max(F.length("block"))).first()[0] < 128


def test_numbers_of_a_key_that_spans_tasks(spark, tmp_path):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("key"), (-F.col("id")).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = runs.numbered(runs.placed(rows, [F.col("at")], str(tmp_path / "placed")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = table.where("key = 'hot'").orderBy("at").select("index").collect()
    assert [r[0] for r in hot] == list(range(900))
    assert table.where("key = 'hot'").select(F.shiftright("place", runs.PART_BITS).alias("part")).distinct().count() > 1
