"""Conversation structure repair: the cheapest edits that make a conversation follow `(s?(ua)+)?`, with a written audit.

Every conversation is a DAG of (row, state); its edges keep, rerole, delete or insert a message. A path's weight is one integer: the
high digits carry its cost, the low digits the initials of its edits, one digit each at a fixed width, the first edit
highest and zeros behind the last, so the ordinary minimum of integers picks the least cost and, among equals, the least audit in ASCII order. A cheaper
path's digits never reach the cost, and equal costs of the same rows are never prefixes of each other (only an insertion
adds a letter, and it costs), so the minimum over parts of a conversation is the minimum over the whole.

A conversation is cut into chunks of at most 4,096 rows. Each chunk, on its own, gives the least weights between all pairs of states; one
pass over a conversation's chunks, last first, chooses the states at their borders and keeps one weight a state, whose size is that of the audit. Texts
are moved twice, by range: to be ordered and to be digested in blocks. The chunks hold codes of rows only.

States: 0 nothing yet, 1 after a system message, 2 after a user's, 3 after an assistant's; 0 and 3 may end.

Edge cases: null roles and texts are one space; rows are in order of turn, nulls first, then role and text, then as read. Equal rows are
repeats of the first. Rows of a null conversation id are one conversation. A role's initial is its first character, so an empty role
has none and can only be changed or deleted. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import group_id, group_key, placed, run_digests
from .tables import workspace, written

# Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# The edits' initials in ASCII order; a letter's digit is its place from 1, 0 stands behind the end.
LETTERS = "DIKR"
# The white space that does not count as content.
BLANKS = " \t\n\x0b\x0c\r"
NO_TEXT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
CHUNK_BITS = 12
# Short conversations repeat each other's codes; a worker keeps so many answers, of at most so many rows.
SEEN, SEEN_ROWS = 1 << 13, 12

DIGIT_BITS = 3
_D, _I, _K, _R = (LETTERS.index(c) + 1 for c in "DIKR")
_TO_DIGITS, _TO_LETTERS = str.maketrans(LETTERS, "1234"), str.maketrans("1234", LETTERS)
STATES = 4
# What a user's and an assistant's message lead to from each state, and a system message from the first; -1 where it may not stand.
AFTER = {"u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "s": (1, -1, -1, -1)}
# Edits behind the last row that bring a state to an end: (cost, audit, roles added).
ENDS = {0: (0, "", ()), 1: (2 * INSERT, "II", ("user", "assistant")), 2: (INSERT, "I", ("assistant",)), 3: (0, "", ())}
INITIALS = "sua"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one of five faults, or none, chosen by the CRC of conversation and turn; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))).alias("crc"))
    rows = rows.withColumn("fault", F.col("crc") % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired conversation's digest.

    `conversations` adds ids (column conv_id) that may have no rows.
    """
    folder = workspace(rows, "repair")
    kind = rows.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    keyed = rows.select(group_key(F.col("conv_id")).alias("key"), "turn", space("role").alias("role"), space("text").alias("text"))
    table = placed(keyed, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], f"{folder}/rows")
    chunks = _chunks(table, folder)
    folded = written(_folded(chunks), f"{folder}/folded")
    lines = _lines(table, _edits(chunks, folded))
    digests = run_digests(lines, ["place", "kind"], f"{folder}/lines", _repaired_lines, b"\n", 1)
    gaps = table.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    found = folded.where("audit is not null").select("key", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    found = found.join(gaps, "key", "left").join(digests, "key", "left")
    if conversations is not None:
        found = conversations.select(group_key(F.col("conv_id")).alias("key")).distinct().join(found, "key", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        group_id(F.col("key"), kind).alias("conv_id"),
        *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(NO_TEXT)).alias("repaired_sha256"),
    )


def _chunks(table: DataFrame, folder: str) -> DataFrame:
    """Least weights between the states of every chunk, with its rows' codes and counts."""
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    coded = table.select(
        "key",
        "place",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("said"),
        _initial_code(F.substring("role", 1, 1)).alias("initial"),
        (text == "").alias("blank"),
        (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    coded = written(coded, f"{folder}/codes")
    repeats = coded.groupBy("key", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), 1).when(F.col("place") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0)
    coded = coded.join(repeats, ["key", "said"], "left").select("key", "place", (F.col("initial") + 4 * fault).alias("code"))
    gathered = coded.groupBy("key", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    gathered = gathered.select("key", "chunk", F.col("rows.place").alias("places"), F.col("rows.code").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            least = [seen_weights(tuple(c)) if len(c) <= SEEN_ROWS else least_weights(c) for c in codes]
            made = [
                pa.array([[cost for cost, _ in m] for m in least], pa.list_(pa.int64())),
                pa.array([[audit for _, audit in m] for m in least], pa.list_(pa.string())),
                pa.array([sum(_illegal(a % 4, b % 4) for a, b in zip(c, c[1:])) for c in codes], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "costs", "audits", "illegal"])

    schema = "key string, chunk long, places array<long>, codes array<int>, costs array<long>, audits array<string>, illegal long"
    return written(gathered.mapInArrow(run, schema), f"{folder}/chunks")


def _initial_code(initial: Column) -> Column:
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def _illegal(first: int, second: int) -> bool:
    """Whether two neighbouring initials (as codes) are none of su, ua, au."""
    return (first, second) not in ((0, 1), (1, 2), (2, 1))


def least_weights(codes: Sequence[int]) -> list[tuple[int | None, str | None]]:
    """(cost, audit) of the best edits of the rows between each pair of states, at 4 * from + to; (None, None) where there are none."""
    width = 3 * len(codes)
    bits = DIGIT_BITS * width
    mask, top = (1 << bits) - 1, bits - DIGIT_BITS
    nowhere = 1 << (bits + 48)

    def put(digit: int, cost: int, weight: int) -> int:
        """The weight with an edit before it: its digit goes on top, the others move down into the zeros."""
        return (((weight >> bits) + cost) << bits) | (digit << top) | ((weight & mask) >> DIGIT_BITS)

    out: list[tuple[int | None, str | None]] = [(None, None)] * (STATES * STATES)
    for target in range(STATES):
        least = [nowhere] * STATES
        least[target] = 0
        for code in reversed(codes):
            initial, fault = code % 4, code // 4
            extra = TRUNCATED if fault == 3 else 0
            before = []
            for state in range(STATES):
                best = put(_D, DELETE, least[state])
                if fault not in (1, 2):
                    for role in "ua":
                        if (after := AFTER[role][state]) >= 0:
                            best = min(best, put(_R, REROLE + extra, least[after]))
                    if initial < 3 and (after := AFTER[INITIALS[initial]][state]) >= 0:
                        best = min(best, put(_K, extra, least[after]))
                before.append(best)
            # At most two insertions in a row: a third would come back to a state at a higher cost.
            once = [put(_I, INSERT, before[_inserted(state)]) for state in range(STATES)]
            first = [min(a, b) for a, b in zip(before, once)]
            least = [min(before[state], put(_I, INSERT, first[_inserted(state)])) for state in range(STATES)]
        for state, weight in enumerate(least):
            if weight < nowhere:
                out[STATES * state + target] = weight >> bits, unpacked(weight & mask, width)
    return out


@lru_cache(SEEN)
def seen_weights(codes: tuple[int, ...]) -> list[tuple[int | None, str | None]]:
    return least_weights(codes)


def _inserted(state: int) -> int:
    """The state after an inserted message: an assistant's after a user's, else a user's."""
    return 3 if state == 2 else 2


def unpacked(digits: int, width: int) -> str:
    return format(digits, "o").zfill(width).rstrip("0").translate(_TO_LETTERS) if digits else ""


def packed(audit: str) -> int:
    return int(audit.translate(_TO_DIGITS), 8) if audit else 0


def _folded(chunks: DataFrame) -> DataFrame:
    """Per conversation its sums and audit, and per chunk the states it is entered and left in."""
    names = ["key", "chunk", "enter", "leave", "cost", "audit", "blank", "duplicate", "truncated", "illegal"]
    types = pa.schema([(n, pa.string() if n in ("key", "audit") else pa.int64()) for n in names])

    def end(key, state):
        weights, width, steps, sums, chunk_ids = state["weights"], state["width"], state["steps"], state["sums"], state["chunks"]
        bits = DIGIT_BITS * width
        rows = [(key, None, None, None, weights[0] >> bits, unpacked(weights[0] & ((1 << bits) - 1), width), *sums)]
        at = 0
        for chunk, step in zip(reversed(chunk_ids), reversed(steps)):
            rows.append((key, chunk, at, step[at], *[None] * 6))
            at = step[at]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    if key is not None:
                        out += end(key, state)
                    key = row["key"]
                    weights = [(ENDS[s][0] << DIGIT_BITS * 2) | (packed(ENDS[s][1]) << DIGIT_BITS * (2 - len(ENDS[s][1]))) for s in range(STATES)]
                    state = {"weights": weights, "width": 2, "steps": [], "sums": [0, 0, 0, 0], "chunks": [], "next": None}
                _fold(state, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*end(key, state)), types)], schema=types)

    dealt = chunks.drop("places").repartition("key").sortWithinPartitions("key", F.col("chunk").desc())
    return dealt.mapInArrow(run, ", ".join(f"{n} {'string' if n in ('key', 'audit') else 'long'}" for n in names))


def _fold(state: dict, row: dict) -> None:
    """Put a chunk before what follows it in its conversation."""
    width, codes = state["width"], row["codes"]
    own = 3 * len(codes)
    bits, both = DIGIT_BITS * width, DIGIT_BITS * (width + own)
    mask = (1 << bits) - 1
    weights, step = [], []
    for s in range(STATES):
        best, chosen = None, 0
        for t in range(STATES):
            cost, audit = row["costs"][STATES * s + t], row["audits"][STATES * s + t]
            if cost is None:
                continue
            after, free = state["weights"][t], own - len(audit)
            weight = ((cost + (after >> bits)) << both) | (packed(audit) << (bits + DIGIT_BITS * free)) | ((after & mask) << (DIGIT_BITS * free))
            if best is None or weight < best:
                best, chosen = weight, t
        weights.append(best)
        step.append(chosen)
    state["weights"], state["width"] = weights, width + own
    state["steps"].append(step)
    state["chunks"].append(row["chunk"])
    faults = [c // 4 for c in codes]
    illegal = row["illegal"] + (state["next"] is not None and _illegal(codes[-1] % 4, state["next"]))
    state["next"] = codes[0] % 4
    state["sums"] = [a + b for a, b in zip(state["sums"], (faults.count(1), faults.count(2), faults.count(3), illegal))]


def row_edits(codes: list[int], audit: str, state: int) -> tuple[list[tuple[list[str], str | None]], int]:
    """Per row the roles inserted before it and what becomes of it (None: deleted, "": kept, else its new role); the last state."""
    out: list[tuple[list[str], str | None]] = []
    inserted: list[str] = []
    rows = iter(codes)
    for letter in audit:
        if letter == "I":
            state = _inserted(state)
            inserted.append("assistant" if state == 3 else "user")
            continue
        code, becomes = next(rows), None
        if letter == "K":
            state, becomes = AFTER[INITIALS[code % 4]][state], ""
        elif letter == "R":
            state = _inserted(state)
            becomes = "assistant" if state == 3 else "user"
        out.append((inserted, becomes))
        inserted = []
    return out, state


def _edits(chunks: DataFrame, folded: DataFrame) -> DataFrame:
    """(key, place, kind, added, becomes) for every row, and behind a conversation's last row where messages are added there."""
    chosen = folded.where("chunk is not null").select("key", "chunk", "enter", "leave")
    last = chosen.groupBy("key").agg(F.max("chunk").alias("last"))
    picked = chunks.join(chosen, ["key", "chunk"]).join(last, "key")
    picked = picked.select("key", "places", "codes", "enter", "leave", F.element_at("audits", (F.col("enter") * STATES + F.col("leave") + 1).cast("int")).alias("audit"), (F.col("chunk") == F.col("last")).alias("ends"))
    types = pa.schema([("key", pa.string()), ("place", pa.int64()), ("kind", pa.int32()), ("added", pa.list_(pa.string())), ("becomes", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                edits, state = row_edits(row["codes"], row["audit"], row["enter"])
                out += [(row["key"], place, 0, added, becomes) for place, (added, becomes) in zip(row["places"], edits)]
                if row["ends"] and ENDS[state][2]:
                    out.append((row["key"], row["places"][-1], 2, list(ENDS[state][2]), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    return picked.mapInArrow(run, "key string, place long, kind int, added array<string>, becomes string")


def _lines(table: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and rows side by side: kind 0 an edit, 1 the row it is of, 2 what comes behind the last row."""
    rows = table.select("key", "place", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("added"), F.lit(None).cast("string").alias("becomes"), "role", "text")
    return edits.withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}).unionByName(rows)


def _repaired_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Key and `role:text` of the repaired messages of sorted `_lines`."""
    becomes: str | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "kind", "added", "becomes", "role", "text")]
        for key, kind, added, change, role, text in zip(*columns):
            if kind == 1:
                if becomes is not None:
                    yield key, f"{becomes or role}:{text}".encode()
                continue
            for new in added:
                yield key, f"{new}:".encode()
            becomes = change
