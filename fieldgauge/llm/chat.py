"""Chat formatting of reply trees: best root-to-leaf path of every tree, written with a reversible template.

Messages name their parent. Iterative self-joins double the reach of every message's pointer: after k rounds it knows its
ancestor 2^k levels up, its depth and the score on the way, so a tree of any depth takes logarithmically many rounds. Branches
(leaves) are ranked by the score of their path; the chosen leaf's ancestors are collected by walking the same
pointers back from the largest step. Only ids and scores take part; the texts are joined once at the end.

The template: `<s>[ROLE]` text `[/ROLE]</s>` per turn. Control strings inside texts are escaped with a backslash after their first
character, and backslashes are doubled, so texts come back exactly. The loss mask is a list of spans over the
formatted text that cover assistant texts alone.

A formatted conversation is its rows in order of `turn`, one per turn, each with its spans; the rows' texts after one another are the
conversation. So a conversation of any length is spread over tasks: it is numbered by shares of ranges, joined by turn, and read
back into digests in blocks. `whole_conversations` puts short ones into one string each.

Edge cases: a null text is empty, a null role is the role `null`. Messages whose parent is null or absent are roots; a tree with
several roots chooses among all their paths. Rows without a conversation id form one conversation, which no id shares. Equal scores prefer the longer path, then the
least leaf. Repeated rows of a turn follow one another (`as_chain` orders them by role and text). Messages on a
parent cycle have no root and appear in no path. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import group_id, group_key, numbered, placed, run_digests
from .tables import workspace, written

# The strings that mean something in a formatted conversation.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[USER]", "[/USER]", "[ASSISTANT]", "[/ASSISTANT]", "[SYSTEM]", "[/SYSTEM]", "[ROLE ", "[/ROLE]")
NAMED = ("user", "assistant", "system")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(r"<s>\[(?:(USER|ASSISTANT|SYSTEM)\]|ROLE ((?:[^\]\\]|\\.)*)\])(.*?)\[/(?:USER|ASSISTANT|SYSTEM|ROLE)\]</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        name = role.upper() if role in NAMED else None
        head = f"<s>[{name}]" if name else "<s>[ROLE " + re.sub(r"([\\\]])", r"\\\1", role) + "]"
        body, tail = escape(text), f"[/{name or 'ROLE'}]</s>"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(m[1].lower() if m[1] else re.sub(r"\\(.)", r"\1", m[2], flags=re.S), unescape(m[3])) for m in _TURN.finditer(formatted)]


def masked_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def as_chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as a reply tree: every message answers the one before. Columns tree, node, parent, score, role, text.

    Rows are numbered by range of conversation and turn, so a conversation is no group; a message's score is 1, so the whole
    chain is the best path.
    """
    rows = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("null")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    folder = workspace(rows, "chain")
    keyed = rows.withColumn("key", group_key(F.col("tree")))
    rows = numbered(placed(keyed, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], f"{folder}/rows"))
    rows = rows.withColumn("node", F.col("index") + 1)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def best_paths(messages: DataFrame, folder: str) -> DataFrame:
    """(tree, node, depth) of the messages on each tree's best path, root first at depth 0; trees by their keys."""
    ids = messages.select(group_key(F.col("tree")).alias("tree"), "node", "parent", "score")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    # `up` is null once a root is reached; steps and total then are final.
    hops = ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"), F.col("score").alias("total")
    )
    levels, step = [written(hops, f"{folder}/hops-0")], 0
    size = levels[0].count()
    final = levels[0].where("up IS NULL")
    while (1 << step) <= size:
        moving = levels[-1].where("up IS NOT NULL")
        if moving.isEmpty():
            break
        step += 1
        # Only messages below a root go on; what they point at may have reached it in any round before.
        known = moving.select("tree", "node", "up", "steps", "total").unionByName(final)
        above = known.select("tree", F.col("node").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"), F.col("total").alias("gain"))
        joined = moving.join(above, ["tree", "up"], "left")
        hops = joined.select(
            "tree",
            "node",
            F.col("top").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"),
        )
        levels.append(written(hops, f"{folder}/hops-{step}"))
        final = final.unionByName(levels[-1].where("up IS NULL"))
    leaves = final.join(ids.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    order = F.struct(F.col("total"), F.col("steps"), -F.col("node"))
    chosen = leaves.groupBy("tree").agg(F.max_by(F.struct("node", "steps"), order).alias("leaf"))
    path = written(chosen.select("tree", F.col("leaf.node").alias("node"), F.col("leaf.steps").alias("depth")), f"{folder}/path-0")
    # From the chosen leaves up: messages that are reached by the largest step, then by half of it, and so on. Sums of
    # different steps differ, so no message is reached twice unless its rows are repeated.
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].where("up IS NOT NULL").select("tree", "node", "up")
        more = path.join(jump, ["tree", "node"]).select("tree", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        path = path.unionByName(written(more, f"{folder}/path-{len(levels) - k}"))
    return path.distinct()


def format_conversations(messages: DataFrame) -> DataFrame:
    """(tree, turn, role, formatted, spans): the turns of every tree's best path in the template, a row each, and where in
    the row's text the loss is taken. Turns count from 0; repeated rows of a message share theirs."""
    folder = workspace(messages, "chat")
    messages = written(messages, f"{folder}/messages")
    path = best_paths(messages, folder)
    keyed = messages.select(group_key(F.col("tree")).alias("key"), "tree", "node", "role", "text")
    turns = keyed.join(path.withColumnRenamed("tree", "key"), ["key", "node"]).select("tree", F.col("depth").alias("turn"), "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [format_turns([turn]) for turn in zip(frame["role"], frame["text"])]
            spans = [[{"start": a, "end": b} for a, b in spans] for _, spans in made]
            yield pd.DataFrame({"tree": frame["tree"], "turn": frame["turn"], "role": frame["role"], "formatted": [m[0] for m in made], "spans": spans})

    kind = turns.schema["tree"].dataType.simpleString()
    out = turns.mapInPandas(run, f"tree {kind}, turn long, role string, formatted string, spans array<struct<start:int,end:int>>")
    return written(out, f"{folder}/formatted")


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, formatted): a conversation as one string, for those that are known to be short."""
    turns = formatted.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "formatted"))).alias("turns"))
    return turns.select("tree", F.size("turns").alias("n_turns"), F.array_join("turns.formatted", "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted rows: tree, n_turns, digests of the turns and of the masked text, in order."""
    folder = workspace(formatted, "chat-read")
    kind = formatted.schema["tree"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            turns = [parse_turns(f) for f in frame["formatted"]]
            masked = [masked_text(f, [(s["start"], s["end"]) for s in spans]) for f, spans in zip(frame["formatted"], frame["spans"])]
            said = ["".join(f"{role}\n{text}\n" for role, text in t) for t in turns]
            sizes = {"n_turns": [len(t) for t in turns], "loss_chars": [len(m) for m in masked], "formatted_chars": [len(f) for f in frame["formatted"]]}
            yield pd.DataFrame({"key": frame["key"], "turn": frame["turn"], "said": said, "masked": masked} | sizes)

    rows = formatted.select(group_key(F.col("tree")).alias("key"), "turn", "formatted", "spans")
    rows = rows.mapInPandas(run, "key string, turn long, said string, masked string, n_turns long, loss_chars long, formatted_chars long")
    rows = written(rows, f"{folder}/parsed")
    sums = rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars")])
    order = ["turn", "said"]
    said = run_digests(rows.select("key", *order, F.col("said").alias("piece")), order, f"{folder}/said").withColumnRenamed("sha256", "turns_sha256")
    masked = rows.where("loss_chars > 0").select("key", *order, F.col("masked").alias("piece"))
    masked = run_digests(masked, order, f"{folder}/masked").withColumnRenamed("sha256", "loss_sha256")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = sums.join(said, "key").join(masked, "key", "left").withColumn("loss_sha256", F.coalesce("loss_sha256", nothing))
    return out.select(group_id(F.col("key"), kind).alias("tree"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
