import random
from collections import Counter

import numpy as np
import pytest

from fieldgauge.llm.near_dedup import banding, drop_near_duplicates, least_agreement, near_duplicate_classes, signatures


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(rows, similarity=0.8):
    rows = [(i, t or "") for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, t, shingles(t)) for i, t in rows]
    for k, (i, t, a) in enumerate(bags):
        for j, u, b in bags[k + 1 :]:
            low, high = sum((a & b).values()), sum((a | b).values())
            if t == u or (high and low >= similarity * high):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def varied(seed):
    """Groups of copies, near copies and chains, documents with a shared passage, and lone ones."""
    random.seed(seed)
    say = lambda n: [f"w{random.randrange(400)}" for _ in range(n)]
    texts, passage = [], say(30)
    for group in range(12):
        base = say(random.randint(20, 150))
        for _ in range(random.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                copy[random.randrange(len(copy))] = random.choice(["new", "other", "w1"])
            texts.append(" ".join(copy))
        chain = list(base)
        for k in range(4):
            chain[(k * 17) % len(chain)] = f"c{k}"
            texts.append(" ".join(chain))
    texts += [" ".join(passage + say(25)) for _ in range(40)] + [None, "", " ", "a", "A", "a b c", "rep " * 300, "rep " * 290]
    random.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[0])]


@pytest.mark.parametrize("block", [128, 3])
def test_classes_equal_brute_force(spark, block):
    rows = varied(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicate_classes(frame, block=block).collect()
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == brute(rows)
    assert [r.class_id for r in found if r.doc_id is None] == [None]


def test_signature_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    prints = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(0, 40, 60), rng.integers(0, 40, 60)
    text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sign = signatures(text, np.concatenate([prints[a > 0], prints[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5


def test_filter_and_empty_table(documents, empty):
    kept = drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    # 8 is a near copy of 1, 3 is empty as is 2; rows without an id stay.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "4", "None", "None", "5", "6", "7", "9", "10"])
    assert near_duplicate_classes(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def planted_pairs(similarity, n=60):
    """Pairs of texts of at least a similarity, up to a tenth above it, unlike all other texts."""
    random.seed(9)
    rows = []
    while len(rows) < 2 * n:
        base = [f"p{len(rows)}x{k}" for k in range(120)]
        other = list(base)
        for k in range(0, 120, 7 if similarity < 0.6 else 25):
            other[k] = f"q{len(rows)}x{k}"
        cut = 0
        while True:
            a, b = shingles(" ".join(base)), shingles(" ".join(other))
            value = sum((a & b).values()) / sum((a | b).values())
            if value >= similarity:
                break
            other[7 * cut if similarity < 0.6 else 25 * cut] = base[7 * cut if similarity < 0.6 else 25 * cut]
            cut += 1
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.8])
def test_pairs_are_found_at_any_similarity(spark, similarity):
    rows = planted_pairs(similarity)
    found = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()
    want = brute(rows, similarity)
    classes = {r.doc_id: r.class_id for r in found}
    linked = [i for i, c in want.items() if c != i]
    assert len(linked) == 60 and sum(classes[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(classes[i] in (i, want[i]) for i in want)


def test_bands_and_agreement_follow_the_similarity():
    assert banding(0.8) == (24, 4) and banding(0.5) == (48, 2) and banding(0.1) == (96, 1)
    assert all((1 - s**rows) ** bands <= 1e-5 for s in (0.2, 0.3, 0.5, 0.6, 0.8, 0.95) for bands, rows in [banding(s)])
    assert 0.59 < least_agreement(0.8, 96) < 0.6 and least_agreement(0.5, 96) < 0.25


def test_dropping_copies_shuffles_no_document(spark):
    """Whatever size the ids of copies are taken to have, the documents stay where they are."""
    texts = [f"one text of many words, the copy {k % 40} of it, is given here" for k in range(100)]
    documents = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = drop_near_duplicates(documents, similarity=1.0)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == list(range(40))
        assert kept.where("doc_id IS NULL").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
