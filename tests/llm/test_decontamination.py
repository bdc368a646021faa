import random
import re

import pytest

from fieldgauge.llm.decontamination import contamination, drop_contaminated, is_contaminated


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            w = words_of(item_text)
            n = min(13, len(w))
            for s in range(max(1, len(w) - 12)) if w else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[s : s + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(item))
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_equals_brute_force(spark, broadcast_rows):
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(12)] + ["The", "Été"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(k, say(random.choice([2, 3, 5, 12, 13, 14, 30]))) for k in range(25)] + [(90, None), (91, ""), (92, "W1!"), (10, "w1 w2")]
    docs = []
    for k in range(80):
        middle = random.choice(items)[1] or ""
        docs.append((k, f"{say(random.randint(0, 30))} {middle.upper() if k % 3 else middle}. {say(random.randint(0, 9))}"))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    found = contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows
    )
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=repr)
    assert got == brute(docs, items)


def test_filter_and_empty_tables(spark, documents, empty):
    bench = spark.createDataFrame([(1, "The quick brown fox and the lazy dog went to the river that was in the valley")], "item_id long, text string")
    kept = drop_contaminated(documents, bench)
    assert kept.columns == documents.columns
    gone = {r.doc_id for r in documents.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {1, 8}
    assert drop_contaminated(documents, bench.where("false")).count() == documents.count()
    assert contamination(empty, bench).count() == 0
    judged = contamination(documents, bench)
    assert judged.where(is_contaminated(judged["n_words"], judged["n_hit"])).count() == 2
