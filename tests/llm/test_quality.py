import random
import re
from collections import Counter

from fieldgauge.llm.quality import STOP_WORDS, keep_good, quality_report


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base_failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    counted = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    return (*counted, base_failed)


def test_counts_equal_brute_force(spark, documents):
    random.seed(1)
    alphabet = ["a", "bb", "c", "the", "|", "#x", "\n", "\n", "a b c d e", "éß", "\U0001f642", "\x0b"]
    texts = [" ".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (made, documents.select("doc_id", "text")):
        want = sorted(((r.doc_id, *brute(r.text)) for r in frame.collect()), key=repr)
        columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert sorted(map(tuple, quality_report(frame).select(columns).collect()), key=repr) == want


def kept(text, stop_words=STOP_WORDS):
    """The whole verdict, rule by rule."""
    n_words, word_chars, n_symbols, n_dup_lines, _, base_failed = brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n_lines = sum(bool(line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n"))
    forms = {f for w in stop_words for f in (w, w.capitalize(), w.upper())}
    if base_failed or not 2 <= word_chars / n_words <= 15 or n_symbols / n_words > 0.1 or (text or "").count("!") / n_words > 0.3:
        return False
    if n_words >= 50 and sum(w in forms for w in words) / n_words < 0.01:
        return False
    return not (n_lines >= 5 and n_dup_lines / n_lines > 0.3)


def test_verdicts_equal_the_rules(spark, documents):
    random.seed(2)
    makers = [lambda: random.choice(["The", "word", "und", "für"]), lambda: "x" * random.randint(1, 30), lambda: f"w{random.randrange(10**6)}", lambda: "#$%", lambda: "hey!!"]
    texts = []
    for k in range(400):
        weights = [random.random() ** 3 for _ in makers]
        words = [random.choices(makers, weights)[0]() for _ in range(random.choice([5, 9, 10, 49, 50, 80]))]
        breaks = random.choice([0, 0.05, 0.5])
        texts.append("".join(w + ("\n" if random.random() < breaks else " ") for w in words) + random.choice(["", "\nsame\nsame\nsame\nsame"]))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.doc_id, r.kept) for r in quality_report(made).collect()]
    assert found == [(i, kept(t)) for i, t in enumerate(texts)] and 20 < sum(k for _, k in found) < 380
    for frame in (documents.select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want = sorted(((r.doc_id, kept(r.text)) for r in frame.collect()), key=repr)
        assert sorted(((r.doc_id, r.kept) for r in quality_report(frame).collect()), key=repr) == want
    # A fifth language is not turned away once its words are given.
    polish = spark.createDataFrame([(1, " ".join(f"słowo{k} i" if k % 9 == 0 else f"słowo{k}" for k in range(60)))], "doc_id long, text string")
    assert [quality_report(polish, stop_words=w).first().kept for w in (STOP_WORDS, [*STOP_WORDS, "i"])] == [False, True]


def test_filter_keeps_columns_and_rows(documents, empty):
    kept = keep_good(documents)
    assert kept.columns == documents.columns
    passed = quality_report(documents).where("kept").count()
    assert kept.count() == passed
    assert keep_good(empty).count() == 0 and quality_report(empty).count() == 0


def test_plan_has_no_shuffle_and_no_python(documents):
    plan = keep_good(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
