import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldgauge.llm import class_lm, language_id, pieces, token_counts

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, PIECES = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=MODEL)
ALPHABET = [*"aabcdeth inn   \n\té好ö-=#.0123456789'sve<|>\U0001f642AB\u2003", "<|endoftext|>", " the", "'ll", "  ", "</s>", "and of "]


def random_texts(n, longest=40, seed=7):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, longest))) for _ in range(n)]


def test_pieces_equal_the_library_and_come_back():
    vocabulary, library = pieces.Vocabulary.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*random_texts(3000), "", " ", " " * 37, "a" * 1500, "-=" * 400, "\x00▁▁x ▁"]
    for text, ids, want in zip(texts, pieces.encode_texts(texts, vocabulary), library.encode(texts)):
        assert ids.tolist() == want, text
        assert pieces.decode(ids, vocabulary) == text.replace("▁", " ")


def test_piece_queries(documents, empty):
    encoded = pieces.encode_documents(documents, MODEL)
    assert {(r.doc_id, r.exact) for r in encoded.collect() if not r.exact} == {(9, False)}
    back = pieces.decode_documents(encoded, MODEL)
    want = sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in documents.collect())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == want
    assert pieces.encode_documents(empty, MODEL).count() == 0


def test_every_prefix_count_equals_the_library():
    vocabulary, library = token_counts.Vocabulary.load(BYTES), Tokenizer.from_file(BYTES)
    for text in [*random_texts(400, 25), "ab" * 60, " " * 90, "é" * 70]:
        parts = token_counts.split_parts(text, vocabulary)
        token_counts._fill(set(parts), vocabulary)
        got = token_counts.prefix_table(text, parts, vocabulary).tolist() if parts else []
        assert got == [len(library.encode(text[:n], add_special_tokens=False).ids) for n in range(1, len(text) + 1)], text


def test_stored_tables_answer_budget_questions(documents, empty):
    library = Tokenizer.from_file(BYTES)
    counted = token_counts.count_documents(documents.where("doc_id <> 7"), BYTES, store=True)
    asked = token_counts.longest_prefix_within(counted, 9).withColumn("ten", token_counts.tokens_of_prefix(F.col("prefix_counts"), F.lit(10)))
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in asked.collect():
        text = texts[r.doc_id]
        count = lambda n: len(library.encode(text[:n], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.ten) == (len(text.encode()), count(len(text)), count(10))
        assert count(r.n_chars) <= 9 and all(count(n) > 9 for n in range(r.n_chars + 1, min(len(text), r.n_chars + 40) + 1))
    assert token_counts.count_documents(empty, BYTES).count() == 0


def by_hand(training, text, language):
    """Code length by walking the contexts of each byte, longest first."""
    seen = {}
    for t in training:
        data = b"\n\n\n" + t.encode()
        for k in range(3, len(data)):
            for order in range(4):
                seen.setdefault(data[k - order : k], Counter())[data[k]] += 1
    bits, data = 0.0, b"\n\n\n" + text.encode()
    for k in range(3, len(data)):
        for order in range(3, -1, -1):
            counts = seen.get(data[k - order : k])
            if counts is None:
                continue
            whole = sum(counts.values()) + len(counts)
            if counts[data[k]]:
                bits -= math.log2(counts[data[k]] / whole)
                break
            bits -= math.log2(len(counts) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_walk_through_the_contexts(spark):
    rows = [("the cat and the dog", "en"), ("a hat", "en"), ("der Hund und die Katze", "de"), ("über Öl", "de"), (None, "de"), ("x", None)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["the dog", "der Hut", "zq über", "\n", "日本"]
    data = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = language_id.text_bits(model, np.frombuffer(data, np.uint8), offsets)
    for k, language in enumerate(model.languages):
        want = [by_hand([t for t, x in rows if x == language and t], text, language) for text in texts]
        assert np.allclose(got[:, k], want, rtol=1e-5)


def test_held_out_languages_and_edges(spark, documents, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.train(table.where(fold != 1))
    judged = language_id.classify(table.where(fold == 1), model, {"lang": F.col("lang")}).select("row.lang", "lang_pred")
    assert judged.where("lang = lang_pred").count() >= 0.95 * judged.count()
    edge = {(r.text, r.lang_pred, r.score) for r in language_id.classify(documents, model, {"text": F.col("text")}).select("row.text", "lang_pred", "score").collect()}
    assert {t for t, lang, score in edge if lang == "und" and score == 0} == {None, "", " \n\t ", "1234 5678 --- 9"}
    assert language_id.keep_known(documents, model).columns == documents.columns
    assert language_id.keep_known(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.classify(documents, nothing, {}).select("lang_pred").collect()} == {"und"}


def test_base_scores_and_probabilities(spark, documents):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    train = table.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    model, counts = class_lm.train(train, head=300, clustered=200, classes=8, rounds=2)
    rows = table.unionByName(documents.select("doc_id", "text"))
    found = {(r.doc_id, r.text): r for r in class_lm.score(rows, model, counts, {"doc_id": F.col("doc_id"), "text": F.col("text")}).select("row.*", "*").collect()}
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in words(r.text))
    total, different = sum(c.values()), len(c)
    for r in rows.collect():
        got, want = found[(r.doc_id, r.text)], words(r.text)
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(want), sum(c[w] > 0 for w in want), total)
        assert math.isclose(got.base_score, sum(math.log10((c[w] + 1) / (total + different + 1)) for w in want), rel_tol=1e-9)
    # Probabilities of a class's successors, and of a class's words, sum to one.
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    for k in range(8):
        own = (model.classes == k).nonzero()[0]
        assert not len(own) or math.isclose((10 ** model.emission[own]).sum(), 1, rel_tol=1e-9)
    held = [r for r in found.values() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_a_slice_are_those_of_its_texts():
    texts = [*random_texts(300), None, "", " \t\n", "x" * 64, "x" * 65 + " A", "x" * 65, "ÄB\u00a0c d\x0b\x0ce\x1cf", "end", "end"]
    (part, words, codes, begins), *rest = class_lm._texts([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])], 0)
    assert not rest and len(set(words.to_pylist())) == len(words)
    found = [words[c].as_py() for c in codes.tolist()]
    assert [found[a:b] for a, b in zip(begins, begins[1:])] == [class_lm.tokens(t) for t in texts]
    counted = list(class_lm._counted([part]))
    assert {w: n for b in counted for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist())} == Counter(found) + Counter({class_lm.END: len(texts)})
    index = class_lm.Index("none", 0, 0, [], np.zeros(1, np.int64))
    assert index.keys(words.slice(7, 5)).tolist() == index.keys(words)[7:12].tolist() and len(set(index.keys(words).tolist())) == len(words)


def test_counts_past_32_bits_come_back():
    counts = [1, 2**32 - 1, 2**32, 2**35 + 7]
    lists = [pa.array([x], pa.list_(pa.int64())) for x in ([8, 4, 6, 2], counts)]
    (stored,) = class_lm._merged([pa.RecordBatch.from_arrays([pa.array([5]), pa.array([0]), pa.array([1]), *lists], names=["w", "chunk", "chunks", "to", "n"])])
    found = Counter()
    for w, to, n in zip(*class_lm._links_of(stored)):
        found[int(w), int(to)] += int(n)
    assert found == {(5, to): n for to, n in zip([8, 4, 6, 2], counts)}


def test_matrix_is_summed_in_few_tasks(spark, tmp_path):
    """What tasks send by class does not grow with the number of partitions."""
    words = [b"w%d" % (k * k % 97) for k in range(400)]
    table = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "word binary, n long")
    index = class_lm.build_index(table, table.count(), 4, str(tmp_path))
    head, text = pa.array([], pa.binary()), pa.array([b" ".join(words).decode()])
    batch = next(class_lm._links([pa.RecordBatch.from_arrays([text], names=["text"])], index, head, np.zeros(0, np.int64)))
    rows = [r for merged in class_lm._merged([batch]) for r in merged.to_pylist()]
    links = spark.createDataFrame([tuple(r.values()) for r in rows], class_lm.STORED_LINKS).repartition(300)
    many = 3 * class_lm.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert links.rdd.getNumPartitions() == 300 > many / 3
    ran = []
    for group, frame in (("few", links), ("one", links.coalesce(1))):
        spark.sparkContext.setJobGroup(group, group)
        ran.append(class_lm._matrix(frame, index, [0] * len(index.shards), 4))
    spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    assert max(tasks) <= many / 3 and (ran[0] == ran[1]).all() and ran[0].sum() == len(words) + 1


def test_exchange_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(1)
    counts, assigned = rng.integers(0, 9, (12, 12)).astype(float), rng.integers(0, 3, 12)

    def matrix(of):
        out = np.zeros((3, 3))
        np.add.at(out, (of[:, None], of[None, :]), counts)
        return out

    now = matrix(assigned)
    for w in range(12):
        after, before = (np.bincount(assigned, x, 3) for x in (counts[w], counts[:, w]))
        gains = class_lm.exchange_gains(assigned[w], after, before, counts[w, w], now, 3)
        for k in range(3):
            moved = assigned.copy()
            moved[w] = k
            assert math.isclose(gains[k], class_lm.likelihood(matrix(moved)) - class_lm.likelihood(now), abs_tol=1e-6)


def test_gains_of_a_batch_are_those_of_its_words():
    # Words of classes 0 and 1 meet those of classes 2 to 4 alone, so a move between 0 and 1 changes no cell twice.
    rng = np.random.default_rng(2)
    assigned = np.array([0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4])
    counts = rng.integers(0, 9, (12, 12)).astype(float)
    counts[:6, :6] = 0

    matrix = np.zeros((5, 5))
    np.add.at(matrix, (assigned[:, None], assigned[None, :]), counts)
    profiles = [np.concatenate([np.bincount(assigned, x, 5) for x in (counts[w], counts[:, w])]).astype(np.int64) for w in range(6)]
    at, n = (np.concatenate(x) for x in zip(*[(np.flatnonzero(p), p[p > 0]) for p in profiles]))
    begins = np.cumsum([0, *(int((p > 0).sum()) for p in profiles[:-1])])
    got = class_lm.batch_gains(assigned[:6], begins, at, n, matrix, 3, (matrix.sum(axis=1), matrix.sum(axis=0)))
    for w in range(6):
        want = class_lm.exchange_gains(assigned[w], profiles[w][:5], profiles[w][5:], 0.0, matrix, 3)
        assert np.allclose(got[w, :2], want[:2], atol=1e-3) and got[w, assigned[w]] == 0
        # A class that the word meets is off by the one cell that changes twice.
        assert abs(got[w, 2] - want[2]) < 0.2 * abs(want[2]) + 1


def test_language_model_of_nothing(documents, empty):
    model, counts = class_lm.train(empty)
    scored = class_lm.score(documents, model, counts, {"doc_id": F.col("doc_id")}).collect()
    assert len(scored) == documents.count() and {(r.n_known, r.train_tokens, r.base_score) for r in scored} == {(0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in scored)


@pytest.mark.parametrize("name", ["op2_token_counts", "op4_sentencepiece"])
def test_queries_equal_the_libraries(spark, name):
    import __spark_entry__ as driver

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in driver.queries()[name](spark, "/root/testdata/sf0.001").collect():
        text = texts[r.doc_id] or ""
        if name.startswith("op2"):
            assert r.n_tokens == len(LIBRARY.encode(text, add_special_tokens=False).ids)
        else:
            assert list(r.token_ids) == PIECES.encode(text) and r.exact


def test_every_repeated_word_is_clustered(spark):
    # 9,000 words of three uses each in two kinds that take turns, and one word whose neighbours fill several rows.
    random.seed(3)
    kinds = [[f"{kind}{k}" for k in range(4500)] * 3 for kind in "xy"]
    for kind in kinds:
        random.shuffle(kind)
    words = [w for pair in zip(*kinds) for w in pair]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)] + ["zz " * 9000 + "once", None]
    model, counts = class_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), head=50, rounds=2)
    assert model.index.size == 9001 and len(model.in_class) - 2 == max(64, round(2 * 9001 ** (1 / 3)))
    classes = model.index.classes(model.steps, len(model.in_class) - 2).astype(int)
    of = {w: classes[k] for w, k in zip({*words, "zz"}, model.index.find([w.encode() for w in {*words, "zz"}])[0])}
    matrix = np.zeros((len(model.in_class),) * 2)
    for k, text in enumerate(texts):
        path = [len(matrix) - 1, *(of.get(w, len(matrix) - 2) for w in (text or "").split()), len(matrix) - 1]
        np.add.at(matrix, (path[:-1], path[1:]), 1)
    assert (matrix.sum(axis=1) == model.in_class).all()
    by_chance = [{w: k % (len(matrix) - 2) for k, w in enumerate(of)}, of]
    risen = []
    for assigned in by_chance:
        m = np.zeros_like(matrix)
        for text in texts[:-2]:
            path = [assigned[w] for w in text.split()]
            np.add.at(m, (path[:-1], path[1:]), 1)
        risen.append(class_lm.likelihood(m))
    assert risen[1] > risen[0]
    held = "x1 y2 zz once never"
    got = class_lm.score(spark.createDataFrame([(held,)], "text string"), model, counts, {"text": F.col("text")}).first()
    path = [len(matrix) - 1, *(of.get(w, len(matrix) - 2) for w in held.split()), len(matrix) - 1]
    n = {"x1": 3, "y2": 3, "zz": 9000}
    rare = [math.log10(2 / (1 + 1 + 1)), math.log10(1 / (1 + 1 + 1))]
    want = model.transition[path[:-1], path[1:]].sum() + sum(math.log10(n[w] / model.in_class[of[w]]) for w in n) + sum(rare)
    assert math.isclose(got.score, want, rel_tol=1e-9) and got.n_known == 5


def test_clustering_goes_on_while_the_likelihood_rises(spark):
    random.seed(4)
    texts = [" ".join(f"{kind}{random.randrange(20)}" for _ in range(20) for kind in "pqr") for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    values = []
    for rounds in (0, 1, None):
        model, counts = class_lm.train(rows, classes=4, rounds=rounds)
        values.append(sum(r.score for r in class_lm.score(rows, model, counts, {"text": F.col("text")}).collect()))
    assert values[0] < values[1] < values[2]


def test_texts_that_fit_no_language_go(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    random.seed(5)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        " ".join("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(40)),
        "".join(random.choices("0123456789abcdef", k=400)),
    ]
    planted = spark.createDataFrame([(-k, text, None) for k, text in enumerate(foreign, 1)], table.schema)
    model = language_id.train(table)
    rows = table.unionByName(planted)
    assert language_id.keep_known(planted, model).count() == len(foreign)
    kept = {r.doc_id for r in language_id.keep_known(rows, language_id.learned(rows)).collect()}
    assert kept == {r.doc_id for r in table.collect()}


def test_languages_without_a_limit_are_not_dropped(spark, documents):
    # One text of a language: the halves cannot tell it apart, so it has no limit of its own and takes that of all.
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    lone = spark.createDataFrame([(-1, "Все люди рождаются свободными и равными в своем достоинстве и правах.", "ru")], table.schema)
    rows = table.unionByName(lone)
    model = language_id.learned(rows)
    assert set(model.limits) == set(model.languages) and "ru" in model.limits and all(map(math.isfinite, model.limits.values()))
    assert -1 in {r.doc_id for r in language_id.keep_known(rows, model).collect()}
    # Nothing learned, nothing judged: null labels, or no text to a label.
    for nothing in (table.withColumn("lang", F.lit(None).cast("string")), table.withColumn("text", F.lit(None).cast("string"))):
        assert language_id.keep_known(nothing, language_id.learned(nothing)).count() == nothing.count()
    assert language_id.keep_known(documents, language_id.learned(documents)).columns == documents.columns


def test_all_labels_and_contexts_are_learned(spark):
    random.seed(6)
    texts = [["".join(random.choices(ALPHABET[:8] + [chr(k) for k in range(256, 900)], k=600)), f"l{k:02}"] for k in range(70)]
    model = language_id.train(spark.createDataFrame(texts, "text string, lang string"))
    seen = [(b"\n\n\n" + t.encode()) for t, _ in texts]
    contexts = {data[k - 3 : k] for data in seen for k in range(3, len(data))}
    assert len(model.languages) == 70 and len(model.contexts) == len(contexts)
    data = texts[69][0][:40].encode()
    got = language_id.text_bits(model, np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert math.isclose(got[69], by_hand([texts[69][0]], data.decode(), "l69"), rel_tol=1e-5)
    assert got.argmin() == 69


def test_links_are_sent_as_bytes_and_come_back():
    """Also counts past 32 bits, slices of batches, and rows of several tasks, wherever a batch ends."""
    rows = [(5, 0, 1, [8, 4], [1, 2**32 + 3]), (9, 0, 2, [2, 3, 4], [2**34, 1, 2]), (9, 1, 2, [6], [7])]
    lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (3, 4)]
    batch = pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows]) for k in range(3)), *lists], names=["w", "chunk", "chunks", "to", "n"])
    for first in (0, 1):
        (sent,) = class_lm._sent([batch.slice(first)])
        assert sent.schema.field("pairs").type == pa.binary()
        thrice = sent.take(pa.array(np.repeat(np.arange(len(sent)), 3)))
        for size in range(1, len(thrice) + 1):
            cut = [sent.slice(0, 0), *(thrice.slice(k, size) for k in range(0, len(thrice), size))]
            found, seen = Counter(), []
            for stored in class_lm._merged(class_lm._received(cut)):
                seen += zip(*(stored[c].to_pylist() for c in ("w", "chunk", "chunks")))
                for w, to, n in zip(*class_lm._links_of(stored)):
                    found[int(w), int(to)] += int(n)
            assert seen == [r[:3] for r in rows[first:]]
            assert found == {(r[0], to): 3 * n for r in rows[first:] for to, n in zip(r[3], r[4])}
    assert not list(class_lm._received([sent.slice(0, 0)]))


def test_links_are_not_collected_by_word_and_tables_have_few_files(spark, documents, monkeypatch):
    plans, files, cluster, written = [], [], class_lm.cluster, class_lm.written

    def clustered(links, *args):
        plans.append(links._jdf.queryExecution().analyzed().toString())
        return cluster(links, *args)

    def stored(frame, path):
        files.append(frame.rdd.getNumPartitions())
        return written(frame, path)

    monkeypatch.setattr(class_lm, "cluster", clustered)
    monkeypatch.setattr(class_lm, "written", stored)
    rows = documents.repartition(3 * class_lm.TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    model, counts = class_lm.train(rows, head=300, classes=8, rounds=1)
    files.append(class_lm.score(rows, model, counts, {"doc_id": F.col("doc_id")}).rdd.getNumPartitions())
    assert len(plans) == 1 and "collect_list" not in plans[0] and "Sort" in plans[0]
    assert files and max(files) <= class_lm.TASKS_A_CORE * spark.sparkContext.defaultParallelism


def test_sums_of_keys_do_not_depend_on_their_size():
    rng = np.random.default_rng(3)
    keys, values = rng.integers(0, 50, 400), rng.integers(1, 9, 400)
    for scale in (1, 1 << 30, 1 << 57):
        found = class_lm._flat(keys * scale, values)
        assert [x.tolist() for x in found] == [(np.unique(keys) * scale).tolist(), [int(values[keys == k].sum()) for k in np.unique(keys)]]
    assert [len(x) for x in class_lm._flat(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
