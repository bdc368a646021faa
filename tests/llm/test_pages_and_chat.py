import base64
import hashlib
import random

import numpy as np

from fieldgauge.llm import chat, url_filter, warc


def test_archives_come_back(spark, empty):
    html = [None, "", "same", "same", "<p>é</p>" * 400, "same", *(f"<html>page {k % 7} {'x' * k}</html>" for k in range(40))]
    rows = [(k, None if k == 4 else f"http://a.example/ü {k}\r\n", h, 1) for k, h in enumerate(html)] + [(None, "u", "same", 2), (45, "again", html[45], 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    files = warc.write_archives(pages, warc.archive_folder(pages), archive_bytes=3_000)
    got = sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files).collect()), key=repr)
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = i == last[h or ""]
        want.append((None if i is None else str(i), len(data), digest, "response" if response else "revisit", None if response else str(last[h or ""])))
    assert got == sorted(want, key=repr)
    assert files.count() > 3
    none = pages.where("false")
    assert warc.read_archives(warc.write_archives(none, warc.archive_folder(none))).count() == 0


def test_records_stand_alone(spark, tmp_path):
    writer = warc.ArchiveWriter(f"{tmp_path}/a")
    for k in range(200):
        writer.add(warc.record(str(k), f"http://x/{k}", b"<html><body>hello world %d</body></html>" % k, None))
    path, n, _ = writer.close()
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert n == 200 and [h["WARC-Record-ID"] for h, _ in warc.read_records(path)] == [f"<urn:page:{k}>" for k in range(200)]


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_rules_equal_brute_force(spark):
    random.seed(4)
    label = lambda: random.choice(["com", "net", "www", "example", "a", "É"])
    hosts = lambda: ".".join(label() for _ in range(random.randint(1, 4)))
    paths = lambda: random.choice(["", "/", "/en", "/en/", "/es/x", "/en/y/z"])
    rules = {(hosts().lower().replace("é", "É"), paths()): random.choice(url_filter.VERDICTS) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{hosts().upper()}{paths()}{random.choice(['', '?q=/en/', '#://b', 'tail'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://?x", "a://b://c/en/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for shard_rules in (1_000_000, 7):
        filters = url_filter.build(spark.createDataFrame(rules, url_filter.RULE_SCHEMA), shard_rules)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, filters).collect()}
        for k, url in enumerate(urls):
            want = brute_rule(url.replace("É".lower(), "é") if url else url, rules)
            assert got[k] == want, (url, got[k], want)
    none = url_filter.build(spark.createDataFrame([], url_filter.RULE_SCHEMA))
    assert {r.verdict for r in url_filter.judge(frame, none).collect()} == {"allow"}


def test_equal_keys_are_told_apart(spark):
    shard = object.__new__(url_filter._Shard)
    strings = [b'["a", "/x"]', b'["b", "/y"]', b'["c", "/z"]']
    shard.keys, shard.verdicts = np.array([5, 5, 9], np.uint64), np.array([0, 1, 1], np.uint8)
    shard.offsets, shard.strings = np.cumsum([0, *map(len, strings)]).astype(np.uint64), np.frombuffer(b"".join(strings), np.uint8)
    keys = np.array([5, 5, 5, 9, 10], np.uint64)
    assert shard.find(keys, [("a", "/x"), ("b", "/y"), ("q", "/"), ("c", "/z"), ("c", "/z")]).tolist() == [0, 1, -1, 2, -1]


def test_template_is_reversible():
    random.seed(6)
    parts = [*chat.CONTROLS, "\\", "\\\\", "[", "]", "<", "/", "ok", "\n", "é", "<s>[USER]", "[/ASSISTANT]</s>", "[\\INST]"]
    for _ in range(500):
        turns = [(random.choice(["user", "assistant", "system", "tool]\\", ""]), "".join(random.choice(parts) for _ in range(random.randint(0, 8)))) for _ in range(random.randint(0, 5))]
        formatted, spans = chat.format_turns(turns)
        assert chat.parse_turns(formatted) == turns
        assert chat.masked_text(formatted, spans) == "".join(t for role, t in turns if role == "assistant")


def test_best_paths_of_trees_equal_brute_force(spark):
    random.seed(8)
    rows = []
    for tree in range(12):
        for node in range(random.choice([1, 2, 9, 40])):
            parent = None if node == 0 else random.choice([node - 1, node - 1, random.randrange(node)])
            rows.append((tree, node, parent, float(random.randint(-2, 4)), random.choice(["user", "assistant"]), f"t{tree}.{node}"))
    rows += [(50, k, k - 1 if k else 99, 1.0, "user", str(k)) for k in range(70)] + [(None, 1, None, 1.0, "user", "lone"), (60, 1, 2, 1.0, "user", "loop"), (60, 2, 1, 1.0, "user", "loop")]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = {r.tree: [t for _, t in chat.parse_turns(r.formatted)] for r in chat.whole_conversations(chat.format_conversations(frame)).collect()}
    want = {}
    for tree in {r[0] for r in rows} - {60}:
        own = {r[1]: r for r in rows if r[0] == tree}
        best = None
        for node in set(own) - {r[2] for r in own.values()}:
            path, at = [], node
            while at in own:
                path.append(own[at])
                at = own[at][2]
            rank = (sum(r[3] for r in path), len(path), -node)
            best = max(best or (rank, path), (rank, path), key=lambda x: x[0])
        want[tree] = [r[5] for r in reversed(best[1])]
    assert got == want


def test_chain_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 0, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r.tree: chat.parse_turns(r.formatted) for r in chat.whole_conversations(chat.format_conversations(chat.as_chain(frame))).collect()}
    assert made == {1: [("user", "a"), ("assistant", ""), ("assistant", "b")], 2: [("null", "x")], None: [("user", "y")]}
    assert chat.read_back(chat.format_conversations(chat.as_chain(frame.where("false")))).count() == 0


def test_a_long_conversation_is_no_group(spark):
    # One conversation holds nearly all rows, and another has the text id that its null id could be mixed up with.
    rows = [(None, k, "assistant" if k % 2 else "user", f"turn {k} </s>") for k in range(400)] + [("null", 0, "assistant", "x"), ("7", 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    formatted = chat.format_conversations(chat.as_chain(frame))
    assert formatted.groupBy("tree", "turn").count().agg({"count": "max"}).first()[0] == 1
    got = {r.tree: r for r in chat.read_back(formatted).collect()}
    for conv in (None, "null", "7"):
        own = [(role, text) for c, _, role, text in rows if c == conv]
        loss = "".join(text for role, text in own if role == "assistant")
        whole = chat.format_turns(own)[0]
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(own), len(loss), len(whole))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
