"""DuckDB SQL of those queries that SQL can express over whole tables."""

from .quality import STOP_WORDS



def _crc32(text: str) -> str:
    """CRC-32 of ASCII text: DuckDB has none, so its bits are folded one by one, each byte (0 or more) before eight shifts (-1)."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({text}, ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def _edited(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A path (k: six digits of cost and the audit, l: its lines) with one more edit; '~' is no path."""
    lines = f"{state}.l" if line is None else f"{state}.l || chr(10) || {line}"
    return f"CASE WHEN {state}.k = '~' THEN {state} ELSE {{'k': lpad(CAST(CAST(left({state}.k, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || substr({state}.k, 7) || '{letter}', 'l': {lines}}} END"


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def _inserted(state: str, role: str) -> str:
    return _edited(state, "3", "I", f"'{role}:'")


def _changed(state: str, initial: str, role: str) -> list[str]:
    """A row kept, if its initial fits, or given another role."""
    stays = "fault NOT IN ('blank', 'duplicate')"
    extra = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    kept = f"CASE WHEN {stays} AND left(role, 1) = '{initial}' THEN {_edited(state, extra, 'K', "role || ':' || text")} ELSE nil END"
    if initial == "s":
        return [kept]
    return [kept, f"CASE WHEN {stays} THEN {_edited(state, f'3 + {extra}', 'R', f"'{role}:' || text")} ELSE nil END"]


# A conversation's rows are followed one by one; a state keeps its best path as (cost and audit, lines).
_REPAIR = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS damage FROM conversations
), d AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE damage <> 0
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    i > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o
), c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'k': '000000', 'l': ''}} AS s0, {{'k': '~', 'l': ''}} AS s1, {{'k': '~', 'l': ''}} AS s2, {{'k': '~', 'l': ''}} AS s3 FROM c
  UNION ALL
  SELECT conv_id, i, {_edited("s0", "4", "D")}, {_least(_edited("s1", "4", "D"), *_changed("s0", "s", "system"))},
    {_least(_edited("g2", "4", "D"), *[p for state in ("s0", "s1", "g3") for p in _changed(state, "u", "user")])},
    {_least(_edited("g3", "4", "D"), *_changed("g2", "a", "assistant"))}
  FROM (
    SELECT *, {_least("a2", _inserted("a3", "user"))} AS g2, {_least("a3", _inserted("a2", "assistant"))} AS g3 FROM (
      SELECT f.conv_id, f.i, f.role, f.text, f.fault, s0, s1, {{'k': '~', 'l': ''}} AS nil,
        {_least("s2", *[_inserted(x, "user") for x in ("s0", "s1", "s3")])} AS a2, {_least("s3", _inserted("s2", "assistant"))} AS a3
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1))
), e AS (
  SELECT c.*, {_least("s0", "s3", _inserted("s2", "assistant"), "two")} AS best
  FROM (SELECT *, {_edited(f"({_inserted('s1', 'user')})", "3", "I", "'assistant:'")} AS two FROM dp) AS dp JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(left(best.k, 6) AS BIGINT), 0) AS cost, coalesce(substr(best.k, 7), '') AS audit, sha256(coalesce(substr(best.l, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

_STOP_LIST = ", ".join(f"'{form}'" for w in STOP_WORDS for form in dict.fromkeys((w, w.capitalize(), w.upper())))

ORACLES = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), w AS (
  SELECT item_id, least(len(words), 13) AS n, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), p AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)
), h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN w ON p.win = w.win AND p.n = w.n
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations, len(list_filter(words, lambda x: x IN ({_STOP_LIST}))) AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1::DOUBLE AND (n_words < 50 OR n_stop_words / n_words >= 0.01::DOUBLE)
    AND (n_lines < 5 OR n_dup_lines / n_lines <= 0.3::DOUBLE) AND n_exclamations / n_words <= 0.3::DOUBLE AS kept
FROM b
""",
    # DuckDB has no base32: 5-bit groups of the hexadecimal digest are looked up in the alphabet.
    "op5_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, count(*) OVER same AS n, max(page_id) OVER same AS first
  FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
), b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right('000' || bin(CAST('0x' || hex[i] AS INTEGER)), 4)), 'string_agg', '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(('0b' || substr(bits, 5 * i + 1, 5)) AS INTEGER)]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
""",
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'null') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
    '(<)(s>|/s>)|(\[)(/?INST\]|/?USER\]|/?ASSISTANT\]|/?SYSTEM\]|ROLE |/ROLE\])', '\1\3\\\2\4', 'g') AS body,
    CASE WHEN role IN ('user', 'assistant', 'system') THEN 2 * length(role) + 12 ELSE 0 END AS marks FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op8_url_filter": r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(h, p, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND k = 1
""",
    "op11_conversation_repair": _REPAIR,
    "op12_prefix_trie": rf"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, list(said ORDER BY i) AS turns FROM t GROUP BY conv_id
), c AS (
  SELECT conv_id, turns, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[:c.h], c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN o AS b ON b.conv_id = c.base
), p AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r
), n AS (
  SELECT turns[:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM p GROUP BY turns[:depth], depth
), k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(path[depth].text) ELSE 0 END AS own
  FROM n LEFT JOIN k USING (path)
), up AS (SELECT path[:d] AS path, n_children, own FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f)
), s AS (SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM up GROUP BY path)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n AS q ON f.depth > 0 AND q.path = f.path[:f.depth - 1]
""",
}
