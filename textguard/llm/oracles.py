"""SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from textguard.llm import licences, quality, resample, shards, urls

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Licences: sentence by sentence, then the rules as alternatives of one pattern.
_names = " ".join(f"WHEN regexp_full_match(s, {_text(p)}) THEN {_text(n)}" for n, p in licences.SENTENCES)
_rules = "|".join("".join(f"<{s}>" for s in ids) for _, ids in licences.RULES)
_licence = " ".join(f"WHEN t = {_text(''.join(f'<{s}>' for s in ids))} THEN {_text(n)}" for n, ids in licences.RULES)
ORACLES["op3_licence_scan"] = f"""
WITH parts AS (
  SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, string_split_regex(lower(text), {_text(licences.BREAKS)}) AS x FROM documents)
), known AS (
  SELECT doc_id, i, CASE {_names} ELSE 'unknown' END AS name
  FROM (SELECT doc_id, i, trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM parts WHERE regexp_matches(s, {_text(licences.WORDS)}))
), seqs AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY i) AS sentences, string_agg('<' || name || '>', '' ORDER BY i) AS seq FROM known GROUP BY 1
), taken AS (
  SELECT doc_id, CASE {_licence} END AS name, i
  FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(seq, '{_rules}') AS x FROM seqs))
), named AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY i) AS licences FROM (SELECT doc_id, name, min(i) AS i FROM taken GROUP BY 1, 2) GROUP BY 1
)
SELECT d.doc_id, coalesce(sentences, '') AS sentences, coalesce(licences, '') AS licences,
       CAST(coalesce(len(regexp_extract_all(regexp_replace(seq, '{_rules}', '', 'g'), '<')), 0) AS BIGINT) AS n_unknown
FROM documents d LEFT JOIN seqs s ON s.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

# URLs: RE2 has no look-ahead, so arguments are split and filtered as a list.
_fits = ", ".join(
    f"CASE WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}} END"
    for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
)
_labels = " OR ".join(f"contains('.' || host || '.', '.{x}.')" for x in urls.LISTED_LABELS)
ORACLES["op4_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         [x FOR x IN string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&') IF x != '' AND NOT regexp_full_match(x, '(utm_[a-z]+|ref)(=.*)?')] AS args
  FROM parts
), canon AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\\.|:(80|443)$', '', 'g') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS c,
         coalesce({_fits}) AS fit
  FROM hosts
), listed AS (SELECT DISTINCT c FROM canon WHERE {_labels})
SELECT page_id, host, path, fit.rule AS rule, l.c IS NOT NULL AS listed,
       coalesce(fit.verdict, CASE WHEN l.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN listed l ON l.c = canon.c
"""

_gram = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]"
_grams = (
    "SELECT DISTINCT {key} AS id, " + _gram + " AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM "
    "(SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}))"
)
ORACLES["op5_decontamination"] = f"""
WITH items AS ({_grams.format(key='item_id', table='benchmark')}),
docs AS ({_grams.format(key='doc_id', table='documents')}),
sizes AS (SELECT id, count(*) AS n FROM items GROUP BY 1),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM docs d JOIN items i ON d.g = i.g GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(shared.n AS INTEGER) AS n_shared, CAST(sizes.n AS INTEGER) AS n_item
FROM shared JOIN sizes ON sizes.id = item_id WHERE shared.n * 10 >= sizes.n * 8
"""

ORACLES["op7_line_dedup"] = f"""
WITH each AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), keyed AS (SELECT doc_id, i, line, translate(trim(line, {_BLANK}), {_UPPER}) AS k FROM each),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_failed = " | ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality.RULES))
_ledger = f"""
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM parts)
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY 1),
measures AS (
  SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_word_lines, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM parts p LEFT JOIN covered c ON c.doc_id = p.doc_id
), judged AS (SELECT *, CAST({_failed} AS BIGINT) AS failed FROM measures)
"""
ORACLES["op8_quality_rules"] = _ledger + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines, n_exclaims, n_capitals,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed & {quality.mask('v1')} = 0 AS kept, failed
FROM judged
"""
_strict = quality.POLICIES["strict"]
ORACLES["quality_ablation"] = _ledger + f"""
, fails AS (SELECT doc_id, unnest([{', '.join(f"{{'rule': {_text(n)}, 'hit': {r}}}" for n, r in quality.RULES if n in _strict)}], recursive := true) FROM judged),
sums AS (SELECT doc_id, sum(hit::INT) AS n FROM fails GROUP BY doc_id)
SELECT rule, CAST(count(*) FILTER (hit) AS BIGINT) AS n_failed, CAST(count(*) FILTER (hit AND n = 1) AS BIGINT) AS n_only
FROM fails JOIN sums USING (doc_id) GROUP BY rule
"""

# CRC-32 of a string: its bytes from their hex digits, four bits a step.
def _nibbles() -> str:
    out = list(range(16))
    for _ in range(4):
        out = [0xEDB88320 ^ (x >> 1) if x & 1 else x >> 1 for x in out]
    return "[" + ", ".join(f"{x}::BIGINT" for x in out) + "]"


def _crc32(value: str) -> str:
    step = lambda x: f"xor(({x}) >> 4, {_nibbles()}[(({x}) & 15) + 1])"
    data = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {data}, lambda c, b: {step(step('xor(c, b)'))}), 4294967295::BIGINT)"


# Conversations: rows from the last to the first, with the best edits of the rest by state.
def _best(options: str) -> str:
    return f"list_sort([{options}])[1]"


def _edit(cost: str, edit: str, then: str, kept: str | None = None) -> str:
    left = f"list_prepend({kept}, {then}.t)" if kept else f"{then}.t"
    return f"{{'c': {then}.c + {cost}, 'a': '{edit}' || {then}.a, 't': {left}}}"


def _row(state: str, after: str, keeps: dict[str, str]) -> str:
    """The best edit of a row in a state but for insertions; ``after`` is the state user or assistant leads to."""
    keep = " ".join(f"WHEN letter = '{c}' THEN {_edit('cut', 'K', s, 'line')}" for c, s in keeps.items())
    other = "'assistant:' || text" if after == "a" else "'user:' || text"
    drop = _edit("3", "D", state)
    return f"""CASE WHEN letter = 'x' THEN {drop} ELSE {_best(f"{drop}, {_edit('2 + cut', 'R', after, other)}"
        + f", coalesce(CASE {keep} END, {drop})")} END"""


def _insert(base: str, then: str, role: str) -> str:
    made = _edit("2", "I", then, f"'{role}:'")
    return _best(f"{base}, {made}")


_none = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
_ua = "{'c': 2::BIGINT, 'a': 'I', 't': ['assistant:']}"
_suu = "{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}"
ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         rtrim(text, {_BLANK}) AS tail,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
  FROM hurt
), faults AS (
  SELECT *, CASE WHEN tail = '' THEN 'b' WHEN again THEN 'd' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM judged
), figures AS (
  SELECT c.conv_id, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY 1
), letters AS (
  SELECT conv_id, i, CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE initial END AS letter, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut,
         role || ':' || text AS line, text
  FROM faults
), back(conv_id, i, o, s, u, a) AS (
  SELECT conv_id, n, {_none}, {_suu}, {_ua}, {_none} FROM figures
  UNION ALL
  SELECT conv_id, i, {_insert('ro', 'iu', 'user')}, {_insert('rs', 'iu', 'user')}, iu, {_insert('ra', 'iu', 'user')}
  FROM (
    SELECT conv_id, i, ro, rs, ra, {_insert('ru', 'ra', 'assistant')} AS iu
    FROM (
      SELECT b.conv_id, b.i - 1 AS i,
             {_row('o', 'u', {'s': 's', 'u': 'u'})} AS ro, {_row('s', 'u', {'u': 'u'})} AS rs,
             {_row('u', 'a', {'a': 'a'})} AS ru, {_row('a', 'u', {'u': 'u'})} AS ra
      FROM back b JOIN letters l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.i = b.i
    )
  )
)
SELECT f.conv_id, gaps, blank, duplicate, truncated, illegal, b.o.c AS cost, b.o.a AS audit,
       sha256(array_to_string(b.o.t, chr(10))) AS repaired_sha256
FROM figures f JOIN back b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = 0
"""

# Resampling: features as rows, their CRCs once for each different one.
_words = f"regexp_extract_all(translate(text, {_UPPER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op12_importance_resampling"] = f"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, {_words} AS w FROM documents
  UNION ALL SELECT 'b', item_id, {_words} FROM benchmark
), runs AS (
  SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), coded AS (
  SELECT f, {_crc32("f")} % {resample.BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM runs)
), placed AS (
  SELECT side, id, bucket FROM runs JOIN coded USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY 1
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {resample.BUCKETS})
         / ((s + 1)::DOUBLE * (sum(t) OVER () + {resample.BUCKETS})))) AS BIGINT) AS gain
  FROM counts
), weights AS (
  SELECT id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT id AS doc_id, len(w) >= {resample.LEAST_WORDS} AS may, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('{resample.SEED}:' || id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS among FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {resample.PERCENT} * among // 100 THEN place END AS rank FROM ordered
"""

# Sharding: the entries of the map one after another, the largest first.
_N = 40


def _fold(name: str, source: str, count: int, start: str, choice: str, gain: str) -> str:
    return f"""{name}_order AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot, stripe) AS k FROM {source}
), {name}_rest AS (
  SELECT *, {count} - k + 1 > 1 AND bytes * ({count} - k + 1) > sum(bytes) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS large
  FROM {name}_order
), {name}_list AS (
  SELECT virtual_slot, stripe, bytes, shard, k, CAST(ceil(sum(bytes) FILTER (NOT large) OVER () / ({count} - count(*) FILTER (large) OVER ())) AS BIGINT) AS share
  FROM {name}_rest
), {name}_steps(k, loads, given) AS (
  SELECT 0::BIGINT, {start}, NULL::INTEGER
  UNION ALL
  SELECT k, list_transform(loads, lambda x, i: x + {gain}), s
  FROM (SELECT e.k, p.loads, e.bytes, e.shard, CAST({choice} AS INTEGER) AS s FROM {name}_steps p JOIN {name}_list e ON e.k = p.k + 1)
), {name} AS (
  SELECT e.virtual_slot, e.stripe, e.bytes, e.k, given AS shard FROM {name}_steps JOIN {name}_list e USING (k)
)"""


_stay = "CASE WHEN p.loads[e.shard + 1] + e.bytes <= e.share THEN e.shard ELSE list_position(p.loads, list_min(p.loads)) - 1 END"
_move = f"""CASE WHEN p.loads[{_N + 1}] + e.bytes <= e.share AND 2 * (p.loads[e.shard + 1] - e.share) >= e.bytes THEN {_N} ELSE e.shard END"""
_sums = ", ".join(f"coalesce((SELECT sum(bytes) FROM two WHERE shard = {i}), 0)::BIGINT" for i in range(_N + 1))
ORACLES["op13_sharding"] = f"""
WITH RECURSIVE records AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {shards.HEAD}::BIGINT AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
         ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 8))::BIGINT % {shards.SLOTS} AS virtual_slot
  FROM documents
), slots AS (
  SELECT virtual_slot, greatest(1, least(count(*), CAST(ceil(sum(size) * {_N * shards.FINE} / sum(sum(size)) OVER ()) AS BIGINT))) AS stripes
  FROM records GROUP BY 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size) - 1 AS place
  FROM records JOIN slots USING (virtual_slot)
), striped AS (
  SELECT *, place % stripes AS stripe FROM placed
), one AS (
  SELECT virtual_slot, stripe, count(*) AS n, sum(size)::BIGINT AS bytes, CAST((virtual_slot + stripe) % {_N} AS INTEGER) AS shard
  FROM striped GROUP BY 1, 2
), {_fold("two", "one", _N, f"list_transform(range({_N}), lambda x: 0::BIGINT)", _stay, "CASE WHEN i = s + 1 THEN bytes ELSE 0 END")},
{_fold("three", "two", _N + 1, f"[{_sums}]", _move,
       "CASE WHEN s = shard THEN 0 WHEN i = s + 1 THEN bytes WHEN i = shard + 1 THEN -bytes ELSE 0 END")},
offsets AS (
  SELECT two.virtual_slot, two.stripe, two.shard, sum(n) OVER (PARTITION BY two.shard ORDER BY two.virtual_slot, two.stripe) - n AS before
  FROM two JOIN one USING (virtual_slot, stripe)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, o.shard AS shard, CAST(before + place // stripes AS BIGINT) AS slot,
       NULL::INTEGER AS grown_shard, CAST(virtual_slot AS INTEGER) AS virtual_slot, three.shard AS next_shard
FROM striped JOIN offsets o USING (virtual_slot, stripe) JOIN three USING (virtual_slot, stripe)
"""
