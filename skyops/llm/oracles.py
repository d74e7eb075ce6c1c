"""DuckDB SQL of the queries that SQL can express, written from their rules (no filters, no automaton, no signatures)."""

from __future__ import annotations

from skyops.llm.licenses import PHRASES, SLACK, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP2 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
phrase(p, label) AS (VALUES {_values(PHRASES.items())}),
place AS (
  SELECT doc_id, i - 1 AS pos, label
  FROM (SELECT doc_id, w, p, label, len(string_split(p, ' ')) AS k FROM d, phrase WHERE len(w) >= len(string_split(p, ' '))) x, unnest(range(1, len(w) - k + 2)) t(i)
  WHERE array_to_string(w[i:i + k - 1], ' ') = p),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM place GROUP BY doc_id),
template AS (
  SELECT k, label, list_distinct(w) AS words, CAST(ceil({SLACK} * len(w) - 1e-9) AS BIGINT) AS width, ceil(0.9 * len(list_distinct(w)) - 1e-9) AS need
  FROM (SELECT row_number() OVER () AS k, label, string_split(t, ' ') AS w FROM (VALUES {_values(TEMPLATES)}) v(label, t)) x),
held AS (
  SELECT doc_id, k, label, pos, word, width, need, len(words) AS size
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d) o JOIN (SELECT *, unnest(words) AS word FROM template) t USING (word)),
near AS (
  SELECT doc_id, label, n / size AS share
  FROM (SELECT *, count(DISTINCT word) OVER (PARTITION BY doc_id, k ORDER BY pos RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS n FROM held) x WHERE n >= need),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM near GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP4 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM sized, unnest(range(1, len(w) - n + 2)) t(i)),
size AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
gram AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n FROM d, size WHERE len(w) >= n) x, unnest(range(1, len(w) - n + 2)) t(i)),
occ AS (SELECT doc_id, i, n, item FROM gram JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM occ) o, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""

OP5 = """
WITH said AS (
  SELECT *, coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS part, md5(concat_ws(chr(10), role, text)) AS digest
  FROM (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)),
sized AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY conv_id, part) / 256.0) AS BIGINT) AS pieces FROM said),
placed AS (
  SELECT *, CASE WHEN pieces > 1 THEN coalesce(turn, -1) ELSE 0 END AS subturn,
    CAST(floor(CAST('0x' || substr(digest, 1, 8) AS BIGINT) / 4294967296.0 * pieces) AS BIGINT) AS subpart
  FROM sized),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
seen AS (
  SELECT p.*, speaker, p.role = speaker AS own,
    '<|im_start|>' || CASE WHEN p.role = speaker THEN 'assistant' WHEN p.role = 'system' THEN 'system' ELSE 'user name=' || p.role END || chr(10) AS head,
    p.text || '<|im_end|>' || chr(10) AS body
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
run AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, speaker, part, subturn, subpart ORDER BY turn NULLS FIRST, digest, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM seen)
SELECT conv_id, speaker, part, subturn, subpart, CAST(count(*) AS INTEGER) AS n_messages, CAST(count(*) FILTER (own) AS INTEGER) AS n_trained,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, digest, role, text) AS text,
  coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) - 1 AS BIGINT), ',' ORDER BY pos) FILTER (own), '') AS mask
FROM run GROUP BY conv_id, speaker, part, subturn, subpart
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT * FROM d WHERE len(w) > 0) x, unnest(range(1, len(w) - least(len(w), 5) + 2)) t(i)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r LEFT JOIN size USING (doc_id)
"""

#: crc32 (unsigned) of the decimal doc_id, bit by bit; 3988292384 is the polynomial
_CRC = ("xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
        "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))")

OP11 = rf"""
WITH split AS (SELECT doc_id, {_CRC} AS h, text IS NULL AS missing, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT *, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM split),
d AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_concat(w[1:a], list_transform(range(len(w) - a), lambda i: w[a + i % (1 + (len(w) - a) // (3 + g % 8)) + 1])) ELSE w END AS w
  FROM cut),
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM d, unnest(range(len(w) - 5)) t(i)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q + 5 AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island),
long AS (SELECT * FROM stretch WHERE n >= greatest(12, 2 * q)),
run AS (SELECT * FROM long x WHERE NOT EXISTS (FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.start <= x.start AND x.start + x.n <= y.start + y.n)),
best AS (SELECT doc_id, count(*) AS n_runs, max({{'n': n, 's': -start, 'q': -q}}) AS b, string_agg(start || ',' || n || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + n)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS t FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) k
  WHERE NOT EXISTS (FROM gone WHERE gone.doc_id = k.doc_id AND gone.i = k.i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -b.s AS start, b.n AS length, -b.q AS period, 1000 * b.n // -b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _group(k: int) -> str:
    """The k-th group of eight hex digits of ``digest`` as a number."""
    return f"list_reduce(list_transform(string_split(substr(digest, {8 * k - 7}, 8), ''), lambda c: instr('0123456789abcdef', c)::BIGINT - 1), lambda x, y: 16 * x + y)"


OP13 = f"""
WITH unit AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS digest FROM documents),
drawn AS (SELECT *, len(u) AS n, {_group(1)} AS h1, {_group(2)} AS h2, {_group(3)} AS h3, {_group(4)} AS h4 FROM unit),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM part
"""

SQL = {"op2_license_scan": OP2, "op4_benchmark_hits": OP4, "op5_perspectives": OP5, "op8_jaccard_groups": OP8, "op11_word_runs": OP11, "op13_infilled": OP13}
