"""DuckDB SQL for the queries that SQL can express (op1, op5, op8, op11, op12, op13; see the tests for the others)."""

from __future__ import annotations

from millrun.llm.rules import COMMON_WORDS, LIMITS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sets of 3-word shingles, links at 100 * intersection >= 85 * union, least id reachable.
OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN list_aggregate(ws, 'string_agg', ' ')
         ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w
        WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT c.x, c.y
  FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id) c
  JOIN n nx ON nx.doc_id = c.x JOIN n ny ON ny.doc_id = c.y
  WHERE 100 * c.k >= 85 * (nx.k + ny.k - c.k)),
reach AS (
  SELECT x AS doc, x AS place FROM links
  UNION
  SELECT reach.doc, links.y FROM reach JOIN links ON links.x = reach.place),
least AS (SELECT doc, min(place) AS c FROM reach GROUP BY doc)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc = d.doc_id"""

# Windows of 50 bytes (100 hexadecimal digits) that a smaller document has, joined into runs.
OP8 = """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN m ON m.s = w.s WHERE m.least < w.doc_id),
starts AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50
                         THEN 0 ELSE 1 END AS fresh
  FROM hit),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts)
  GROUP BY doc_id, run),
cut AS (
  SELECT r.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) r
  JOIN d ON d.doc_id = r.doc_id
  GROUP BY r.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.h
                         ELSE c.kept || substr(d.h, 2 * c.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id"""

_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
_IN = ", ".join(f"'{w}'" for w in _WORDS)


# Jensen-Shannon distance of the grouped shares p and q.
_JS = """sqrt(greatest(sum(
           CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
           + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0))"""
# Letters of any script and blanks as one class.
_COARSE = "CASE WHEN bin IN ('1', '2', '4', '8') THEN 'text' ELSE bin END"


def _without(pattern: str) -> str:
    """Characters of the text that match ``pattern``."""
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


# Base counts, histograms in billionths, references by language, distances, verdict.
OP5 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t,
         nullif(lower(trim(lang)), '') AS lang,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
triples AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
repeats AS (
  SELECT doc_id, count(DISTINCT at_word) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_word FROM triples WHERE k > 1)
  GROUP BY doc_id),
base AS MATERIALIZED (
  SELECT d.doc_id, d.lang, length(t) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST({_without('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         len(ws) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(ws) AS base_failed
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id
  LEFT JOIN repeats ON repeats.doc_id = d.doc_id),
chars AS (
  SELECT doc_id, [{_without('[a-z]')}, {_without('[A-Z]')}, {_without('[0-9]')},
                  {_without('[ \t\n\r\x0B\x0C]')}, {_without("[.,;:!?''\"()-]")}, 0,
                  {_without('[#*$%&|<>]')}, {_without('[^\x00-\x7F]')}] AS counts,
         length(t) AS n FROM d),
words AS (
  SELECT doc_id, CASE WHEN word IN ({_IN}) THEN word ELSE '(other)' END AS bin, count(*) AS k
  FROM (SELECT doc_id, trim(translate(unnest(ws), '{UPPER}', '{LOWER}'), '.,;:!?') AS word FROM d)
  GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT doc_id, 'class' AS name, CAST(i AS VARCHAR) AS bin,
         (CASE WHEN i = 6 THEN n - list_sum(counts) ELSE counts[i] END) * 1000000000 // n AS share
  FROM (SELECT *, unnest(range(1, 9)) AS i FROM chars WHERE n > 0)
  UNION ALL
  SELECT w.doc_id, 'word', bin, k * 1000000000 // b.n_words
  FROM words w JOIN base b ON b.doc_id = w.doc_id),
passing AS (
  SELECT s.*, b.lang FROM shares s JOIN base b ON b.doc_id = s.doc_id
  WHERE NOT b.base_failed AND b.lang IS NOT NULL),
medians AS (
  SELECT lang, bin, m / greatest(sum(m) OVER (PARTITION BY lang), 1) AS q
  FROM (SELECT lang, bin, quantile_cont(share // 1000000, 0.5) AS m, count(*) AS n
        FROM passing WHERE name = 'class' GROUP BY lang, bin)
  WHERE n >= {LIMITS["min_docs"]}),
core AS MATERIALIZED (
  SELECT doc_id FROM (
    SELECT p.doc_id, m.q, CAST(p.share AS DOUBLE) / 1000000000 AS p
    FROM passing p JOIN medians m ON m.lang = p.lang AND m.bin = p.bin WHERE p.name = 'class')
  GROUP BY doc_id HAVING {_JS} <= {LIMITS["class"]}),
sums AS MATERIALIZED (
  SELECT lang, name, bin, CAST(sum(share) AS DOUBLE) AS k
  FROM passing p JOIN core ON core.doc_id = p.doc_id
  WHERE lang IN (SELECT b.lang FROM base b JOIN core c ON c.doc_id = b.doc_id
                 GROUP BY b.lang HAVING count(*) >= {LIMITS["min_docs"]})
    AND (name = 'class' OR lang IN ({", ".join(f"'{g}'" for g in COMMON_WORDS)}))
  GROUP BY ALL),
refs AS MATERIALIZED (
  SELECT lang, name, bin, k / sum(k) OVER (PARTITION BY lang, name) AS q FROM sums
  UNION ALL
  SELECT '(any)', 'class', {_COARSE}, sum(k) / (SELECT sum(k) FROM sums WHERE name = 'class')
  FROM sums WHERE name = 'class' GROUP BY ALL),
judged AS (
  SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM refs) THEN lang ELSE '(any)' END AS ref
  FROM base),
pairs AS (
  SELECT j.doc_id, r.name, r.bin, r.q, 0 AS share FROM judged j JOIN refs r ON r.lang = j.ref
  UNION ALL
  SELECT s.doc_id, name, CASE WHEN j.ref = '(any)' THEN {_COARSE} ELSE bin END, 0, share
  FROM shares s JOIN judged j ON j.doc_id = s.doc_id),
bins AS (
  SELECT doc_id, name, bin, sum(q) AS q, CAST(sum(share) AS DOUBLE) / 1000000000 AS p
  FROM pairs GROUP BY doc_id, name, bin),
dist AS (
  SELECT b.doc_id, b.name, {_JS} AS x
  FROM bins b JOIN judged j ON j.doc_id = b.doc_id
  WHERE EXISTS (SELECT 1 FROM refs r WHERE r.lang = j.ref AND r.name = b.name)
  GROUP BY b.doc_id, b.name),
far AS (
  SELECT b.doc_id,
         coalesce(max(x) FILTER (name = 'class' AND n_chars >= {LIMITS["min_chars"]}), 0) AS c,
         coalesce(max(x) FILTER (name = 'word' AND n_words >= {LIMITS["min_words"]}), 0) AS w
  FROM base b LEFT JOIN dist ON dist.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (c > {LIMITS["class"]} OR (c > {LIMITS["both_class"]}
                                                         AND w > {LIMITS["both_word"]})) AS kept
FROM base b JOIN far ON far.doc_id = b.doc_id"""



def _crc_table() -> list[int]:
    """The 256 entries of CRC-32, from its polynomial."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


# Jumps of every key up to 9 shards in 128-bit integers, checksums byte by byte.
OP11 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
jumps AS (
  SELECT r, ((coalesce(doc_id, 0) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)
            AS state, 0::BIGINT AS cell, 0::BIGINT AS shard, 0::BIGINT AS grown FROM d
  UNION ALL
  SELECT r, state, CAST(floor((cell + 1) * (2147483648::DOUBLE / CAST(
           state // 8589934592::HUGEINT + 1 AS DOUBLE))) AS BIGINT),
         CASE WHEN cell < 8 THEN cell ELSE shard END, cell
  FROM (SELECT r, cell, shard, (state * 2862933555777941757::HUGEINT + 1)
               % 18446744073709551616::HUGEINT AS state FROM jumps WHERE cell <= 8)),
table_ AS (SELECT {_crc_table()}::BIGINT[] AS t),
sums AS (
  SELECT r, xor(list_reduce(
    list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)
    AS crc
  FROM d, table_)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32, r) - 1
         AS slot, grown_shard
FROM (SELECT d.r, doc_id, CAST(octet_length(b) + 1 AS BIGINT) AS size, crc AS text_crc32,
             CAST(shard AS INTEGER) AS shard, CAST(grown AS INTEGER) AS grown_shard
      FROM d JOIN jumps ON jumps.r = d.r AND cell > 8 JOIN sums ON sums.r = d.r)"""

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SCALED = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"

# All anchors against all rows; sums of integers in doubles are exact here.
OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_SCALED} AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place
  FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.id)
            AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score,
       s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
     AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""


def _rounds(k: int, rounds: int) -> str:
    """Assignments and centroids of every round as further tables."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min([CAST(list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v)
                      + list_dot_product(c.v, c.v) AS BIGINT), c.k]) AS near
  FROM v, c{i} c GROUP BY r)""")
        if i < rounds:
            out.append(f"""s{i} AS (
  SELECT k, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT near[2] AS k, unnest(v.v) AS x, unnest(range(len(v.v))) AS dim
        FROM a{i} JOIN v ON v.r = a{i}.r) GROUP BY k, dim),
c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v
  FROM c{i} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY dim) AS v
    FROM s{i} GROUP BY k) m ON m.k = c.k)""")
    return ",\n".join(out)


OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {_SCALED} AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM v
  QUALIFY k < 40),
{_rounds(40, 5)}
SELECT v.vec_id, CAST(near[2] AS INTEGER) AS cluster, near[1] AS distance,
       CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(near[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))
         AS centroid_sha256
FROM a5 JOIN v ON v.r = a5.r JOIN c5 c ON c.k = near[2]"""

ORACLES: dict[str, str] = {"op1_minhash": OP1, "op5_quality_rules": OP5, "op8_suffix_dedup": OP8,
                           "op11_jump_shards": OP11, "op12_hard_negatives": OP12,
                           "op13_centroids": OP13}
