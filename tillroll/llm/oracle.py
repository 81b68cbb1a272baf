"""Check SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op8_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS k_lang, coalesce('=' || source, '') AS k_source,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n >= 2),
covered AS (
  SELECT rid, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, k_lang, k_source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.rid = covered.rid),
j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM m),
v AS (
  SELECT k_lang, k_source, unnest(['symbols', 'repeats', 'dup_lines', 'word_length']) AS measure,
    unnest([symbols, repeats, dup_lines, word_length]) AS v FROM j WHERE NOT base_failed),
b AS (
  SELECT *, CAST(CASE WHEN v < 64 THEN 1 ELSE 2 ** (floor(log2(v)) - 5) END AS BIGINT) AS step FROM v),
s AS (
  SELECT k_lang, k_source, measure, v // step * step AS low, v // step * step + step - 1 AS high FROM b),
levels AS (
  SELECT 'fine' AS level, k_lang, k_source, measure, low, high FROM s
  UNION ALL SELECT 'lang', k_lang, '', measure, low, high FROM s
  UNION ALL SELECT 'every', '', '', measure, low, high FROM s),
c AS (
  SELECT level, k_lang, k_source, measure, low, high, count(*) AS n FROM levels GROUP BY ALL),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, k_lang, k_source, measure ORDER BY low) AS upto,
    sum(n) OVER (PARTITION BY level, k_lang, k_source, measure) AS total FROM c),
q AS (
  SELECT level, k_lang, k_source, measure, max(total) AS n, min(low) FILTER (4 * upto >= total) AS q1,
    min(high) FILTER (4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL),
f AS (
  SELECT level, k_lang, k_source, max(n) AS n,
    max(q3 + greatest(3 * (q3 - q1), 50)) FILTER (measure = 'symbols') AS symbols_most,
    max(q3 + greatest(3 * (q3 - q1), 300)) FILTER (measure = 'repeats') AS repeats_most,
    max(q3 + greatest(3 * (q3 - q1), 300)) FILTER (measure = 'dup_lines') AS dup_lines_most,
    max(q3 + greatest(3 * (q3 - q1), 3000)) FILTER (measure = 'word_length') AS word_length_most,
    max(q1 - greatest(3 * (q3 - q1), 2000)) FILTER (measure = 'word_length') AS word_length_least
  FROM q GROUP BY ALL),
pick AS (
  SELECT a.k_lang, a.k_source, CASE WHEN a.n >= 100 THEN 'fine' WHEN l.n >= 100 THEN 'lang' ELSE 'every' END AS level
  FROM f a JOIN f l ON l.level = 'lang' AND l.k_lang = a.k_lang WHERE a.level = 'fine')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= symbols_most AND repeats <= repeats_most AND dup_lines <= dup_lines_most
    AND word_length <= word_length_most AND word_length >= word_length_least, true) AS kept
FROM j LEFT JOIN pick ON j.k_lang = pick.k_lang AND j.k_source = pick.k_source
  LEFT JOIN f ON f.level = pick.level AND f.k_lang = CASE WHEN pick.level = 'every' THEN '' ELSE j.k_lang END
    AND f.k_source = CASE WHEN pick.level = 'fine' THEN j.k_source ELSE '' END
"""

ORACLE["op1_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def _tree(name: str, levels: int = 6) -> str:
    """Levels of the trees over {name}_n0 (k, i, h), and what folds leaves {name}_p0 (rid, k, i, now, proof)."""
    parts = []
    for j in range(levels):
        parts.append(f"""
{name}_r{j} AS (
  SELECT k, i // 16 AS i, list(h ORDER BY i) AS run, any_value(c) > 1 AS more
  FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM {name}_n{j}) GROUP BY k, i // 16),
{name}_n{j + 1} AS (
  SELECT k, i, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}_r{j}),
{name}_p{j + 1} AS (
  SELECT rid, p.k, p.i // 16 AS i,
    CASE WHEN more THEN sha256(array_to_string(run[1:p.i % 16] || [now] || run[p.i % 16 + 2:], '')) ELSE now END AS now,
    CASE WHEN more THEN proof || array_to_string(run[1:p.i % 16] || run[p.i % 16 + 2:], '') ELSE proof END AS proof
  FROM {name}_p{j} p JOIN {name}_r{j} r ON p.k = r.k AND p.i // 16 = r.i)""")
    return ",".join(parts)


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


# there is no crc32 function: eight steps for each byte of the id's digits
ORACLE["op13_manifest"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, *, coalesce('=' || source, '') AS k FROM documents),
crc AS (
  SELECT doc_id AS id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL)),
l AS (
  SELECT rid, doc_id, k, {_leaf("text")} AS leaf,
    CASE WHEN crc % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM d LEFT JOIN crc ON d.doc_id = crc.id),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
s_n0 AS (SELECT k, i, leaf AS h FROM o),
s_p0 AS (SELECT rid, k, i, coalesce(changed, leaf) AS now, '' AS proof FROM o),
{_tree("s")},
t_n0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, k AS source FROM s_n6),
t_p0 AS (SELECT rid, '' AS k, t.i, now, proof FROM s_p6 p JOIN t_n0 t ON p.k = t.source),
{_tree("t")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.h AS verified
FROM o JOIN t_p6 p ON o.rid = p.rid JOIN t_n0 s ON o.k = s.source CROSS JOIN t_n6 t
"""

_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op12_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format(text="text")} AS w FROM documents),
stats AS (SELECT count(*) AS total, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
m AS (
  SELECT rid, doc_id, w, 75 + (25 * len(w)::BIGINT * total) // terms AS m FROM d, stats WHERE len(w) > 0),
tf AS (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM m) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf, stats GROUP BY term, total),
i AS (SELECT row_number() OVER () AS nr, item_id, {_TERMS.format(text="text")} AS w FROM benchmark),
q AS (SELECT nr, term, count(*)::BIGINT AS times FROM (SELECT nr, unnest(w) AS term FROM i) GROUP BY ALL),
s AS (
  SELECT nr, tf.rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.rid = tf.rid GROUP BY ALL),
r AS (
  SELECT nr, doc_id, score, CAST(row_number() OVER (PARTITION BY nr ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM s JOIN m ON s.rid = m.rid WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i ON r.nr = i.nr WHERE rank <= 20
"""
