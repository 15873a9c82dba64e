"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_top_k, html_extract, line_dedup, media, mixing, ngram_join, packing, periodic_runs, pq_near, quality, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_packing": packing.op2_packing,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_media_columns": media.op5_media_columns,
        "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
        "op7_quality": quality.op7_quality,
        "op8_pq_near_dedup": pq_near.op8_pq_near_dedup,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_exact_top_k": exact_top_k.op12_exact_top_k,
        "op13_whitening": whitening.op13_whitening,
    }


MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS chars,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS bits
  FROM documents),
stats AS (
  SELECT doc_id, source, size,
         -ln((bits + 1)::DOUBLE / 4503599627370497.0::DOUBLE)
           / greatest(0.05::DOUBLE, 1 - abs((chars - size)::DOUBLE / greatest(size, 1) - 6) / 8) AS key
  FROM sized),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w
  FROM stats GROUP BY source),
open AS (
  SELECT source, source_size, w,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w,
         sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS open_words
  FROM src
  WINDOW o AS (ORDER BY 3 * source_size::DOUBLE / w, source ASC NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT *, open_words::DOUBLE / open_w::DOUBLE AS level FROM open),
hit AS (
  SELECT max_by(level, open_w) AS level FROM lev WHERE level * w <= 3 * source_size),
tgt AS (
  SELECT source, source_size,
         least(w * coalesce((SELECT level FROM hit), 0), (3 * source_size)::DOUBLE) AS target FROM src),
bud AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM tgt),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs,
         CAST(round(b.target - b.epochs * b.source_size) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM stats s JOIN bud b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(budget - before, 0)) AS BIGINT) AS taken
FROM run
"""


LINE_DEDUP_SQL = """
WITH boiler AS (
  SELECT trim(line, ' \t\r') AS k
  FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
  WHERE trim(line, ' \t\r') <> '' AND source IS NOT NULL
  GROUP BY 1 HAVING count(DISTINCT source) >= 10),
lines AS (
  SELECT no, doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS no, doc_id, text FROM documents WHERE text IS NOT NULL)),
marked AS (
  SELECT no, doc_id, text, line, pos, trim(line, ' \t\r') IN (SELECT k FROM boiler) AS gone FROM lines),
bare AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
         count(*) FILTER (WHERE NOT gone AND trim(line, ' \t\r') <> '') AS n_own,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS bare
  FROM marked GROUP BY no, doc_id, text),
judged AS (
  SELECT *, n_gone > 0 AND n_own > 0 AS cut FROM bare)
SELECT doc_id, n_lines, CASE WHEN cut THEN n_gone ELSE 0 END AS n_removed, n_gone > 0 AND n_own = 0 AS whole_copy,
       CASE WHEN cut THEN bare ELSE text END AS text
FROM judged
UNION ALL
SELECT doc_id, 0, 0, false, NULL FROM documents WHERE text IS NULL
"""


NGRAM_JOIN_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
texts AS (
  SELECT words, min(doc_id) AS first_id, count(*) AS n_docs, row_number() OVER (ORDER BY min(doc_id), words) AS tid
  FROM split WHERE len(words) > 0 GROUP BY words),
sets AS (
  SELECT tid, list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
                                           lambda i: array_to_string(words[i:i + 4], ' '))) AS grams
  FROM texts),
grams AS (
  SELECT tid, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (
  SELECT a.tid AS x, b.tid AS y
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.tid < b.tid
  GROUP BY a.tid, b.tid HAVING 5 * count(*) >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  SELECT x AS tid, x AS other FROM links
  UNION
  SELECT r.tid, l.y FROM reach r JOIN links l ON r.other = l.x),
classes AS (
  SELECT r.tid, min(t.first_id) AS class_id FROM reach r JOIN texts t ON t.tid = r.other GROUP BY r.tid),
linked AS (
  SELECT l.x AS tid, sum(t.n_docs) AS n FROM links l JOIN texts t ON t.tid = l.y GROUP BY l.x),
named AS (
  SELECT t.words, coalesce(c.class_id, t.first_id) AS class_id, CAST(t.n_docs - 1 + coalesce(l.n, 0) AS BIGINT) AS n_links
  FROM texts t LEFT JOIN classes c ON c.tid = t.tid LEFT JOIN linked l ON l.tid = t.tid)
SELECT s.doc_id, n.class_id, n.n_links, s.doc_id IS NOT DISTINCT FROM n.class_id AS kept
FROM split s JOIN named n ON n.words = s.words
UNION ALL
SELECT doc_id, doc_id, 0, true FROM split WHERE len(words) = 0
"""


PQ_NEAR_SQL = """
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS no, vec_id, embedding FROM embeddings),
usable AS MATERIALIZED (
  SELECT no, vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v
  FROM numbered
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.no AS x, b.no AS y
  FROM usable a JOIN usable b ON a.no < b.no AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (
  SELECT x AS no, x AS other FROM links
  UNION
  SELECT r.no, l.y FROM reach r JOIN links l ON r.other = l.x),
classes AS (
  SELECT r.no, min(u.vec_id) AS component_id FROM reach r JOIN usable u ON u.no = r.other GROUP BY r.no),
counts AS (
  SELECT x AS no, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM numbered e LEFT JOIN classes c ON c.no = e.no LEFT JOIN counts n ON n.no = e.no
"""


URL_FILTER_SQL = """
WITH RECURSIVE rules(name, start, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
numbered AS (
  SELECT row_number() OVER () AS no, page_id, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT n.no, arg_max(r.name || r.start, (length(r.name || r.start), r.name, r.start)) AS rule,
         arg_max(r.verdict, (length(r.name || r.start), r.name, r.start)) AS verdict
  FROM numbered n JOIN rules r
    ON (n.host = r.name OR ends_with(n.host, '.' || r.name)) AND starts_with(n.path, r.start)
  GROUP BY n.no),
judged AS (
  SELECT n.no, n.page_id, n.host, n.path, r.rule, r.verdict FROM numbered n LEFT JOIN ruled r ON r.no = n.no),
hrefs AS (
  SELECT no, host, trim(unnest(regexp_extract_all(html,
    '(?is)<[a-z][^<>]*?\\s(?:href|src)\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''<>]+)', 1)), '"'' ' || chr(9) || chr(10) || chr(13)) AS link
  FROM numbered),
schemed AS (
  SELECT no, host, link, lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM hrefs WHERE link <> ''),
targets AS (
  SELECT DISTINCT no, host AS src,
         CASE WHEN scheme = '' AND NOT starts_with(link, '//') THEN CASE WHEN NOT starts_with(link, '#') THEN host END
              WHEN scheme = '' OR scheme IN ('http', 'https')
              THEN translate(regexp_extract('x:' || link, '(?s)^.*?://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS dst
  FROM schemed),
edges AS (
  SELECT src, dst, count(*) AS n FROM targets WHERE src <> '' AND dst <> '' GROUP BY src, dst),
both_ways AS (
  SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
shares AS (
  SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
votes AS (
  SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
  FROM judged WHERE rule IS NOT NULL GROUP BY 1, 2),
walked AS (
  SELECT 0 AS step, kind, host, 0.15::DOUBLE * n / sum(n) OVER (PARTITION BY kind) AS mass FROM votes
  UNION ALL
  SELECT w.step + 1, w.kind, s.dst, sum(0.85::DOUBLE * w.mass * s.share)
  FROM walked w JOIN shares s ON s.kind = w.kind AND s.src = w.host
  WHERE w.step < 150 GROUP BY w.step, w.kind, s.dst),
ranks AS (
  SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) AS trust,
         coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) AS distrust
  FROM walked GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN r.distrust > r.trust THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(r.trust, 0), 6) AS trust, round(coalesce(r.distrust, 0), 6) AS distrust
FROM judged j LEFT JOIN ranks r ON r.host = j.host
"""


PERIODIC_RUNS_SQL = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
split AS (
  SELECT row_number() OVER () AS no, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits
  FROM documents),
hashed AS (
  SELECT no, doc_id, words, len(words) AS n,
         xor(list_reduce(list_prepend(4294967295, digits), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM split, crc),
places AS MATERIALIZED (
  SELECT no, doc_id, words, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS parts
  FROM hashed),
texts AS (
  SELECT no, doc_id, n FROM places),
original AS MATERIALIZED (
  SELECT no, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM places),
sources AS (
  SELECT no, i, CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END AS j
  FROM (SELECT no, planted, a, n, parts, unnest(range(n)) AS i FROM places)),
flat AS MATERIALIZED (
  SELECT s.no, s.i, o.w FROM sources s JOIN original o ON o.no = s.no AND o.i = s.j),
lags AS (
  SELECT no, n, unnest(range(1, n // 4 + 1)) AS q FROM texts),
anchors AS (
  SELECT no, q, unnest(range(0, n - 3 * q, q)) AS i FROM lags),
worded AS MATERIALIZED (
  SELECT a.no, a.q, a.i + a.q AS i, f.w FROM anchors a JOIN flat f ON f.no = a.no AND f.i = a.i),
twice AS MATERIALIZED (
  SELECT a.no, a.q, a.i + a.q AS i, a.w FROM worded a JOIN flat f ON f.no = a.no AND f.i = a.i AND f.w = a.w),
thrice AS MATERIALIZED (
  SELECT a.no, a.q, a.i + a.q AS i, a.w FROM twice a JOIN flat f ON f.no = a.no AND f.i = a.i AND f.w = a.w),
likely AS MATERIALIZED (
  SELECT DISTINCT a.no, a.q FROM thrice a JOIN flat f ON f.no = a.no AND f.i = a.i AND f.w = a.w),
compared AS MATERIALIZED (
  SELECT l.no, l.q, f.i, f.w, f.i - l.q AS before FROM likely l JOIN flat f ON f.no = l.no),
equal AS MATERIALIZED (
  SELECT x.no, x.q, x.i, x.i - row_number() OVER (PARTITION BY x.no, x.q ORDER BY x.i) AS stretch
  FROM compared x JOIN flat f ON f.no = x.no AND f.i = x.before AND f.w = x.w),
stretches AS (
  SELECT no, q, min(i) - q AS start, count(*) + q AS length FROM equal GROUP BY no, q, stretch
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT no, start, length, min(q) AS period FROM stretches GROUP BY no, start, length),
summed AS (
  SELECT no, count(*) AS n_runs, arg_max({'start': start, 'length': length, 'period': period}, (length, -start, -period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY no),
dropped AS (
  SELECT DISTINCT no, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT f.no, string_agg(f.w, ' ' ORDER BY f.i) AS text FROM flat f ANTI JOIN dropped d ON d.no = f.no AND d.i = f.i GROUP BY f.no)
SELECT t.doc_id, CAST(coalesce(s.n_runs, 0) AS BIGINT) AS n_runs, CAST(s.best.start AS BIGINT) AS start,
       CAST(s.best.length AS BIGINT) AS length, CAST(s.best.period AS BIGINT) AS period,
       CAST(1000 * s.best.length // s.best.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(s.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN summed s ON s.no = t.no LEFT JOIN kept k ON k.no = t.no
"""


EXACT_TOP_K_SQL = """
WITH numbered AS (
  SELECT row_number() OVER () AS no, vec_id, embedding FROM embeddings),
usable AS (
  SELECT no, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v
  FROM numbered
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id, c.no AS other, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON len(q.v) = len(c.v) AND q.no <> c.no
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id ASC NULLS LAST, other) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": MIXING_SQL,
        "op3_line_dedup": LINE_DEDUP_SQL,
        "op6_ngram_jaccard": NGRAM_JOIN_SQL,
        "op8_pq_near_dedup": PQ_NEAR_SQL,
        "op10_url_filter": URL_FILTER_SQL,
        "op11_periodic_runs": PERIODIC_RUNS_SQL,
        "op12_exact_top_k": EXACT_TOP_K_SQL,
    }
