"""SQL twins of the operators that SQL can express, written from the operators' definitions."""

from __future__ import annotations

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS bad FROM b GROUP BY host
), total AS (
  SELECT CAST(sum(n) AS DOUBLE) AS all_n, CAST(sum(bad) AS DOUBLE) AS all_bad, CAST(count(*) AS DOUBLE) AS hosts, sum(CAST(bad AS DOUBLE) * bad / n) AS sq FROM h
), moments AS (
  SELECT all_bad / all_n AS m, greatest(sq / all_n - (all_bad / all_n) ** 2 - (all_bad / all_n) * (1 - all_bad / all_n) * hosts / all_n, 0.0) AS v FROM total
), prior AS (
  SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 0.0) END AS s FROM moments
), verdict AS (
  SELECT host, n, bad, CASE WHEN s IS NULL THEN m ELSE (bad + m * s) / (n + s) END > 0.5 AS rejected FROM h, prior
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept,
       b.host, v.n AS host_docs, v.bad AS host_failed
FROM b JOIN verdict v ON b.host IS NOT DISTINCT FROM v.host
"""


def url_filter(rules: list[tuple[str, str, str]], unit: int, follow: int, rest: int) -> str:
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN" for _, h, p in longest]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, longest, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, longest, strict=True)) + " END"

    def host(rest: str) -> str:
        return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_A}', '{_Z}')"

    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, html, {host('rest')} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
), r AS (
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled FROM q
), targets AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS t FROM q
), links AS (
  SELECT DISTINCT src, dst FROM (SELECT src, {host("substr(t, strpos(t, '//') + 2)")} AS dst FROM targets) WHERE src <> dst AND src <> '' AND dst <> ''
), both_ways AS (
  SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links
), edges AS (
  SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM both_ways
), seeds AS (
  SELECT host, kind FROM (SELECT host, CASE WHEN 2 * count(*) FILTER (ruled = 'allow') > count(*) THEN 'trust'
    WHEN 2 * count(*) FILTER (ruled = 'block') > count(*) THEN 'distrust' END AS kind FROM r GROUP BY host) WHERE kind IS NOT NULL
), flow AS (
  SELECT 0 AS step, kind, host, CAST({unit} // count(*) OVER (PARTITION BY kind) AS BIGINT) AS mass FROM seeds
  UNION ALL
  SELECT any_value(m.step) + 1, e.kind, e.dst, CAST(sum((m.mass // 100 * {follow} + m.mass % 100 * {follow} // 100) // e.degree) AS BIGINT)
  FROM (SELECT *, sum(mass) OVER () AS moving FROM flow) m JOIN edges e ON m.kind = e.kind AND m.host = e.src WHERE moving > {rest}
  GROUP BY e.kind, e.dst HAVING sum((m.mass // 100 * {follow} + m.mass % 100 * {follow} // 100) // e.degree) > 0
), mass AS (
  SELECT host, CAST(coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust
  FROM flow GROUP BY host
)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM r LEFT JOIN mass ON r.host = mass.host
"""


_GROUPS = " || ".join(
    f"list_reduce(list_transform(range(0, 8), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> (35 - 5 * i)) & 31 AS INT) + 1, 1)), lambda a, b: a || b)"
    for g in range(4))

WARC = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
  SELECT h, max(page_id) AS keeper FROM p GROUP BY h
)
SELECT page_id, payload_bytes, {_GROUPS} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (h)
"""


def mixing(weights: tuple[int, ...], share: tuple[int, int], most: int, seed: str) -> str:
    num, den = share
    weight = "CASE place % " + str(len(weights)) + " " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CAST({weight} AS HUGEINT) AS weight, sum(source_size) OVER () AS total, CAST(sum({weight}) OVER () AS HUGEINT) AS heavy FROM s
), f AS (
  SELECT *, coalesce(sum(source_size) OVER o, 0) AS size_before, coalesce(sum(weight) OVER o, 0) AS weight_before,
         row_number() OVER (ORDER BY source_size * 1.0 / weight, place) AS turn
  FROM w WINDOW o AS (ORDER BY source_size * 1.0 / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT turn AS from_turn, {num} * total - {den * most} * size_before AS remaining, {den} * (heavy - weight_before) AS over FROM f
  WHERE {den * most} * source_size * (heavy - weight_before) >= ({num} * total - {den * most} * size_before) * weight ORDER BY turn LIMIT 1
), t AS (
  SELECT source, source_size, turn < from_turn AS held,
         CASE WHEN turn < from_turn THEN CAST({most} * source_size AS DOUBLE) ELSE CAST(remaining * weight AS DOUBLE) / CAST(over AS DOUBLE) END AS target,
         CAST(CASE WHEN turn < from_turn THEN {most} * source_size ELSE (remaining * weight) // over END AS BIGINT) AS budget FROM f, level
), k AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, budget, t.source
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT *, budget - epochs * source_size AS rest, CAST('0x' || substr(md5('{seed}|' || epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM k
), r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o
)
SELECT doc_id, source AS mix_source, size, source_size, target, CAST(epochs AS BIGINT) AS epochs,
       CAST(epochs * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken FROM r
"""


def hard_negatives(positives: int, negatives: int, low: int, high: int) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {negatives}
"""
