"""DuckDB statements with the same results as the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import CLOSINGS, ENDS, LineRules

ORACLES: dict[str, str] = {}

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op3_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {BLANK}), {LOWER}) AS k FROM lines
), hot AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY doc_id
"""

ORACLES["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


def _url_filter(order: int = 4, folds: int = 5, unit: str = "1000000000") -> str:
    """The url filter: rules, back-off tables of each order, the calibrated threshold."""
    ranked = [("example.com/de/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), ("net/", "block")]
    fits = [f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN" for r, _ in ranked]
    rule = "CASE " + " ".join(f"{f} '{r}'" for f, (r, _) in zip(fits, ranked, strict=True)) + " END"
    said = "CASE " + " ".join(f"{f} '{v}'" for f, (_, v) in zip(fits, ranked, strict=True)) + " END"
    parts = [
        "u AS (SELECT DISTINCT url FROM pages)",
        "h AS (SELECT url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u)",
        f"hp AS (SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h)",
        f"r AS MATERIALIZED (SELECT url, host, path, {rule} AS rule, {said} AS said FROM hp)",
        f"k AS (SELECT url, said, said IS NOT NULL AND CAST('0x' || substr(md5(coalesce(url, '')), 1, 7) AS BIGINT) % {folds} = 0 AS held, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE url END, '') AS txt FROM r)",
        f"g AS MATERIALIZED (SELECT url, said, held, substr(repeat(chr(2), {order}) || txt || chr(3), pos, {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(txt) + 2)) AS pos FROM k))",
        f"c{order} AS MATERIALIZED (SELECT gram, coalesce(count_if(said = 'allow' AND NOT held), 0) AS a, coalesce(count_if(said = 'block' AND NOT held), 0) AS b FROM g GROUP BY gram)",
    ]
    parts += [f"c{k} AS MATERIALIZED (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM c{k + 1} GROUP BY 1)" for k in range(order - 1, -1, -1)]
    parts += [f"x{k} AS MATERIALIZED (SELECT substr(gram, 1, {k}) AS ctx, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM c{k} GROUP BY 1)" for k in range(order + 1)]
    mixed = lambda s, below: f"CASE WHEN n{s} + t{s} > 0 THEN (c.{s} + t{s} * {below}) / (n{s} + t{s}) ELSE {below} END AS p{s}"
    flat = f"(SELECT 1.0e0 / greatest(1, count(DISTINCT substr(gram, {order + 1}, 1))) FROM c{order})"
    parts.append(f"p0 AS MATERIALIZED (SELECT c.gram, {mixed('a', flat)}, {mixed('b', flat)} FROM c0 c JOIN x0 ON x0.ctx = '')")
    for k in range(1, order + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT c.gram, {mixed('a', 'l.pa')}, {mixed('b', 'l.pb')} FROM c{k} c JOIN x{k} x ON x.ctx = substr(c.gram, 1, {k}) JOIN p{k - 1} l ON l.gram = substr(c.gram, 2))")
    parts += [
        f"m AS (SELECT gram, CAST(round((ln(pa) - ln(pb)) * {unit}) AS BIGINT) AS ratio FROM p{order})",
        "s AS MATERIALIZED (SELECT url, said, sum(ratio) / count(*) AS score FROM g JOIN m USING (gram) WHERE said IS NULL OR held GROUP BY url, said)",
        "f AS (SELECT avg(score) FILTER (said = 'allow') AS ma, avg(score) FILTER (said = 'block') AS mb, stddev_pop(score) FILTER (said = 'allow') AS sa, stddev_pop(score) FILTER (said = 'block') AS sb FROM s)",
        "t AS (SELECT round(coalesce(CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) END, (ma + mb) / 2, 0)) AS threshold, (SELECT count(DISTINCT said) FROM k WHERE said IS NOT NULL AND NOT held) < 2 AS untrained FROM f)",
    ]
    return "WITH " + ",\n".join(parts) + """
SELECT page_id, host, path, rule, coalesce(r.said, CASE WHEN untrained OR score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM pages JOIN r ON r.url IS NOT DISTINCT FROM pages.url CROSS JOIN t LEFT JOIN s ON s.url IS NOT DISTINCT FROM pages.url AND s.said IS NULL"""


ORACLES["op7_url_filter"] = _url_filter()

#: Earliest deadline first over the windows of each kind of cycle, one slot a step of the recursion.
ORACLES["op5_source_mix"] = """
WITH RECURSIVE s AS (SELECT coalesce(source, chr(0)) AS nm, count(*) AS n FROM documents GROUP BY 1),
w AS MATERIALIZED (SELECT nm, n, greatest(1, CAST(round(500 * pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM s)) AS BIGINT)) AS k, (n + 15) // 16 AS nb FROM s),
kinds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c0) - 1 AS kind, c0 FROM (SELECT 0 AS c0 UNION SELECT nb // k FROM w UNION SELECT nb // k + 1 FROM w)),
b AS MATERIALIZED (SELECT kind, c0, nm, k, greatest(least(nb - c0 * k, k), 0) AS b, least(nb, c0 * k) AS bef FROM kinds CROSS JOIN w),
z AS MATERIALIZED (SELECT kind, CAST(sum(b) AS BIGINT) AS size, CAST(sum(bef) AS BIGINT) AS base FROM b GROUP BY kind HAVING sum(b) > 0),
own AS (SELECT *, unnest(range(b)) AS j FROM b),
jobs AS MATERIALIZED (
  SELECT x.kind, x.nm, x.j, sum(least(o.b * x.k, o.k * x.j)) // any_value(x.k) AS rel, 
    CAST(ceil(sum(least(o.b * x.k, o.k * (x.j + 1))) / any_value(x.k)) AS BIGINT) AS due
  FROM own x JOIN b o ON o.kind = x.kind GROUP BY x.kind, x.nm, x.j),
sim AS (
  SELECT kind, CAST(-1 AS BIGINT) AS t, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS pick, size FROM z
  UNION ALL
  SELECT q.kind, q.t + 1, list_append(q.done, q.p), q.p, q.size FROM (
    SELECT sim.kind, sim.t, sim.done, sim.size, arg_min(jobs.nm || '|' || jobs.j, {'d': jobs.due, 'n': jobs.nm, 'j': jobs.j}) AS p
    FROM sim JOIN jobs ON jobs.kind = sim.kind WHERE sim.t + 1 < sim.size AND jobs.rel <= sim.t + 1 AND NOT list_contains(sim.done, jobs.nm || '|' || jobs.j)
    GROUP BY sim.kind, sim.t, sim.done, sim.size) q
),
ranked AS (SELECT doc_id, source, coalesce(source, chr(0)) AS nm, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS i FROM documents),
placed AS (SELECT r.doc_id, r.source, r.nm, r.i, r.i // 16 // w.k AS c, r.i // 16 - (r.i // 16 // w.k) * w.k AS j, (SELECT max(kind) FROM kinds WHERE c0 <= r.i // 16 // w.k) AS kind FROM ranked r JOIN w USING (nm))
SELECT doc_id, source, CAST((z.base + (p.c - kinds.c0) * z.size + sim.t) * 16 + p.i % 16 AS BIGINT) AS position
FROM placed p JOIN z USING (kind) JOIN kinds USING (kind) JOIN sim ON sim.kind = p.kind AND sim.pick = p.nm || '|' || p.j
"""


def _quality_rules(rules: LineRules = LineRules()) -> str:
    word = r"'[^\x20\x09-\x0D]+'"
    bars = "['|', '||', '»', '«', '›', '‹', '•', '·', '>', '<', '>>', '<<', '/', '→']"
    phrases = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in rules.boilerplate) + "]"
    closings = "".join("\\" + c if c in "]" else "''" if c == "'" else c for c in CLOSINGS)
    end = f"'[{ENDS}][{closings}]*(?:[\\x20\\x09-\\x0D]|$)'"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, {word}) AS w FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
j AS (SELECT doc_id, len(w) AS n,
    NOT regexp_matches(line, {end})
    OR (len(list_filter(w, lambda x: list_contains({bars}, x))) >= 3 AND len(list_filter(w, lambda x: list_contains({bars}, x))) >= {rules.max_separator_share} * len(w))
    OR (len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) >= {rules.max_symbol_share} * len(w))
    OR (len(w) >= 5 AND (len(list_filter(w, lambda x: ends_with(x, '!'))) >= {rules.max_loud_share} * len(w) OR len(regexp_extract_all(line, '\\p{{Lu}}')) > {rules.max_loud_share} * len(regexp_extract_all(line, '\\p{{L}}'))))
    OR (len(w) >= 20 AND len(list_distinct(w)) < {rules.min_distinct_share} * len(w))
    OR (len(w) <= {rules.boilerplate_words} AND len(list_filter({phrases}, lambda x: contains(lower(line), x))) > 0) AS fails
  FROM l WHERE len(w) > 0),
f AS (SELECT doc_id, CAST(count(*) FILTER (fails) AS BIGINT) AS n_failed_lines, CAST(coalesce(sum(n) FILTER (fails), 0) AS BIGINT) AS n_lost_words FROM j GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, {word}))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, {word})))) AS n_dup_lines,
    coalesce(inside.n, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_lost_words, 0) AS n_lost_words
  FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AND n_lost_words <= {rules.max_lost_share} * n_words AS kept, n_failed_lines, n_lost_words FROM b"""


ORACLES["op1_quality_rules"] = _quality_rules()
