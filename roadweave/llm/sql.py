"""SQL twins (DuckDB) of the queries that SQL can express, written for checking, not for scale."""

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(t=LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)
),
n AS (SELECT d.doc_id, count(s.k) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS doc, doc_id AS c FROM documents UNION SELECT r.doc, sym.b FROM r JOIN sym ON sym.a = r.c),
m AS (SELECT doc, min(c) AS c FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m ON m.doc = n.doc_id
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8))
  QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM dup) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (
  SELECT d.doc_id, d.source, CAST(len(d.w) AS BIGINT) AS n_words, CAST(length(array_to_string(d.w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS x FROM f GROUP BY 1),
m AS (SELECT avg(x / n) AS m, var_pop(x / n) AS v FROM h),
q AS (SELECT m, least(1000.0, greatest(1.0, coalesce(m * (1 - m) / nullif(v, 0) - 1, 1000.0))) AS s FROM m),
r AS (SELECT h.source, (x + m * s) / (n + s) AS shrunk_rate FROM h, q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.shrunk_rate <= 0.5 AS kept, round(shrunk_rate, 9) AS shrunk_rate, r.shrunk_rate > 0.5 AS host_rejected
FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
t AS (SELECT b, max(page_id) AS top FROM p WHERE octet_length(b) >= 1000 GROUP BY 1),
r AS (SELECT p.page_id, p.b, CASE WHEN t.top <> p.page_id OR p.page_id IS NULL THEN t.top END AS refers_to FROM p LEFT JOIN t ON t.b = p.b)
SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

def _runs(length: int, p: str) -> str:
    """Common table expressions: windows of ``length`` bytes that start twice, joined to maximal runs [lo, hi) of each document (from 1)."""
    return f"""
{p}w AS (SELECT doc_id, s, md5(b[s:s + {length - 1}]) AS h FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - {length - 1})) AS s FROM d WHERE octet_length(b) >= {length})),
{p}c AS (SELECT h FROM {p}w GROUP BY 1 HAVING count(*) > 1),
{p}x AS (SELECT w.doc_id, w.s, CASE WHEN w.s - lag(w.s) OVER (PARTITION BY w.doc_id ORDER BY w.s) <= {length} THEN 0 ELSE 1 END AS fresh FROM {p}w w JOIN {p}c c ON c.h = w.h),
{p}g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM {p}x),
{p} AS (SELECT doc_id, span, min(s) AS lo, max(s) + {length} AS hi FROM {p}g GROUP BY 1, 2)"""


OP6 = rf"""
WITH d AS (SELECT doc_id, text AS t, encode(coalesce(text, '')) AS b FROM documents),
{_runs(400, "p")},
{_runs(200, "q")},
k AS (SELECT p.doc_id, lo, hi, lag(hi, 1, CAST(1 AS BIGINT)) OVER (PARTITION BY p.doc_id ORDER BY lo) AS behind FROM p),
piece AS (
  SELECT k.doc_id, k.behind, hex(d.b[k.behind:k.lo - 1]) AS v FROM k JOIN d ON d.doc_id = k.doc_id WHERE k.lo > k.behind
  UNION ALL SELECT e.doc_id, e.hi, hex(d.b[e.hi:octet_length(d.b)]) FROM (SELECT doc_id, max(hi) AS hi FROM p GROUP BY 1) e JOIN d ON d.doc_id = e.doc_id WHERE e.hi <= octet_length(d.b)
),
kept AS (SELECT doc_id, string_agg(v, '' ORDER BY behind) AS v FROM piece GROUP BY 1),
sums AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM p GROUP BY 1),
step AS (
  SELECT doc_id, i, octet_length(encode(x)) AS n, octet_length(encode(ltrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS m
  FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+') AS l FROM d))
),
word AS (SELECT doc_id, m, sum(n) OVER (PARTITION BY doc_id ORDER BY i) + 1 AS behind FROM step),
found AS (SELECT q.doc_id, q.lo, q.hi FROM q JOIN word ON word.doc_id = q.doc_id AND word.behind - word.m >= q.lo AND word.behind <= q.hi GROUP BY 1, 2, 3 HAVING count(*) > 50),
passages AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_passage_bytes, count(*) AS n_passages FROM found GROUP BY 1)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(d.b) ELSE sha256(unhex(coalesce(kept.v, ''))) END AS kept_sha256,
  coalesce(n_passage_bytes, 0) AS n_passage_bytes, coalesce(n_passages, 0) AS n_passages
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN passages ON passages.doc_id = d.doc_id
"""


def _fills(n: int) -> str:
    """The documents that close the gap of each source, one after the other, and all of them as ``f``."""
    same = "k.doc_id IS NOT DISTINCT FROM {0}.doc_id AND k.of_text = {0}.of_text AND k.nth = {0}.nth"
    out = ["g0 AS (SELECT source, gap, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS of_text, CAST(NULL AS BIGINT) AS nth FROM g)"]
    for i in range(1, n + 1):
        fits = "k.size <= g.gap" if i < n else "true"
        taken = " ".join(f"AND NOT EXISTS (FROM g{j} WHERE g{j}.source IS NOT DISTINCT FROM k.source AND {same.format(f'g{j}')})" for j in range(1, i))
        out.append(f"""b{i} AS (
  SELECT k.source, g.gap - k.size AS gap, k.doc_id, k.of_text, k.nth FROM k JOIN g{i - 1} g ON g.source IS NOT DISTINCT FROM k.source
  WHERE open AND NOT extra AND {fits} AND abs(g.gap - k.size) < g.gap {taken}
  QUALIFY row_number() OVER (PARTITION BY k.source ORDER BY abs(g.gap - k.size), odds, k.doc_id NULLS FIRST, k.of_text, k.nth) = 1
),
g{i} AS (SELECT g.source, coalesce(b.gap, g.gap) AS gap, b.doc_id, b.of_text, b.nth FROM g{i - 1} g LEFT JOIN b{i} b ON b.source IS NOT DISTINCT FROM g.source)""")
    every = " UNION ALL ".join(f"SELECT source, doc_id, of_text, nth FROM g{i} WHERE nth IS NOT NULL" for i in range(1, n + 1))
    return ",\n".join([*out, f"f AS ({every}),"])


OP8 = f"""
WITH z AS (SELECT doc_id, source, CAST(len({WORDS.format(t="coalesce(text, '')")}) AS BIGINT) AS size, md5(coalesce(text, '')) AS of_text FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS weight, row_number() OVER (PARTITION BY doc_id, source, of_text) AS nth FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM w),
b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT *, (total - caps) / (all_w - ws) AS level FROM b),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)), cap) AS target FROM l),
c AS (SELECT source, weight, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
v AS (
  SELECT c.*, t.source_size, t.target,
    (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(CAST(sum(words * weight) OVER (PARTITION BY c.source ORDER BY weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 0) AS level
  FROM c JOIN t ON t.source IS NOT DISTINCT FROM c.source
),
m AS (SELECT source, arg_max(level, weight) FILTER (level * weight <= 2.0) AS level FROM v GROUP BY 1),
e AS (
  SELECT v.* EXCLUDE (level), CASE WHEN words = 0 THEN 0.0::DOUBLE WHEN m.level IS NULL THEN 2.0 ELSE least(2.0, m.level * weight) END AS e
  FROM v JOIN m ON m.source IS NOT DISTINCT FROM v.source
),
q AS (SELECT *, CAST(floor(e + 1e-9) AS BIGINT) AS whole, e - floor(e + 1e-9) AS part FROM e),
plan AS (SELECT *, CASE WHEN part > 1e-9 THEN part END AS p, target - sum(whole * words) OVER (PARTITION BY source) AS rest FROM q),
x AS (
  SELECT d.*, plan.source_size, plan.target, plan.whole, plan.p, plan.rest,
    (CAST('0x' || substr(md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(d.source, '~'), of_text, CAST(nth AS VARCHAR))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN plan ON plan.source IS NOT DISTINCT FROM d.source AND plan.weight = d.weight
),
y AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds, p IS NOT NULL AND size > 0 AS open FROM x),
k AS (
  SELECT *, open AND sum(CASE WHEN open THEN size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS FIRST, of_text, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS extra
  FROM y
),
g AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (extra), 0) AS gap FROM k GROUP BY 1),
{_fills(8)}
n AS (
  SELECT k.*, whole + CAST(extra OR f.nth IS NOT NULL AS BIGINT) AS copies
  FROM k LEFT JOIN f ON f.source IS NOT DISTINCT FROM k.source AND f.doc_id IS NOT DISTINCT FROM k.doc_id AND f.of_text = k.of_text AND f.nth = k.nth
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, weight FROM n
"""


def _url_level(k: int) -> str:
    """Templates one segment longer: variable and rare segments become ``*``."""
    x = f"parts[{k + 1}]"
    variable = (
        f"regexp_matches({x}, '^([0-9][0-9._-]*|[0-9a-fA-F]{{8,}}|[0-9a-fA-F]{{8}}-[0-9a-fA-F-]{{27}})(\\.[A-Za-z]{{1,5}})?$')"
        f" OR (regexp_matches({x}, '^[0-9A-Za-z_%-]{{5,}}(\\.[A-Za-z]{{1,5}})?$') AND regexp_matches({x}, '^[^.]*[0-9]'))"
    )
    return f"""
s{k} AS (SELECT *, CASE WHEN len(parts) > {k} THEN CASE WHEN {variable} THEN '*' ELSE {x} END END AS seg FROM r{k}),
n{k} AS (SELECT host, template, seg, sum(n) AS rows_n FROM s{k} WHERE seg IS NOT NULL GROUP BY 1, 2, 3),
p{k} AS (SELECT *, sum(rows_n) OVER w AS all_n, count(*) OVER w AS children FROM n{k} WINDOW w AS (PARTITION BY host, template)),
r{k + 1} AS (
  SELECT s.host, s.path, s.n, s.allow, s.block, s.parts,
    s.template || CASE WHEN s.seg IS NULL THEN '' WHEN children <= 12 OR (rows_n >= 30 AND rows_n >= 0.02 * all_n) THEN '/' || s.seg ELSE '/*' END AS template
  FROM s{k} s LEFT JOIN p{k} p ON p.host = s.host AND p.template = s.template AND p.seg = s.seg
),"""


def _url_rules() -> str:
    """The rule that decides a url, the longest first."""
    rules = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for h, p, v in rules]
    return "CASE " + " ".join(fits) + " END"


OP10 = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
g AS (SELECT *, {_url_rules()} AS given FROM u),
r0 AS (
  SELECT host, path, count(*) AS n, count(*) FILTER (given.verdict = 'allow') AS allow, count(*) FILTER (given.verdict = 'block') AS block,
    list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, '' AS template
  FROM g GROUP BY host, path
),
{"".join(map(_url_level, range(6)))}
t AS (SELECT host, path, n, allow, block, template || CASE WHEN len(parts) > 6 THEN '/**' ELSE '' END AS template FROM r6),
labelled AS (SELECT host, template, sum(n) AS n, sum(allow) AS allow, sum(block) AS block, string_split(template, '/') AS parts FROM t GROUP BY host, template),
lv AS (
  SELECT host, template, n, allow, block, i - 1 AS level, parts[i] AS seg, array_to_string(parts[1:i - 1], '/') AS parent, array_to_string(parts[i + 1:], '/') AS below
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM labelled)
),
node AS (SELECT host, level, parent, seg, sum(n) AS n, sum(allow + block) AS labels, sum(block) AS block FROM lv GROUP BY 1, 2, 3, 4),
shape AS (SELECT host, level, parent, seg, below, sum(n) AS of_n FROM lv WHERE level > 0 AND seg NOT IN ('*', '**') GROUP BY 1, 2, 3, 4, 5),
sized AS (SELECT *, sum(of_n) OVER (PARTITION BY host, level, parent, seg) AS n FROM shape),
profile AS (SELECT host, level, parent, seg, string_agg(below, ' ' ORDER BY below) AS profile FROM sized WHERE of_n >= 0.1 * n GROUP BY 1, 2, 3, 4),
shaped AS (SELECT sized.*, profile FROM sized JOIN profile USING (host, level, parent, seg)),
pooled AS (SELECT host, level, parent, profile, below, sum(of_n) AS pool_n FROM shaped GROUP BY 1, 2, 3, 4, 5),
pools AS (SELECT *, sum(pool_n) OVER w AS all_n, count(*) OVER w - 1 AS df FROM pooled WINDOW w AS (PARTITION BY host, level, parent, profile)),
chi AS (
  SELECT host, level, parent, seg, profile, any_value(n) AS n, any_value(df) AS df, sum(CAST(of_n AS DOUBLE) * of_n / (pool_n / all_n)) AS q
  FROM shaped JOIN pools USING (host, level, parent, profile, below) GROUP BY 1, 2, 3, 4, 5
),
alike AS (SELECT chi.host, chi.level, chi.parent, seg, profile, labels, block FROM chi JOIN node USING (host, level, parent, seg) WHERE q / chi.n - chi.n <= df + 1.96 * sqrt(2 * df) + 1e-6),
rated AS (SELECT *, sum(block) OVER w / nullif(sum(labels) OVER w, 0) AS rate FROM alike WINDOW w AS (PARTITION BY host, level, parent, profile)),
tested AS (SELECT * FROM rated WHERE labels = 0 OR abs(block / labels - rate) / sqrt(greatest(rate * (1 - rate), 1e-9) / labels) < 1.96),
merged AS (
  SELECT host, level, parent, seg, sum(block) OVER w AS m_block, sum(labels) OVER w AS m_labels FROM tested
  WINDOW w AS (PARTITION BY host, level, parent, profile) QUALIFY count(*) OVER w > 1
),
way AS (
  SELECT lv.host, lv.template, lv.level, CASE WHEN m_labels IS NULL THEN lv.seg ELSE '+' END AS shown, coalesce(m_block, node.block) AS b, coalesce(m_labels, node.labels) AS n
  FROM lv JOIN node USING (host, level, parent, seg) LEFT JOIN merged USING (host, level, parent, seg)
),
beyond AS (
  SELECT host, template, level, shown, greatest(0, b - coalesce(lead(b) OVER w, 0)) AS b, greatest(0, n - coalesce(lead(n) OVER w, 0)) AS n FROM way
  WINDOW w AS (PARTITION BY host, template ORDER BY level)
),
down AS (
  SELECT host, template, 0 AS level, (b + 0.5::DOUBLE * 2) / (n + 2) AS purity FROM beyond WHERE level = 0
  UNION ALL
  SELECT x.host, x.template, d.level + 1, (x.b + d.purity * 2) / (x.n + 2) FROM down d JOIN beyond x ON x.host = d.host AND x.template = d.template AND x.level = d.level + 1
),
judged AS (SELECT host, template, arg_max(purity, level) AS purity FROM down GROUP BY 1, 2),
branches AS (SELECT host, template, string_agg(shown, '/' ORDER BY level) AS branch FROM way GROUP BY 1, 2)
SELECT g.page_id, g.host, g.path, g.given.rule AS rule, coalesce(g.given.verdict, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, t.template, branch, round(purity, 9) AS purity
FROM g JOIN t ON t.host = g.host AND t.path = g.path JOIN judged j ON j.host = t.host AND j.template = t.template JOIN branches x ON x.host = t.host AND x.template = t.template
"""
