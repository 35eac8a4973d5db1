"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':11'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM s),
lv AS (
  SELECT *, (total - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level
  FROM w WINDOW r AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT (SELECT level FROM lv WHERE w * level < cap ORDER BY cap / w, source IS NULL, encode(source) LIMIT 1) AS common),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, w * common) END AS target FROM lv, c),
f AS (  -- words of each size class: the size's length in bits; copies fall by half for each fourfold size
  SELECT d.source, length(bin(size)) AS klass, pow(2.0::DOUBLE, -floor(length(bin(size))::DOUBLE / 2)) AS a, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
g AS (
  SELECT f.*, t.target, (t.target - coalesce(sum(words) OVER r, 0) * 2.0::DOUBLE) / (sum(words * a) OVER (PARTITION BY f.source) - coalesce(sum(words * a) OVER r, 0)) AS c
  FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source WINDOW r AS (PARTITION BY f.source ORDER BY klass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, min(CASE WHEN c * a < 2.0 THEN klass END) OVER (PARTITION BY source) AS k0 FROM g),
e AS (
  SELECT h.source, h.klass, h.words, CASE WHEN h.klass >= h.k0 THEN greatest(0.0, b.c * h.a) ELSE 2.0::DOUBLE END AS n
  FROM h LEFT JOIN h b ON h.source IS NOT DISTINCT FROM b.source AND b.klass = h.k0),
p AS (SELECT source, klass, words, floor(n)::BIGINT AS whole, n - floor(n) AS p FROM e),
x AS (SELECT source, sum(whole * words)::BIGINT AS certain FROM p GROUP BY source),
j AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, t.target - coalesce(x.certain, 0) AS rest, coalesce(p.whole, 0) AS whole, p.p,
         CASE WHEN p.p > 0 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p)) END AS q
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM t.source
  LEFT JOIN p ON p.source IS NOT DISTINCT FROM t.source AND d.size > 0 AND p.klass = length(bin(d.size))),
o AS (
  SELECT source, q, sum(size) OVER (PARTITION BY source ORDER BY q, size ROWS UNBOUNDED PRECEDING) AS upto, size, rest
  FROM j WHERE q IS NOT NULL),
k AS (SELECT source, max(q) AS cut FROM o WHERE upto - size < rest AND abs(upto - rest) <= abs(upto - size - rest) GROUP BY source)
SELECT j.doc_id, j.size, j.source_size, j.target, ((j.whole + CASE WHEN j.q <= k.cut THEN 1 ELSE 0 END) * j.size)::BIGINT AS taken
FROM j LEFT JOIN k ON j.source IS NOT DISTINCT FROM k.source
"""


def op1_sql(depth: int = 32, support: int = 20, z: float = 1.96, m: float = 10.0) -> str:
    """The template tree, one step of the recursion a level; a row leaves it when its template is complete."""
    differs = lambda b, n, ab, an, tests: f"""CASE WHEN {an} > {n} AND {ab} > 0 AND {ab} < {an} AND
      pow({b}::DOUBLE / {n} - ({ab} - {b})::DOUBLE / ({an} - {n}), 2) >= ({z * z}::DOUBLE + 2 * ln({tests}::DOUBLE)) * ({ab}::DOUBLE / {an}) * (1 - {ab}::DOUBLE / {an}) * (1::DOUBLE / {n} + 1::DOUBLE / ({an} - {n}))
      THEN CASE WHEN {b}::DOUBLE / {n} - ({ab} - {b})::DOUBLE / ({an} - {n}) > 0 THEN '+' ELSE '-' END ELSE '' END"""  # noqa: E731
    sums = lambda by, p: ", ".join(f"(sum({c}) OVER (PARTITION BY {by}))::BIGINT AS {p}{c[0]}" for c in ("n", "labelled", "bad"))
    out = [f"""
WITH RECURSIVE lab AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END)::BIGINT AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[0-9a-fA-F-]{{16,}}$', '{{h}}'), '[0-9]+', '{{n}}', 'g')) AS parts FROM u),
r AS (SELECT s.*, lab.bad, CASE WHEN len(parts) > {depth} THEN parts[:{depth}] || [array_to_string(parts[{depth + 1}:], '/')] ELSE parts END AS segs FROM s LEFT JOIN lab ON page_id = doc_id),
g AS (SELECT host, segs, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0)::BIGINT AS bad FROM r GROUP BY host, segs),
o AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad)::DOUBLE / sum(labelled)::DOUBLE ELSE 0 END AS overall FROM g),
h AS (SELECT host AS hh, (sum(bad)::DOUBLE + {m} * any_value(overall)) / (sum(labelled)::DOUBLE + {m}) AS purity FROM g, o GROUP BY host),
t AS (
  SELECT host, segs, n, labelled, bad, purity, host AS node, true AS open, 1 AS d FROM g JOIN h ON host = hh
  UNION ALL
  SELECT host, segs, n, labelled, bad,
         CASE WHEN settled OR tk = 0 THEN purity ELSE (gb::DOUBLE + {m} * purity) / (gl::DOUBLE + {m}) END,
         CASE WHEN settled THEN node || '/**' WHEN together = 1 AND (s2 <> '' OR kids = 1) THEN node || '/' || seg ELSE node || '/*' || s2 END, NOT settled AND seg <> '$', d + 1
  FROM (SELECT *, {sums("node, s2", "g")}, count(DISTINCT seg) OVER (PARTITION BY node, s2) AS together, count(DISTINCT seg) OVER (PARTITION BY node) AS kids, count(CASE WHEN s2 <> '' THEN 1 END) OVER (PARTITION BY node) AS tk FROM (
    SELECT *, CASE WHEN s1 = '' THEN '' ELSE s1 || {differs("kb", "kl", "sb", "sl", "m2")} END AS s2 FROM (
    SELECT *, {sums("node, s1", "s")}, count(DISTINCT seg) OVER (PARTITION BY node, s1) AS m2 FROM (
    SELECT *, CASE WHEN able AND NOT settled THEN {differs("kb", "kl", "wb", "wl", "m1")} ELSE '' END AS s1 FROM (
    SELECT *, wb = 0 OR wb = wl OR wn < {2 * support} AS settled, count(DISTINCT CASE WHEN able THEN seg END) OVER (PARTITION BY node) AS m1 FROM (
    SELECT *, kn >= {support} AND kl > 0 AS able FROM (
    SELECT *, {sums("node, seg", "k")}, {sums("node", "w")} FROM (SELECT *, coalesce(segs[d], '$') AS seg FROM t WHERE open)))))))))"""]
    rules = [("block", "net/fr/"), ("block", "net/es/"), ("allow", "www.example.com/en/"), ("block", "example.com/en/"), ("allow", "com/")]
    rules.sort(key=lambda x: -len(x[1]))
    fits = [(a, x, "(r.host = '{0}' OR suffix(r.host, '.{0}')) AND prefix(r.path, '/{1}')".format(*x.split("/", 1))) for a, x in rules]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    return ",".join(out) + f"""
SELECT page_id, r.host, r.path, {case(1)} AS rule, coalesce({case(0)}, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       regexp_replace(node, '/\\$$', '') AS template, purity
FROM r JOIN t ON r.host = t.host AND r.segs = t.segs AND NOT t.open"""


#: The main text as it lies in these pages: the article element, a line for each paragraph or heading.
OP2 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), '</?b>', '', 'g') AS h FROM pages),
l AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(p|h1|br)>'), lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS lines FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text FROM l)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

OP4 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h,
         translate(array_to_string(list_transform(range(8), lambda i: lpad(to_base(('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT, 32), 4, '0')), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN NULL ELSE min(page_id) OVER (PARTITION BY h) END AS refers_to
FROM d
"""

OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_templates": op1_sql(), "op2_html_extraction": OP2, "op4_warc_bundles": OP4, "op7_pareto_mix": OP7, "op8_kdtree_topk": OP8}
