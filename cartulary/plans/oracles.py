"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN, STOP, TOKENS

ACTS = r"""acts AS (
  SELECT doc_id AS i, doc_id::VARCHAR AS id_archivo, 'DISP-' || upper(source) AS code, (doc_id % 50 + 1)::VARCHAR || '/' || (2024 + doc_id % 3)::VARCHAR AS number, 2024 + doc_id % 3 AS year,
         DATE '2024-01-01' + (doc_id % 700)::INT AS act_date, strftime(DATE '2024-01-01' + (doc_id % 700)::INT, '%d/%m/%Y') AS fecha_acto, lang AS section,
         CASE WHEN doc_id % 7 <> 0 THEN 'https://portal.example/' || doc_id::VARCHAR END AS url, ['alta', 'media', 'baja'][(doc_id % 3 + 1)::INT] AS confidence, string_split(text, chr(10))[1] AS title, text
  FROM documents)"""
LINES = r"""lines AS (
  SELECT doc_id, (p - 1)::INT AS ord, s[p] AS line, ['Visto', 'Considerando', 'Que sigue', 'Parte resolutiva', 'Artículo n', 'Firmas', 'PROGRAMA', 'ANEXO I'][((p - 1) % 8 + 1)::INT] AS heading
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(p))"""
CATALOG = ACTS + r""", catalog AS (SELECT a.*, i % 5 <> 0 AS downloaded, i % 5 <> 0 AND i IN (SELECT doc_id FROM labels) AS indexed FROM acts a)"""
MESSAGES = r"""messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn, conv_id % 17 AS user_id, role, text,
         CASE WHEN role = 'assistant' THEN CASE (conv_id * 1000 + turn) % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 END END AS useful,
         CASE WHEN role <> 'assistant' THEN NULL WHEN (conv_id * 1000 + turn) % 4 = 0 THEN '[]' WHEN (conv_id * 1000 + turn) % 4 = 1 THEN NULL
              ELSE '[{"cita":"Disposición ' || ((conv_id * 1000 + turn) % 50)::VARCHAR || ' — Artículo 1"},{"cita":"Resolución ' || ((conv_id * 1000 + turn) % 7)::VARCHAR || '"}]' END AS sources
  FROM conversations)"""


def fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def tokens(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    ok = lambda t: f"length({t}) >= 2 AND NOT list_contains([{stop}], {t})"
    raw = f"list_filter(list_transform(regexp_extract_all({x}, '{TOKENS}'), lambda m: regexp_replace({fold('m')}, '\\s+', '', 'g')), lambda m: {ok('m')})"
    return f"flatten(list_transform({raw}, lambda t: CASE WHEN regexp_matches(t, '[:/]') THEN [t] || list_filter(string_split_regex(t, '[:/]'), lambda p: {ok('p')}) ELSE [t] END))"


def kind(t: str, after: str = "false") -> str:
    n = r"(?i)^(universidad nacional|rep[uú]blica argentina|p[aá]gina\s*\d|fecha\s*:|lugar de entrega\s*:|expediente\s*n?[°º]?\s*:|ap proveedor|\d+\s*/\s*\d+\s*$)"
    x = f"lower(trim({t}))"
    return (
        f"CASE WHEN {x} IN ('firmas', 'hoja de firmas') THEN 'firmas' WHEN prefix({x}, 'anexo') THEN 'anexo' WHEN {after} THEN CASE WHEN regexp_matches(trim({t}), '{n}') THEN 'ruido' ELSE 'anexo' END "
        f"WHEN prefix({x}, 'artículo') OR prefix({x}, 'articulo') THEN 'articulo' WHEN contains({x}, 'visto') THEN 'visto' WHEN contains({x}, 'considerando') OR {x} = 'que' OR prefix({x}, 'que ') THEN 'considerando' "
        f"WHEN contains({x}, 'resolutiva') OR contains({x}, 'dispositiva') THEN 'parte_resolutiva' ELSE 'otra' END"
    )


def bm25(k: int, asked: str = "SELECT item_id AS q, text FROM benchmark") -> str:
    return f"""tok AS (SELECT doc_id AS i, {tokens("text")} AS t FROM documents),
len AS (SELECT i, len(t) AS len FROM tok), st AS (SELECT count(*) AS n, avg(len) AS avg FROM len),
post AS (SELECT token, i, count(*) AS tf FROM (SELECT i, unnest(t) AS token FROM tok) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT q, token, count(*) AS qtf FROM (SELECT q, unnest({tokens("text")}) AS token FROM ({asked})) GROUP BY ALL),
sc AS (SELECT q, i, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score
  FROM qt JOIN df USING (token) JOIN post USING (token) JOIN len USING (i), st GROUP BY q, i),
lex AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i)::INT AS rank FROM sc QUALIFY rank <= {k})"""


COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (greatest(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-9) * greatest(sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-9)), 6)"
METRICS = "count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r8, round(avg(CASE WHEN rank <= 10 THEN 1::DOUBLE / rank ELSE 0 END), 6) AS mrr10, round(avg(CASE WHEN rank <= 10 THEN 1::DOUBLE / log2(1 + rank) ELSE 0 END), 6) AS ndcg10, count(*) FILTER (rank IS NULL) AS not_found"


def oracle_sql() -> dict[str, str]:
    a, ln, m, c = f"WITH {ACTS}\n", f"WITH {LINES}\n", f"WITH {MESSAGES}\n", f"WITH {CATALOG}\n"
    # places of a word: its first letters, which cannot overlap themselves, followed by the rest of it
    def at(head: str, tail: str) -> str:
        p = f"string_split(t, '{head}')"
        return f"list_filter(list_transform(range(1, len({p})), lambda k: CASE WHEN prefix({p}[k + 1] || CASE WHEN k + 1 < len({p}) THEN '{head}' ELSE '' END, '{tail}') THEN list_sum(list_transform({p}[1:k], lambda x: length(x))) + {len(head)} * (k - 1) END), lambda z: z IS NOT NULL)"

    near = " AND ".join(f"len(list_filter({p}, lambda y: abs(y - o) <= 40)) > 0" for p in ("b", "c"))
    out = {
        "src12_html_paragraphs": r"""WITH h AS (SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM pages),
          p AS (SELECT page_id, list_filter(list_transform(string_split_regex(h, '\n\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM h) SELECT page_id, (i - 1)::INT AS ord, p[i] AS paragraph FROM p, unnest(range(1, len(p) + 1)) AS u(i)""",
        "flt01_equal_filters": a + "SELECT i, section, confidence FROM acts WHERE section = 'en' AND confidence = 'alta'",
        "flt02_since": a + "SELECT i, fecha_acto FROM acts WHERE act_date >= DATE '2025-06-01'",
        "flt03_articles_only": ln + "SELECT doc_id, ord FROM lines WHERE heading = 'Artículo n'",
        "flt06_multi_get": a + "SELECT (p - 1)::INT AS pos, w AS want, number, code FROM (SELECT unnest([1, 2, 3, 4]) AS p, unnest([7, 3, 999999999, 11])::BIGINT AS w) LEFT JOIN acts ON w = i",
        "flt07_fragments_of": ln + "SELECT ord, line FROM lines WHERE doc_id = 5",
        "flt08_url_of": a + "SELECT number, arg_min(url, i) FILTER (url IS NOT NULL) AS url FROM acts GROUP BY number",
        "flt10_mentions_strict": f"SELECT doc_id, len(list_filter(a, lambda o: {near})) > 0 AS strict FROM (SELECT doc_id, {at('the', '')} AS a, {at('tha', 't')} AS b, {at('with', '')} AS c FROM (SELECT doc_id, {fold('text')} AS t FROM documents))",
        "flt11_mentions_loose": f"SELECT doc_id, {' + '.join(f'contains(t, {p!r})::INT' for p in ('the', 'that', 'with'))} >= 2 AS loose FROM (SELECT doc_id, {fold('text')} AS t FROM documents)",
        "flt13_min_length": ln + "SELECT doc_id, count(*) AS parts FROM lines WHERE length(line) >= 80 GROUP BY doc_id",
        "flt14_tables": "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 3",
        "flt15_incomplete": a + "SELECT i, coalesce(trim(lower(url)), '') IN ('', 'unknown') AS no_url, coalesce(trim(lower(code)), '') IN ('', 'unknown') AS no_code FROM acts",
        "join01_on_disk": a + "SELECT id_archivo, code, number FROM acts WHERE i IN (SELECT doc_id FROM labels)",
        "join02_override": a + "SELECT doc_id, coalesce(nullif(url, ''), source) AS origin, coalesce(nullif(section, ''), 'none') AS section FROM documents LEFT JOIN (SELECT * FROM acts WHERE confidence IN ('alta', 'media')) ON doc_id = i",
        "join03_first_key": a + "SELECT i, (min(i) OVER (PARTITION BY code, number)) AS b, 1 AS tier FROM acts",
        "join04_unique_candidate": a + r"SELECT i, id_archivo FROM (SELECT *, count(*) OVER (PARTITION BY section, upper(trim(regexp_replace(title, '\s+', ' ', 'g')))) AS n FROM acts) WHERE n = 1",
        "join06_pending_download": c + "SELECT i, id_archivo FROM catalog WHERE NOT downloaded",
        "join07_pending_index": c + "SELECT i FROM catalog WHERE downloaded AND NOT indexed",
        "join08_not_indexed": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "join10_two_tier": a + "SELECT i, CASE WHEN i % 3 = 0 THEN 'id' WHEN number IN (SELECT number FROM acts WHERE i % 4 = 1) THEN 'number' END AS via FROM acts",
        "join12_messages": m + "SELECT user_id, count(*) AS n, count(DISTINCT conv_id) AS convs FROM messages GROUP BY user_id",
        "join14_previous_user_turn": m + "SELECT id, (SELECT text FROM messages p WHERE p.conv_id = x.conv_id AND p.role = 'user' AND p.id < x.id ORDER BY p.id DESC LIMIT 1) AS question FROM messages x WHERE role = 'assistant'",
        "join16_inventory_diff": """WITH a AS (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey AS k, p_name AS n, p_size + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS s FROM part WHERE p_partkey % 7 <> 0)
          SELECT k AS part, s AS size, 'local' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, s, 'remote' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
        "join19_uncovered": "SELECT k, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT doc_id AS k, 'md' AS kind FROM documents UNION ALL SELECT doc_id, 'json' FROM labels UNION ALL SELECT vec_id, 'yaml' FROM embeddings) GROUP BY k HAVING count(DISTINCT kind) < 3",
        "agg01_size": "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT text) AS texts FROM documents",
        "agg02_coverage_date": a + "SELECT min(act_date) AS coverage_date FROM (SELECT act_date FROM acts ORDER BY act_date DESC LIMIT 6)",
        "agg03_by_section": ln + f", k AS (SELECT *, {kind('heading')} AS kind FROM lines) SELECT kind, count(*) AS fragments, count(*) FILTER (ord = 0) AS documents FROM k GROUP BY kind",
        "agg04_by_type": a + "SELECT coalesce(nullif(upper(trim(code)), ''), '(sin identificar)') AS code, count(*) AS documents FROM acts GROUP BY 1",
        "agg05_ratings": m + "SELECT count(*) AS answers, count(*) FILTER (useful = 1) AS useful, count(*) FILTER (useful = 0) AS useless FROM messages WHERE role = 'assistant'",
        "agg06_usage": "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
        "agg07_no_sources": m + "SELECT count(*) FILTER (coalesce(sources, '') IN ('', '[]')) AS n FROM messages WHERE role = 'assistant'",
        "agg08_daily_series": "WITH p AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1) SELECT u.day::DATE AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(d) FROM p)::TIMESTAMP, (SELECT max(d) FROM p)::TIMESTAMP, INTERVAL 1 DAY)) AS day) u LEFT JOIN p ON p.d = u.day::DATE",
        "agg09_most_cited": m + ", l AS (SELECT * FROM messages WHERE role = 'assistant' ORDER BY id DESC LIMIT 500), e AS (SELECT unnest(json_extract_string(sources, '$[*].cita')) AS cita FROM l) SELECT lower(trim(split_part(cita, '—', 1))) AS act, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, act LIMIT 10",
        "agg10_catalog_state": c + "SELECT count(*) AS total, count(*) FILTER (downloaded) AS downloaded, count(*) FILTER (indexed) AS indexed, count(*) FILTER (NOT downloaded) AS pending, count(*) FILTER (downloaded AND NOT indexed) AS to_index, count(*) FILTER (url IS NULL) AS no_url FROM catalog",
        "agg17_collisions": a + "SELECT code, number, count(*) AS n FROM acts GROUP BY ALL HAVING count(*) > 1",
        "agg19_missing": a + "SELECT f AS field, count(*) FILTER (v IS NULL) AS absent, count(*) FILTER (v = '') AS empty FROM (SELECT 'url' AS f, url AS v FROM acts UNION ALL SELECT 'code', code FROM acts UNION ALL SELECT 'section', section FROM acts UNION ALL SELECT 'title', title FROM acts) GROUP BY f",
        "agg20_vocabulary": "SELECT lang, count(*) AS n, lang IN ('es', 'en') AS known FROM documents GROUP BY lang",
        "agg28_metrics_by_group": f"WITH r AS (SELECT lang, source, CASE WHEN doc_id % 12 <> 0 THEN doc_id % 12 END AS rank FROM documents), b AS (SELECT lang, 'all' AS type, rank FROM r UNION ALL SELECT lang, source, rank FROM r) SELECT lang, type, {METRICS} FROM b GROUP BY lang, type",
        "agg30_mean_sd": "SELECT 'size' AS dimension, round(avg(p_size), 4) AS mean, round(stddev_samp(p_size), 4) AS sd FROM part UNION ALL SELECT 'price', round(avg(p_retailprice), 4), round(stddev_samp(p_retailprice), 4) FROM part",
        "win02_survivors": a + "SELECT code, number, i FROM acts QUALIFY row_number() OVER (PARTITION BY code, number ORDER BY url IS NULL, confidence = 'alta' DESC, i DESC) = 1",
        "win03_cap": a + "SELECT number, i FROM acts QUALIFY row_number() OVER (PARTITION BY number ORDER BY i) <= 3",
        "win04_islands": a + ", l AS (SELECT i, section, i * 7 % 50 AS c, lag(i * 7 % 50) OVER (PARTITION BY section ORDER BY i) AS p FROM acts) SELECT i, section, (sum(CASE WHEN c <= p THEN 1 ELSE 0 END) OVER (PARTITION BY section ORDER BY i))::BIGINT AS segment FROM l",
        "win05_after_signatures": ln + f", f AS (SELECT *, coalesce(bool_or(lower(heading) = 'firmas') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM lines) SELECT doc_id, ord, {kind('heading', 'after')} AS kind FROM f",
        "win06_current_annex": ln + "SELECT doc_id, ord, max(CASE WHEN prefix(lower(heading), 'anexo') THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS annex FROM lines",
        "win12_round_robin": a + ", r AS (SELECT i, section, code, row_number() OVER (PARTITION BY section, code ORDER BY md5('2026:' || i::VARCHAR), i)::INT AS round FROM acts) SELECT i, round FROM r ORDER BY round, section, code LIMIT 100",
        "win15_last_turns": m + "SELECT conv_id, id, substring(text, 1, 100) AS text FROM messages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) <= 6",
        "win18_share_of_max": "SELECT source, round(n::DOUBLE / greatest(1, max(n) OVER ()), 6) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
        "top08_modulo_shard": "SELECT doc_id, (rn - 1)::INT AS k FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents) WHERE (rn - 1) % 4 = 1",
        "set02_difference": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
        "set04_ordered_distinct": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
        "str01_tokenize": f"SELECT item_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT item_id, {tokens('text')} AS t FROM benchmark)",
        "str02_fold": a + f"SELECT i, {fold('title')} AS folded FROM acts",
        "str04_act_ids": a + f"SELECT i, array_to_string(list_filter({tokens(chr(39) + 'según ' + chr(39) + ' || code || ' + chr(39) + ' : ' + chr(39) + ' || number || ' + chr(39) + ' y 17 / 2008' + chr(39))}, lambda z: regexp_full_match(z, '\\d{{1,6}}/\\d{{4}}')), ',') AS ids FROM acts",
        "str10_identity": a + "SELECT i, 'disposición ' || number AS identity FROM acts",
        "str14_section_type": ln + f"SELECT {kind('heading')} AS kind, count(*) AS n FROM lines GROUP BY 1",
        "str23_truncate": "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE CASE WHEN contains(h, ' ') AND 120 - instr(reverse(h), ' ') > 60 THEN substring(h, 1, (120 - instr(reverse(h), ' '))::INT) ELSE h END || ' […]' END AS short FROM (SELECT doc_id, text, substring(text, 1, 120) AS h FROM documents)",
        "dat01_iso": a + "SELECT i, strftime(act_date, '%Y-%m-%d') AS iso FROM acts",
        "ret01_index": f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY token",
        "ret02_bm25": f"WITH {bm25(10)} SELECT q, i, score, rank FROM lex",
        "ret04_knn": f"SELECT a.vec_id AS q, b.vec_id AS i, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10",
        "ret08_fusion": f"WITH {bm25(60)}, den AS (SELECT a.vec_id AS q, b.vec_id AS i, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b QUALIFY rank <= 60), f AS (SELECT coalesce(den.q, lex.q) AS q, coalesce(den.i, lex.i) AS i, round(coalesce(1::DOUBLE / (60 + den.rank), 0) + coalesce(1::DOUBLE / (60 + lex.rank), 0), 9) AS total, den.rank AS rd, lex.rank AS rl FROM den FULL JOIN lex ON den.q = lex.q AND den.i = lex.i) SELECT q, i, total, row_number() OVER (PARTITION BY q ORDER BY total DESC, coalesce(rd, 1000000), coalesce(rl, 1000000), i)::INT AS rank FROM f QUALIFY rank <= 8",
        "dml01_upsert": a + "SELECT i, CASE WHEN i % 3 = 0 THEN number || '-v2' ELSE number END AS number, url FROM acts UNION ALL SELECT i + 10000000, number, NULL FROM acts WHERE i % 100 = 1",
    }
    return out
