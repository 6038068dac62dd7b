"""DuckDB SQL for the queries of the training-data operators that SQL can express."""

from __future__ import annotations

from tensorloom.llm import license_scan, pii, url_filter

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key, hash(coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM r),
k AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS left_weight
  FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, left_size * weight >= cap * left_weight AS full_ FROM k),
g AS (
  SELECT *, coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)::BIGINT AS full_cap,
         coalesce(sum(CASE WHEN full_ THEN weight END) OVER (), 0)::BIGINT AS full_weight
  FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN cap::DOUBLE
              ELSE ((all_size - full_cap) * weight)::DOUBLE / greatest(all_weight - full_weight, 1)::DOUBLE END AS target,
         CASE WHEN full_ THEN cap ELSE ((all_size - full_cap) * weight) // greatest(all_weight - full_weight, 1) END AS budget
  FROM g),
p AS (
  SELECT d.*, t.source_size, t.target, t.budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size, h
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
FROM p
"""

OP3 = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

def _op7() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    doubled = f"list_transform(range(1, len({digits}) + 1), lambda i: {digits}[len({digits}) - i + 1]::INTEGER * (2 - i % 2))"
    valid = {
        "email": "true", "ip": rf"regexp_full_match(m, '{part}(?:\.{part}){{3}}')", "phone": f"len({digits}) BETWEEN 9 AND 15",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform({doubled}, lambda d: CASE WHEN d > 9 THEN d - 9 ELSE d END)) % 10 = 0",
    }
    # A match starts after the gaps up to it and the matches before it.
    walk = " UNION ALL ".join(
        f"""SELECT row_id, doc_id, h, text, '{kind}' AS kind, {k} AS place, m, s, s + length(m) AS e FROM (
          SELECT row_id, doc_id, h, text, ms[i] AS m, list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)::BIGINT AS s
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d))) WHERE {valid[kind]}"""
        for k, (kind, pattern) in enumerate(patterns.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in patterns)
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s{}), '')"
    blank = f"chr({ord(pii.BLANK)})"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, hash(coalesce(text, '')) AS h FROM documents),
b AS ({walk}),
o AS (SELECT row_id, s, e, row_number() OVER (PARTITION BY row_id ORDER BY s, e) AS i, count(*) OVER (PARTITION BY row_id) AS n FROM b),
c(row_id, i, t) AS (
  SELECT row_id, 0::BIGINT, text FROM d
  UNION ALL SELECT c.row_id, o.i, substring(t, 1, s) || repeat({blank}, (e - s)::BIGINT) || substring(t, e + 1) FROM c JOIN o ON c.row_id = o.row_id AND o.i = c.i + 1),
u AS (SELECT c.row_id, t FROM c LEFT JOIN (SELECT DISTINCT row_id, n FROM o) o ON c.row_id = o.row_id WHERE i = coalesce(n, 0)),
w0 AS (SELECT row_id, t, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(gaps[:len(ws)]) AS g FROM (SELECT *, regexp_extract_all(t, '\p{{L}}+') AS ws, string_split_regex(t, '\p{{L}}+') AS gaps FROM u)),
w1 AS (SELECT row_id, t, lower(w) AS term, (sum(length(g) + length(w)) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS e, length(w) AS n FROM w0),
w AS (SELECT row_id, term, e - n AS s, e FROM w1 WHERE substring(t, e + 1, 1) <> {blank} AND (e = n OR substring(t, e - n, 1) <> {blank})),
y0 AS (SELECT DISTINCT row_id, h, kind || ':' || lower(m) AS entity FROM b),
p AS (SELECT entity, term, count(*) AS n_both, count(DISTINCT h) AS texts FROM y0 JOIN (SELECT DISTINCT row_id, term FROM w) w ON y0.row_id = w.row_id GROUP BY ALL),
n AS (SELECT entity, count(*) AS n_entity, count(DISTINCT h) AS all_texts FROM y0 GROUP BY ALL),
f AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda x: lower(x)))) AS term FROM d) GROUP BY term),
k AS (SELECT p.term, n_both, n_entity, n_term, n_all, texts, texts::DOUBLE AS k, all_texts::DOUBLE AS n, n_term / n_all AS q
      FROM p JOIN n ON p.entity = n.entity JOIN f ON p.term = f.term, (SELECT count(*) AS n_all FROM d)),
t AS (SELECT DISTINCT term FROM k WHERE log2(n_all / n_entity) > 0 AND log2(n_both * n_all / (n_entity * n_term)) >= {pii.DISCLOSURE} * log2(n_all / n_entity) - 1e-9
        AND (n_term <= n_both OR texts >= {pii.MEETINGS}) AND k > n * q AND k * log2(k / (n * q)) + CASE WHEN k < n THEN (n - k) * log2((1 - k / n) / (1 - q)) ELSE 0 END >= -log2({pii.CHANCE}) - 1e-9),
y AS (SELECT row_id, kind, place, s, e FROM b UNION ALL SELECT row_id, '{pii.TERM}', 9, s, e FROM w JOIN t ON w.term = t.term WHERE row_id IN (SELECT row_id FROM b)),
z AS (SELECT row_id, {counts}, {listed.format("")} AS spans FROM y GROUP BY row_id),
x AS (SELECT row_id, sha256({listed.format("")}) AS base_sha256 FROM b GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in patterns)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z ON d.row_id = z.row_id LEFT JOIN x ON d.row_id = x.row_id
"""


#: The rules as the registered SQL has them, left as it is: it blocks ``net/de/``, which the contract and ``url_filter.RULES`` allow.
_OP6_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def _op6() -> str:
    def fits(domain: str, start: str) -> str:
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{start}')"

    ordered = sorted(_OP6_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(d, p)} THEN '{d + p}'" for _, d, p in ordered)
    verdict = " ".join(f"WHEN {fits(d, p)} THEN '{v}'" for v, d, p in ordered)
    tagged = "list_transform(list_filter({}, lambda x: x <> ''), lambda x: '{}=' || regexp_replace(x, '[0-9]+', '#', 'g'))"
    parts = [
        ("[translate(regexp_extract(url, '^(.*?)://', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')]", "scheme"), ("string_split(host, '.')", "host"),
        (r"string_split(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '/')", "segment"), (r"[regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)]", "ext"),
        ("[CASE WHEN regexp_matches(path, './$') THEN '/' ELSE '' END]", "end"), (r"list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1, 's'), '&'), lambda x: string_split(x, '=')[1])", "query"),
        ("[CASE WHEN contains(url, '#') THEN 'fragment' ELSE '' END]", "mark"),
    ]
    items = "[]"
    for body, name in parts:
        items = f"list_concat({items}, {tagged.format(body, name)})"
    return rf"""
WITH u0 AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
u AS (SELECT page_id, host, path, try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS BIGINT) AS number,
             CASE WHEN url IS NULL THEN []::VARCHAR[] ELSE list_sort(list_distinct({items}))[:{url_filter.MAX_TOKENS}] END AS items FROM u0),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT items, CASE WHEN bad = 1 THEN 'block' ELSE 'allow' END AS v FROM u JOIN l ON number = doc_id),
n AS (SELECT count(*) AS total FROM b),
nv AS (SELECT v, count(*) AS n_v FROM b GROUP BY v),
x AS (SELECT items, v, unnest(range(1, 1 << len(items))) AS mask FROM b),
s AS (SELECT list_filter(items, lambda y, i: (mask >> (i - 1)) & 1 = 1) AS a, v FROM x),
r0 AS (SELECT a, count(*) AS n_a FROM s GROUP BY a),
r1 AS (SELECT a, v, count(*) AS n_av FROM s GROUP BY a, v),
r2 AS (SELECT r1.a, r1.v, n_av, n_a, n_v, total, n_v / total AS q, n_av / n_v AS own, CASE WHEN total > n_v THEN (n_a - n_av) / (total - n_v) END AS other
       FROM r1 JOIN r0 ON r1.a = r0.a JOIN nv ON r1.v = nv.v, n
       WHERE least(n_av, n_v) >= ceil(least(1.0, greatest({url_filter.MIN_SUPPORT}, ({url_filter.MIN_COUNT} - 0.5) / greatest(1, total))) * total)),
r AS (SELECT a, v, own / (own + other) AS confidence, n_av AS support FROM r2
      WHERE own / (own + other) >= {url_filter.MIN_CONFIDENCE} AND n_av > n_a * q
        AND n_av * log2(n_av / (n_a * q)) + CASE WHEN n_av < n_a THEN (n_a - n_av) * log2((1 - n_av / n_a) / (1 - q)) ELSE 0 END >= log2((SELECT count(*) FROM r2) / {url_filter.CHANCE}) - 1e-9),
k AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r g WHERE g.v = r.v AND len(g.a) < len(r.a) AND g.confidence >= r.confidence AND list_has_all(r.a, g.a))),
m AS (SELECT d.items, k.v AS mined FROM (SELECT DISTINCT items FROM u) d JOIN k ON list_has_all(d.items, k.a)
      QUALIFY row_number() OVER (PARTITION BY d.items ORDER BY confidence DESC, support DESC, len(k.a) DESC, k.a DESC, k.v DESC) = 1)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, mined, 'allow') AS verdict, mined
FROM u LEFT JOIN m ON u.items = m.items
"""


OP8 = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""


def _op2() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(t, licence, body.replace("'", "''")) for t, (licence, _, body) in enumerate(license_scan.TEMPLATES))
    limits = ", ".join(f"({t}, {reach})" for t, (_, _, body) in enumerate(license_scan.TEMPLATES) for reach in license_scan.reaches(len(license_scan.words_of(body)) - 1))
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram, unnest(range(1, len(w))) AS pos"

    def placed(source: str, key: str) -> str:
        order = f'PARTITION BY {key} ORDER BY start, "end", t, dice'
        return f"""(SELECT *, sum(opens) OVER ({order} ROWS UNBOUNDED PRECEDING) AS place FROM (
          SELECT *, CASE WHEN start <= max("end") OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {source}))"""

    return rf"""
WITH t0(t, licence, body) AS (VALUES {rows}),
reaches(t, reach) AS (VALUES {limits}),
t1 AS (SELECT t, licence, {words.format("body")} AS w FROM t0),
t2 AS (SELECT t, licence, len(w) - 1 AS size, {grams} FROM t1),
g AS (SELECT t, licence, size, gram, count(*) AS times FROM t2 GROUP BY ALL),
d AS (SELECT row_number() OVER () AS d, doc_id, {words.format("text")} AS w FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT d, doc_id, {grams} FROM d),
h0 AS (SELECT d, doc_id, t, licence, size, b.gram, times, pos, row_number() OVER (PARTITION BY d, t, b.gram ORDER BY pos) AS n FROM b JOIN g ON b.gram = g.gram),
h AS (SELECT x.*, y.pos AS prev FROM h0 x LEFT JOIN h0 y ON x.d = y.d AND x.t = y.t AND x.gram = y.gram AND y.n = x.n - x.times),
w0 AS (SELECT a.d, a.doc_id, a.t, a.licence, a.size, a.pos AS start, max(c.pos) AS "end", 2.0::DOUBLE * count(*) FILTER (c.prev IS NULL OR c.prev < a.pos) / (max(c.pos) - a.pos + 1 + a.size) AS dice
       FROM h a JOIN reaches r ON a.t = r.t JOIN h c ON a.d = c.d AND a.t = c.t AND c.pos >= a.pos AND c.pos < a.pos + r.reach GROUP BY a.d, a.doc_id, a.t, a.licence, a.size, a.pos, r.reach),
w AS (SELECT * FROM w0 WHERE dice >= {license_scan.THRESHOLD}),
p AS (SELECT * FROM {placed("w", "d, t")} QUALIFY row_number() OVER (PARTITION BY d, t, place ORDER BY dice DESC, start, "end" DESC) = 1),
k AS (SELECT * FROM {placed("(SELECT * EXCLUDE (opens, place) FROM p)", "d")} QUALIFY row_number() OVER (PARTITION BY d, place ORDER BY dice DESC, size DESC, licence) = 1)
SELECT doc_id, licence, count(*)::BIGINT AS n_passages, max(dice) AS best_dice FROM k GROUP BY d, doc_id, licence
"""


ORACLES: dict[str, str] = {"op2_license_scan": _op2(), "op3_topk": OP3, "op6_url_filter": _op6(), "op7_pii": _op7(), "op8_embed_dedup": OP8, "op9_mixing": OP9}
