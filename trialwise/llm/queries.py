"""Queries of the training-data operators, and SQL for those that SQL can express over whole tables."""

from . import bpe, fill_middle, jaccard, license_scan, line_dedup, mixing, near_vectors, posting_lists, quality, runs, sharding, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_license_scan": license_scan.op3,
    "op4_ngram_jaccard": jaccard.op4,
    "op5_mixing": mixing.op5,
    "op6_quality_rules": quality.op6,
    "op7_sharding": sharding.op7,
    "op8_embedding_near_dedup": near_vectors.op8,
    "op9_url_filters": url_filter.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_periodic_runs": runs.op11,
    "op12_fill_middle": fill_middle.op12,
    "op13_posting_lists": posting_lists.op13,
}

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM sums
), ordered AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS caps, coalesce(sum(w) OVER o, 0.0::DOUBLE) AS used
  FROM weighed WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - caps) / (all_w - used) AS level FROM ordered
), chosen AS (
  SELECT arg_min(level, cap / w) AS level FROM levels WHERE cap > level * w
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM chosen) IS NULL THEN cap ELSE least(cap, (SELECT level FROM chosen) * w) END AS target FROM levels
), drawn AS (
  SELECT doc_id, size, source_size, target, s.source AS source,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM taken
"""

_HOST = "translate(regexp_extract({0}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
_RULE = """CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END"""
_VERDICT = "CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END"


def _attr(name: str) -> str:
    value = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "trim(regexp_replace(" + " || ".join(f"regexp_extract(tag, '{value}', {i})" for i in (1, 2, 3)) + ", '&(amp|#38|#[xX]26);', '&', 'g'))"


_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_URLS = rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^<>]*>')) AS tag FROM pages WHERE strpos(url, '://') > 0
), parts AS (
  SELECT url, tag, regexp_matches(tag, '(?i)^<link') AS link, {_attr("rel")} AS rel, {_attr("href")} AS href, lower({_attr("http-equiv")}) AS equiv,
    lower({_attr("property")}) AS property, {_attr("content")} AS content
  FROM tags
), targets AS (
  SELECT url, CASE WHEN link AND regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)') THEN href WHEN NOT link AND equiv = 'refresh' THEN trim(regexp_extract(content, '(?i)url\s*=\s*[''"]?([^''"]*)', 1))
    WHEN NOT link AND property = 'og:url' THEN content ELSE '' END AS t,
    regexp_extract(url, '^({_SCHEME})://', 1) AS scheme, regexp_extract(url, '^({_SCHEME}://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([^?#]*)', 1) AS page,
    regexp_extract(url, '^({_SCHEME}://[^?#]*/)', 1) AS folder
  FROM parts
), links AS (
  SELECT regexp_extract(url, '^([^#]*)', 1) AS a, regexp_extract(CASE WHEN regexp_matches(t, '^{_SCHEME}://') THEN t WHEN regexp_matches(t, '^(#|$|{_SCHEME}:)') OR scheme = '' THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN origin || t WHEN starts_with(t, '?') THEN page || t
    WHEN length(folder) > length(origin) THEN folder || t ELSE origin || '/' || t END, '^([^#]*)', 1) AS b
  FROM targets WHERE t <> ''
), edges AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
  SELECT a AS u, a AS v FROM edges UNION SELECT r.u, e.b FROM reach r JOIN edges e ON r.v = e.a
), ends AS (
  SELECT u, v, {_REST.format("v")} AS rest FROM reach
), ends_judged AS (
  SELECT u, v, {_HOST.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM ends
), ends_ruled AS (
  SELECT u, v, {_RULE} AS rule FROM ends_judged
), known AS (
  SELECT u, min(v) AS component, bool_or(coalesce({_VERDICT} = 'block', FALSE)) AS blocked FROM ends_ruled GROUP BY u
), cut AS (
  SELECT page_id, coalesce(url, '') AS url, {_REST.format("coalesce(url, '')")} AS rest FROM pages
), judged AS (
  SELECT page_id, url, {_HOST.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, {_RULE} AS rule FROM judged
), given AS (
  SELECT *, {_VERDICT} AS verdict_of_rule FROM ruled
)
SELECT page_id, host, path, rule, coalesce(verdict_of_rule, CASE WHEN coalesce(blocked, FALSE) THEN 'block' ELSE 'allow' END) AS verdict,
  verdict_of_rule IS NULL AND coalesce(blocked, FALSE) AS inherited
FROM given LEFT JOIN known ON strpos(given.url, '://') > 0 AND regexp_extract(given.url, '^([^#]*)', 1) = known.u
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _licences() -> str:
    """Every template at every place, and base phrases word by word: from the operator's fixed values alone."""
    places, needs = [], []
    for n, (label, notice, phrase) in enumerate(license_scan.TEMPLATES):
        words, need = notice.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        must = range(start, start + len(need))
        indexed = [(n, i, w, int(i in must)) for i, w in enumerate(words) if w not in license_scan.FUNCTION_WORDS or i in must]
        places += indexed
        needs.append((n, label, len(indexed), len(need)))
    base = [(n, i, w, len(phrase.split()), label) for n, (phrase, label) in enumerate(license_scan.BASE) for i, w in enumerate(phrase.split())]
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
t AS (SELECT * FROM (VALUES {_values(places)}) t(template, spot, w, must)), needed AS (SELECT * FROM (VALUES {_values(needs)}) t(template, label, indexed, musts)),
b AS (SELECT * FROM (VALUES {_values(base)}) t(phrase, spot, w, words, label)),
lines AS (SELECT doc_id, template, count(*) AS hits, sum(must) AS musts FROM x JOIN t USING (w) GROUP BY doc_id, template, i - spot),
found AS (SELECT doc_id, label, l.hits / indexed::DOUBLE AS share FROM lines l JOIN needed n USING (template) WHERE l.musts = n.musts AND l.hits >= {license_scan.ALIGNED} * indexed),
based AS (SELECT doc_id, label, i - spot AS start FROM x JOIN b USING (w) GROUP BY doc_id, label, phrase, words, i - spot HAVING count(*) = words),
s AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM based GROUP BY doc_id),
every AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM based),
e AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id), f AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(s.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)
"""


_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
m AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), '  ')) END AS mark, s FROM s),
c AS (SELECT mark, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM m WHERE mark IS NOT NULL GROUP BY mark),
x AS (SELECT id, n, unnest(s) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT a AS u, a AS v FROM edges UNION SELECT r.u, e.b FROM reach r JOIN edges e ON r.v = e.a),
k AS (SELECT u, min(v) AS least FROM reach GROUP BY u)
SELECT doc_id, m.n::BIGINT AS n_shingles, coalesce(least, c.id, doc_id) AS component_id, coalesce(c.id, doc_id) AS class_id FROM m LEFT JOIN c USING (mark) LEFT JOIN k ON k.u = c.id
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT a AS u, a AS v FROM edges UNION SELECT r.u, e.b FROM reach r JOIN edges e ON r.v = e.a),
k AS (SELECT u, min(v) AS least FROM reach GROUP BY u), n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN k ON k.u = vec_id
"""

_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

#: SQL finds every pair of vectors; on tables of up to half an audit's vectors the search is audited on all, and finds every pair as well.
ORACLE_SQL = {"op3_license_scan": _licences(), "op4_ngram_jaccard": _JACCARD, "op5_mixing": _MIX, "op8_embedding_near_dedup": _VECTORS, "op9_url_filters": _URLS, "op12_fill_middle": _MIDDLE}
