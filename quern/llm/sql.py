"""DuckDB SQL that gives the rows of the queries it can express."""

from __future__ import annotations

from quern.llm import mixing, quality, spelling, url_filter

_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted({*quality.STOP_WORDS, *map(str.capitalize, quality.STOP_WORDS)})) + "]"


def _rule(rule: quality.Rule) -> str:
    bounds = ([f"{rule.numerator} >= {rule.low} * {rule.denominator}"] if rule.low is not None else []) + ([f"{rule.numerator} <= {rule.high} * {rule.denominator}"] if rule.high is not None else [])
    return f"({rule.denominator} = 0 OR ({' AND '.join(bounds)}))"


_OP2 = rf"""WITH w AS (SELECT doc_id, {_W} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
  g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
  m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(array_to_string(w, ''), '[^!?]+', '', 'g')) AS n_marks,
    len(list_filter(w, lambda x: list_contains({_STOP}, x))) AS n_stop_words, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
  b AS (SELECT *, n_words < {quality.BASE_MIN_WORDS} OR 100 * n_repeat_words > {quality.BASE_MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(map(_rule, quality.RULES))} AS kept FROM b"""

_OP4 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.x, b.x) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

_OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_transform({_W}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id"""

#: Characters that the template's escapes add to a text.
_ESCAPES = " + ".join(rf"(length({{x}}) - length(replace({{x}}, '{c}', ''))) // {len(c)}" for c in ("\\", "<|", "</s>", "[INST]", "[/INST]"))
_OP9 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(24 + length(role) + length(text) + {_ESCAPES.format(x='role')} + {_ESCAPES.format(x='text')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fit(value) -> str:
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in sorted(url_filter.RULES, key=lambda r: -len(r.text))
    )
    return f"CASE {cases} END"


def _node(host: str, rest: str) -> str:
    return f"CASE WHEN {host} <> '' THEN {host} || {rest} END"


_OP6 = rf"""WITH RECURSIVE p AS (SELECT page_id, url, html, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^#]*?(\?[^#]*)', 1), '') AS q FROM pages),
  n AS (SELECT *, CASE WHEN host <> '' THEN host || path || q END AS node FROM p),
  t AS (SELECT node, url, host, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS l FROM n
    UNION ALL SELECT node, url, host, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM n),
  a AS (SELECT node AS src, CASE WHEN contains(l, '://') THEN l WHEN starts_with(l, '//') THEN 'x:' || l WHEN starts_with(l, '/') THEN 'x://' || host || l END AS url FROM (SELECT node, url, host, replace(l, '&amp;', '&') AS l FROM t WHERE l <> '')),
  h AS (SELECT src, url, {_HOST} AS host FROM a), e AS (SELECT src, host || coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') || coalesce(regexp_extract(url, '(?s)^[^#]*?(\?[^#]*)', 1), '') AS dst FROM h WHERE host <> '' AND src IS NOT NULL),
  ed AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), rc(id, r) AS (SELECT src, src FROM ed UNION SELECT ed.dst, rc.r FROM rc JOIN ed ON ed.src = rc.id),
  cc AS (SELECT id, min(r) AS component FROM rc GROUP BY id), x AS (SELECT id, component, regexp_extract(id, '^([^/?#]*)', 1) AS host, regexp_extract(id, '^[^/?#]*([^?#]*)', 1) AS path FROM cc),
  y AS (SELECT id, component, {_fit(lambda r: r.verdict)} AS v FROM x), z AS (SELECT component, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM y GROUP BY component)
  SELECT page_id, host, path, {_fit(lambda r: r.text)} AS rule, coalesce({_fit(lambda r: r.verdict)}, z.v, 'allow') AS verdict FROM n LEFT JOIN cc ON cc.id = n.node LEFT JOIN z ON z.component = cc.component"""

_OP7 = rf"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
  m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g), r AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM m WHERE first < doc_id)),
  o AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
  k AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.i) AS kept, count(*) AS n FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND r.i = o.i WHERE r.i IS NULL GROUP BY o.doc_id)
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_OP8 = rf"""WITH d AS (SELECT doc_id, source, CAST(len({_W}) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), w AS (SELECT *, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 0 THEN 3.0::DOUBLE ELSE (row_number() OVER (ORDER BY source NULLS LAST) % 3)::DOUBLE END AS weight FROM s),
  c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS full_at FROM w),
  l AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM c WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
  t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(level, place) FROM l WHERE level <= full_at), full_at)) AS target FROM l),
  u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
  f AS (SELECT doc_id, d.source, size, source_size, target, rate, rate - floor(rate) AS part, k, CAST('0x' || substr(sha256((k // 8) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * (k % 8) + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
    FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source, (SELECT unnest(range(0, {mixing.SEEDS})) AS k)),
  b AS (SELECT source, k, abs(sum(CASE WHEN draw < part THEN size ELSE 0 END) - max(part) * max(source_size)) AS miss FROM f GROUP BY source, k),
  e AS (SELECT source, k FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, k) = 1)
  SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f JOIN e ON f.source IS NOT DISTINCT FROM e.source AND f.k = e.k"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP11 = rf"""WITH RECURSIVE c AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
  o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[a-z\x{{c0}}-\x{{ff}}]+')) AS w FROM documents) GROUP BY ALL),
  b AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM o),
  h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM b, c),
  v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {spelling.DAMAGED} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h) WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_SEEN}),
  d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS r FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
  e AS (SELECT a.word AS u, b.word AS v FROM d a JOIN d b ON a.r = b.r AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.r = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.r = v.word),
  m AS (SELECT e.u, e.v, v.n, count(*) OVER (PARTITION BY e.u) AS n_near FROM e JOIN v ON v.word = e.v QUALIFY row_number() OVER (PARTITION BY e.u ORDER BY v.n DESC, e.v) = 1),
  f AS (SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.n >= {spelling.RATIO} * v.n THEN m.v END AS form, CASE WHEN m.n >= {spelling.RATIO} * v.n THEN m.n END AS form_n FROM v LEFT JOIN m ON m.u = v.word),
  r(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, depth + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, x.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM r GROUP BY word) x ON x.word = f.word"""

_OP12 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _OP2,
    "op4_approximate_neighbours": _OP4,
    "op5_ngram_jaccard_join": _OP5,
    "op6_url_filter": _OP6,
    "op7_substring_dedup": _OP7,
    "op8_mixing": _OP8,
    "op9_chat_formatting": _OP9,
    "op11_spelling_variants": _OP11,
    "op12_exact_dedup": _OP12,
}
