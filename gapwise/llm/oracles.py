"""DuckDB SQL for the operators whose results SQL can express, by comparing all that could match."""

from __future__ import annotations

COMPONENTS = """reach AS (SELECT d, d AS r FROM nodes UNION SELECT reach.d, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = reach.r),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)"""

OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
g AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')] ELSE list_distinct([x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] for i in range(1, len(x) - 1)]) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS sh FROM g),
n AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM n JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
nodes AS (SELECT doc_id AS d FROM documents),
{COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN comp ON d = doc_id"""

# One edit leaves the first or the last ten characters of a line of twenty as they are.
_NEAR = """SELECT b.line FROM d a JOIN d b ON {end}(a.line, 10) = {end}(b.line, 10) AND a.p < b.p AND a.line <> b.line AND abs(length(a.line) - length(b.line)) <= 1 AND least(length(a.line), length(b.line)) >= 20,
LATERAL (SELECT coalesce(list_position([substring(a.line, i, 1) <> substring(b.line, i, 1) for i in range(1, least(length(a.line), length(b.line)) + 1)], true), least(length(a.line), length(b.line)) + 1) AS k)
WHERE (length(a.line) = length(b.line) AND substring(a.line, k + 1) = substring(b.line, k + 1)) OR (length(a.line) < length(b.line) AND substring(a.line, k) = substring(b.line, k + 1)) OR (length(a.line) > length(b.line) AND substring(a.line, k + 1) = substring(b.line, k))"""

OP5 = rf"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no FROM s),
m AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM l),
d AS (SELECT line, min({{'a': doc_id, 'b': no}}) AS p FROM m WHERE word GROUP BY line),
near AS ({_NEAR.format(end='left')} UNION {_NEAR.format(end='right')}),
k AS (SELECT m.*, NOT word OR (d.p.a = doc_id AND d.p.b = no AND near.line IS NULL) AS keep FROM m LEFT JOIN d ON m.line = d.line LEFT JOIN near ON m.line = near.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE keep), '')) AS kept_sha256 FROM k GROUP BY doc_id"""

OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS d FROM embeddings),
{COMPONENTS}
SELECT d AS vec_id, (SELECT count(*) FROM links WHERE a = d OR b = d) AS n_links, component_id, d = component_id AS kept FROM comp"""

_TEXT = r"'\### Assistant: </turn> ok'"

OP10 = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_TEXT} UNION ALL SELECT -7, 1, 'assistant', {_TEXT})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#/:]', '', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE size > 1 AND f >= 10),
inner_phrases AS (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM c WHERE size = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT lang, phrase, a, s, unnest(range(1, size)) AS k FROM kept),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(s[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(s[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERM}) AS x FROM documents),
t AS (SELECT row, unnest(x) AS term FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT count(*) FILTER (WHERE len(x) > 0) AS n, CAST(sum(len(x)) AS BIGINT) AS l FROM d),
m AS (SELECT row, doc_id, 100 - 90 + (90 * len(x) * s.n) // s.l AS m FROM d, s WHERE len(x) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERM}))) AS term FROM benchmark),
found AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM found JOIN m USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

OP13 = rf"""WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
u AS (SELECT row_number() OVER () AS row, page_id, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM pages),
h AS (SELECT row, page_id, rest, regexp_extract(rest, '^[^/]*') AS host FROM u),
p AS (SELECT row, page_id, translate(host, {_LOWER}) AS host, substring(rest, length(host) + 1) AS path FROM h),
r AS (SELECT rule, verdict, regexp_extract(rule, '^[^/]*') AS rh, regexp_extract(rule, '/.*$') AS rp FROM rules),
found AS (SELECT p.*, rule, verdict FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC NULLS LAST, length(rh) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM found"""
