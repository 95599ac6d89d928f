"""The contract queries as plain SQL for DuckDB: by definition, not by the operators' methods."""

from __future__ import annotations

from .quality import DELTA, RISK, RULES
from .urls import BLOCK_SHARE, DAMPING, RULES as URL_RULES

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The smallest id that links reach from each end; l has (a, b), both ways.
_REACH = "reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH}
SELECT vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = vec_id), 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id"""

OP3 = f"""WITH w AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM (SELECT DISTINCT doc_id, s FROM win JOIN f USING (h) WHERE doc_id > lo), range(50) t(k)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_FITS = [
    (k, r, f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))")
    for k, r in sorted(URL_RULES, key=lambda x: (-len(x[1]), x[1]))
]
_HOST = r"translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6 = rf"""WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, {_HOST.format('rest')} AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM p),
r AS (SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r}'" for _, r, f in _FITS)} END AS rule, CASE {' '.join(f"WHEN {f} THEN '{k}'" for k, _, f in _FITS)} END AS by_rule FROM q),
o AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"''\s>]+)', 1)) AS u FROM q),
e AS (SELECT src, {_HOST.format("substr(u, instr(u, '//') + 2)")} AS dst, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT 't' AS kind, src AS a, dst AS b, n FROM e WHERE src <> dst AND src <> '' AND dst <> '' UNION ALL SELECT 'd', dst, src, n FROM e WHERE src <> dst AND src <> '' AND dst <> ''),
s AS (SELECT 't' AS kind, host, count(*) AS w FROM r WHERE by_rule = 'allow' AND host <> '' GROUP BY host UNION ALL SELECT 'd', host, count(*) FROM r WHERE by_rule = 'block' AND host <> '' GROUP BY host),
walk(kind, host, k, m) AS (SELECT kind, host, 0, {1 - DAMPING!r} * w / sum(w) OVER (PARTITION BY kind) FROM s
 UNION ALL SELECT walk.kind, g.b, k + 1, sum(m * {DAMPING} * g.n / (SELECT sum(n) FROM g h WHERE h.kind = g.kind AND h.a = g.a)) FROM walk JOIN g ON walk.kind = g.kind AND walk.host = g.a WHERE m > 1e-12 GROUP BY walk.kind, g.b, k),
h AS (SELECT host, coalesce(sum(m) FILTER (WHERE kind = 't'), 0) AS trust, coalesce(sum(m) FILTER (WHERE kind = 'd'), 0) AS distrust FROM walk GROUP BY host)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust > 0 AND distrust >= {BLOCK_SHARE} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN h USING (host)"""

OP7 = f"""WITH u AS (SELECT doc_id, source, len({_SPLIT})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM u GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM s),
c AS (SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS whole, coalesce(sum(3.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
lv AS (SELECT (whole - held) / free AS level FROM c WHERE (whole - held) / free <= 3.0 * source_size / weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(3.0 * source_size, weight * level)::DOUBLE AS target, weight FROM s, lv),
z AS (SELECT sum(target) AS whole, sum(target * (weight - 1) / 2) / sum(target) AS mean FROM t),
d AS (SELECT u.*, source_size, target, target / whole AS q, 0.5 * (target / whole) * ((weight - 1) / 2 - mean) AS d, round(target)::BIGINT AS goal,
 sum(size) OVER (PARTITION BY u.source ORDER BY md5('7/' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS stream FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source, z)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN (goal // source_size) * size + least(greatest(goal - (goal // source_size) * source_size - stream, 0), size) ELSE 0 END)::BIGINT AS taken,
 round(CASE WHEN target > 0 AND (q - d) + sqrt(greatest((q - d) * (q - d) + 4 * d * (stream / target * q), 0)) > 0 THEN least(1.0, 2 * (stream / target * q) / ((q - d) + sqrt(greatest((q - d) * (q - d) + 4 * d * (stream / target * q), 0)))) ELSE 0.0 END, 6) AS position FROM d"""

OP8 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
h AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
l AS (SELECT a, b FROM h UNION SELECT b, a FROM h), {_REACH}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id, doc_id <= coalesce(low.b, doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id"""

_VALUE = {
    "symbols_per_word": "n_symbols / n_words", "chars_per_word_high": "word_chars / n_words", "chars_per_word_low": "word_chars / n_words",
    "dup_lines_per_word": "n_dup_lines / n_words", "repeated_words": "n_repeat_words / n_words", "few_words": "n_words::DOUBLE",
}
_HIT = "CASE WHEN n_words = 0 THEN false ELSE CASE rule " + " ".join(f"WHEN '{r}' THEN {_VALUE[r]} {s} cutoff" for r, s, _ in RULES) + " END END"
_CUTS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, _, cuts in RULES for i, c in enumerate(cuts))
OP10 = rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_SPLIT} AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) t(k) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
cuts(rule, level, cutoff) AS (VALUES {_CUTS}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, (SELECT min(level) FROM cuts WHERE {_HIT}) AS severity FROM m),
held AS (SELECT f.*, quality FROM f JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) x USING (doc_id) WHERE NOT base_failed),
cells AS (SELECT lang, level, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality = 1 AND severity <= level) AS k, count(*) FILTER (WHERE quality = 0 AND severity <= level) AS hits
 FROM held, (SELECT DISTINCT level FROM cuts) GROUP BY ALL),
sure AS (SELECT *, bool_and(k < n * {RISK} AND
 list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln({1 - RISK!r})))) <= {DELTA} / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM held)) OVER (PARTITION BY lang ORDER BY level) AS ok FROM cells WHERE n > 0),
best AS (SELECT lang, level FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hits / bad - k / n DESC, level) AS o FROM sure WHERE ok AND bad > 0 AND hits / bad > k / n) WHERE o = 1),
hit AS (SELECT DISTINCT f.doc_id FROM f JOIN best ON f.lang IS NOT DISTINCT FROM best.lang WHERE f.severity <= best.level)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM f"""
