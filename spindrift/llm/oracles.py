"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re

from spindrift.llm import chat, filteraudit, secrets, urlrep

_ESCAPED = "|".join([r"\\", *map(re.escape, chat.CONTROL)])
_COST = lambda c: f"(length({c}) + len(regexp_extract_all({c}, '{_ESCAPED}')))"
CHAT = f"""WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum({len(chat.TURN + chat.SAYS + chat.END)} + {_COST('role')} + {_COST('text')})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

_SUFFIXES = ", ".join(f"'{s}'" for s in urlrep.SUFFIXES)
_LAST = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlrep.RULES)
_FIT = """SELECT sum(good)::DOUBLE / sum(n) AS m, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS n2, sum(good * good / n::DOUBLE) AS sq FROM {0} WHERE n > 0"""
_RHO = "least(greatest(CASE WHEN m * (1 - m) > 0 AND n - n2 / n - (k - 1) > 1e-9 THEN (sq - n * m * m - (k - 1) * m * (1 - m)) / (m * (1 - m) * (n - n2 / n - (k - 1))) ELSE 1 END, 1e-4), 0.5)"
_STRENGTH = lambda units: f"(SELECT round(1 / {_RHO} - 1, 6) FROM ({_FIT.format(units)}))"
URLS = rf"""WITH r AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
seen AS (SELECT doc_id AS page_id, sum(quality) AS good, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, coalesce(sum(good), 0) AS good, coalesce(sum(n), 0) AS n, CASE WHEN {_LAST(2)} IN ({_SUFFIXES}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain, CASE WHEN {_LAST(2)} IN ({_SUFFIXES}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix FROM r LEFT JOIN seen USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY 1, 2), s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY 1), whole AS (SELECT sum(good)::DOUBLE / sum(n) AS rate, sum(good) AS gw, sum(n) AS nw FROM s),
sp AS (SELECT suffix, good AS gs, n AS ns, CASE WHEN nw > n THEN (gw - good) / (nw - n)::DOUBLE ELSE rate END AS above FROM s, whole), dp AS (SELECT domain, good AS gd, n AS nd, (gs - good + {_STRENGTH('s')} * above) / (ns - n + {_STRENGTH('s')}) AS above FROM d JOIN sp USING (suffix)),
mh AS (SELECT host, good, n, (gd - good + {_STRENGTH('d')} * above) / (nd - n + {_STRENGTH('d')}) AS mean FROM h JOIN dp USING (domain)), ab AS (SELECT host, good + {_STRENGTH('h')} * mean AS a, n - good + {_STRENGTH('h')} * (1 - mean) AS b FROM mh),
ub AS (SELECT host, round(a / (a + b) + {urlrep.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS bound FROM ab),
rules AS (SELECT * FROM (VALUES {_RULES}) AS v(verdict, at_host, start)),
f AS (SELECT page_id, r.host, r.path, max((length(at_host || start), at_host || start, verdict)) AS fit FROM r JOIN rules ON (r.host = at_host OR ends_with(r.host, '.' || at_host)) AND starts_with(r.path, start) GROUP BY ALL)
SELECT r.page_id, r.host, r.path, fit[2] AS rule, coalesce(fit[3], CASE WHEN bound < round({urlrep.FLOOR} * rate, 9) THEN 'block' ELSE 'allow' END) AS verdict, bound FROM r JOIN ub ON ub.host = r.host LEFT JOIN f ON f.page_id = r.page_id, whole"""

_SPANS = lambda name, pattern, value: rf"""{name} AS (SELECT doc_id, source, m[i] AS m, {value} AS v, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS st FROM (SELECT doc_id, source, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')), unnest(range(1, len(m) + 1)) AS u(i))"""
_ASSIGN = secrets.ASSIGN.replace("'", "''").replace("(" + secrets.ASSIGN[1:].split(")")[0] + ")", "(?:" + secrets.ASSIGN[1:].split(")")[0] + ")").replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")
_TAIL = secrets.ASSIGN.replace("'", "''")
_JOIN = lambda rows: f"coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k, en) FILTER (WHERE {rows}), '')"
SECRETS = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
{_SPANS('a', _ASSIGN, f"regexp_extract(m[i], '{_TAIL}', 2)")}, {_SPANS('c', secrets.KINDS[1][1], 'm[i]')}, {_SPANS('x', secrets.KINDS[2][1], 'm[i]')}, {_SPANS('b', '[A-Za-z0-9+/_-]{20,}', 'm[i]')},
base AS (SELECT doc_id, source, 'assign' AS kind, 0 AS k, st, st + length(m) AS en, v FROM a WHERE length(v) >= 8 UNION ALL SELECT doc_id, source, 'access', 1, st, st + length(m), v FROM c UNION ALL SELECT doc_id, source, 'hex', 2, st, st + length(m), v FROM x),
cand AS (SELECT doc_id, source, v, en - length(v) AS st, en FROM base UNION SELECT doc_id, source, v, st, st + length(v) FROM b),
look AS (SELECT * FROM cand WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {secrets.DIFFERENT}),
few AS (SELECT v FROM look GROUP BY v HAVING count(DISTINCT coalesce('=' || source, '')) <= {secrets.OWNERS} AND count(DISTINCT (coalesce('=' || source, ''), doc_id)) <= {secrets.REPOSITORIES}),
al AS (SELECT doc_id, kind, k, st, en FROM base UNION ALL SELECT DISTINCT doc_id, 'live', 3, st, en FROM look WHERE v IN (SELECT v FROM few))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({_JOIN("k < 3")}) AS base_sha256, {_JOIN('k IS NOT NULL')} AS spans FROM d LEFT JOIN al ON al.doc_id = d.doc_id GROUP BY d.doc_id"""

_BITS = "(CASE {0} WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END)"
_SUM = lambda column, rows: f"coalesce(sum({column}) FILTER (WHERE {rows}), 0)::BIGINT"
AUDIT = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, doc_id, (len(w) < {filteraudit.WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {filteraudit.DIFFERENT} * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filteraudit.CAPITALS} * length(t))::INT + 8 * regexp_matches(t, '{filteraudit.MARKS}')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM t),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, coalesce(list_sum(list_transform(string_split(filter_order[:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE {_BITS.format('x')} END)), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
x AS (SELECT *, {_BITS.format('f')} AS own FROM s),
r AS (SELECT part, filter_order, step, f, {_SUM('n', '(mask & (earlier | own)) = 0')} AS kept, {_SUM('n', '(mask & own) > 0 AND (mask & earlier) = 0')} AS removed, {_SUM('n', '(mask & own) > 0 AND (mask & earlier) > 0')} AS redundant, {_SUM('n', 'mask = own')} AS unique_fails,
{_SUM('good', '(mask & own) > 0 AND (mask & earlier) = 0')} AS good_lost, {_SUM('toxic', '(mask & own) > 0 AND (mask & earlier) = 0')} AS toxic_lost FROM c, x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""

ORACLES = {"op12_filteraudit": AUDIT, "op3_chat": CHAT, "op8_urlrep": URLS, "op10_secrets": SECRETS}
