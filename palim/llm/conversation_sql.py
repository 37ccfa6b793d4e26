"""SQL of op11: checksums by table, one recursive step a row over the four states, edits replayed by their place."""

_WORST = "'900000000'"


def _plus(state: str, cost: str, edit: str) -> str:
    """A state (nine digits of cost, then its edits) with one more edit."""
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || {edit}"


def _step() -> str:
    """The four states after a row: inserts before it, then its edit."""
    i = {k: _plus(k, "3", "'I'") for k in ("s0", "s1", "s2", "s3")}
    ii = {k: _plus(k, "6", "'II'") for k in ("s0", "s1")}
    return f"""SELECT conv_id, n, initial, must, more, s0 AS p0, s1 AS p1, least(s2, {i['s0']}, {i['s1']}, {i['s3']}) AS p2, least(s3, {i['s2']}, {ii['s0']}, {ii['s1']}) AS p3
    FROM walk JOIN marked USING (conv_id) WHERE marked.n = walk.i + 1"""


def _edit(state: str, initial: str) -> str:
    cost = f"(CASE WHEN initial = '{initial}' THEN 0 ELSE 3 END + more)"
    return f"CASE WHEN must THEN {_WORST} ELSE {_plus(state, cost, f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END")} END"


def op11_sql() -> str:
    delete = {k: _plus(k, "4", "'D'") for k in ("p0", "p1", "p2", "p3")}
    keep_system = f"CASE WHEN must OR initial <> 's' THEN {_WORST} ELSE {_plus('p0', 'more', "'K'")} END"
    return rf"""WITH RECURSIVE crcs AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS k FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(k, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS f FROM keyed, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
faulty AS (SELECT *, left(role, 1) AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS solid, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM ordered),
marked AS (SELECT *, CASE WHEN solid = '' THEN 1 ELSE 0 END AS blank, CASE WHEN solid <> '' AND seen > 1 THEN 1 ELSE 0 END AS duplicate, CASE WHEN solid <> '' AND seen = 1 AND right(solid, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS truncated,
  solid = '' OR seen > 1 AS must, CASE WHEN right(solid, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM faulty),
counts AS (SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank, sum(duplicate) AS duplicate, sum(truncated) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, {_WORST} AS s1, {_WORST} AS s2, {_WORST} AS s3 FROM counts
  UNION ALL SELECT conv_id, n, {delete['p0']}, least({delete['p1']}, {keep_system}), least({delete['p2']}, {_edit('p0', 'u')}, {_edit('p1', 'u')}, {_edit('p3', 'u')}), least({delete['p3']}, {_edit('p2', 'a')}) FROM ({_step()})),
ends AS (SELECT conv_id, least(s0, s3, {_plus('s2', '3', "'I'")}, {_plus('s1', '6', "'II'")}) AS best FROM walk JOIN counts USING (conv_id) WHERE walk.i = rows_),
letters AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS e, generate_subscripts(string_split(substr(best, 10), ''), 1) AS p FROM ends),
placed AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS n FROM letters),
kept AS (SELECT placed.conv_id, e, p, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY placed.conv_id ORDER BY p) AS k FROM placed LEFT JOIN marked ON marked.conv_id = placed.conv_id AND marked.n = placed.n WHERE e <> 'D'),
led AS (SELECT *, max(CASE WHEN k = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM kept),
repaired AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body FROM led GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(CAST(left(best, 9) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id) LEFT JOIN repaired USING (conv_id)"""
