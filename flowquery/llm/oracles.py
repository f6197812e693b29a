"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from flowquery.llm.decontaminate import SIDE_ANCHORS, SLOP
from flowquery.llm.secret_scan import BASE_RULES, RULES

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS6 = f"list_filter(string_split_regex({FOLDED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
WORDS8 = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP6 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS6} AS w FROM documents),
b AS (SELECT item_id, {WORDS6} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid
),
tok AS (SELECT rid, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS term FROM d),
contents AS (
  SELECT DISTINCT win, n, w FROM (
    SELECT least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS w, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
  )
),
places AS (SELECT win, n, unnest(range(0, n)) AS off, unnest(w) AS term FROM contents),
freq AS (SELECT term, count(*) AS c FROM tok WHERE term IN (SELECT term FROM places) GROUP BY term),
firsts AS (
  SELECT win, n, off * 2 >= n AS half, term, coalesce(c, 0) AS c, min(off) AS off FROM places LEFT JOIN freq USING (term) GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY win, half ORDER BY c, term) AS side, row_number() OVER (PARTITION BY win ORDER BY c, term, off) AS top FROM firsts
),
sides AS (SELECT win, off, term, top FROM ranked WHERE side <= {SIDE_ANCHORS}),
many AS (SELECT win, count(*) AS k FROM sides GROUP BY win HAVING count(*) > 1),
began AS (SELECT sides.win, k, rid, p - off AS s FROM sides JOIN many USING (win) JOIN tok USING (term) WHERE top = 1),
stood AS (
  SELECT began.win, began.k, began.rid, began.s, count(DISTINCT (sides.off, sides.term)) AS found
  FROM began JOIN sides ON sides.win = began.win
  JOIN tok ON tok.rid = began.rid AND tok.term = sides.term AND abs(tok.p - sides.off - began.s) <= {SLOP}
  GROUP BY ALL
),
whole AS (SELECT DISTINCT rid, win, i - 1 AS s FROM dw WHERE win IN (SELECT win FROM iw)),
nearby AS (
  SELECT rid, count(*) AS n_near FROM stood
  WHERE found = k AND NOT EXISTS (SELECT 1 FROM whole WHERE whole.rid = stood.rid AND whole.win = stood.win AND abs(whole.s - stood.s) <= {SLOP}) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid) LEFT JOIN nearby USING (rid)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS8} AS w FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 13 + 2)) AS i FROM d WHERE len(w) >= 13)
),
low AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE least < doc_id),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def _spans(number: int) -> str:
    """(rid, number, kind, s, e) of one rule: matches stand between the pieces that the regex leaves."""
    rule = RULES[number]
    regex = rule.regex.replace("'", "''")
    return f"""
SELECT rid, {number} AS number, '{rule.kind}' AS kind, e - len(m) AS s, e FROM (
  SELECT rid, m, k, CAST(sum(len(m) + len(piece)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e FROM (
    SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ks) AS k, unnest(ps[1 : len(ms)]) AS piece FROM (
      SELECT rid, regexp_extract_all(t, '{regex}') AS ms, regexp_extract_all(t, '{regex}', {rule.group}) AS ks, string_split_regex(t, '{regex}') AS ps FROM d
    )
  )
) WHERE len(k) >= {rule.least}"""


def _listed(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) FILTER (WHERE {where}), '')"


OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(map(_spans, range(len(RULES))))}),
per AS (
  SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
    sha256({_listed(f"number < {len(BASE_RULES)}")}) AS base_sha256, {_listed("true")} AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""

ORACLE_SQL = {"op2_secret_scan": OP2, "op6_decontaminate": OP6, "op8_substring_dedup": OP8}
