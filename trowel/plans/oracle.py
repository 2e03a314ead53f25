"""The driver queries in DuckDB SQL, each written from its definition rather than from the plan."""

from __future__ import annotations

from trowel.functions.text import STOPWORDS

CO_CHANGE = """
  SELECT x.i AS item_a, y.i AS item_b, count(*) AS n
  FROM (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem) x
  JOIN (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem) y ON x.g = y.g AND x.i < y.i
  WHERE x.g IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) BETWEEN 2 AND 25)
  GROUP BY x.i, y.i HAVING count(*) >= 2
"""

LINES = """
  SELECT DISTINCT doc_id, trim(l, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
  WHERE length(trim(l, ' ')) >= 4
"""

PAIRS = """
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM lines x JOIN lines y ON x.line = y.line AND x.doc_id < y.doc_id
  GROUP BY 1, 2 HAVING count(*) >= 3
"""

MEMBERS = f"""
lines AS ({LINES}), pairs AS ({PAIRS}),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON e.a = w.seen),
members AS (SELECT node AS doc_id, min(seen) AS component FROM walk GROUP BY node)
"""

RANKED = """
, quality AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
ranked AS (
  SELECT m.component, m.doc_id, d.n_chars,
         row_number() OVER (PARTITION BY m.component ORDER BY coalesce(q.quality, 0) DESC, d.n_chars DESC, m.doc_id) AS rank
  FROM members m JOIN documents d USING (doc_id) LEFT JOIN quality q USING (doc_id)
)
"""

LATER = """
  SELECT a.user_id, a.event_type AS stopped, b.event_type AS continued, a.last AS x, b.last AS y
  FROM (SELECT user_id, event_type, floor(epoch(max(ts))) AS last FROM events GROUP BY ALL) a
  JOIN (SELECT user_id, event_type, floor(epoch(max(ts))) AS last FROM events GROUP BY ALL) b ON a.user_id = b.user_id AND b.last > a.last
"""

WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)

SQL: dict[str, str] = {
    "co_change": CO_CHANGE,
    "file_history": """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders)
SELECT o_custkey, count(*) AS commits,
       max(CASE WHEN f = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END) AS first_seen,
       max(CASE WHEN r = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END) AS last_touched,
       max(CASE WHEN f = 1 THEN o_orderpriority END) AS first_subject,
       max(CASE WHEN r = 1 THEN o_orderpriority END) AS last_subject,
       string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS authors,
       string_agg(o_orderpriority, '|' ORDER BY r) FILTER (WHERE r <= 8) AS subjects
FROM o GROUP BY o_custkey""",
    "timeline": """
SELECT month, count(*) AS n, min(o_custkey) AS first_key
FROM (SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS month FROM orders GROUP BY o_custkey) GROUP BY month""",
    "stalled": """
SELECT o_custkey, commits, CAST(floor((newest - last) / 86400) AS BIGINT) AS days_quiet FROM (
  SELECT o_custkey, count(*) AS commits, floor(epoch(max(o_orderdate))) AS last FROM orders GROUP BY o_custkey),
  (SELECT floor(epoch(max(o_orderdate))) AS newest FROM orders)
WHERE commits <= 5 AND newest - last >= 60 * 86400""",
    "frontier_score": """
SELECT user_id, round(sum(w * pow(n, 0.6)), 4) AS score, CAST(sum(n) AS BIGINT) AS n_signals FROM (
  SELECT user_id, CASE event_type WHEN 'error' THEN 6.0 WHEN 'purchase' THEN 4.0 WHEN 'click' THEN 3.0 WHEN 'signup' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, count(*) AS n
  FROM events GROUP BY user_id, event_type) GROUP BY user_id""",
    "signal_totals": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "dominant_state": """
SELECT user_id, event_type, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type)) AS r
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1""",
    "fan": f"""
WITH e AS ({CO_CHANGE})
SELECT part, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out
FROM (SELECT item_a AS part, 0 AS i, 1 AS o FROM e UNION ALL SELECT item_b, 1, 0 FROM e) GROUP BY part""",
    "orphans": """
SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY)""",
    "unreferenced": """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_retailprice > 1500 THEN 'dear' END AS caveat FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 7)""",
    "overlap_pairs": f"WITH lines AS ({LINES}) {PAIRS}",
    "attempt_components": f"WITH RECURSIVE {MEMBERS} SELECT doc_id, component FROM members",
    "same_file_sets": f"""
WITH lines AS ({LINES}), sets AS (SELECT doc_id, list(line ORDER BY line) AS s FROM lines GROUP BY doc_id HAVING count(*) >= 3)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS leader, n FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS n FROM sets) WHERE n > 1""",
    "group_shared": f"""
WITH RECURSIVE {MEMBERS}
SELECT component, n_members, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_shared, CAST(sum(CASE WHEN n = n_members THEN 1 ELSE 0 END) AS BIGINT) AS n_common
FROM (SELECT component, line, count(*) AS n FROM members JOIN lines USING (doc_id) GROUP BY ALL)
JOIN (SELECT component, count(*) AS n_members FROM members GROUP BY component) USING (component) GROUP BY component, n_members""",
    "completeness_rank": f"WITH RECURSIVE {MEMBERS} {RANKED} SELECT component, doc_id, CAST(rank AS INTEGER) AS rank FROM ranked",
    "lineage": f"""
WITH RECURSIVE {MEMBERS},
steps AS (SELECT component, doc_id, row_number() OVER (PARTITION BY component ORDER BY size, doc_id) AS step FROM members JOIN (SELECT doc_id, count(*) AS size FROM lines GROUP BY doc_id) USING (doc_id)),
held AS (SELECT s.*, l.line FROM steps s JOIN lines l USING (doc_id))
SELECT component, doc_id, CAST(step AS INTEGER) AS step,
  (SELECT count(*) FROM held h WHERE h.doc_id = s.doc_id AND NOT EXISTS (SELECT 1 FROM held e WHERE e.component = h.component AND e.line = h.line AND e.step < h.step)) AS added,
  (SELECT count(*) FROM held h WHERE h.doc_id = s.doc_id AND EXISTS (SELECT 1 FROM held e WHERE e.component = h.component AND e.line = h.line AND e.step < h.step)) AS carried,
  (SELECT count(DISTINCT e.line) FROM held e WHERE e.component = s.component AND e.step < s.step AND NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = s.doc_id AND h.line = e.line)) AS dropped
FROM steps s""",
    "salvage_counterpart": f"""
WITH lines AS ({LINES}), pairs AS ({PAIRS}), both_ways AS (SELECT a, b, shared FROM pairs UNION ALL SELECT b, a, shared FROM pairs)
SELECT mine, counterpart, shared FROM (
  SELECT a AS mine, b AS counterpart, shared, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM both_ways
  WHERE a NOT IN (SELECT doc_id FROM labels) AND b IN (SELECT doc_id FROM labels)) WHERE r = 1""",
    "replaced_methods": """
SELECT l_partkey, count(DISTINCT c_mktsegment) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY l_partkey HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer)""",
    "forks": f"SELECT user_id, stopped, continued, CAST(floor((y - x) / 86400) AS BIGINT) AS days_after FROM ({LATER}) WHERE y > x + 5 * 86400",
    "hub_trim": f"""
WITH e AS ({CO_CHANGE})
SELECT item_a, item_b FROM e WHERE item_b NOT IN (
  SELECT item_b FROM e GROUP BY item_b HAVING count(*) > greatest(2, floor(0.001 * (SELECT count(DISTINCT item_a) FROM e))))""",
    "ribbons": """
SELECT a.r_name AS src_folder, b.r_name AS dst_folder, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation x ON c_nationkey = x.n_nationkey JOIN region a ON x.n_regionkey = a.r_regionkey
JOIN nation y ON s_nationkey = y.n_nationkey JOIN region b ON y.n_regionkey = b.r_regionkey
WHERE a.r_name <> b.r_name GROUP BY 1, 2""",
    "layers": f"""
WITH RECURSIVE e AS ({CO_CHANGE}),
roots AS (SELECT item_a AS node FROM e GROUP BY item_a ORDER BY count(*) DESC, item_a LIMIT 5),
walk AS (SELECT node, 0 AS depth FROM roots UNION SELECT e.item_b, w.depth + 1 FROM walk w JOIN e ON e.item_a = w.node)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
    "trace_up_down": f"""
WITH RECURSIVE e AS ({CO_CHANGE}),
f AS (SELECT part, sum(i) AS fi, sum(o) AS fo FROM (SELECT item_a AS part, 0 AS i, 1 AS o FROM e UNION ALL SELECT item_b, 1, 0 FROM e) GROUP BY part),
seed AS (SELECT part AS node FROM f ORDER BY fi * fo DESC, part LIMIT 1),
walk AS (
  SELECT 'uses' AS direction, node, 0 AS depth FROM seed UNION SELECT 'used_by', node, 0 FROM seed
  UNION SELECT w.direction, CASE WHEN w.direction = 'uses' THEN e.item_b ELSE e.item_a END, w.depth + 1
  FROM walk w JOIN e ON (w.direction = 'uses' AND e.item_a = w.node) OR (w.direction = 'used_by' AND e.item_b = w.node))
SELECT direction, node, min(depth) AS depth FROM walk GROUP BY direction, node""",
    "rename_chain": """
SELECT doc_id, canonical FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS canonical FROM documents) WHERE doc_id < canonical""",
    "rename_history": """
WITH RECURSIVE ev AS (SELECT DISTINCT ((CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS ord, 'p' || l_partkey AS old, 'p' || ((l_partkey * 7 + l_suppkey * 13) % 5000 + 1) AS new FROM lineitem),
nexts AS (SELECT a.ord, a.old, a.new, b.ord AS next FROM ev a ASOF LEFT JOIN ev b ON a.new = b.old AND a.ord < b.ord),
lasts AS (SELECT old AS name, arg_max(new, ord) AS new, arg_max(next, ord) AS next FROM (SELECT ord, old, new, coalesce(next, -1) AS next FROM nexts) GROUP BY old),
walk AS (SELECT name, new, next FROM lasts UNION ALL SELECT w.name, n.new, coalesce(n.next, -1) FROM walk w JOIN nexts n ON n.ord = w.next WHERE w.next >= 0),
became AS (SELECT name, new FROM walk WHERE next < 0),
follow AS (SELECT name AS node, [name] AS path, new AS here FROM became UNION ALL SELECT f.node, list_append(f.path, f.here), b.new FROM follow f JOIN became b ON b.name = f.here WHERE NOT list_contains(f.path, f.here))
SELECT node, arg_max(here, len(path)) AS canonical FROM follow GROUP BY node""",
    "islands": """
WITH s AS (SELECT user_id, ts - INTERVAL 30 MINUTE AS lo, ts + INTERVAL 30 MINUTE AS hi FROM events),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(lo) AS island_start, max(hi) AS island_end, count(*) AS n FROM i GROUP BY user_id, island""",
    "topn_more": """
SELECT l_orderkey, l_partkey, l_extendedprice, CAST(rank AS INTEGER) AS rank, greatest(total - 3, 0) AS more FROM (
  SELECT l_orderkey, l_partkey, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey) AS total,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""",
    "upsert_latest": """
SELECT user_id, event_type, ts, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "quiet_rank": """
WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
SELECT o_custkey, later FROM (SELECT o_custkey, rank() OVER (ORDER BY last DESC) - 1 AS later FROM l) WHERE later >= 3""",
    "stamp_dates": r"""
SELECT o_orderkey, CASE WHEN d <> '' THEN substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) END AS stamped
FROM (SELECT o_orderkey, regexp_extract('backup_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.py', '(?:^|[^0-9])(20[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?:[^0-9]|$)', 1) AS d FROM orders)""",
    "vocab": rf"""
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\1_\2', 'g')), '[a-z]+')) AS word FROM documents)
WHERE length(word) > 2 AND word NOT IN ({WORDS}) GROUP BY word""",
    "size_share": """
SELECT doc_id, round(CASE WHEN n_chars <= 40 THEN 0.0 WHEN n_chars >= 2400 THEN 1.0
  ELSE (log10(n_chars) - log10(40)) / (log10(2400) - log10(40)) END::DOUBLE, 6) AS share FROM documents""",
    "href_resolution": r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>([^< ]*)', 1) AS slug, html FROM pages),
refs AS (SELECT DISTINCT page_id, host, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS href FROM p),
found AS (
  SELECT r.page_id, r.href, 0 AS priority, t.page_id AS target FROM refs r JOIN p t ON t.host = r.host AND t.slug = r.href
  UNION ALL SELECT r.page_id, r.href, 1, t.page_id FROM refs r JOIN p t ON t.slug = r.href)
SELECT page_id, href, target, CAST(priority AS INTEGER) AS priority FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY priority, target) AS k FROM found) WHERE k = 1""",
}

SQL |= {
    "range_join": """
SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY 1""",
    "representatives": """
SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal < 0, s_suppkey) AS r FROM supplier) WHERE r = 1""",
    "labels_clipped": """
SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN p_name[1:11] || '…' ELSE p_name END AS "end",
       CASE WHEN length(p_name) > 9 THEN p_name[1:4] || '…' || p_name[-4:] ELSE p_name END AS middle,
       CASE WHEN length(p_name) > 9 THEN regexp_replace(p_name[1:5], ' [^ ]*$', '') || ' ...' ELSE p_name END AS words, CASE WHEN length(line) > 14 THEN line[1:13] || '…' ELSE line END AS meta
FROM (SELECT *, p_size || ' lines' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '  ·  ' || p_brand END AS line FROM part)""",
    "durations": """
SELECT p_partkey, CASE WHEN t < 1 THEN format('{:.0f} ms', t * 1000) WHEN t < 90 THEN format('{:.1f} seconds', t) ELSE format('{:.1f} minutes', t / 60) END AS took FROM (SELECT p_partkey, p_size * 25e-1 - 19e-1 AS t FROM part)""",
    "score_bars": """
SELECT event_type, rpad(repeat('#', CAST(greatest(1, round_even(n / most * 20, 0)) AS INTEGER)), 20, '.') AS bar
FROM (SELECT event_type, count(*) AS n, max(count(*)) OVER () AS most FROM events GROUP BY event_type)""",
    "escaped_html": """
SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
    "declared_entries": """
      WITH p AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '_')) AS b, p_size FROM part),
      written AS (
        SELECT k, 1 AS place, b || '.cli' AS module, b || '.cli:main' AS spec, 'scripts' AS "by", 'pyproject.toml' AS source, 'run' AS name FROM p
        UNION ALL SELECT k, 2, b || '.tool', b || '.tool : run [extra]', 'scripts', 'pyproject.toml', 'odd name' FROM p
        UNION ALL SELECT k, 3, b || '.gui', b || '.gui', 'gui-scripts', 'pyproject.toml', 'show' FROM p
        UNION ALL SELECT k, 4, b || '.cli', b || '.cli:other', 'some.plugins', 'pyproject.toml', 'again' FROM p
        UNION ALL SELECT k, 5, b || '.plugins.m' || k, b || '.plugins.m' || k || ':hook', 'some.plugins', 'pyproject.toml', 'plug' FROM p
        UNION ALL SELECT k, 6, b || '.cli', b || '.cli:start', 'console_scripts', 'setup.cfg', 'run' FROM p
        UNION ALL SELECT k, 7, b || '.work_' || k, b || '.work_' || k || ':work', 'console_scripts', 'setup.cfg', 'work' FROM p
        UNION ALL SELECT k, 8, b || '.tool', b || '.tool', 'other.group', 'setup.cfg', 'tool' FROM p),
      legible AS (SELECT w.* FROM written w JOIN p USING (k) WHERE CASE source WHEN 'setup.cfg' THEN p_size % 3 <> 0 ELSE p_size % 3 <> 2 AND p_size % 7 <> 0 END)
      SELECT 'projects/p' || k AS project, module, arg_min(spec, place) AS spec, arg_min("by", place) AS "by", arg_min(source, place) AS source, arg_min(name, place) AS name FROM legible GROUP BY k, module""",
    "module_names": """
SELECT p_partkey, 'pkg.' || lower(replace(p_brand, '#', '_')) || CASE WHEN p_size % 5 = 0 THEN '' ELSE '.m' || p_partkey END AS dotted FROM part""",
}
