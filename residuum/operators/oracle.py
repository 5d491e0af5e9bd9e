"""SQL views of the bridge relations, and SQL forms of the queries over them.

Written from the operators' meaning for an engine that knows recursive UNION;
the DataFrame forms don't use it.
"""

from __future__ import annotations

VIEWS = r"""
WITH RECURSIVE ev AS (
  SELECT event_id, event_type, value, CAST((props->>'$.k') AS INT) AS k, 'p' || (user_id * 8 + event_id % 8) AS slug FROM events),
slugs AS (SELECT DISTINCT slug FROM ev),
typed AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'option' WHEN 'view' THEN 'transient'
      WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'cron' ELSE 'post_meta' END
      ELSE CASE WHEN k % 5 = 0 THEN 'table' ELSE 'rewrite_rule' END END AS type,
    event_id % 10 = 0 AS net
  FROM ev WHERE event_type <> 'error'),
findings AS (
  SELECT slug, event_id AS ord, type,
    CASE type WHEN 'option' THEN CASE WHEN net THEN 'update_site_option' ELSE 'update_option' END
      WHEN 'transient' THEN CASE WHEN net THEN 'set_site_transient' ELSE 'set_transient' END
      WHEN 'cron' THEN 'wp_schedule_event' WHEN 'post_meta' THEN 'update_post_meta' WHEN 'table' THEN 'dbDelta' ELSE 'add_rewrite_rule' END AS function,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 'k' || (k % 6) || '*'
      WHEN k % 6 = 5 AND k % 4 = 1 THEN CASE type WHEN 'option' THEN 'blogname' WHEN 'cron' THEN 'wp_version_check'
        WHEN 'post_meta' THEN '_edit_lock' WHEN 'table' THEN '{prefix}Posts' ELSE 'k' || (k % 6) END
      ELSE 'k' || (k % 6) END AS key,
    CASE WHEN k % 11 = 0 THEN 'dynamic' WHEN k % 7 = 0 THEN 'pattern' WHEN k % 3 = 0 THEN 'resolved' ELSE 'verified' END AS confidence,
    'f' || (event_id % 7) || '.php' AS file, CAST(event_id % 500 + 1 AS INT) AS line,
    CASE WHEN type = 'option' AND NOT net THEN CASE WHEN value > 60 THEN 'no' WHEN value > 30 THEN 'unknown' ELSE 'yes' END END AS autoload,
    CASE WHEN k % 11 = 0 THEN '$x' || k END AS expression,
    CASE WHEN type = 'cron' THEN CASE WHEN k % 4 = 0 THEN 'daily' ELSE 'hourly' END END AS recurrence,
    event_id % 9 = 0 AS has_args, CASE WHEN net AND type IN ('option', 'transient') THEN 'network' ELSE 'site' END AS scope,
    CASE WHEN autoload = 'yes' THEN 2 WHEN autoload = 'unknown' THEN 1 ELSE 0 END AS rnk
  FROM typed),
core(t, c) AS (VALUES ('option', 'blogname'), ('cron', 'wp_version_check'), ('post_meta', '_edit_lock'), ('table', '{prefix}posts')),
flagged AS (
  SELECT f.*, c.c IS NOT NULL AS core FROM findings f LEFT JOIN core c ON f.type = c.t AND CASE WHEN f.type = 'table' THEN lower(f.key) ELSE f.key END = c.c),
removals AS (
  SELECT slug, event_id AS ord, x.type, 'k' || (k % 6) AS key,
    CASE x.type WHEN 'option' THEN CASE WHEN event_id % 10 = 0 THEN 'delete_site_option' ELSE 'delete_option' END
      WHEN 'transient' THEN CASE WHEN event_id % 10 = 0 THEN 'delete_site_transient' ELSE 'delete_transient' END
      WHEN 'cron' THEN CASE WHEN k % 3 = 1 THEN 'wp_unschedule_hook' ELSE 'wp_clear_scheduled_hook' END
      WHEN 'post_meta' THEN 'delete_post_meta_by_key' WHEN 'table' THEN '$wpdb->query' ELSE 'flush' END AS via,
    CASE WHEN k % 3 <> 0 THEN 'Fn' || (k % 10) END AS function,
    CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'uninstall.php' ELSE 'inc/more.php' END ELSE 'lib.php' END AS file,
    CASE WHEN event_id % 10 = 0 AND x.type IN ('option', 'transient') THEN 'network' ELSE 'site' END AS scope
  FROM ev CROSS JOIN (VALUES ('option'), ('transient'), ('cron'), ('post_meta'), ('table'), ('rewrite_rule')) x(type) WHERE event_type = 'error'),
bulk AS (
  SELECT DISTINCT slug, CASE k % 3 WHEN 0 THEN 'k\_%' WHEN 1 THEN 'K' || (k % 6) || '%' ELSE '\_transient\_k' || (k % 6) END AS pattern,
    CASE WHEN event_id % 4 = 0 THEN 'network' ELSE 'site' END AS scope FROM ev WHERE event_type = 'error' AND k % 5 = 0),
blankets AS (
  SELECT slug, CASE WHEN k % 2 = 0 THEN 'fn' || (k % 10) END AS function FROM ev WHERE event_type = 'error' AND k % 7 = 0),
calls AS (
  SELECT slug, CASE WHEN k % 8 <> 0 THEN 'fn' || (k % 10) END AS src, 'fn' || ((k * 3 + 1) % 10) AS dst,
    CASE event_id % 3 WHEN 0 THEN 'uninstall.php' WHEN 1 THEN 'inc/more.php' ELSE 'main.php' END AS file FROM ev WHERE event_type = 'error' OR k % 4 = 0),
req AS (
  SELECT slug, ['uninstall.php', 'inc/more.php', 'inc/deep.php', 'main.php'][CAST(event_id % 4 AS INT) + 1] AS src,
    ['uninstall.php', 'inc/more.php', 'inc/deep.php', 'main.php'][CAST((k + event_id % 3) % 4 AS INT) + 1] AS dst FROM ev WHERE k % 6 = 0),
ufiles AS (SELECT slug, 'uninstall.php' AS node FROM slugs UNION SELECT u.slug, e.dst FROM ufiles u JOIN req e ON u.slug = e.slug AND u.node = e.src),
sroots AS (
  SELECT slug, 'fn' || (k % 10) AS node FROM ev WHERE event_type = 'error' AND k % 5 = 1
  UNION SELECT c.slug, c.dst FROM calls c JOIN ufiles u ON c.slug = u.slug AND c.file = u.node WHERE c.src IS NULL),
scoped AS (SELECT * FROM sroots UNION SELECT s.slug, c.dst FROM scoped s JOIN calls c ON s.slug = c.slug AND s.node = c.src),
late AS (
  SELECT slug, 'fn' || (k % 10) AS node FROM ev WHERE event_type = 'error' AND k % 5 = 2
  UNION SELECT s.slug, c.dst FROM late s JOIN calls c ON s.slug = c.slug AND s.node = c.src),
rem AS (
  SELECT r.*, CASE WHEN r.function IS NULL THEN r.file = 'uninstall.php' OR (r.slug, r.file) IN (SELECT slug, node FROM ufiles)
      ELSE (r.slug, lower(r.function)) IN (SELECT slug, node FROM scoped) END
    OR (r.function IS NOT NULL AND r.type IN ('cron', 'action', 'transient', 'rewrite_rule') AND (r.slug, lower(r.function)) IN (SELECT slug, node FROM late)) AS runs
  FROM removals r),
whole AS (
  SELECT DISTINCT slug FROM blankets b WHERE function IS NULL OR (slug, function) IN (SELECT slug, node FROM scoped) OR (slug, function) IN (SELECT slug, node FROM late)),
bulked AS (
  SELECT DISTINCT f.ord FROM findings f JOIN bulk b ON f.slug = b.slug AND f.scope = b.scope
  WHERE f.key IS NOT NULL AND f.confidence IN ('verified', 'resolved') AND f.type IN ('option', 'transient')
    AND (CASE WHEN f.type = 'option' THEN f.key WHEN f.scope = 'network' THEN '_site_transient_' || f.key ELSE '_transient_' || f.key END) ILIKE b.pattern ESCAPE '\'),
exact AS (
  SELECT DISTINCT f.ord FROM findings f JOIN rem r ON f.slug = r.slug AND f.type = r.type AND f.scope = r.scope AND f.key = r.key
  WHERE r.runs AND (NOT f.has_args OR f.type <> 'cron' OR r.via = 'wp_unschedule_hook')),
cleaned AS (
  SELECT f.*, f.ord IN (SELECT ord FROM exact) OR f.ord IN (SELECT ord FROM bulked) OR (f.type = 'rewrite_rule' AND f.slug IN (SELECT slug FROM whole)) AS cleaned FROM flagged f),
guards AS (
  SELECT slug, event_id AS ord, CASE WHEN k % 2 = 0 THEN 'keep' || (k % 6) END AS option, CASE k % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'text' END AS default_text,
    CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'fn' || (k % 10) END AS function,
    CASE WHEN event_id % 2 = 0 THEN 'uninstall.php' ELSE 'inc/more.php' END AS file, event_id % 3 = 0 AS exits, event_id % 5 = 0 AS removes, 'fn' || (event_id % 10) AS call
  FROM ev WHERE k % 9 = 0),
removing AS (SELECT DISTINCT slug, lower(function) AS node FROM removals WHERE function IS NOT NULL AND (slug, lower(function)) IN (SELECT slug, node FROM scoped)),
gate AS (
  SELECT slug, arg_min(option, ord) AS option, arg_min(CASE WHEN default_text IS NULL THEN '' ELSE default_text END, ord) AS default_text, min(ord) AS guard_ord,
    arg_min(CASE WHEN option IS NULL THEN '' ELSE option END, ord) AS option_text
  FROM guards WHERE CASE WHEN function IS NULL THEN (slug, file) IN (SELECT slug, node FROM ufiles) ELSE (slug, function) IN (SELECT slug, node FROM scoped) END
    AND (exits OR removes OR (slug, call) IN (SELECT slug, node FROM removing)) GROUP BY slug),
paths AS (
  SELECT s.slug, EXISTS (SELECT 1 FROM removals r WHERE r.slug = s.slug AND r.file = 'uninstall.php') OR EXISTS (SELECT 1 FROM ev WHERE ev.slug = s.slug AND event_type = 'error' AND k % 5 = 1) AS has_path,
    s.slug IN (SELECT slug FROM gate) AS conditional FROM slugs s),
uniq AS (
  SELECT slug, type, key, bool_and(cleaned) AS cleaned, max(rnk) AS rnk, CASE max(rnk) WHEN 2 THEN 'yes' WHEN 1 THEN 'unknown' ELSE arg_min(coalesce(autoload, ''), CASE WHEN rnk = 0 THEN ord END) END AS autoload
  FROM cleaned WHERE key IS NOT NULL AND confidence IN ('verified', 'resolved') AND NOT core GROUP BY slug, type, key),
sums AS (
  SELECT slug, count(*) AS n, count(*) FILTER (NOT cleaned) AS n_left,
    count(*) FILTER (NOT cleaned AND (type IN ('table', 'cron') OR (type = 'option' AND rnk > 0))) AS heavy,
    coalesce(sum(CASE type WHEN 'table' THEN 15 WHEN 'cron' THEN 12 WHEN 'transient' THEN 3 WHEN 'post_meta' THEN 10 WHEN 'rewrite_rule' THEN 2
      ELSE CASE rnk WHEN 2 THEN 18 WHEN 1 THEN 8 ELSE 4 END END) FILTER (NOT cleaned), 0) AS penalty
  FROM uniq GROUP BY slug),
graded AS (
  SELECT slug, letter, CAST(least(CASE WHEN letter = 'B' THEN 90 WHEN letter = 'A' THEN 100 ELSE greatest(0, 100 - penalty) END,
      CASE letter WHEN 'A' THEN 100 WHEN 'B' THEN 90 WHEN 'C' THEN 85 WHEN 'D' THEN 65 ELSE 49 END) AS BIGINT) AS score, n - n_left AS n_cleaned, n_left
  FROM (SELECT p.slug, coalesce(n, 0) AS n, coalesce(n_left, 0) AS n_left, coalesce(penalty, 0) AS penalty,
      CASE WHEN n IS NULL THEN 'A' WHEN NOT has_path AND n_left > 0 THEN 'F' WHEN n_left = 0 THEN CASE WHEN conditional THEN 'B' ELSE 'A' END
        WHEN heavy > 0 THEN 'D' WHEN n_left < 5 THEN 'C' ELSE 'D' END AS letter
    FROM paths p LEFT JOIN sums s ON p.slug = s.slug)),
cov AS (
  SELECT slug, count(*) AS write_calls, count(*) FILTER (confidence = 'verified') AS n_verified, count(*) FILTER (confidence = 'resolved') AS n_resolved,
    count(*) FILTER (confidence = 'pattern') AS n_pattern, count(*) FILTER (confidence = 'dynamic') AS n_dynamic FROM findings GROUP BY slug),
creates AS (
  SELECT slug, type, key, arg_min(confidence, ord) AS confidence, arg_min(coalesce(recurrence, ''), ord) AS recurrence, bool_and(cleaned) AS cleaned,
    CASE max(rnk) WHEN 2 THEN 'yes' WHEN 1 THEN 'unknown' ELSE arg_min(coalesce(autoload, ''), CASE WHEN rnk = 0 THEN ord END) END AS autoload,
    string_agg(file || ':' || line, ',' ORDER BY file, line) AS sources
  FROM cleaned WHERE key IS NOT NULL AND NOT core GROUP BY slug, type, key)
"""

#: Half-up to three decimals in whole numbers.
RATE = "CASE WHEN {t} = 0 THEN 1.0 ELSE CAST((2000 * ({p}) + ({t})) // (2 * ({t})) AS DOUBLE) / 1000 END"


def sql(select: str) -> str:
    return VIEWS + select


GROUP = """CASE type WHEN 'option' THEN 'options' WHEN 'table' THEN 'tables' WHEN 'transient' THEN 'transients' WHEN 'rewrite_rule' THEN 'rewrite_rules' ELSE type END"""
_RATE = RATE.format(p="n_verified + n_resolved", t="write_calls")

HALVES = VIEWS + r""", hb AS (
  SELECT slug, GROUP_ || ':' || key AS id, bool_and(cleaned) AS cleaned, CASE WHEN max(CASE WHEN autoload IS NULL THEN 0 ELSE 1 END) = 1 THEN max(rnk) END AS rnk FROM cleaned WHERE key IS NOT NULL AND NOT core AND ord % 2 = 0 GROUP BY ALL),
ha AS (
  SELECT slug, GROUP_ || ':' || key AS id, bool_and(cleaned) AS cleaned, CASE WHEN max(CASE WHEN autoload IS NULL THEN 0 ELSE 1 END) = 1 THEN max(rnk) END AS rnk FROM cleaned WHERE key IS NOT NULL AND NOT core GROUP BY ALL),
j AS (SELECT coalesce(a.slug, b.slug) AS slug, coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS ia, b.id IS NOT NULL AS ib, a.cleaned AS ca, b.cleaned AS cb, a.rnk AS ra, b.rnk AS rb FROM hb b FULL JOIN ha a ON a.slug = b.slug AND a.id = b.id),
ch AS (
  SELECT slug, id, 'added' AS kind, coalesce(ca, false) AS cleaned FROM j WHERE NOT ib
  UNION ALL SELECT slug, id, 'removed', false FROM j WHERE NOT ia
  UNION ALL SELECT slug, id, 'no_longer_cleaned', ca FROM j WHERE ia AND ib AND cb AND NOT ca
  UNION ALL SELECT slug, id, 'newly_cleaned', ca FROM j WHERE ia AND ib AND NOT cb AND ca
  UNION ALL SELECT slug, id, 'autoload_raised', ca FROM j WHERE ia AND ib AND ra > rb)
""".replace("GROUP_", GROUP)

ORACLES = {
    "cleaned_share": sql("SELECT type, count(*) AS n, count(*) FILTER (cleaned) AS n_cleaned FROM cleaned GROUP BY type"),
    "check_gate": sql(f"SELECT slug, letter IN ('D', 'F') OR r < 0.5 AS failed, r < 0.9 AS is_floor FROM (SELECT g.slug, letter, coalesce({_RATE}, 1.0) AS r FROM graded g LEFT JOIN cov ON g.slug = cov.slug)"),
    "flagship": sql("SELECT letter, count(*) AS n, sum(n_left) AS n_left, sum(score) AS total_score, (SELECT count(DISTINCT type || ':' || key) FROM creates) AS n_artifacts FROM graded GROUP BY letter"),
    "coverage_by_plugin": sql(f"SELECT *, {_RATE} AS resolution_rate FROM cov"),
    "pooled_coverage": sql("SELECT sum(write_calls) AS write_calls, sum(n_verified + n_resolved) AS resolved_calls, " + RATE.format(p="sum(n_verified + n_resolved)", t="sum(write_calls)") + " AS resolution_rate FROM cov"),
    "core_flag": sql("SELECT ord, type, key, core FROM flagged"),
    "core_anti": sql("SELECT type, count(*) AS n FROM flagged WHERE NOT core AND key IS NOT NULL GROUP BY type"),
    "create_groups": sql("SELECT slug, type, key, confidence, recurrence, cleaned, autoload, sources FROM creates"),
    "core_groups": sql("SELECT slug, type, key, arg_min(confidence, ord) AS confidence, string_agg(file || ':' || line, ',' ORDER BY file, line) AS sources FROM flagged WHERE core GROUP BY slug, type, key"),
    "unresolved_list": sql("SELECT slug, string_agg(file || ':' || line || ':' || function || ':' || expression, ',' ORDER BY file, line, function) AS unresolved FROM findings WHERE key IS NULL GROUP BY slug"),
    "unique_confident": sql("SELECT slug, type, key, cleaned, autoload FROM uniq"),
    "grade_letter": sql("SELECT * FROM graded"),
    "grade_histogram": sql("SELECT letter, count(*) AS n, printf('%.1f', 100.0 * count(*) / (SELECT count(*) FROM graded)) AS share FROM graded GROUP BY letter"),
    "cleaned_exact": sql("SELECT ord, ord IN (SELECT ord FROM exact) AS exact FROM findings"),
    "cleaned_scope": sql("SELECT scope, type, count(*) AS n, count(*) FILTER (ord IN (SELECT ord FROM exact)) AS n_exact FROM findings GROUP BY scope, type"),
    "cleaned_has_args": sql("SELECT type, has_args, count(*) FILTER (ord IN (SELECT ord FROM exact)) AS n_exact FROM findings GROUP BY type, has_args"),
    "cleaned_bulk_like": sql("SELECT slug, scope, CASE WHEN type = 'option' THEN key WHEN scope = 'network' THEN '_site_transient_' || key ELSE '_transient_' || key END AS \"row\" FROM findings WHERE ord IN (SELECT ord FROM bulked) GROUP BY ALL"),
    "cleaned_blanket": sql("SELECT slug, count(*) AS n FROM findings WHERE type = 'rewrite_rule' AND slug IN (SELECT slug FROM whole) GROUP BY slug"),
    "cleaned_all": sql("SELECT ord, cleaned FROM cleaned"),
    "runs_on_uninstall": sql("SELECT slug, ord, type, runs FROM rem"),
    "guard_condition": sql("SELECT slug, option_text AS option, default_text, guard_ord FROM gate"),
    "reachable_functions": sql("SELECT slug, node FROM late"),
    "scoped_functions": sql("SELECT slug, node FROM scoped"),
    "uninstall_files": sql("SELECT slug, node FROM ufiles"),
    "reachable_orders": """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 31 + 7) % (SELECT count(*) FROM customer) AS dst FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT c_custkey AS node FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT 'g' AS slug, CAST(node AS VARCHAR) AS node FROM r""",
    "symbol_poison_merge": """
WITH f AS (SELECT 'p' || (p_partkey % 50) AS slug, p_brand AS name, CASE WHEN p_size % 10 > 0 THEN p_type END AS value FROM part)
SELECT slug, name, CASE WHEN count(DISTINCT value) = 1 AND count(value) = count(*) THEN max(value) END AS value, NOT (count(DISTINCT value) = 1 AND count(value) = count(*)) AS poisoned FROM f GROUP BY slug, name""",
    "inherited_member": """
WITH RECURSIVE par AS (
  SELECT s_suppkey % 20 AS s, s_suppkey AS c, arg_max(s_suppkey // 2, s_suppkey) AS p FROM supplier WHERE s_suppkey > 1 GROUP BY s_suppkey),
walk AS (SELECT s_suppkey AS cls, s_suppkey AS owner, 0 AS d FROM supplier UNION SELECT cls, s_owner.s_suppkey // 2, d + 1 FROM walk JOIN supplier s_owner ON walk.owner = s_owner.s_suppkey WHERE s_owner.s_suppkey > 1),
m AS (SELECT s_suppkey AS owner, 'm' || (s_nationkey % 5) AS member, s_name AS value FROM supplier)
SELECT 'g' AS slug, 'c' || cls AS cls, member, arg_min(value, d) AS value, 'c' || arg_min(walk.owner, d) AS owner FROM walk JOIN m ON walk.owner = m.owner GROUP BY cls, member""",
    "poison_overridden": """
WITH RECURSIVE walk AS (SELECT s_suppkey AS cls, s_suppkey AS owner FROM supplier UNION SELECT cls, owner // 2 FROM walk WHERE owner > 1),
m AS (SELECT s_suppkey AS owner, 'm' || (s_nationkey % 5) AS member, s_name AS value FROM supplier)
SELECT 'g' AS slug, 'c' || m.owner AS owner, m.member, CASE WHEN h.owner IS NULL THEN value END AS value, h.owner IS NOT NULL AS poisoned FROM m
LEFT JOIN (SELECT DISTINCT walk.owner, d.member FROM walk JOIN m d ON walk.cls = d.owner WHERE walk.cls <> walk.owner) h ON m.owner = h.owner AND m.member = h.member""",
    "late_bound": """
WITH RECURSIVE walk AS (SELECT s_suppkey AS cls, s_suppkey AS owner FROM supplier UNION SELECT cls, owner // 2 FROM walk WHERE owner > 1),
m AS (SELECT s_suppkey AS owner, 'm' || (s_nationkey % 5) AS member FROM supplier)
SELECT 'c' || m.owner AS owner, m.member FROM m WHERE NOT EXISTS (SELECT 1 FROM walk JOIN m d ON walk.cls = d.owner WHERE walk.cls <> walk.owner AND walk.owner = m.owner AND d.member = m.member)""",
    "wrapper_expand": """
WITH a AS (SELECT 'w' || (o_custkey % 200) AS callee, o_orderkey % 3 AS idx, CASE WHEN o_orderpriority <> '5-LOW' OR o_orderkey % 50 > 0 THEN 'l' || (o_orderkey % 150) END AS literal FROM orders),
g AS (SELECT callee, idx, list_slice(list_sort(list_distinct(list(literal))), 1, 100) AS lits, bool_and(literal IS NOT NULL) AND count(DISTINCT literal) <= 100 AND CAST(substr(callee, 2) AS INT) % 7 > 0 AS complete FROM a GROUP BY callee, idx),
f AS (SELECT c_custkey AS ord, 'w' || (c_custkey % 250) AS callee, c_custkey % 4 AS idx, c_nationkey % 2 = 0 AS sure FROM customer)
SELECT ord, 'a_' || l AS key, 'resolved' AS confidence FROM (SELECT ord, unnest(lits) AS l FROM f JOIN g ON f.callee = g.callee AND f.idx = g.idx WHERE NOT sure)
UNION ALL SELECT ord, CASE WHEN sure THEN 'own' END, CASE WHEN sure THEN 'verified' ELSE 'dynamic' END FROM f LEFT JOIN g ON f.callee = g.callee AND f.idx = g.idx WHERE sure OR g.callee IS NULL OR NOT complete""",
    "resolve_segments": """
WITH s AS (
  SELECT l_orderkey AS expr, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS pos, CASE WHEN l_returnflag = 'R' THEN 'const' ELSE 'lit' END AS kind,
    CASE WHEN l_returnflag = 'R' THEN 'C' || (l_partkey % 40) ELSE CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 's' || (l_partkey % 7) END END AS t FROM lineitem),
v AS (SELECT *, CASE WHEN kind = 'lit' THEN nullif(t, '') WHEN CAST(substr(t, 2) AS INT) % 3 > 0 THEN 'v' || substr(t, 2) END AS val FROM s),
r AS (SELECT *, min(CASE WHEN val IS NULL THEN pos END) OVER (PARTITION BY expr) AS cut FROM v),
k AS (SELECT expr, string_agg(val, '' ORDER BY pos) FILTER (cut IS NULL OR pos < cut) AS known, max(cut) IS NOT NULL AS shut, bool_or(kind = 'const' AND (cut IS NULL OR pos < cut)) AS sym FROM r GROUP BY expr)
SELECT CAST(expr AS VARCHAR) AS expr, CASE WHEN known IS NULL THEN NULL WHEN shut THEN known || '*' ELSE known END AS key,
  CASE WHEN known IS NULL THEN 'dynamic' WHEN shut THEN 'pattern' WHEN sym THEN 'resolved' ELSE 'verified' END AS confidence FROM k""",
    "manifest_diff": HALVES + "SELECT slug, id, kind, cleaned FROM ch",
    "diff_verdict": HALVES + f"""
, cb AS (SELECT slug, {RATE.format(p="count(*) FILTER (confidence IN ('verified', 'resolved'))", t="count(*)")} AS r FROM findings WHERE ord % 2 = 0 GROUP BY slug)
, ca AS (SELECT slug, {_RATE} AS r FROM cov)
, n AS (SELECT slug, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed, count(*) FILTER (kind = 'no_longer_cleaned') AS n_no_longer_cleaned,
    count(*) FILTER (kind = 'newly_cleaned') AS n_newly_cleaned, count(*) FILTER (kind = 'autoload_raised') AS n_autoload_raised,
    count(*) FILTER (kind = 'no_longer_cleaned' OR (kind IN ('added', 'autoload_raised') AND NOT cleaned)) AS bad FROM ch GROUP BY slug)
SELECT ca.slug, coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_no_longer_cleaned, 0) AS n_no_longer_cleaned, coalesce(n_newly_cleaned, 0) AS n_newly_cleaned,
  coalesce(n_autoload_raised, 0) AS n_autoload_raised, coalesce(ca.r < cb.r, false) AS dropped, coalesce(bad, 0) > 0 OR coalesce(ca.r < cb.r, false) AS regressed
FROM ca LEFT JOIN cb ON ca.slug = cb.slug LEFT JOIN n ON ca.slug = n.slug""",
    "reverse_lookup": sql("SELECT type || ':' || key AS id, string_agg(DISTINCT slug, ',' ORDER BY slug) AS slugs, count(DISTINCT slug) AS n_slugs FROM creates GROUP BY type, key"),
    "distinct_artifacts": sql("SELECT count(*) AS artifacts, count(*) FILTER (cleaned) AS cleaned, count(*) FILTER (NOT cleaned) AS left_behind, count(DISTINCT type || ':' || key) AS distinct_artifacts FROM creates"),
    "left_by_type": sql("SELECT type, count(*) AS n FROM creates WHERE NOT cleaned GROUP BY type"),
    "heaviest_footprint": sql("SELECT slug, count(*) AS n FROM creates GROUP BY slug ORDER BY n DESC, slug LIMIT 10"),
    "qa_violations": sql("""
SELECT category, count(*) AS n FROM (
  SELECT 'unreadable' AS category FROM slugs WHERE CAST(substr(slug, 2) AS INT) % 13 = 0
  UNION ALL SELECT 'schema_version' FROM slugs WHERE CAST(substr(slug, 2) AS INT) % 13 > 0 AND CAST(substr(slug, 2) AS INT) % 17 = 0
  UNION ALL SELECT 'zero_files' FROM slugs WHERE CAST(substr(slug, 2) AS INT) % 13 > 0 AND CAST(substr(slug, 2) AS INT) % 19 = 0
  UNION ALL SELECT 'core_artifacts' FROM (SELECT DISTINCT slug, type, key FROM flagged WHERE core AND CAST(substr(slug, 2) AS INT) % 13 > 0 AND CAST(substr(slug, 2) AS INT) % 5 = 0)) GROUP BY category"""),
    "pinned_missing": "SELECT 's' || c_custkey AS slug FROM customer WHERE c_custkey % 40 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "pinned_extra": "SELECT DISTINCT 's' || k AS slug FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0)",
    "resume_pending": "SELECT 's' || c_custkey AS slug FROM customer WHERE c_custkey % 40 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "coverage_floor": """
WITH p AS (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0)
SELECT count(*) AS n_pinned, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_missing, CAST(count(*) - floor(count(*) * 995 / 1000.0) AS BIGINT) AS allowed,
  count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) > count(*) - floor(count(*) * 995 / 1000.0) AS failed FROM p""",
    "missing_shown": "WITH m AS (SELECT 's' || c_custkey AS slug FROM customer WHERE c_custkey % 40 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)), t AS (SELECT slug FROM m ORDER BY slug LIMIT 20) SELECT coalesce((SELECT string_agg(slug, ', ' ORDER BY slug) FROM t), '') || CASE WHEN (SELECT count(*) FROM m) > 20 THEN ', ...' ELSE '' END AS listed",
    "provenance_merge": "SELECT source || '-' || (doc_id % 7) AS slug, arg_min('v' || lang, doc_id) AS version, arg_min(sha256(text), doc_id) AS sha256 FROM documents GROUP BY 1",
    "shard_assignment": "SELECT slug, (pos % 10) AS shard, (pos // 10) // 100 AS wave FROM (SELECT 's' || c_custkey AS slug, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)",
    "header_extract": "SELECT page_id, nullif(regexp_extract(html, '(?i)<title>([^<]*)', 1), '') AS title, nullif(regexp_extract(html, '(?i)<html lang=\"([a-z]+)', 1), '') AS lang FROM pages",
    "plugin_header": "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 3 > 0 THEN '1.' || p_size END AS version FROM part",
    "sql_created": "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN '' ELSE '{prefix}t' || p_size || CASE WHEN p_size % 2 = 0 THEN ',' || p_brand ELSE '' END END AS names FROM part",
    "sql_dropped": "SELECT p_partkey, 'a' || p_size || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',b' || p_size END AS names FROM part",
    "sql_deleted_rows": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 4 THEN '' WHEN s_suppkey % 2 = 0 THEN 'option|acme\\_' || s_nationkey || '%|false' || ';option|x\\_y\\%|false' ELSE 'option|m' || s_nationkey || '|true' END AS rows_text FROM supplier",
    "path_classify": "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'dropin' WHEN p_size % 4 = 1 THEN 'muplugin' END AS kind FROM part",
    "path_normalize": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a/' || p_brand || '/c.php' WHEN 1 THEN 'c' || p_size ELSE 'x/y' END AS path FROM part",
    "file_filter": "SELECT p_partkey, p_size % 6 IN (0, 3) AS kept FROM part",
    "generator_routing": sql("""
SELECT slug, bucket, key, CASE WHEN bool_or(c = 'wp_unschedule_hook') THEN 'wp_unschedule_hook' ELSE max(c) END AS call FROM (
  SELECT slug, key, CASE type WHEN 'option' THEN CASE WHEN scope = 'network' THEN 'site_options' ELSE 'options' END WHEN 'transient' THEN CASE WHEN scope = 'network' THEN 'site_transients' ELSE 'transients' END
      WHEN 'post_meta' THEN 'meta' WHEN 'table' THEN 'tables' WHEN 'cron' THEN 'cron' ELSE 'content' END AS bucket,
    CASE WHEN type = 'cron' THEN CASE WHEN has_args THEN 'wp_unschedule_hook' ELSE 'wp_clear_scheduled_hook' END WHEN type = 'post_meta' THEN 'post' ELSE type END AS c
  FROM cleaned WHERE key IS NOT NULL AND confidence IN ('verified', 'resolved') AND NOT core AND NOT cleaned) GROUP BY slug, bucket, key"""),
    "generator_teardown": sql(r"""
SELECT slug, concat('<?php', nl, '/** Generated uninstall routine for ', upper(slug), '. Review before shipping. */', nl, 'defined(''WP_UNINSTALL_PLUGIN'') || exit;', nl,
    CASE WHEN own IS NULL THEN '' ELSE concat(nl, '$each_site = static function (): void {', nl, CASE WHEN db THEN '    global $wpdb;' || nl ELSE '' END, own, '};', nl, 'if (is_multisite()) {', nl,
      '    foreach (get_sites([''fields'' => ''ids'', ''number'' => 0]) as $site) {', nl, '        switch_to_blog((int) $site);', nl, '        $each_site();', nl, '        restore_current_blog();', nl,
      '    }', nl, '} else {', nl, '    $each_site();', nl, '}', nl) END, coalesce(rest, '')) AS text
FROM (
  SELECT slug, chr(10) AS nl, bool_or(place = 2) AS db, string_agg(chr(10) || '    // ' || head || chr(10) || lines, '' ORDER BY place) FILTER (place < 10) AS own,
    string_agg(chr(10) || '// ' || head || chr(10) || lines, '' ORDER BY place) FILTER (place >= 10) AS rest
  FROM (
    SELECT slug, place, any_value(head) AS head, string_agg(CASE WHEN place < 10 THEN '    ' ELSE '' END || line || chr(10), '' ORDER BY key) AS lines
    FROM (
      SELECT slug, key, place, any_value(head) AS head, CASE WHEN place = 3 AND bool_or(has_args) THEN 'wp_unschedule_hook(''' || key || ''');' ELSE any_value(line) END AS line
      FROM (
        SELECT slug, key, has_args, CASE WHEN type = 'option' AND scope = 'network' THEN 10 WHEN type = 'transient' AND scope = 'network' THEN 11
            ELSE CASE type WHEN 'option' THEN 1 WHEN 'table' THEN 2 WHEN 'cron' THEN 3 WHEN 'transient' THEN 4 WHEN 'post_meta' THEN 5 ELSE 12 END END AS place,
          CASE WHEN type = 'option' AND scope = 'network' THEN 'Network options' WHEN type = 'transient' AND scope = 'network' THEN 'Network transients'
            ELSE CASE type WHEN 'option' THEN 'Options' WHEN 'table' THEN 'Custom tables' WHEN 'cron' THEN 'Scheduled events' WHEN 'transient' THEN 'Transients' WHEN 'post_meta' THEN 'Metadata, of every object'
              ELSE 'Left behind on purpose, as removal could destroy data' END END AS head,
          CASE type WHEN 'option' THEN CASE WHEN scope = 'network' THEN 'delete_site_option' ELSE 'delete_option' END || '(''' || key || ''');'
            WHEN 'transient' THEN CASE WHEN scope = 'network' THEN 'delete_site_transient' ELSE 'delete_transient' END || '(''' || key || ''');'
            WHEN 'table' THEN '$wpdb->query(''DROP TABLE IF EXISTS `'' . str_replace(''`'', ''``'', ''' || key || ''') . ''`'');'
            WHEN 'cron' THEN 'wp_clear_scheduled_hook(''' || key || ''');' WHEN 'post_meta' THEN 'delete_post_meta_by_key(''' || key || ''');'
            ELSE '// - rewrite rule "' || key || '"' END AS line
        FROM cleaned WHERE key IS NOT NULL AND confidence IN ('verified', 'resolved') AND NOT core AND NOT cleaned)
      GROUP BY slug, key, place)
    GROUP BY slug, place)
  GROUP BY slug)"""),
    "corpus_stats": sql(f"""
SELECT concat('{{"generated_at":"2025-01-01T00:00:00Z","plugins":', (SELECT count(*) FROM slugs), ',"grades":{{', (SELECT string_agg('"' || letter || '":' || n, ',' ORDER BY letter) FROM (SELECT letter, count(*) AS n FROM graded GROUP BY letter)),
  '}},"coverage":{{"write_calls":', w, ',"resolved_calls":', r, ',"resolution_rate":', {RATE.format(p="r", t="w")}, '}},"artifacts":{{"artifacts":', a, ',"cleaned":', c, ',"left_behind":', a - c, ',"distinct_artifacts":', u,
  ',"left_by_type":{{', (SELECT string_agg('"' || type || '":' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM creates WHERE NOT cleaned GROUP BY type)),
  '}}}},"cleanup":{{"with_path":', (SELECT count(*) FILTER (has_path) FROM paths), ',"conditional":', (SELECT count(*) FILTER (conditional) FROM paths), '}}}}') AS doc
FROM (SELECT sum(write_calls) AS w, sum(n_verified + n_resolved) AS r FROM cov), (SELECT count(*) AS a, count(*) FILTER (cleaned) AS c, count(DISTINCT type || ':' || key) AS u FROM creates)"""),
    "snapshot_diff": """
WITH a AS (SELECT o_custkey AS g, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS b, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS c, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P') AS d FROM orders GROUP BY 1),
n AS (SELECT g, coalesce(b, []) AS b, coalesce(c, []) AS c, coalesce(d, []) AS d FROM a)
SELECT g, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(b, x))), ',') AS created,
  array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(b, x) AND list_contains(d, x))), ',') AS leftover,
  array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(d, x))), ',') AS collateral FROM n""",
    "manifest_roundtrip": sql("SELECT slug, letter AS grade, score, (SELECT count(*) FROM creates c WHERE c.slug = g.slug) AS n_creates, coalesce((SELECT write_calls FROM cov WHERE cov.slug = g.slug), 0) AS write_calls FROM graded g"),
}
