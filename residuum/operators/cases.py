"""Scans of one small plugin per supplier, of which each kind of source is in turn.

A case is a source in which @ stands for the supplier's number, and the rows
that it must give. The expected rows are the oracle, as SQL values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators.synth import NOW, _files
from residuum.phpsrc import scan
from residuum.plans.tables import table

_O = "update_option"


def _opt(key: str | None, confidence: str, function: str = _O) -> tuple:
    return ("option", function, key, confidence)


#: Source, and (type, function, key, confidence) of what it writes.
WRITES = [
    ("update_option('o@', 1);", [_opt("o@", "verified")]),
    ("add_option('o@'); add_site_option('p@', 1); update_site_option('q@', 1);", [_opt("o@", "verified", "add_option"), _opt("p@", "verified", "add_site_option"), _opt("q@", "verified", "update_site_option")]),
    ("set_transient('t@', 1); set_site_transient('u@', 1);", [("transient", "set_transient", "t@", "verified"), ("transient", "set_site_transient", "u@", "verified")]),
    ("wp_schedule_event(time(), 'daily', 'h@'); wp_schedule_single_event(time(), 'i@');", [("cron", "wp_schedule_event", "h@", "verified"), ("cron", "wp_schedule_single_event", "i@", "verified")]),
    ("as_enqueue_async_action('j@');", [("action", "as_enqueue_async_action", "j@", "verified")]),
    ("update_post_meta(1, 'k@', 2); add_user_meta(1, $x, 2);", [("post_meta", "update_post_meta", "k@", "verified"), ("user_meta", "add_user_meta", None, "dynamic")]),
    ("register_meta('term', 'm@', []); register_meta($t, 'm@', []);", [("term_meta", "register_meta", "m@", "verified")]),
    ("add_metadata('comment', 1, 'n@', 2); update_metadata('user', 1, 'o@', 2);", [("comment_meta", "add_metadata", "n@", "verified"), ("user_meta", "update_metadata", "o@", "verified")]),
    ("add_role('r@', 'R', ['c@' => true, 'd@' => true, 3]);", [("role", "add_role", "r@", "verified"), ("capability", "add_role", "c@", "verified"), ("capability", "add_role", "d@", "verified")]),
    ("$role->add_cap('c@'); $wp_roles->add_cap('editor', 'd@');", [("capability", "add_cap", "c@", "verified"), ("capability", "add_cap", "d@", "verified")]),
    ("register_post_type('p@'); register_taxonomy('x@', 'p@');", [("post_type", "register_post_type", "p@", "verified"), ("taxonomy", "register_taxonomy", "x@", "verified")]),
    ("add_rewrite_rule('^x@', 'y'); add_rewrite_tag();", [("rewrite_rule", "add_rewrite_rule", "^x@", "verified")]),
    ("wp_mkdir_p(WP_CONTENT_DIR . '/a@'); wp_mkdir_p(WP_CONTENT_DIR); mkdir($x);", [("directory", "wp_mkdir_p", "{content_dir}/a@", "resolved"), ("directory", "mkdir", None, "dynamic")]),
    ("file_put_contents(WP_CONTENT_DIR . '/db.php', '@'); copy($a, WPMU_PLUGIN_DIR . '/x@.php'); copy($a, WP_CONTENT_DIR . '/o@.php');", [("dropin", "file_put_contents", "{content_dir}/db.php", "resolved"), ("muplugin", "copy", "{mu_plugins}/x@.php", "resolved")]),
    ("$wpdb->query('CREATE TABLE IF NOT EXISTS a@ (id int)');", [("table", "$wpdb->query", "a@", "verified")]),
    ('dbDelta("CREATE TABLE {$wpdb->prefix}t@ (id int)");', [("table", "dbDelta", "{prefix}t@", "resolved")]),
    ('dbDelta("CREATE TABLE {$wpdb->prefix}t@{$x} (id int)");', [("table", "dbDelta", None, "dynamic")]),
    ("$f = update_option(...);", [_opt(None, "dynamic")]),
    ("update_option('a@_' . $x, 1);", [_opt("a@_*", "pattern")]),
    ("update_option($x . 'a@', 1);", [_opt(None, "dynamic")]),
    ("$x = 'b@'; update_option('a_' . $x, 1);", [_opt("a_b@", "resolved")]),
    ("$x = 'b@'; if ($c) { $x = 'd@'; } update_option($x, 1);", [_opt(None, "dynamic")]),
    ("$x = 'b@'; $x .= 'c'; update_option($x, 1);", [_opt(None, "dynamic")]),
    ("define('C', 'v@'); update_option(C, 1);", [_opt("v@", "resolved")]),
    ("define('C', 'v@'); define('C', 'w@'); update_option(C, 1);", [_opt(None, "dynamic")]),
    ("class K { const C = 'v@'; function f() { update_option(self::C, 1); } }", [_opt("v@", "resolved")]),
    ("class P { const C = 'v@'; } class K extends P { function f() { update_option(parent::C . '_x', 1); } }", [_opt("v@_x", "resolved")]),
    ("class K { const C = 'v@'; function f() { update_option(static::C, 1); } } class L extends K { const C = 'w@'; }", [_opt(None, "dynamic")]),
    ("class K { private $p = 'v@'; function f() { update_option($this->p, 1); } }", [_opt("v@", "resolved")]),
    ("class K { public $p = 'v@'; function f() { update_option($this->p, 1); } } class L extends K { public $p = 'w@'; }", [_opt(None, "dynamic")]),
    ("class K { private $p = 'v@'; function g($x) { $this->p = $x; } function f() { update_option($this->p, 1); } }", [_opt(None, "dynamic")]),
    ("class K { function __construct(private $p = 'v@') {} function f() { update_option($this->p, 1); } }", [_opt(None, "dynamic")]),
    ("trait T { static $s = 't@'; } trait U { static $s = 'u@'; } class K { use T, U; function f() { update_option(self::$s, 1); } }", [_opt("u@", "resolved")]),
    ("class K { function f() { update_option(__CLASS__ . '_x@', 1); } }", [_opt("K_x@", "resolved")]),
    ("namespace N@; class K { function f() { update_option(K::class, 1); } }", [_opt("N@\\K", "resolved")]),
    ("update_option(option: 'a@', value: 1);", [_opt("a@", "verified")]),
    ("update_option($wpdb->prefix . 'u@', 1);", [_opt("{prefix}u@", "resolved")]),
    ("update_option(<<<X\nabc@\nX, 1);", [_opt("abc@", "verified")]),
    ("class O { function set($k, $v) { update_option('p_' . $k, $v); } } function go(O $o) { $o->set('a@', 1); $o->set('b@', 2); }", [_opt("p_a@", "resolved"), _opt("p_b@", "resolved")]),
    ("class O { function set($k, $v) { update_option('p_' . $k, $v); } } function go(O $o, $x) { $o->set('a@', 1); $o->set($x, 2); }", [_opt("p_a@", "resolved"), _opt("p_*", "pattern")]),
    ("function set($k) { update_option($k, 1); } set('a@'); add_action('init', 'set');", [_opt("a@", "resolved"), _opt(None, "dynamic")]),
    ("function set($k) { $k = strtolower($k); update_option($k, 1); } set('a@');", [_opt(None, "dynamic")]),
    ("foreach (['a@', 'b@'] as $n) { add_option('k_' . $n); }", [_opt("k_a@", "resolved", "add_option"), _opt("k_b@", "resolved", "add_option")]),
    ("$list = ['a@' => 1, 'b@' => 2]; foreach ($list as $n => $v) { add_option($n); } add_option($n);", [_opt("a@", "resolved", "add_option"), _opt("b@", "resolved", "add_option"), _opt(None, "dynamic", "add_option")]),
    ("$x = ; add_option('b@');", [_opt("b@", "verified", "add_option")]),
    ("echo 'update_option(1@)'; // add_option('c@');", []),
]
#: Source, and (type, key, via) of what it removes.
REMOVALS = [
    ("delete_option('a@'); delete_site_option('b@');", [("option", "a@", "delete_option"), ("option", "b@", "delete_site_option")]),
    ("delete_transient('a@'); delete_site_transient('b@');", [("transient", "a@", "delete_transient"), ("transient", "b@", "delete_site_transient")]),
    ("wp_clear_scheduled_hook('h@'); wp_clear_scheduled_hook('i@', [1]); wp_unschedule_hook('j@');", [("cron", "h@", "wp_clear_scheduled_hook"), ("cron", "j@", "wp_unschedule_hook")]),
    ("as_unschedule_all_actions('a@'); as_unschedule_all_actions('b@', [1]);", [("action", "a@", "as_unschedule_all_actions")]),
    ("delete_post_meta(1, 'k@'); delete_option($x);", []),
    ("foreach ($posts as $p) { delete_post_meta($p, 'k@'); }", [("post_meta", "k@", "delete_post_meta")]),
    ("delete_post_meta_by_key('k@');", [("post_meta", "k@", "delete_post_meta_by_key")]),
    ("delete_metadata('user', 0, 'm@', '', true); delete_metadata('user', 1, 'n@');", [("user_meta", "m@", "delete_metadata")]),
    ("foreach (['a@', 'b@'] as $o) delete_option('x_' . $o);", [("option", "x_a@", "delete_option"), ("option", "x_b@", "delete_option")]),
    ("unlink(WP_CONTENT_DIR . '/db.php'); wp_delete_file(WPMU_PLUGIN_DIR . '/x@.php'); unlink('y@');", [("dropin", "{content_dir}/db.php", "unlink"), ("muplugin", "{mu_plugins}/x@.php", "wp_delete_file")]),
    ("remove_role('r@');", [("role", "r@", "remove_role")]),
    ("$wpdb->query('DROP TABLE IF EXISTS a@, `b@`');", [("table", "a@", "$wpdb->query"), ("table", "b@", "$wpdb->query")]),
    ('$wpdb->query("DROP TABLE {$wpdb->prefix}t@");', [("table", "{prefix}t@", "$wpdb->query")]),
    ("define('C', 'v@'); delete_option(C); delete_option('a@_' . $x);", [("option", "v@", "delete_option")]),
    ("delete_option('a@'); if (", []),
]
#: Source, and (option, default, exits, removes) of its gates.
GATES = [
    ("if (!get_option('keep@')) { return; }", [("keep@", "false", True, False)]),
    ("$k = get_option('keep@', true); if ($k) { delete_option('a'); }", [("keep@", "true", False, True)]),
    ("if (get_option('mode@', 'soft') === 'hard') { delete_option('a'); }", [("mode@", "soft", False, True)]),
    ("if (Settings::get('remove_data@')) { $wpdb->query($x); }", [("remove_data@", None, False, True)]),
    ("if (!defined('WP_UNINSTALL_PLUGIN')) { exit; }", []),
    ("if (is_multisite()) { delete_option('a@'); }", []),
    ("if (function_exists('remove_all_data')) { delete_option('a@'); }", []),
    ("if (get_site_option('net@')) { exit; }", [("net@", "false", True, False)]),
]
#: main.php, uninstall.php or none, and (type, key, cleaned) of what is written.
CLEANUPS = [
    ("add_option('a@');", "delete_option('a@');", [("option", "a@", True)]),
    ("add_option('a@');", None, [("option", "a@", False)]),
    ("add_option('a@');", "function never() { delete_option('a@'); }", [("option", "a@", False)]),
    ("add_option('a@'); register_uninstall_hook(__FILE__, 'gone'); function gone() { more(); } function more() { delete_option('a@'); }", None, [("option", "a@", True)]),
    ("set_transient('t@', 1); register_deactivation_hook(__FILE__, 'off'); function off() { delete_transient('t@'); }", None, [("transient", "t@", True)]),
    ("wp_schedule_event(1, 'd', 'h@', [1]);", "wp_clear_scheduled_hook('h@');", [("cron", "h@", False)]),
    ("wp_schedule_event(1, 'd', 'h@', [1]);", "wp_unschedule_hook('h@');", [("cron", "h@", True)]),
    ("wp_schedule_event(1, 'd', 'h@');", "wp_clear_scheduled_hook('h@');", [("cron", "h@", True)]),
    ("add_option('acme@_a'); set_transient('acme@_t', 1);", "$wpdb->query(\"DELETE FROM {$wpdb->options} WHERE option_name LIKE 'acme@\\_%' OR option_name LIKE '\\_transient\\_acme@%'\");", [("option", "acme@_a", True), ("transient", "acme@_t", True)]),
    ("add_option('acme@_a');", "$wpdb->query(\"DELETE FROM {$wpdb->options} WHERE option_name LIKE 'acme@\\_%' AND autoload = 'no'\");", [("option", "acme@_a", False)]),
    ("update_site_option('a@', 1);", "delete_option('a@');", [("option", "a@", False)]),
    ("update_site_option('a@', 1);", "delete_site_option('a@');", [("option", "a@", True)]),
    ("add_option('a@');", "delete_option('a@'); if (", [("option", "a@", False)]),
    ("add_rewrite_rule('x@', 'y');", "flush_rewrite_rules();", [("rewrite_rule", "x@", True)]),
    ("dbDelta(\"CREATE TABLE {$wpdb->prefix}x@ (id int)\");", "$wpdb->query(\"DROP TABLE IF EXISTS {$wpdb->prefix}x@\");", [("table", "{prefix}x@", True)]),
    ("update_option('a@_' . $x, 1);", "delete_option('a@_');", [("option", "a@_*", False)]),
]


def _suppliers(spark: SparkSession, d: str, cases: list, **files: int) -> DataFrame:
    """Files of one plugin per supplier; ``files`` names a file and its place in a case."""
    number = F.col("s_suppkey").cast("string")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), number).alias("slug"), number.alias("number"), F.pmod("s_suppkey", F.lit(len(cases))).alias("case"))
    texts = {}
    for name, at in files.items():
        body = F.lit(None).cast("string")
        for k, case in enumerate(cases):
            if case[at] is not None:
                body = F.when(F.col("case") == k, F.lit("<?php " + case[at])).otherwise(body)
        texts[f"{name}.php"] = F.replace(body, F.lit("@"), F.col("number"))
    return _files(rows, texts)


def _sql(cases: list, columns: tuple[str, ...]) -> str:
    def value(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({k}, {', '.join(map(value, row))})" for k, case in enumerate(cases) for row in case[-1])
    of = {"key", "option"}
    shown = ", ".join(f"replace({c}, '@', CAST(s_suppkey AS VARCHAR)) AS {c}" if c in of else f"CAST({c} AS BOOLEAN) AS {c}" if c in ("exits", "removes", "cleaned") else c for c in columns)
    return f'SELECT \'s\' || s_suppkey AS slug, {shown} FROM supplier JOIN (VALUES {rows}) AS v("case", {", ".join(columns)}) ON s_suppkey % {len(cases)} = "case"'


def scan_writes(spark: SparkSession, d: str) -> DataFrame:
    """What each source writes, its key and how sure that is."""
    return scan.relations(_suppliers(spark, d, WRITES, main=0))["finding"].select("slug", "type", "function", "key", "confidence")


def scan_removals(spark: SparkSession, d: str) -> DataFrame:
    """What each source removes by name."""
    return scan.relations(_suppliers(spark, d, REMOVALS, main=0))["removal"].select("slug", "type", "key", "via")


def scan_gates(spark: SparkSession, d: str) -> DataFrame:
    """The settings that removals depend on."""
    return scan.relations(_suppliers(spark, d, GATES, main=0))["guard"].select("slug", "option", F.col("default_text").alias("fallback"), "exits", "removes")


def scan_cleanups(spark: SparkSession, d: str) -> DataFrame:
    """Which writes are cleaned up, through all ways that run on uninstall."""
    files = _suppliers(spark, d, CLEANUPS, main=0, uninstall=1)
    headers = files.select("slug").distinct().withColumns({"plugin_name": F.lit("X"), "plugin_version": F.lit("1")})
    return scan.analyse(files, headers, NOW)["findings"].select("slug", "type", "key", F.coalesce("cleaned", F.lit(False)).alias("cleaned"))


QUERIES = {"scan_case_writes": scan_writes, "scan_case_removals": scan_removals, "scan_case_gates": scan_gates, "scan_case_cleanups": scan_cleanups}
ORACLES = {
    "scan_case_writes": _sql(WRITES, ("type", "function", "key", "confidence")),
    "scan_case_removals": _sql(REMOVALS, ("type", "key", "via")),
    "scan_case_gates": _sql(GATES, ("option", "fallback", "exits", "removes")),
    "scan_case_cleanups": _sql(CLEANUPS, ("type", "key", "cleaned")),
}
