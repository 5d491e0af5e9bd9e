"""From findings to a teardown routine: what is deletable, its bucket, its statement, and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators import dims
from residuum.operators.grading import without_core

#: Buckets in the order of the text, their headings, and whether each site of a network has its own.
BUCKETS = [
    ("options", "Options", True), ("tables", "Custom tables", True), ("cron", "Scheduled events", True), ("transients", "Transients", True),
    ("meta", "Metadata, of every object", True), ("roles", "Roles and what they were created with", True), ("actions", "Queued actions, if the library is still there", True),
    ("site_options", "Network options", False), ("site_transients", "Network transients", False), ("user_meta", "User metadata, of every user", False),
    ("dropins", "Drop-ins, removed only if they still name this plugin", False), ("muplugins", "Must-use files", False),
    ("capabilities", "Capabilities that may be left; find the role that holds each", False), ("content", "Left behind on purpose, as removal could destroy data", False),
]
#: Portable tokens and what they stand for in the text.
TOKENS = {"{prefix}": "$wpdb->prefix", "{content_dir}": "WP_CONTENT_DIR", "{mu_plugins}": "WPMU_PLUGIN_DIR", "{plugin_dir}": "WP_PLUGIN_DIR", "{abspath}": "ABSPATH"}


def bucket(kind: Column, key: Column, function: Column) -> Column:
    """Where an artifact goes; null for types that are never mentioned."""
    network = dims.network_call(function)
    return (
        F.when(kind == "option", F.when(network, "site_options").otherwise("options"))
        .when(kind == "transient", F.when(network, "site_transients").otherwise("transients"))
        .when(kind == "user_meta", F.when(F.contains(key, F.lit("{prefix}")), "meta").otherwise("user_meta"))
        .when(kind.isin("post_meta", "term_meta", "comment_meta"), "meta")
        .when(kind.isin("post_type", "taxonomy", "directory", "rewrite_rule"), "content")
        .when(kind == "table", "tables").when(kind == "cron", "cron").when(kind == "role", "roles").when(kind == "action", "actions")
        .when(kind == "capability", "capabilities").when(kind == "dropin", "dropins").when(kind == "muplugin", "muplugins")
    )


def route(findings: DataFrame) -> DataFrame:
    """slug, bucket, key, call: one row per deletable key of a bucket. ``call`` is the clearing
    call of an event (the broad one if any of its writes has arguments) or the object's type."""
    own = without_core(findings.filter(dims.confident(F.col("confidence")) & F.col("key").isNotNull() & ~F.coalesce("cleaned", F.lit(False))))
    kind = F.col("type")
    call = F.when(kind == "cron", F.when(F.col("has_args"), "wp_unschedule_hook").otherwise("wp_clear_scheduled_hook")).when(
        kind.isin("user_meta", "post_meta", "term_meta", "comment_meta"), F.regexp_replace(kind, "_meta$", "")
    ).otherwise(kind)
    routed = own.select("slug", "ord", bucket(kind, F.col("key"), F.col("function")).alias("bucket"), "key", call.alias("call")).filter("bucket is not null")
    broad = F.max_by("call", F.struct((F.col("call") == "wp_unschedule_hook").cast("int"), "ord"))
    return routed.groupBy("slug", "bucket", "key").agg(broad.alias("call"))


def quoted(text: Column) -> Column:
    """A single-quoted literal."""
    return F.concat(F.lit("'"), F.regexp_replace(text, r"([\\'])", r"\\$1"), F.lit("'"))


def key_expression(key: Column) -> Column:
    """An expression for a key: literals and what its tokens stand for, joined by dots."""
    parts = F.regexp_extract_all(key, F.lit(r"(\{(?:prefix|content_dir|mu_plugins|plugin_dir|abspath)\}|(?:(?!\{(?:prefix|content_dir|mu_plugins|plugin_dir|abspath)\})[\s\S])+)"))
    named = F.create_map(*(F.lit(x) for pair in TOKENS.items() for x in pair))
    return F.when(key == "", F.lit("''")).otherwise(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(named, p), quoted(p))), " . "))


def _comment_safe(text: Column) -> Column:
    """Text that can't end a line comment: no new line, no closing tag."""
    return F.replace(F.translate(text, "\r\n", "  "), F.lit("?>"), F.lit("? >"))


def statement(bucket_: Column, key: Column, call: Column, name: Column) -> Column:
    """The statement, or comment, for one key."""
    k = key_expression(key)
    simple = {"options": "delete_option", "site_options": "delete_site_option", "transients": "delete_transient", "site_transients": "delete_site_transient", "roles": "remove_role", "muplugins": "wp_delete_file"}
    out = F.when(bucket_ == "cron", F.concat(call, F.lit("("), k, F.lit(");")))
    for where, fn in simple.items():
        out = out.when(bucket_ == where, F.concat(F.lit(f"{fn}("), k, F.lit(");")))
    object_meta = F.concat(F.lit("delete_metadata('"), call, F.lit("', 0, "), k, F.lit(", '', true);"))
    return (
        out.when(bucket_ == "tables", F.concat(F.lit("$wpdb->query('DROP TABLE IF EXISTS `' . str_replace('`', '``', "), k, F.lit(") . '`');")))
        .when((bucket_ == "meta") & (call == "post"), F.concat(F.lit("delete_post_meta_by_key("), k, F.lit(");")))
        .when(bucket_.isin("meta", "user_meta"), object_meta)
        .when(bucket_ == "actions", F.concat(F.lit("function_exists('as_unschedule_all_actions') && as_unschedule_all_actions("), k, F.lit(");")))
        .when(bucket_ == "dropins", F.concat(F.lit("is_file("), k, F.lit(") && stripos((string) file_get_contents("), k, F.lit("), "), quoted(name), F.lit(") !== false && wp_delete_file("), k, F.lit(");")))
        .when(bucket_ == "capabilities", F.concat(F.lit("// remove_cap('<role>', "), _comment_safe(quoted(key)), F.lit(");")))
        .otherwise(F.concat(F.lit("// - "), F.translate(call, "_", " "), F.lit(' "'), _comment_safe(key), F.lit('"')))
    )


def teardown(findings: DataFrame, names: DataFrame) -> DataFrame:
    """slug and ``text``, a whole teardown file; ``names`` has slug and plugin_name.

    Statements that each site of a network needs run once for each of them.
    """
    order = F.create_map(*(F.lit(x) for k, (b, *_) in enumerate(BUCKETS) for x in (b, k)))
    heads = F.create_map(*(F.lit(x) for b, head, _ in BUCKETS for x in (b, head)))
    per_site = F.create_map(*(F.lit(x) for b, _, own in BUCKETS for x in (b, own)))
    name = F.coalesce(F.nullif(F.trim(F.replace(F.translate("plugin_name", "\r\n", "  "), F.lit("*/"), F.lit(" "))), F.lit("")), F.lit("this plugin"))
    rows = route(findings).join(names, "slug", "left").withColumn("plugin_name", name)
    lines = rows.select("slug", "plugin_name", "bucket", "key", statement(F.col("bucket"), F.col("key"), F.col("call"), F.col("plugin_name")).alias("line"), F.contains("key", F.lit("{prefix}")).alias("prefixed"))
    blocks = lines.groupBy("slug", "plugin_name", "bucket").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("own"), F.bool_or("prefixed").alias("prefixed"))
    head = F.concat(F.lit("// "), heads[F.col("bucket")])
    block = F.struct(order[F.col("bucket")].alias("at"), per_site[F.col("bucket")].alias("site"), F.concat(F.array(F.lit(""), head), F.transform("own", lambda x: x["line"])).alias("lines"), ((F.col("bucket") == "tables") | F.col("prefixed")).alias("db"))
    whole = blocks.groupBy("slug", "plugin_name").agg(F.array_sort(F.collect_list(block)).alias("b"))
    part = lambda own: F.filter("b", lambda x: x["site"] == own)
    db = lambda own: F.when(F.exists(part(own), lambda x: x["db"]), F.array(F.lit("global $wpdb;"))).otherwise(F.array().cast("array<string>"))
    body = lambda own: F.concat(db(own), F.flatten(F.transform(part(own), lambda x: x["lines"])))
    site = F.when(F.size(part(True)) > 0, F.concat(
        F.array(F.lit(""), F.lit("$each_site = static function (): void {")), F.transform(body(True), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("    "), x))),
        F.array(*map(F.lit, ("};", "if (is_multisite()) {", "    foreach (get_sites(['fields' => 'ids', 'number' => 0]) as $site) {", "        switch_to_blog((int) $site);", "        $each_site();", "        restore_current_blog();", "    }", "} else {", "    $each_site();", "}"))),
    )).otherwise(F.array().cast("array<string>"))
    top = F.array(F.lit("<?php"), F.concat(F.lit("/** Generated uninstall routine for "), F.col("plugin_name"), F.lit(". Review before shipping. */")), F.lit("defined('WP_UNINSTALL_PLUGIN') || exit;"))
    return whole.select("slug", F.concat(F.array_join(F.concat(top, site, body(False)), "\n"), F.lit("\n")).alias("text"))
