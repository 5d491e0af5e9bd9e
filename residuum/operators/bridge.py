"""The analyzer's relations, built from the star-schema test tables.

Real findings come from source text (``residuum.phpsrc``). These views give the
relational operators the same shapes at any scale: each event is a write or,
when it is an error, a set of removals; users split into slugs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.plans.tables import table

REMOVABLE = ("option", "transient", "cron", "post_meta", "table", "rewrite_rule")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    slug = F.concat(F.lit("p"), (F.col("user_id") * 8 + F.col("event_id") % 8).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", k.alias("k"), slug.alias("slug"))


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes: one row per event that isn't an error."""
    k, e = F.col("k"), F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "click", "option").when(F.col("event_type") == "view", "transient")
        .when(F.col("event_type") == "purchase", F.when(k % 2 == 0, "cron").otherwise("post_meta"))
        .otherwise(F.when(k % 5 == 0, "table").otherwise("rewrite_rule"))
    )
    own = _text("k", (k % 6).cast("string"))
    core = (
        F.when(F.col("type") == "option", "blogname").when(F.col("type") == "cron", "wp_version_check")
        .when(F.col("type") == "post_meta", "_edit_lock").when(F.col("type") == "table", "{prefix}Posts").otherwise(own)
    )
    key = F.when(k % 11 == 0, None).when(k % 7 == 0, F.concat(own, F.lit("*"))).when((k % 6 == 5) & (k % 4 == 1), core).otherwise(own)
    sure = F.when(k % 3 == 0, "resolved").otherwise("verified")
    network = e % 10 == 0
    call = (
        F.when(F.col("type") == "option", F.when(network, "update_site_option").otherwise("update_option"))
        .when(F.col("type") == "transient", F.when(network, "set_site_transient").otherwise("set_transient"))
        .when(F.col("type") == "cron", "wp_schedule_event").when(F.col("type") == "post_meta", "update_post_meta")
        .when(F.col("type") == "table", "dbDelta").otherwise("add_rewrite_rule")
    )
    load = F.when(F.col("value") > 60, "no").when(F.col("value") > 30, "unknown").otherwise("yes")
    return (
        _events(spark, sf_dir).filter("event_type <> 'error'").withColumn("type", kind)
        .select(
            "slug", e.alias("ord"), "type", call.alias("function"), key.alias("key"),
            F.when(k % 11 == 0, "dynamic").when(k % 7 == 0, "pattern").otherwise(sure).alias("confidence"),
            _text("f", (e % 7).cast("string"), ".php").alias("file"), (e % 500 + 1).cast("int").alias("line"),
            F.when((F.col("type") == "option") & ~network, load).alias("autoload"),
            F.when(k % 11 == 0, _text("$x", k.cast("string"))).alias("expression"),
            F.when(F.col("type") == "cron", F.when(k % 4 == 0, "daily").otherwise("hourly")).alias("recurrence"),
            (e % 9 == 0).alias("has_args"),
        )
    )


def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals: each error event removes one key of each of six types."""
    k, e, kind = F.col("k"), F.col("event_id"), F.col("type")
    network = e % 10 == 0
    via = (
        F.when(kind == "option", F.when(network, "delete_site_option").otherwise("delete_option"))
        .when(kind == "transient", F.when(network, "delete_site_transient").otherwise("delete_transient"))
        .when(kind == "cron", F.when(k % 3 == 1, "wp_unschedule_hook").otherwise("wp_clear_scheduled_hook"))
        .when(kind == "post_meta", "delete_post_meta_by_key").when(kind == "table", "$wpdb->query").otherwise("flush")
    )
    inside = F.when(k % 3 != 0, _text("Fn", (k % 10).cast("string")))
    return (
        _events(spark, sf_dir).filter("event_type = 'error'")
        .withColumn("type", F.explode(F.array(*map(F.lit, REMOVABLE))))
        .select(
            "slug", e.alias("ord"), "type", _text("k", (k % 6).cast("string")).alias("key"), via.alias("via"), inside.alias("function"),
            F.when(k % 3 == 0, F.when(k % 2 == 0, "Uninstall.php").otherwise("inc\\more.php")).otherwise("lib.php").alias("file"),
        )
    )


def bulk_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIKE patterns of bulk deletes: every fifth error event deletes option rows."""
    k, e = F.col("k"), F.col("event_id")
    pattern = (
        F.when(k % 3 == 0, "k\\_%").when(k % 3 == 1, _text("K", (k % 6).cast("string"), "%")).otherwise(_text("\\_transient\\_k", (k % 6).cast("string")))
    )
    return (
        _events(spark, sf_dir).filter((F.col("event_type") == "error") & (k % 5 == 0))
        .select("slug", F.lit("option").alias("type"), pattern.alias("pattern"), F.when(e % 4 == 0, "network").otherwise("site").alias("scope"))
    )


def blankets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that clear a whole type: every seventh error event flushes rewrite rules."""
    k = F.col("k")
    return (
        _events(spark, sf_dir).filter((F.col("event_type") == "error") & (k % 7 == 0))
        .select("slug", F.lit("rewrite_rule").alias("type"), F.when(k % 2 == 0, _text("fn", (k % 10).cast("string"))).alias("function"), F.lit("uninstall.php").alias("file"))
    )


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between ten functions of a slug; some at the top level of a file."""
    k, e = F.col("k"), F.col("event_id")
    return _events(spark, sf_dir).filter((F.col("event_type") == "error") | (k % 4 == 0)).select(
        "slug", F.when(k % 8 != 0, _text("Fn", (k % 10).cast("string"))).alias("from_fn"),
        F.when(e % 3 == 0, "uninstall.php").when(e % 3 == 1, "inc/more.php").otherwise("main.php").alias("file"),
        _text("fN", ((k * 3 + 1) % 10).cast("string")).alias("to_fn"),
    )


def require_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes between files of a slug."""
    k, e = F.col("k"), F.col("event_id")
    place = lambda x: F.when(x % 4 == 0, "UNINSTALL.php").when(x % 4 == 1, "inc/more.php").when(x % 4 == 2, "inc\\deep.php").otherwise("main.php")
    return _events(spark, sf_dir).filter(k % 6 == 0).select("slug", place(e).alias("from_file"), place(k + e % 3).alias("to_file"))


def callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions registered for uninstall and deactivation."""
    k = F.col("k")
    return (
        _events(spark, sf_dir).filter((F.col("event_type") == "error") & k.isNotNull() & (k % 5).isin(1, 2))
        .select("slug", F.when(k % 5 == 1, "uninstall").otherwise("deactivation").alias("kind"), _text("FN", (k % 10).cast("string")).alias("callee"))
    )


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that may gate a slug's cleanup."""
    k, e = F.col("k"), F.col("event_id")
    return _events(spark, sf_dir).filter(k % 9 == 0).select(
        "slug", e.alias("ord"), F.when(k % 2 == 0, _text("keep", (k % 6).cast("string"))).alias("option"),
        F.when(k % 4 == 0, "false").when(k % 4 == 1, "text").alias("default_text"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, _text("fn", (k % 10).cast("string")))).alias("function"),
        F.when(e % 2 == 0, "uninstall.php").otherwise("inc/more.php").alias("file"),
        (e % 3 == 0).alias("exits"), (e % 5 == 0).alias("removes"), F.array(_text("fn", (e % 10).cast("string")), F.lit("log")).alias("calls"),
    )
