"""Which writes are cleaned up: creates against removals, bulk deletes, blankets and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators import dims
from residuum.operators.graph import UNINSTALL_FILE, fold, fold_file


def runs_on_uninstall(rows: DataFrame, scoped: DataFrame, files: DataFrame, deactivation: DataFrame | None = None) -> DataFrame:
    """Add ``runs``: whether the row's code (type, function, file) runs on uninstall.

    Top-level code runs if its file does; a function if it is scoped; and for
    some types a function that runs on deactivation is as good. Three equi-joins
    give flags and the flags are or-ed, so no join has a disjunction.
    """
    node, file = fold(F.col("function")), fold_file(F.col("file"))
    mark = lambda df, name: df.select(F.col("slug").alias(f"_{name}_slug"), F.col("node").alias(f"_{name}")).distinct()
    out = rows.withColumn("_fn", node).withColumn("_file", file)

    def flag(out: DataFrame, df: DataFrame, name: str, column: str) -> DataFrame:
        own = mark(df, name)
        return out.join(own, (F.col("slug") == F.col(f"_{name}_slug")) & (F.col(column) == F.col(f"_{name}")), "left").drop(f"_{name}_slug")

    out = flag(flag(out, scoped, "scoped", "_fn"), files, "reached", "_file")
    late = F.lit(False)
    if deactivation is not None:
        out = flag(out, deactivation, "late", "_fn")
        late = F.col("type").isin(*dims.DEACTIVATION_TYPES) & F.col("_late").isNotNull()
    top = (F.col("_file") == UNINSTALL_FILE) | F.col("_reached").isNotNull()
    runs = F.when(F.col("function").isNull(), F.coalesce(top, F.lit(False))).otherwise(F.col("_scoped").isNotNull()) | late
    return out.withColumn("runs", F.coalesce(runs, F.lit(False))).drop("_fn", "_file", "_scoped", "_reached", "_late")


def _clears(has_args: Column, kind: Column, vias: Column) -> Column:
    """Whether calls that name a key clear it: what is scheduled with arguments needs the broad call."""
    broad = F.when(kind == "cron", F.array_contains(vias, "wp_unschedule_hook")).when(kind == "action", F.array_contains(vias, "as_unschedule_all_actions")).otherwise(True)
    return ~F.coalesce(has_args, F.lit(False)) | broad


def bulk_row(kind: Column, key: Column, function: Column) -> Column:
    """The name of the option row that holds the artifact."""
    prefix = F.when(dims.network_call(function), "_site_transient_").otherwise("_transient_")
    return F.when(kind == "transient", F.concat(prefix, key)).otherwise(key)


def like_regex(pattern: Column) -> Column:
    """A LIKE pattern as an anchored regular expression; compiled in the engine.

    ``%`` any run, ``_`` any character, a backslash makes the next literal;
    case doesn't matter and a dot matches new lines.
    """
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)(\\.|.)"))
    quote = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    one = lambda c: F.when(c == "%", ".*").when(c == "_", ".").when((F.length(c) == 2) & c.startswith("\\"), quote(F.substring(c, 2, 1))).otherwise(quote(c))
    return F.concat(F.lit("(?is)^"), F.array_join(F.transform(parts, one), ""), F.lit("$"))


def cleaned_exact(findings: DataFrame, removals: DataFrame) -> DataFrame:
    """Add ``exact``: a removal that runs names the write's type, scope and key, and clears it."""
    vias = removals.filter("runs").filter(~F.col("via").isin(dims.LIKE, dims.LIKE_NETWORK)).groupBy(
        "slug", "type", dims.scope(F.col("via")).alias("scope"), "key"
    ).agg(F.collect_set("via").alias("vias"))
    out = findings.withColumn("scope", dims.scope(F.col("function"))).join(vias, ["slug", "type", "scope", "key"], "left")
    return out.withColumn("exact", F.col("vias").isNotNull() & _clears(F.col("has_args"), F.col("type"), F.col("vias"))).drop("vias")


def cleaned_bulk(findings: DataFrame, bulk: DataFrame) -> DataFrame:
    """(slug, type, scope, row) of confident writes whose row a bulk delete matches.

    Equi keys first, so patterns meet rows of their own slug, type and scope
    only; distinct rows meet distinct patterns.
    """
    row = bulk_row(F.col("type"), F.col("key"), F.col("function"))
    rows = findings.filter(dims.confident(F.col("confidence")) & F.col("key").isNotNull()).select(
        "slug", F.when(F.col("type") == "transient", "option").otherwise(F.col("type")).alias("bulk_type"), dims.scope(F.col("function")).alias("scope"), row.alias("row")
    ).distinct()
    patterns = bulk.select("slug", F.col("type").alias("bulk_type"), "scope", like_regex(F.col("pattern")).alias("regex")).distinct()
    return rows.join(patterns, ["slug", "bulk_type", "scope"]).filter(F.rlike("row", F.col("regex"))).select("slug", "bulk_type", "scope", "row").distinct()


def apply_cleanup(findings: DataFrame, removals: DataFrame, bulk: DataFrame, blankets: DataFrame) -> DataFrame:
    """Findings with ``cleaned``; removals and blankets carry ``runs``, bulk deletes are those that run."""
    out = cleaned_exact(findings, removals)
    matched = cleaned_bulk(findings, bulk).withColumn("_bulk", F.lit(True))
    whole = blankets.filter("runs").select("slug", "type").distinct().withColumn("_blanket", F.lit(True))
    bulk_type = F.when(F.col("type") == "transient", "option").otherwise(F.col("type"))
    row = F.when(dims.confident(F.col("confidence")), bulk_row(F.col("type"), F.col("key"), F.col("function")))
    out = out.withColumn("bulk_type", bulk_type).withColumn("row", row)
    out = out.join(matched, ["slug", "bulk_type", "scope", "row"], "left").join(whole, ["slug", "type"], "left")
    cleaned = F.col("exact") | F.coalesce("_bulk", F.lit(False)) | F.coalesce("_blanket", F.lit(False))
    return out.withColumn("cleaned", cleaned).select(*findings.columns, "cleaned")


def condition(guards: DataFrame, scoped: DataFrame, files: DataFrame, removals: DataFrame) -> DataFrame:
    """slug, option, default_text, guard_ord of the first guard by scan order that runs and gates cleanup."""
    running = runs_on_uninstall(guards.withColumn("type", F.lit("")), scoped, files).filter("runs").drop("type", "runs")
    removing = removals.filter("function is not null").select("slug", fold(F.col("function")).alias("node")).distinct().join(scoped.select("slug", "node").distinct(), ["slug", "node"], "left_semi")
    calling = (
        running.select("slug", "ord", F.explode("calls").alias("call")).select("slug", "ord", fold(F.col("call")).alias("node"))
        .join(removing, ["slug", "node"], "left_semi").select("slug", "ord").distinct().withColumn("_calls", F.lit(True))
    )
    gates = F.col("exits") | F.col("removes") | F.coalesce("_calls", F.lit(False))
    first = running.join(calling, ["slug", "ord"], "left").filter(gates).groupBy("slug").agg(F.min_by(F.struct("option", "default_text", "ord"), "ord").alias("g"))
    return first.select("slug", F.col("g.option").alias("option"), F.col("g.default_text").alias("default_text"), F.col("g.ord").alias("guard_ord"))
