"""The corpus index: reverse lookup, statistics and quality gates over manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators import dims
from residuum.operators.grading import flag_core
from residuum.operators.manifest import rate


def _types() -> Column:
    """Type of a manifest group; null for an unknown one."""
    return F.create_map(*(F.lit(x) for kind, group in dims.GROUPS.items() for x in (group, kind)))


def artifacts(docs: DataFrame) -> DataFrame:
    """slug, type, key, cleaned of each create; groups that no type has are skipped."""
    items = docs.select("slug", F.explode("doc.creates").alias("group", "items")).select("slug", "group", F.explode("items").alias("item"))
    return items.select("slug", F.try_element_at(_types(), F.col("group")).alias("type"), F.col("item.key").alias("key"), F.coalesce("item.cleaned", F.lit(False)).alias("cleaned")).filter("type is not null and key is not null")


def reverse_lookup(creates: DataFrame) -> DataFrame:
    """id (type:key), its distinct slugs in order and how many."""
    out = creates.groupBy(F.concat_ws(":", "type", "key").alias("id")).agg(F.array_sort(F.collect_set("slug")).alias("slugs"))
    return out.withColumn("n_slugs", F.size("slugs").cast("long"))


def artifact_totals(creates: DataFrame) -> DataFrame:
    """One row: artifacts, cleaned, left behind, distinct ids."""
    return creates.agg(
        F.count("*").alias("artifacts"), F.count_if("cleaned").alias("cleaned"), F.count_if(~F.col("cleaned")).alias("left_behind"),
        F.count_distinct(F.concat_ws(":", "type", "key")).alias("distinct_artifacts"),
    )


def left_by_type(creates: DataFrame) -> DataFrame:
    return creates.filter("not cleaned").groupBy("type").agg(F.count("*").alias("n"))


def pooled(coverage: DataFrame) -> DataFrame:
    """One row: writes, resolved ones and their rate over all slugs of per-slug coverage."""
    out = coverage.agg(F.coalesce(F.sum("write_calls"), F.lit(0)).alias("write_calls"), F.coalesce(F.sum(F.col("n_verified") + F.col("n_resolved")), F.lit(0)).alias("resolved_calls"))
    return out.withColumn("resolution_rate", rate(F.col("resolved_calls"), F.col("write_calls")))


def cleanup_counts(docs: DataFrame) -> DataFrame:
    """One row: slugs with any uninstall path, and with a conditional one."""
    c = F.col("doc.cleanup")
    path = F.coalesce(c["has_uninstall_php"], F.lit(False)) | F.coalesce(c["has_uninstall_hook"], F.lit(False))
    return docs.agg(F.count_if(path).alias("with_path"), F.count_if(F.coalesce(c["conditional"], F.lit(False))).alias("conditional"))


def heaviest(creates: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` slugs with the most artifacts; ties by slug."""
    return creates.groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug").limit(k)


def violations(docs: DataFrame) -> DataFrame:
    """category and item of each breach: documents (file, slug, doc; doc null if unreadable)."""
    good = docs.filter("doc is not null")
    version = F.col("doc.schema_version")
    parts = [
        docs.filter("doc is null").select(F.lit("unreadable").alias("category"), F.col("file").alias("item")),
        good.filter(~F.coalesce(version.startswith("2."), F.lit(False))).select(F.lit("schema_version"), F.concat_ws(": ", "slug", F.coalesce(version, F.lit("missing")))),
        good.filter(F.coalesce("doc.coverage.files_scanned", F.lit(0)) == 0).select(F.lit("zero_files"), F.col("slug")),
        flag_core(artifacts(good)).filter("core").select(F.lit("core_artifacts"), F.concat_ws(":", "slug", "type", "key")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def violation_counts(found: DataFrame) -> DataFrame:
    """Breaches per category; any is a failed gate."""
    return found.groupBy("category").agg(F.count("*").alias("n"))


def stats(docs: DataFrame, coverage: DataFrame, now: str) -> DataFrame:
    """One row: ``doc``, the statistics as a nested document. Unreadable documents count as plugins."""
    good = docs.filter("doc is not null")
    creates = artifacts(good)
    as_map = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m"))
    grades = as_map(good.groupBy(F.col("doc.grade").alias("k")).agg(F.count("*").alias("v")), "k", "v").withColumnRenamed("m", "grades")
    left = as_map(left_by_type(creates).select(F.col("type").alias("k"), F.col("n").alias("v")), "k", "v").withColumnRenamed("m", "left_by_type")
    one = F.lit(1)
    out = docs.agg(F.count("*").alias("plugins")).withColumn("_", one)
    for part in (pooled(coverage), artifact_totals(creates), cleanup_counts(good), grades, left):
        out = out.join(part.withColumn("_", one), "_")
    return out.select(F.struct(
        F.lit(now).alias("generated_at"), "plugins", "grades", F.struct("write_calls", "resolved_calls", "resolution_rate").alias("coverage"),
        F.struct("artifacts", "cleaned", "left_behind", "distinct_artifacts", "left_by_type").alias("artifacts"), F.struct("with_path", "conditional").alias("cleanup"),
    ).alias("doc"))
