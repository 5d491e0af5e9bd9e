"""Comparing two manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators import dims

KINDS = ("added", "removed", "no_longer_cleaned", "newly_cleaned", "autoload_raised")


def worse_grade(before: Column, after: Column) -> Column:
    """Whether both are letters and the second is worse."""
    known = lambda g: g.isin(*dims.CEILINGS)
    return F.coalesce(known(before) & known(after) & (after > before), F.lit(False))


def flatten(docs: DataFrame) -> DataFrame:
    """slug, id (group:key), cleaned, autoload from documents (slug, doc)."""
    entries = docs.select("slug", F.explode("doc.creates").alias("group", "items")).select("slug", "group", F.explode("items").alias("item"))
    return entries.filter("item.key is not null").select(
        "slug", F.concat_ws(":", "group", "item.key").alias("id"), F.coalesce("item.cleaned", F.lit(False)).alias("cleaned"), F.col("item.autoload").alias("autoload")
    )


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """slug, id, kind, cleaned (as after) for each change: one full outer join, then unpivoted flags."""
    sides = [df.select("slug", "id", F.lit(True).alias(f"in_{n}"), F.col("cleaned").alias(f"cleaned_{n}"), F.col("autoload").alias(f"load_{n}")) for n, df in (("b", before), ("a", after))]
    both = sides[0].join(sides[1], ["slug", "id"], "full_outer")
    common = F.col("in_b") & F.col("in_a")
    rank = lambda n: dims.autoload_rank(F.col(f"load_{n}"))
    raised = common & F.col("load_b").isNotNull() & F.col("load_a").isNotNull() & (rank("a") > rank("b"))
    flags = {
        "added": F.col("in_b").isNull(), "removed": F.col("in_a").isNull(),
        "no_longer_cleaned": common & F.col("cleaned_b") & ~F.col("cleaned_a"),
        "newly_cleaned": common & ~F.col("cleaned_b") & F.col("cleaned_a"), "autoload_raised": raised,
    }
    kinds = F.filter(F.array(*(F.when(F.coalesce(flags[k], F.lit(False)), k) for k in KINDS)), lambda x: x.isNotNull())
    return both.select("slug", "id", F.explode(kinds).alias("kind"), F.coalesce("cleaned_a", F.lit(False)).alias("cleaned"))


def coverage_dropped(rate_before: Column, rate_after: Column, skipped_before: Column, skipped_after: Column) -> Column:
    """Whether fewer writes resolve or more files are skipped; a field that either lacks isn't compared."""
    lower = F.round(rate_after, 3) < F.round(rate_before, 3)
    return F.coalesce(lower, F.lit(False)) | F.coalesce(skipped_after > skipped_before, F.lit(False))


def verdict(changed: DataFrame, states: DataFrame) -> DataFrame:
    """slug, counts of each kind, worse_grade, dropped and regressed, one row per slug of ``states``
    (slug, grade_before, grade_after, rate_before, rate_after, skipped_before, skipped_after)."""
    n = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    bad = F.count_if((F.col("kind") == "no_longer_cleaned") | (F.col("kind").isin("added", "autoload_raised") & ~F.col("cleaned")))
    counts = changed.groupBy("slug").agg(*n, bad.alias("n_bad"))
    out = states.join(counts, "slug", "left").fillna(0, [f"n_{k}" for k in KINDS] + ["n_bad"])
    worse = worse_grade(F.col("grade_before"), F.col("grade_after"))
    dropped = coverage_dropped(F.col("rate_before"), F.col("rate_after"), F.col("skipped_before"), F.col("skipped_after"))
    out = out.withColumn("worse_grade", worse).withColumn("dropped", dropped)
    return out.withColumn("regressed", (F.col("n_bad") > 0) | F.col("worse_grade") | F.col("dropped")).drop("n_bad")


def lists(changed: DataFrame) -> DataFrame:
    """slug and one sorted list of ids for each kind of change."""
    return changed.groupBy("slug").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("id")))).alias(k) for k in KINDS))
