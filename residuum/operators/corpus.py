"""Running over a corpus: shards and waves, what is pending, provenance and the coverage floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAVE = 100
FLOOR_PER_MILLE = 995
SHOWN = 20


def shards(pinned: DataFrame, n: int) -> DataFrame:
    """slug, shard and wave within the shard from list positions (pos, from 0)."""
    return pinned.select("slug", (F.col("pos") % n).cast("long").alias("shard"), F.floor(F.floor(F.col("pos") / n) / WAVE).cast("long").alias("wave"))


def missing(pinned: DataFrame, done: DataFrame) -> DataFrame:
    return pinned.select("slug").join(done.select("slug"), "slug", "left_anti")


def extra(pinned: DataFrame, done: DataFrame) -> DataFrame:
    return done.select("slug").distinct().join(pinned.select("slug"), "slug", "left_anti")


def pending(pinned: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run has left: pinned slugs without a complete manifest."""
    return missing(pinned, done.filter("complete"))


def floor(pinned: DataFrame, done: DataFrame) -> DataFrame:
    """One row: pinned, missing, allowed and whether too many are missing. Extras don't count."""
    gone = missing(pinned, done).agg(F.count("*").alias("n_missing")).withColumn("_", F.lit(1))
    out = pinned.agg(F.count("*").alias("n_pinned")).withColumn("_", F.lit(1)).join(gone, "_").drop("_")
    allowed = F.col("n_pinned") - F.floor(F.col("n_pinned") * FLOOR_PER_MILLE / 1000)
    return out.withColumn("allowed", allowed.cast("long")).withColumn("failed", F.col("n_missing") > F.col("allowed"))


def provenance(parts: DataFrame) -> DataFrame:
    """slug, version, sha256: of several shards' records (slug, shard, version, sha256) the first shard's."""
    return parts.groupBy("slug").agg(F.min_by(F.struct("version", "sha256"), "shard").alias("p")).select("slug", "p.version", "p.sha256")


def shown(slugs: DataFrame, n: int = SHOWN) -> DataFrame:
    """One row: the first ``n`` slugs in order as text, an ellipsis if there are more.

    Only ``n`` + 1 rows meet in one place.
    """
    some = slugs.select("slug").orderBy("slug").limit(n + 1).agg(F.array_sort(F.collect_list("slug")).alias("s"))
    return some.select(F.concat(F.array_join(F.slice("s", 1, n), ", "), F.when(F.size("s") > n, ", ...").otherwise("")).alias("listed"))


def report(results: DataFrame) -> DataFrame:
    """One row: scanned, skipped, failed with their reasons, from (slug, status, reason)."""
    failed = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("slug", "reason")))))
    return results.agg(F.count_if(F.col("status") == "scanned").alias("scanned"), F.count_if(F.col("status") == "skipped").alias("skipped"), failed.alias("failed"))
