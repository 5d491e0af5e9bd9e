"""An extension, not part of the batch analyzer: manifests as a stream of files.

New manifests of a folder update the long form of the lookup as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators import index, manifest


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """slug, version, doc of manifests that appear in ``folder``; unreadable ones are left out.

    A slug and version counts once, within a day of arrival.
    """
    lines = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").schema("value string").load(folder)
    docs = lines.select(manifest.from_json(F.col("value")).alias("doc"), F.current_timestamp().alias("seen")).filter("doc is not null")
    out = docs.select(F.col("doc.plugin.slug").alias("slug"), F.col("doc.plugin.version").alias("version"), "doc", "seen")
    return out.withWatermark("seen", "1 day").dropDuplicatesWithinWatermark(["slug", "version"])


def keep_lookup(docs: DataFrame, target: str, checkpoint: str):
    """Append each batch's artifacts (slug, type, key, cleaned, batch) to a Parquet folder; a replayed batch replaces its own part."""

    def put(batch: DataFrame, number: int) -> None:
        index.artifacts(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
