"""Resolution of key expressions: segments joined to symbols, then folded in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operands of one expression beyond so many leave it dynamic.
SEGMENT_CAP = 256


def fold(segments: Column) -> Column:
    """struct(key, confidence) of ordered segments array<struct<kind, value>>.

    Kinds: lit (a literal), sym (a known symbol's value), pattern (a known start
    of something open), unknown. All known: verified if all are literals, else
    resolved. Otherwise the known start is a pattern, if there is one, and the key
    is dynamic if not. An empty literal by itself is unresolved.
    """
    start = F.struct(F.lit("").alias("known"), F.lit(False).alias("shut"), F.lit(False).alias("sym"))

    def step(a: Column, s: Column) -> Column:
        value, kind = F.coalesce(s["value"], F.lit("")), s["kind"]
        open_ = kind.isin("unknown", "pattern") | (kind.isin("lit", "sym") & (value == ""))
        takes = ~a["shut"] & (kind != "unknown")
        return F.struct(
            F.when(takes, F.concat(a["known"], value)).otherwise(a["known"]).alias("known"),
            (a["shut"] | open_).alias("shut"), (a["sym"] | (kind == "sym")).alias("sym"),
        )

    def finish(a: Column) -> Column:
        none = F.lit(None).cast("string")
        return (
            F.when(a["known"] == "", F.struct(none.alias("key"), F.lit("dynamic").alias("confidence")))
            .when(a["shut"], F.struct(F.concat(a["known"], F.lit("*")).alias("key"), F.lit("pattern").alias("confidence")))
            .otherwise(F.struct(a["known"].alias("key"), F.when(a["sym"], "resolved").otherwise("verified").alias("confidence")))
        )

    dynamic = F.struct(F.lit(None).cast("string").alias("key"), F.lit("dynamic").alias("confidence"))
    return F.when((F.size(segments) == 0) | (F.size(segments) > SEGMENT_CAP), dynamic).otherwise(F.aggregate(segments, start, step, finish))


def resolve(segments: DataFrame, symbols: DataFrame) -> DataFrame:
    """slug, expr, key, confidence from segment rows (slug, expr, pos, kind, text).

    Kind ``lit`` stands for itself; any other kind names a symbol of
    ``symbols`` (slug, kind, name, value, poisoned).
    """
    known = symbols.filter("not poisoned").select("slug", "kind", F.col("name").alias("text"), "value")
    joined = segments.join(known, ["slug", "kind", "text"], "left")
    value = F.when(F.col("kind") == "lit", F.col("text")).otherwise(F.col("value"))
    kind = F.when(F.col("kind") == "lit", "lit").when(F.col("value").isNotNull(), "sym").otherwise("unknown")
    rows = joined.select("slug", "expr", F.struct("pos", kind.alias("kind"), value.alias("value")).alias("s"))
    folded = rows.groupBy("slug", "expr").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))).alias("s"))
    return folded.withColumn("r", fold(F.col("s"))).select("slug", "expr", "r.key", "r.confidence")
