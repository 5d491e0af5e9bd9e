"""Keys that wrapper functions get from their callers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.operators.symbols import LITERAL_CAP


def parameter_literals(params: DataFrame, args: DataFrame, ext_callable: DataFrame) -> DataFrame:
    """slug, callee, param, literals (ordered), complete.

    ``params`` (slug, callee, idx, param) ⋈ ``args`` (slug, callee, idx, literal; null if
    opaque). Complete: no opaque argument, no more than LITERAL_CAP literals, and no one
    else can call the function.
    """
    n = F.count_distinct("literal")
    given = args.groupBy("slug", "callee", "idx").agg(
        F.slice(F.array_sort(F.collect_set("literal")), 1, LITERAL_CAP).alias("literals"),
        (F.bool_and(F.col("literal").isNotNull()) & (n <= LITERAL_CAP)).alias("closed"),
    )
    outside = ext_callable.select("slug", "callee").distinct().withColumn("_out", F.lit(True))
    joined = params.join(given, ["slug", "callee", "idx"]).join(outside, ["slug", "callee"], "left")
    return joined.select("slug", "callee", "param", "literals", (F.col("closed") & F.col("_out").isNull()).alias("complete"))


def expand(findings: DataFrame, literals: DataFrame) -> DataFrame:
    """Findings with their callers' literals for keys.

    A finding whose key isn't confident and whose ``callee`` and ``param`` name a
    wrapper's parameter becomes one resolved finding for each literal, between
    ``prefix`` and ``suffix``. If the literals aren't all there are, the original stays too.
    """
    open_ = ~F.col("confidence").isin("verified", "resolved") & F.col("param").isNotNull()
    joined = findings.join(literals, ["slug", "callee", "param"], "left").withColumn("_hit", open_ & F.coalesce(F.size("literals") > 0, F.lit(False)))
    key = F.concat(F.coalesce("prefix", F.lit("")), F.col("_lit"), F.coalesce("suffix", F.lit("")))
    made = joined.filter("_hit").withColumn("_lit", F.explode("literals")).withColumn("key", key).filter("key <> ''").withColumn("confidence", F.lit("resolved"))
    kept = joined.filter("not _hit or not complete")
    names = findings.columns
    return made.select(*names).unionByName(kept.select(*names))
