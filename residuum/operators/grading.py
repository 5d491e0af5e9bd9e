"""Grades: unique confident creates, the damage score and the letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators import dims


def flag_core(findings: DataFrame) -> DataFrame:
    """Add ``core``: whether the platform owns the key. The fixed list is broadcast."""
    listed = F.broadcast(dims.core(findings.sparkSession))
    kind, key = F.col("type"), F.col("key")
    known = findings.join(listed, (kind == F.col("core_type")) & (dims.core_key(kind, key) == F.col("core_key")), "left")
    theme = (kind == "option") & F.coalesce(key.startswith(dims.CORE_OPTION_PREFIX), F.lit(False))
    return known.withColumn("core", F.col("core_key").isNotNull() | theme).drop("core_type", "core_key")


def without_core(findings: DataFrame) -> DataFrame:
    """The anti-join form of ``flag_core``."""
    listed = F.broadcast(dims.core(findings.sparkSession))
    kind, key = F.col("type"), F.col("key")
    own = findings.join(listed, (kind == F.col("core_type")) & (dims.core_key(kind, key) == F.col("core_key")), "left_anti")
    return own.filter(~((kind == "option") & F.coalesce(key.startswith(dims.CORE_OPTION_PREFIX), F.lit(False))))


def unique_confident(findings: DataFrame) -> DataFrame:
    """One row per (slug, type, key) of confident writes that aren't core: cleaned only if all
    are, with the worst autoload, the first of those in scan order."""
    own = findings.filter(dims.confident(F.col("confidence")) & F.col("key").isNotNull())
    worst = F.max_by("autoload", F.struct(dims.autoload_rank(F.col("autoload")), -F.col("ord")))
    return without_core(own).groupBy("slug", "type", "key").agg(F.bool_and("cleaned").alias("cleaned"), worst.alias("autoload"))


def grade(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """slug, letter, score, n_cleaned, n_left of each slug of ``paths``.

    ``paths`` has slug, has_path (any uninstall routine) and conditional.
    """
    unique = unique_confident(findings)
    left = ~F.col("cleaned")
    heavy = F.col("type").isin("table", "cron", "post_type", "dropin", "muplugin") | ((F.col("type") == "option") & F.coalesce(F.col("autoload").isin("yes", "unknown"), F.lit(False)))
    sums = unique.groupBy("slug").agg(
        F.count("*").alias("n"), F.count_if(left).alias("n_left"), F.count_if(left & heavy).alias("n_heavy"),
        F.coalesce(F.sum(F.when(left, dims.weight(F.col("type"), F.col("autoload")))), F.lit(0)).alias("penalty"),
    )
    joined = paths.join(sums, "slug", "left").fillna(0, ["n", "n_left", "n_heavy", "penalty"])
    n_left = F.col("n_left")
    letter = (
        F.when(F.col("n") == 0, "A").when(~F.col("has_path") & (n_left > 0), "F")
        .when(n_left == 0, F.when(F.col("conditional"), "B").otherwise("A"))
        .when(F.col("n_heavy") > 0, "D").when(n_left < dims.MINOR_LEFTOVERS, "C").otherwise("D")
    )
    raw = F.when(n_left == 0, F.when((F.col("n") > 0) & F.col("conditional"), dims.CONDITIONAL_SCORE).otherwise(100)).otherwise(F.greatest(F.lit(0), 100 - F.col("penalty")))
    ceiling = F.create_map(*(F.lit(x) for pair in dims.CEILINGS.items() for x in pair))
    out = joined.withColumn("letter", letter).withColumn("score", F.least(raw, ceiling[F.col("letter")]).cast("long"))
    return out.select("slug", "letter", "score", (F.col("n") - n_left).alias("n_cleaned"), n_left.alias("n_left"))


def histogram(grades: DataFrame) -> DataFrame:
    """Slugs per letter, and their share in percent to one decimal."""
    counts = grades.groupBy("letter").agg(F.count("*").alias("n"))
    total = grades.count()
    return counts.withColumn("share", F.format_string("%.1f", 100.0 * F.col("n") / F.lit(max(total, 1))))


def summary(n_left: Column, letter: Column) -> Column:
    """One line about a grade; wording is free."""
    return F.when(letter == "A", "Nothing is left behind.").when(letter == "B", "Cleans up only if a setting allows it.").when(
        letter == "F", "No uninstall routine."
    ).otherwise(F.format_string("Leaves %d item(s) behind.", n_left))


def fails(letter: Column, threshold: str) -> Column:
    """Whether a grade is as bad as ``threshold`` or worse; a later letter is a worse one."""
    return letter >= F.lit(threshold)


def is_floor(rate: Column) -> Column:
    """Whether a grade is a floor only, as under 90 % of the writes were resolved."""
    return rate < 0.9
