"""The manifest: coverage, groups of creates, touches of core, and what didn't resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.operators import dims
from residuum.operators.grading import flag_core

SCHEMA_VERSION = "2.1"

_SOURCE = "array<struct<file:string,line:int>>"
_ITEM = f"array<struct<key:string,confidence:string,autoload:string,recurrence:string,cleaned:boolean,sources:{_SOURCE}>>"
#: The document as read; fields that older ones lack are null.
DOCUMENT = (
    "struct<schema_version:string,plugin:struct<slug:string,name:string,version:string>,scanned_at:string,grade:string,score:int,summary:string,"
    "coverage:struct<files_scanned:int,files_skipped:int,write_calls_found:int,verified:int,resolved:int,pattern:int,dynamic:int,resolution_rate:double>,"
    "cleanup:struct<has_uninstall_php:boolean,has_uninstall_hook:boolean,conditional:boolean,condition_option:string,condition_default:string>,"
    f"creates:map<string,{_ITEM}>,"
    f"modifies_core:array<struct<type:string,key:string,confidence:string,sources:{_SOURCE}>>,"
    "unresolved:array<struct<file:string,line:int,function:string,expression:string>>,"
    "errors:array<struct<file:string,code:string,message:string>>>"
)


def rate(part: Column, total: Column) -> Column:
    """``part / total`` half-up to three decimals in whole numbers; 1.0 for a total of 0."""
    return F.when(total == 0, F.lit(1.0)).otherwise(F.expr("0").cast("double") + F.floor((2000 * part + total) / (2 * total)) / 1000.0)


def coverage(findings: DataFrame, by: list[str]) -> DataFrame:
    """Writes by confidence and the share that resolved, per ``by`` (or overall)."""
    n = lambda c: F.count_if(F.col("confidence") == c).alias(f"n_{c}")
    out = findings.groupBy(*by).agg(F.count("*").alias("write_calls"), n("verified"), n("resolved"), n("pattern"), n("dynamic"))
    return out.withColumn("resolution_rate", rate(F.col("n_verified") + F.col("n_resolved"), F.col("write_calls")))


def _sources() -> Column:
    return F.array_sort(F.collect_list(F.struct("file", "line")))


def create_groups(findings: DataFrame) -> DataFrame:
    """One row per (slug, type, key) that isn't core: the first write's confidence and recurrence,
    cleaned if all writes are, the worst autoload, and all places in order."""
    own = flag_core(findings.filter("key is not null")).filter("not core")
    worst = F.max_by("autoload", F.struct(dims.autoload_rank(F.col("autoload")), -F.col("ord")))
    return own.groupBy("slug", "type", "key").agg(
        F.min_by("confidence", "ord").alias("confidence"), F.min_by("recurrence", "ord").alias("recurrence"),
        F.bool_and("cleaned").alias("cleaned"), worst.alias("autoload"), _sources().alias("sources"),
    ).withColumn("group", dims.group_of(F.col("type")))


def core_groups(findings: DataFrame) -> DataFrame:
    """One row per (slug, type, key) that is core: the first write's confidence and all places."""
    own = flag_core(findings.filter("key is not null")).filter("core")
    return own.groupBy("slug", "type", "key").agg(F.min_by("confidence", "ord").alias("confidence"), _sources().alias("sources"))


def unresolved(findings: DataFrame) -> DataFrame:
    """Per slug the writes without a key, ordered by file, line and function; calls that these don't tell apart stay in scan order."""
    rows = F.struct("file", "line", "function", "ord", F.coalesce("expression", F.lit("")).alias("expression"))
    shown = lambda x: F.struct(*(x[c].alias(c) for c in ("file", "line", "function", "expression")))
    return findings.filter("key is null").groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(rows)), shown).alias("unresolved"))


def build(findings: DataFrame, grades: DataFrame, paths: DataFrame, files: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """slug and ``doc``, the nested document, one row per slug of ``grades``.

    ``paths`` has the cleanup flags; ``files`` counts what was listed per slug;
    ``errors`` are rows of (slug, file, code, message).
    """
    items = F.struct("key", "confidence", "autoload", "recurrence", "cleaned", "sources")
    groups = create_groups(findings).groupBy("slug", "group").agg(F.array_sort(F.collect_list(items)).alias("items"))
    creates = groups.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("group", "items"))).alias("own"))
    # Every group is there, if only empty.
    empty = F.array().cast(_ITEM)
    every = lambda own: F.create_map(*(x for g in dims.GROUPS.values() for x in (F.lit(g), F.coalesce(F.try_element_at(own, F.lit(g)), empty))))
    touched = core_groups(findings).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("type", "key", "confidence", "sources"))).alias("modifies_core"))
    failed = errors.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("file", "code", "message"))).alias("errors"))
    out = grades
    for part in (paths, files, coverage(findings, ["slug"]), creates, touched, unresolved(findings), failed):
        out = out.join(part, "slug", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    listed = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct("slug", F.col("plugin_name").alias("name"), F.col("plugin_version").alias("version")).alias("plugin"),
        F.lit(now).alias("scanned_at"), F.col("letter").alias("grade"), F.col("score").cast("int").alias("score"), F.col("summary").alias("summary"),
        F.struct(
            n("n_files").alias("files_scanned"), F.size(listed("errors", "array<struct<file:string,code:string,message:string>>")).alias("files_skipped"),
            n("write_calls").alias("write_calls_found"), n("n_verified").alias("verified"), n("n_resolved").alias("resolved"), n("n_pattern").alias("pattern"),
            n("n_dynamic").alias("dynamic"), F.coalesce("resolution_rate", F.lit(1.0)).alias("resolution_rate"),
        ).alias("coverage"),
        F.struct("has_uninstall_php", "has_uninstall_hook", "conditional", "condition_option", "condition_default").alias("cleanup"),
        every(F.coalesce("own", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_ITEM}>")))).alias("creates"),
        listed("modifies_core", f"array<struct<type:string,key:string,confidence:string,sources:{_SOURCE}>>").alias("modifies_core"),
        listed("unresolved", "array<struct<file:string,line:int,function:string,expression:string>>").alias("unresolved"),
        listed("errors", "array<struct<file:string,code:string,message:string>>").alias("errors"),
    )
    return out.select("slug", doc.alias("doc"))


def to_json(doc: Column, pretty: bool = False) -> Column:
    """The document as JSON; nulls stay, a rate of 1.0 stays a decimal."""
    return F.to_json(doc, {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {}))


def from_json(text: Column) -> Column:
    """The document, null for what isn't JSON or lacks grade, coverage or creates."""
    doc = F.from_json(F.make_valid_utf8(text.cast("string")), DOCUMENT, {"mode": "PERMISSIVE"})
    return F.when(doc["grade"].isNotNull() & doc["coverage"].isNotNull() & doc["creates"].isNotNull(), doc)


def as_struct(spark: SparkSession) -> T.StructType:
    """The document's schema."""
    return spark.createDataFrame([], f"doc {DOCUMENT}").schema["doc"].dataType
