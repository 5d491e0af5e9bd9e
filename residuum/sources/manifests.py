"""Reading and writing manifests, indexes and reports."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators import manifest


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """file, slug, doc of each ``*.json`` of a folder, not hidden and not below it.

    ``doc`` is null for what isn't a manifest. Brackets and stars in the folder's
    name are names, not patterns.
    """
    literal = "".join("\\" + c if c in "[]{}*?\\" else c for c in folder.rstrip("/"))
    lines = spark.read.option("pathGlobFilter", "*.json").text(literal, wholetext=True)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    out = lines.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("file"), manifest.from_json(F.col("value")).alias("doc"))
    return out.filter(~F.col("file").startswith(".")).select("file", F.coalesce("doc.plugin.slug", F.regexp_replace("file", r"\.json$", "")).alias("slug"), "doc")


def read_baseline(path: str) -> dict | None:
    """A baseline manifest from a local file; null unless it is an object with a grade and creates."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            doc = json.load(f)
    except (OSError, ValueError):
        return None
    return doc if isinstance(doc, dict) and isinstance(doc.get("grade"), str) and isinstance(doc.get("creates"), dict) else None


def write_text(path: str, body: str) -> None:
    """Write a local file so that readers see all of it or nothing: a hidden file, then a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(body)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_manifests(docs: DataFrame, folder: str) -> None:
    """One ``<slug>.json`` for each document, written where the rows are, each by rename."""
    rows = docs.select("slug", manifest.to_json(F.col("doc"), pretty=True).alias("json"))

    def put(part):
        for row in part:
            write_text(os.path.join(folder, f"{row['slug']}.json"), row["json"] + "\n")

    rows.foreachPartition(put)


def _stream(path: str, head: str, parts: Iterator[str], tail: str) -> None:
    """``write_text`` of parts joined by commas, of which one is held at a time."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(head)
            for k, body in enumerate(parts):
                f.write("," * (k > 0) + body)
            f.write(tail)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_lookup(lookup: DataFrame, path: str) -> int:
    """The reverse lookup as one compact JSON map from id to slugs, ordered by id; how many ids it has.

    Rows come to the driver one partition after the other and go to the file as they come.
    """
    seen = 0

    def parts() -> Iterator[str]:
        nonlocal seen
        for row in lookup.select("id", F.to_json("slugs").alias("slugs")).orderBy("id").toLocalIterator():
            seen += 1
            yield f"{json.dumps(row['id'], ensure_ascii=False)}:{row['slugs']}"

    _stream(path, "{", parts(), "}")
    return seen


def write_violations(found: DataFrame, path: str) -> None:
    """Breaches of the quality gates (category, item) as a JSON document with a list, ordered."""
    rows = found.select(F.to_json(F.struct("category", "item")).alias("j"), "category", "item").orderBy("category", "item").toLocalIterator()
    _stream(path, '{"violations": [', (row["j"] for row in rows), "]}\n")


def merge_records(paths: list[str]) -> dict[str, dict]:
    """JSON maps of several shards as one, ordered by key; of a key's records the first shard's counts."""
    merged: dict[str, dict] = {}
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                record = json.load(f)
        except (OSError, ValueError):
            continue
        if isinstance(record, dict):
            merged = record | merged
    return dict(sorted(merged.items()))


def write_record(rows: DataFrame, path: str) -> None:
    """A one-row frame as a JSON document: statistics, gates, reports."""
    row = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).first()
    write_text(path, json.dumps(json.loads(row["j"]), indent=4, ensure_ascii=False) + "\n")
