"""Commands over local trees and manifest folders: ``python -m residuum.cli``.

A command line that makes no sense exits with 2.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import re
import shutil
import sys
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators import corpus, diff, dims, generator, grading, index, manifest
from residuum.phpsrc import scan
from residuum.plans.tables import materialize
from residuum.sources import archives, manifests, trees


def _session(args) -> SparkSession:
    builder = SparkSession.builder
    if getattr(args, "jobs", None):
        builder = builder.master(f"local[{args.jobs}]")
    if getattr(args, "memory_limit", None):
        builder = builder.config("spark.executor.pyspark.memory", args.memory_limit)
    return builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").appName("residuum").getOrCreate()


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _slug(path: str) -> str:
    return os.path.basename(os.path.abspath(path))


def analyse(spark: SparkSession, roots: dict[str, str], seconds: float | None = None) -> dict[str, DataFrame]:
    """``scan.analyse`` of local trees by slug, and as ``failed`` (slug, reason) those that weren't scanned as a whole."""
    files = materialize(trees.local_files(spark, roots), "files")
    headers = trees.headers(files)
    found = scan.analyse(files, headers, _now(), seconds)
    asked = spark.createDataFrame([(slug,) for slug in sorted(roots)], "slug string")
    empty = asked.join(files.select("slug").distinct(), "slug", "left_anti").withColumn("reason", F.lit("no source files"))
    broken = found["errors"].filter("file = '' or code = 'E_TIMEOUT'").groupBy("slug").agg(F.min("message").alias("reason"))
    return found | {"files": files, "headers": headers, "failed": empty.unionByName(broken)}


def _one(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Relations and the manifest of one tree."""
    found = analyse(spark, {_slug(path): path})
    row = found["docs"].select(manifest.to_json(F.col("doc")).alias("j")).first()
    if row is None:
        groups = {g: [] for g in dims.GROUPS.values()}
        doc = {"schema_version": manifest.SCHEMA_VERSION, "plugin": {"slug": _slug(path), "name": None, "version": None}, "scanned_at": _now(), "grade": "A", "score": 100, "summary": "Nothing is left behind.",
               "coverage": {"files_scanned": 0, "files_skipped": 0, "write_calls_found": 0, "verified": 0, "resolved": 0, "pattern": 0, "dynamic": 0, "resolution_rate": 1.0},
               "cleanup": {"has_uninstall_php": False, "has_uninstall_hook": False, "conditional": False, "condition_option": None, "condition_default": None},
               "creates": groups, "modifies_core": [], "unresolved": [], "errors": []}
        return found, doc
    return found, json.loads(row["j"])


def _cell(text) -> str:
    """Text that stays in its cell of a terminal table: no control characters."""
    return "".join(c if c.isprintable() else "?" for c in str(text))


def _report(doc: dict, findings: DataFrame):
    """Lines of a terminal report: a table for each type, coverage, cleaned share and the cleanup path."""
    yield f"{_cell(doc['plugin']['name'] or doc['plugin']['slug'])}: grade {doc['grade']} ({doc['score']}) - {doc['summary']}"
    counts = {r["type"]: r["count"] for r in findings.groupBy("type").count().collect()}
    rank = F.create_map(*(F.lit(x) for k, t in enumerate(dims.GROUPS) for x in (t, k)))
    kind, left, total = None, 0, 0
    for r in findings.orderBy(rank[F.col("type")].asc_nulls_last(), "type", "ord").toLocalIterator():
        if r["type"] != kind:
            kind = r["type"]
            yield f"\n{dims.GROUPS.get(kind, kind)} ({counts[kind]})"
        key = r["key"] if r["key"] is not None else f"- ({r['expression'] or 'unresolved'})"
        load = [r["autoload"] or "-"] if kind == "option" else []
        cleaned = "cleaned" if r["cleaned"] else "left"
        total, left = total + 1, left + (not r["cleaned"])
        yield "  " + "  ".join(map(_cell, [r["function"], key, r["confidence"], *load, cleaned, f"{r['file']}:{r['line']}"]))
    c, k = doc["coverage"], doc["cleanup"]
    yield f"\n{c['write_calls_found']} writes, {100 * c['resolution_rate']:.1f}% resolved; {c['files_scanned']} files, {c['files_skipped']} errors"
    path = " + ".join(n for n, on in (("uninstall.php", k["has_uninstall_php"]), ("uninstall hook", k["has_uninstall_hook"])) if on) or "none"
    yield f"cleanup: {path}; {total - left} of {total} removed on uninstall"
    if k.get("conditional"):
        yield f"conditional: only if the setting {_cell(k.get('condition_option') or 'that is stored')} allows it"


def cmd_scan(spark, args) -> int:
    if not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 1
    found, doc = _one(spark, args.path)
    for line in [json.dumps(doc, indent=4, ensure_ascii=False)] if args.json else _report(doc, found["findings"]):
        print(line)
    return 0


def cmd_grade(spark, args) -> int:
    if not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 1
    doc = _one(spark, args.path)[1]
    floor = " (a floor: under 90% of the writes resolve)" if doc["coverage"]["resolution_rate"] < 0.9 else ""
    print(f"{doc['grade']} {doc['score']} {doc['summary']}{floor}")
    return 0


def cmd_check(spark, args) -> int:
    if args.fail_on not in dims.CEILINGS or not os.path.exists(args.path):
        print("usage: check PATH [--fail-on LETTER] [--min-coverage PERCENT]", file=sys.stderr)
        return 2
    doc = _one(spark, args.path)[1]
    low = args.min_coverage is not None and 100 * doc["coverage"]["resolution_rate"] < args.min_coverage
    bad = doc["grade"] >= args.fail_on
    print(f"{'FAIL' if bad or low else 'PASS'} grade {doc['grade']}, coverage {100 * doc['coverage']['resolution_rate']:.1f}%")
    return int(bad or low)


def cmd_diff(spark, args) -> int:
    before = manifests.read_baseline(args.baseline)
    if before is None or not os.path.exists(args.path):
        print("usage: diff BASELINE PATH", file=sys.stderr)
        return 2
    after = _one(spark, args.path)[1]
    docs = spark.createDataFrame([("b", json.dumps(before)), ("a", json.dumps(after))], "side string, j string").select("side", F.lit("x").alias("slug"), F.from_json("j", manifest.DOCUMENT).alias("doc"))
    side = lambda s: docs.filter(F.col("side") == s)
    state = lambda s, n: side(s).select("slug", F.col("doc.grade").alias(f"grade_{n}"), F.col("doc.coverage.resolution_rate").alias(f"rate_{n}"), F.col("doc.coverage.files_skipped").alias(f"skipped_{n}"))
    changed = materialize(diff.changes(diff.flatten(side("b")), diff.flatten(side("a"))), "changes")
    verdict = diff.verdict(changed, state("b", "before").join(state("a", "after"), "slug")).first()
    lists = diff.lists(changed).first()
    for kind in diff.KINDS:
        for item in (lists[kind] if lists else []):
            print(f"{kind}: {item}")
    print(f"{before['grade']} -> {after['grade']}" + (", less is covered" if verdict["dropped"] else ""))
    print("REGRESSED" if verdict["regressed"] else "OK")
    return int(verdict["regressed"])


def cmd_batch(spark, args) -> int:
    if not os.path.isdir(args.directory):
        print(f"no such directory: {args.directory}", file=sys.stderr)
        return 1
    roots = trees.plugin_directories(args.directory)
    out = args.out or os.path.join(args.directory, "manifests")
    done: set[str] = set()
    if args.resume and os.path.isdir(out) and any(n.endswith(".json") for n in os.listdir(out)):
        done = {r["slug"] for r in manifests.read_manifests(spark, out).filter("doc is not null").select("slug").collect()}
    todo = {s: p for s, p in roots.items() if s not in done and os.path.abspath(p) != os.path.abspath(out)}
    os.makedirs(out, exist_ok=True)
    lock = os.path.join(out, ".batch.lock")
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL)
    except FileExistsError:
        print(f"another batch writes to {out}", file=sys.stderr)
        return 1
    try:
        grades: Counter = Counter()
        failed: dict[str, str] = {}
        if todo:
            found = analyse(spark, todo, args.timeout)
            fails = materialize(found["failed"], "failed")
            docs = materialize(found["docs"].join(fails.select("slug"), "slug", "left_anti"), "docs")
            manifests.write_manifests(docs, out)
            grades.update({r["grade"]: r["count"] for r in docs.groupBy(F.col("doc.grade").alias("grade")).count().collect()})
            failed = {r["slug"]: r["reason"] for r in fails.toLocalIterator()}
        rows = [(s, "skipped", None) for s in done & set(roots)] + [(s, "failed" if s in failed else "scanned", failed.get(s)) for s in todo]
        tally = corpus.report(spark.createDataFrame(rows, "slug string, status string, reason string"))
        if args.report:
            manifests.write_record(tally, args.report)
        print(", ".join(f"{g}: {n}" for g, n in sorted(grades.items())) or "nothing to do")
        return int(bool(failed))
    finally:
        os.close(handle)
        os.unlink(lock)


def cmd_index(spark, args) -> int:
    if not os.path.isdir(args.manifests):
        print(f"no such directory: {args.manifests}", file=sys.stderr)
        return 1
    out = args.out or args.manifests
    docs = materialize(manifests.read_manifests(spark, args.manifests), "index")
    good = docs.filter("doc is not null")
    creates = index.artifacts(good)
    c = F.col("doc.coverage")
    zero = lambda x: F.coalesce(x, F.lit(0))
    coverage = good.select("slug", zero(c["write_calls_found"]).alias("write_calls"), zero(c["verified"]).alias("n_verified"), zero(c["resolved"]).alias("n_resolved"))
    breaches = materialize(index.violations(docs), "violations")
    manifests.write_lookup(index.reverse_lookup(creates), os.path.join(out, "reverse-lookup.json"))
    manifests.write_record(index.stats(docs, coverage, _now()).select("doc.*"), os.path.join(out, "stats.json"))
    manifests.write_violations(breaches, os.path.join(out, "qa.json"))
    # Files are written before the verdict, so a failed gate can be looked into.
    counts = {r["category"]: r["n"] for r in index.violation_counts(breaches).collect()}
    print(f"{docs.count()} manifests; " + (", ".join(f"{k}: {n}" for k, n in sorted(counts.items())) or "no violations"))
    return int(bool(counts))


def cmd_uninstall(spark, args) -> int:
    if not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return 1
    found, doc = _one(spark, args.path)
    names = spark.createDataFrame([(_slug(args.path), doc["plugin"]["name"])], "slug string, plugin_name string")
    row = generator.teardown(found["findings"], names).first()
    print(row["text"] if row else "<?php\n// Nothing to remove.\n", end="")
    return 0


# The addresses of the public catalogue. Environment variables may name another one.
CATALOGUE = {
    "info": "https://api.wordpress.org/plugins/info/1.0/{slug}.json",
    "versioned": "https://downloads.wordpress.org/plugin/{slug}.{version}.zip",
    "unversioned": "https://downloads.wordpress.org/plugin/{slug}.zip",
}


def _catalogue() -> dict[str, str]:
    return {k: os.environ.get(f"RESIDUUM_{k.upper()}_URL", url) for k, url in CATALOGUE.items()}


def cmd_fetch(_, args) -> int:
    try:
        place = archives.fetch(_catalogue(), args.slug, args.version, Path(args.cache))
    except archives.FetchError as e:
        print(e, file=sys.stderr)
        return 1
    print(place if args.quiet_path else f"unpacked at {place}")
    return 0


def _pinned(path: str) -> dict[str, str] | None:
    """The pinned list, a JSON map from slug to version, in its order; None if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) and found else None


def cmd_shard(spark, args) -> int:
    """One shard of the pinned list: fetch what has no manifest yet, wave by wave, and scan each wave.

    What was fetched and what failed is recorded beside the manifests; a resumed
    run goes on with the records of the one before.
    """
    pinned = _pinned(args.pinned)
    if pinned is None or not 0 <= args.shard < args.shards:
        print("usage: shard PINNED RUN --shard K --shards N", file=sys.stderr)
        return 2
    out, stage = os.path.join(args.run_dir, "manifests"), os.path.join(args.run_dir, f"stage-{args.shard}")
    record = lambda kind: os.path.join(args.run_dir, f"{kind}-shard-{args.shard}.json")
    sources, failures = manifests.merge_records([record("provenance")]), manifests.merge_records([record("fetch-failures")])
    mine = [s for k, s in enumerate(pinned) if k % args.shards == args.shard]
    pending = [s for s in mine if manifests.read_baseline(os.path.join(out, f"{s}.json")) is None]
    print(f"shard {args.shard}/{args.shards}: {len(mine)} plugins, {len(pending)} pending")
    bad = False
    for at in range(0, len(pending), corpus.WAVE):
        shutil.rmtree(stage, ignore_errors=True)
        os.makedirs(stage)
        for slug in pending[at : at + corpus.WAVE]:
            version = pinned[slug]
            try:
                place = archives.fetch(_catalogue(), slug, version, Path(args.cache))
                shutil.copytree(place, os.path.join(stage, slug), symlinks=True)
                sources[slug] = {"version": version, "sha256": (Path(args.cache) / f"{slug}-{version}.sha256").read_text().strip()}
                failures.pop(slug, None)
            except (archives.FetchError, OSError) as e:
                failures[slug] = {"version": version, "error": str(e)}
        for kind, rows in (("provenance", sources), ("fetch-failures", failures)):
            manifests.write_text(record(kind), json.dumps(rows, indent=4) + "\n")
        if os.listdir(stage):
            report = os.path.join(args.run_dir, f"report-shard-{args.shard}-wave-{at // corpus.WAVE + 1}.json")
            wave = argparse.Namespace(directory=stage, out=out, resume=True, report=report, timeout=args.timeout)
            bad = bool(cmd_batch(spark, wave)) or bad
    shutil.rmtree(stage, ignore_errors=True)
    return int(bad)


def cmd_assemble(spark, args) -> int:
    """Merge the shards' records and hold the manifests against the pinned list; too many missing ones fail."""
    pinned = _pinned(args.pinned)
    if pinned is None:
        print(f"the pinned list {args.pinned} is missing or empty", file=sys.stderr)
        return 1
    counts = {}
    for kind in ("provenance", "fetch-failures"):
        shards = glob.glob(os.path.join(glob.escape(args.run_dir), "**", f"{kind}-shard-*.json"), recursive=True)
        merged = manifests.merge_records(sorted(shards, key=lambda p: int(re.search(r"-shard-(\d+)\.json$", p)[1]) if re.search(r"-shard-(\d+)\.json$", p) else -1))
        counts[kind] = len(merged)
        manifests.write_text(os.path.join(args.run_dir, f"{kind}.json"), json.dumps(merged, indent=4) + "\n")
    folder = os.path.join(args.run_dir, "manifests")
    names = sorted(n[:-5] for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []
    of = lambda slugs: spark.createDataFrame([(s,) for s in slugs], "slug string")
    wanted, done = of(pinned), of(names)
    state = corpus.floor(wanted, done).first()
    extra = materialize(corpus.extra(wanted, done), "extra")
    print(f"{state['n_pinned'] - state['n_missing']} of {state['n_pinned']} pinned plugins have a manifest; {state['n_missing']} missing, {counts['fetch-failures']} not fetched, {extra.count()} not on the list")
    for title, slugs in (("missing", corpus.missing(wanted, done)), ("not on the list", extra)):
        if listed := corpus.shown(slugs).first()["listed"]:
            print(f"{title}: {listed}")
    if state["failed"]:
        print(f"more than the {state['allowed']} that may be missing", file=sys.stderr)
    return int(state["failed"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="residuum")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *positional, **options):
        c = sub.add_parser(name)
        for arg in positional:
            c.add_argument(arg.rstrip("?"), nargs="?" if arg.endswith("?") else None)
        for flag, kw in options.items():
            c.add_argument("--" + flag.replace("_", "-"), **kw)
        c.set_defaults(run=run)

    on = {"action": "store_true"}
    add("scan", cmd_scan, "path", json=on)
    add("grade", cmd_grade, "path")
    add("check", cmd_check, "path", fail_on={"default": "D"}, min_coverage={"type": float})
    add("diff", cmd_diff, "baseline", "path")
    limits = {"timeout": {"type": float}, "memory_limit": {}, "jobs": {"type": int}}
    add("batch", cmd_batch, "directory", out={}, resume=on, report={}, **limits)
    add("shard", cmd_shard, "pinned", "run_dir", shard={"type": int, "default": 0}, shards={"type": int, "default": 1}, cache={"default": ".cache"}, **limits)
    add("assemble", cmd_assemble, "pinned", "run_dir")
    add("fetch", cmd_fetch, "slug", "version?", cache={"default": ".cache"}, quiet_path=on)
    add("index", cmd_index, "manifests", out={})
    add("uninstall", cmd_uninstall, "path")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or (None if args.command == "fetch" else _session(args)), args)


if __name__ == "__main__":
    sys.exit(main())
