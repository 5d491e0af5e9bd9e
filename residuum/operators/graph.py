"""Closures over call, include and inheritance graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.plans.tables import materialize

UNINSTALL_FILE = "uninstall.php"


def fold(name: Column) -> Column:
    """A-Z in lower case and nothing else, as the source language folds names."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_file(file: Column) -> Column:
    return fold(F.translate(file, "\\", "/"))


def reachable(roots: DataFrame, edges: DataFrame, *marks: str) -> DataFrame:
    """(slug, *marks, node) reachable from ``roots`` over ``edges`` (slug, src, dst), roots included.

    Roots with different values of the columns ``marks`` are closed apart, over
    the same edges and in the same rounds. Semi-naive: each round joins only the
    last round's new nodes and drops those seen. Rounds are written out, so the
    plan stays one join deep however long the paths are, and cycles end when
    nothing is new.
    """
    names = ["slug", *marks, "node"]
    edges = materialize(edges.filter("src is not null and dst is not null").distinct(), "edges")
    frontier = materialize(roots.select(names).filter("node is not null").distinct(), "reached")
    seen = frontier
    while not frontier.isEmpty():
        met = frontier.join(edges, [frontier["slug"] == edges["slug"], frontier["node"] == edges["src"]])
        step = met.select(frontier["slug"], *(frontier[m] for m in marks), edges["dst"].alias("node"))
        frontier = materialize(step.distinct().join(seen, names, "left_anti"), "reached")
        seen = seen.unionByName(frontier)
    return seen


def _reachable_functions(roots: DataFrame, calls: DataFrame, *marks: str) -> DataFrame:
    """(slug, *marks, node): what runs when the callees of ``roots`` run; calls at a file's top level don't lead on."""
    edges = calls.filter("from_fn is not null").select("slug", fold(F.col("from_fn")).alias("src"), fold(F.col("to_fn")).alias("dst"))
    return reachable(roots.select("slug", *marks, fold(F.col("callee")).alias("node")), edges, *marks)


def uninstall_files(slugs: DataFrame, requires: DataFrame) -> DataFrame:
    """(slug, node): files whose top level runs on uninstall, from the root uninstall.php on."""
    edges = requires.select("slug", fold_file(F.col("from_file")).alias("src"), fold_file(F.col("to_file")).alias("dst"))
    return reachable(slugs.select("slug", F.lit(UNINSTALL_FILE).alias("node")), edges)


def _uninstall_roots(callbacks: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, callee): the uninstall callbacks, and what the top level of an uninstall file calls."""
    top = calls.filter("from_fn is null").select("slug", fold_file(F.col("file")).alias("node"), F.col("to_fn").alias("callee"))
    called = top.join(files, ["slug", "node"], "left_semi").select("slug", "callee")
    return callbacks.filter("kind = 'uninstall'").select("slug", "callee").unionByName(called)


def _deactivation_roots(callbacks: DataFrame) -> DataFrame:
    return callbacks.filter("kind = 'deactivation'").select("slug", "callee")


def scoped_functions(callbacks: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, node): functions that run on uninstall."""
    return _reachable_functions(_uninstall_roots(callbacks, calls, files), calls)


def deactivation_functions(callbacks: DataFrame, calls: DataFrame) -> DataFrame:
    """(slug, node): functions that run on deactivation."""
    return _reachable_functions(_deactivation_roots(callbacks), calls)


def running_functions(callbacks: DataFrame, calls: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scoped_functions`` and ``deactivation_functions``, closed together."""
    mark = lambda roots, on: roots.withColumn("runs_on", F.lit(on))
    roots = mark(_uninstall_roots(callbacks, calls, files), "uninstall").unionByName(mark(_deactivation_roots(callbacks), "deactivation"))
    found = _reachable_functions(roots, calls, "runs_on")
    of = lambda on: found.filter(F.col("runs_on") == on).select("slug", "node")
    return of("uninstall"), of("deactivation")
