"""Paths: normal form, drop-in classes, and which files of a tree are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from residuum.operators import dims


def normalize(path: Column) -> Column:
    """``.``, ``..``, repeated and back slashes resolved; ``..`` above the start is dropped."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def dirname(path: Column) -> Column:
    """What stands before the last slash, empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def classify(path: Column) -> Column:
    """dropin, muplugin or null for a resolved path that starts in a portable token."""
    where, name = dirname(path), F.lower(basename(path))
    return F.when((where == "{content_dir}") & name.isin(*dims.DROPINS), "dropin").when((where == "{mu_plugins}") & name.endswith(".php"), "muplugin")


def is_source(rel: Column) -> Column:
    """Whether a file of a tree is read: .php in any case, not below a skipped directory.

    A ``build`` directory is skipped but for files named render.php.
    """
    parts = F.split(rel, "/")
    above = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p))
    hard = F.array(*(F.lit(d) for d in dims.SKIPPED_DIRECTORIES if d != "build"))
    name = F.element_at(parts, -1)
    in_build = F.array_contains(above, "build")
    return F.lower(name).endswith(".php") & ~F.arrays_overlap(above, hard) & (~in_build | (name == "render.php"))
