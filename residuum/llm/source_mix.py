"""Mixing sources to target weights by the cube method.

A document is taken ``floor(pi)`` times for sure, where ``pi`` is its source's
target over its source's size, and once more with the fractional probability
that is left. The cube method settles these fractions: it moves the vector of
probabilities inside the null space of the constraints (documents and words
taken from the source) until coordinates hit 0 or 1, so both totals are kept
exactly at each move. That runs on blocks of a source; what a block can't
settle (two units at most) meets the rest of its source at the next level, and
in the end a landing problem of a dozen small documents is left per source.

Rows with the same doc_id, source and size are one unit: taken or left together.
Null texts have size 0; a null source is a source, the last one. Very long texts
count with all their words. Other columns are ignored, whatever their names. No
rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from residuum.llm.words import words
from residuum.plans.tables import materialize, ship, table

#: Weights by the sources' order, repeating; the mix's size over all sizes; most of a source over its size.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Units of a block, and the seed of its draws.
BLOCK = 2048
#: Open units that the landing phase settles for each source.
LANDING = 12
SEED = 17
#: Up to so many sources their table is sent to all tasks; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the text, 0 for null) of each row."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target of each source.

    Targets solve: sum of min(MOST * source_size, level * weight) = SHARE * all
    sizes. A source above its bound stays there when the level rises, so the
    level is raised until no more source is cut; each round reads one row.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    listed = materialize(total.withColumn("weight", weight), "mix-sources")
    bound = MOST * F.col("source_size")
    level, cut = 0.0, -1
    while True:
        over = F.col("weight") * level >= bound if cut >= 0 else F.lit(False)
        row = listed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, bound)).alias("at_bound"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not row["free"] or row["n"] == cut:
            break
        cut, level = row["n"], (SHARE * row["all"] - (row["at_bound"] or 0.0)) / row["free"]
    target = F.least(bound.cast("double"), F.lit(float(level)) * F.col("weight"))
    return listed.select("source", "source_size", "n_docs", target.alias("target"))


def settle(size: np.ndarray, pi: np.ndarray, draw: np.ndarray, leave: int = 2) -> np.ndarray:
    """Flight phase: probabilities after moves that keep the sums of ``pi`` and ``pi * size``.

    Units come in an order of falling size. Three open units have one direction
    that keeps both sums; a move goes along it to one of the two ends of the
    unit cube, drawn so that each probability stays the same on average, and
    closes a unit at least. The two largest open units move against each other
    and the smallest one balances their difference, so large units close first
    and those left open at the end, ``leave`` at most, are small.
    """
    pi = pi.copy()
    line = [k for k in range(len(pi)) if 0.0 < pi[k] < 1.0]
    front, back, step_no = 2, len(line) - 1, 0
    hold = line[:2]
    while len(hold) == 2 and len(hold) + max(0, back - front + 1) > leave:
        if back >= front:
            trio = [*hold, line[back]]
        elif size[hold[0]] == size[hold[1]]:
            trio = hold
        else:
            break
        a, b = float(size[trio[0]]), float(size[trio[1]])
        c = float(size[trio[-1]])
        u = (1.0, -1.0, 0.0) if a == b else (0.0, 1.0, -1.0) if b == c else (b - c, c - a, a - b)
        up = down = np.inf
        for j, v in zip(trio, u, strict=False):
            if v > 0:
                up, down = min(up, (1 - pi[j]) / v), min(down, pi[j] / v)
            elif v < 0:
                up, down = min(up, pi[j] / -v), min(down, (1 - pi[j]) / -v)
        step = up if draw[step_no] * (up + down) < down else -down
        step_no += 1
        for j, v in zip(trio, u, strict=False):
            p = pi[j] + step * v
            pi[j] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        if back >= front and not 0.0 < pi[line[back]] < 1.0:
            back -= 1
        hold = [j for j in hold if 0.0 < pi[j] < 1.0]
        while len(hold) < 2 and front <= back:
            hold.append(line[front])
            front += 1
    return pi


def land(size: np.ndarray, pi: np.ndarray, draw: float) -> np.ndarray:
    """Landing phase on the few open units: of all outcomes, the nearest in words and documents.

    Words count in units of the open ones' mean size. Of outcomes that are as
    near, ``draw`` picks.
    """
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(open_):
        return pi
    cases = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = size[open_].astype(float) / max(float(size[open_].mean()), 1.0)
    off = np.abs((cases - pi[open_]) @ words) + 0.1 * np.abs((cases - pi[open_]).sum(1))
    near = np.flatnonzero(off <= off.min() + 1e-9)
    pi = pi.copy()
    pi[open_] = cases[near[int(draw * len(near))]]
    return pi


def _flight(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "h", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        seed = int(np.bitwise_xor.reduce(pdf["h"].to_numpy(np.int64))) & (2**63 - 1)
        draw = np.random.Generator(np.random.PCG64([SEED, seed, len(pdf)])).random(len(pdf) + 1)
        size = pdf["words"].to_numpy(np.int64)
        pi = settle(size, pdf["pi"].to_numpy(float), draw, LANDING if last else 2)
        return pdf.assign(pi=land(size, pi, draw[-1]) if last else pi)

    return run


def decide(sized: DataFrame) -> DataFrame:
    """One row per unit: doc_id, source, size, rows, source_size, target and copies (0, 1 or 2)."""
    ship(sized.sparkSession)
    kind = sized.schema["doc_id"].dataType
    to = targets(sized)
    beside = to.withColumnRenamed("source", "_source")
    if to.count() <= BROADCAST_SOURCES:
        beside = F.broadcast(beside)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
        .join(beside, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("sure", F.floor(ratio + 1e-9))
        .withColumn("pi", F.greatest(ratio - F.col("sure"), F.lit(0.0)))
        .withColumn("pi", F.when(F.col("pi") < 1e-9, 0.0).otherwise(F.col("pi")))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn("h", F.xxhash64("doc_id", "size", F.lit(SEED)))
        .withColumn("doc_id", F.col("doc_id").cast("string"))
    )
    open_, level, settled = units, 0, []
    largest = to.agg(F.max("n_docs")).first()[0] or 0
    n_open = F.col("n_docs")
    while True:
        last = largest <= BLOCK
        blocks = F.ceil(n_open / F.lit(BLOCK)).cast("long")
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), blocks))
        flown = materialize(dealt.groupBy("source", "block").applyInPandas(_flight(last), dealt.schema).drop("block"), f"mix-flight{level}")
        closed = (F.col("pi") == 0) | (F.col("pi") == 1)
        settled.append(flown.filter(closed))
        if last:
            break
        # A block leaves two open units at most.
        open_, level, largest = flown.filter(~closed), level + 1, 2 * -(-largest // BLOCK)
        n_open = 2 * F.ceil(n_open / F.lit(BLOCK))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    return done.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "rows", "source_size", "target",
        (F.col("sure") + F.col("pi")).cast("long").alias("copies"),
    )


def mix(sized: DataFrame) -> DataFrame:
    """One row per row of ``sized``: doc_id, source, size, source_size, target, copies, taken."""
    return (
        decide(sized).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def take(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns."""
    chosen = decide(materialize(sizes(docs), "mix-sizes")).filter("copies > 0").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "copies"
    )
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.size(words(docs["text"])).cast("long").alias("size"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_d")) & F.col("row.source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    return held.join(chosen, same).withColumn("one", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark, sf_dir):
    """The mix of all documents."""
    found = mix(materialize(sizes(table(spark, sf_dir, "documents")), "mix-sizes"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def targets_query(spark, sf_dir):
    """Each source's size, documents and target."""
    return targets(sizes(table(spark, sf_dir, "documents"))).select("source", "source_size", "n_docs", "target")


#: Sources in the order in which a rising level cuts them; the level that cuts as many as it must.
TARGETS_ORACLE = r"""
WITH s AS (
  SELECT source, count(*) AS n_docs, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS size FROM documents GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source NULLS LAST) AS i FROM w),
c AS (
  SELECT *, sum(2 * size) OVER (ORDER BY i) - 2 * size AS cut, sum(weight) OVER (ORDER BY i DESC) AS free, (SELECT 1.5::DOUBLE * sum(size) FROM s) AS share FROM o),
l AS (SELECT (arg_min(share - cut, i)) / arg_min(free, i) AS level FROM c WHERE weight * ((share - cut) / free) < 2 * size)
SELECT source, CAST(size AS BIGINT) AS source_size, n_docs, least(CAST(2 * size AS DOUBLE), coalesce((SELECT level FROM l) * weight, CAST(2 * size AS DOUBLE))) AS target FROM w"""
