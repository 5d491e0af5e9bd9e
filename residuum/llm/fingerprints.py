"""One-permutation MinHash fingerprints, all in column expressions.

Each five-word shingle of a text is hashed once. The hash's top bits name a
bin, and a bin keeps its smallest hash. An empty bin borrows from a bin that has
one, tried in an order of its own that is the same for all texts (optimal
densification), so borrowed values agree as often as sets do. The low bits of
each value are packed into one hexadecimal string. Two values agree by chance
once in 2 ** BITS; the likeness of two fingerprints is corrected for that.

Null and empty texts have no shingles and the fingerprint of all zeros; texts
under five words are one shingle. Equal texts have equal fingerprints; a text
without words is like another such one only. Very long texts are read whole;
repeated rows are rows of their own; columns of the input may have any names but
``next``. No rows in, no rows out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from residuum.llm.words import let, whole, words
from residuum.plans.tables import table

SHINGLE = 5
BINS = 128
BITS = 8
#: Bins that an empty bin tries by hash.
TRIES = 8
#: Documents whose neighbours by doc_id are looked up together, about, and the most ranges of them: beyond, ranges grow.
RUN = 512
MOST_RANGES = 20_000

_BIN_BITS = BINS.bit_length() - 1
_EMPTY = (1 << (64 - _BIN_BITS)) - 1


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """One 64-bit hash for each run of ``width`` words; one for all words if there are fewer."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
        short = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(F.size(h) >= width, runs).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bins(hashes: Column) -> Column:
    """The smallest hash of each bin without its bin's bits, in the bins' order; -1 for an empty bin.

    A largest value for each bin joins the hashes; after sorting, the first
    value of each bin is its smallest.
    """
    # As signed numbers, bins with the top bit set sort first.
    fence = F.transform(F.sequence(F.lit(-(BINS // 2)), F.lit(BINS // 2 - 1)), lambda k: F.shiftleft(k.cast("bigint"), 64 - _BIN_BITS) + F.lit(_EMPTY))
    bin_of = lambda x: F.shiftright(x, 64 - _BIN_BITS)

    def firsts(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
        return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) == _EMPTY, F.lit(-1)).otherwise(x.bitwiseAND(F.lit(_EMPTY))))

    return let(F.sort_array(F.concat(hashes, fence)), firsts)


def densify(values: Column) -> Column:
    """Empty bins filled, each from the first bin with a value in an order that hashes of its number give.

    Most need one or two of the TRIES hashes, which may name a bin twice. If
    all of them name empty bins, hashes order all bins, and the first with a value counts.
    """

    def fill(v: Column, full: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            at = lambda t: F.pmod(F.xxhash64(k, F.lit(t)), F.lit(BINS)).cast("int")
            tries = [F.when(F.get(v, at(t)) >= 0, F.get(v, at(t))) for t in range(TRIES)]
            rest = F.array_min(F.transform(full, lambda y: F.struct(F.xxhash64(k, y["bin"], F.lit(TRIES)).alias("order"), y["value"].alias("value"))))
            return F.when(x >= 0, x).otherwise(F.coalesce(*tries, rest["value"]))

        return F.transform(v, one)

    def filled(v: Column) -> Column:
        full = F.filter(F.transform(v, lambda x, k: F.struct(k.alias("bin"), x.alias("value"))), lambda y: y["value"] >= 0)
        return let(full, lambda f: fill(v, f))

    return let(values, filled)


def sketch(text: Column) -> Column:
    """The BINS low-order values of a text as bytes; an empty array for a text without words."""
    low = lambda x: (x.bitwiseAND(F.lit(2**BITS - 1)) - 2 ** (BITS - 1)).cast("tinyint")
    full = lambda h: F.when(F.size(h) > 0, F.transform(densify(bins(h)), low)).otherwise(F.array().cast("array<tinyint>"))
    return let(shingle_hashes(text), full)


def packed(sketched: Column) -> Column:
    """A sketch as a string of hexadecimal digits."""
    digits = F.transform(sketched, lambda x: F.lpad(F.hex(x.cast("int") + 2 ** (BITS - 1)), BITS // 4, "0"))
    return F.when(F.size(sketched) == 0, F.lit("0" * (BINS * BITS // 4))).otherwise(F.lower(F.array_join(digits, "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness of two shingle sets from their sketches, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    chance = 1 / 2**BITS
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    empty = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(empty == 2, F.lit(1.0)).when(empty == 1, F.lit(0.0)).otherwise(corrected)


def _free(name: str, taken: list[str]) -> str:
    """A column's name that none of ``taken`` has, cases apart."""
    used = {t.lower() for t in taken}
    while name in used:
        name += "_"
    return name


def _cuts(docs: DataFrame) -> list:
    """Ids that cut the rows into ranges of RUN, or MOST_RANGES of them, from a sample by a hash of the id."""
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RUN))
    ids = docs.select("doc_id").filter("doc_id is not null")
    share = 8 * ranges / max(1, n)
    drawn = ids if share >= 1 else ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = [r[0] for r in drawn.distinct().orderBy("doc_id").limit(16 * MOST_RANGES).collect()]
    return found[8::8] if share < 1 else found[RUN::RUN]


def _range_of(value: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending ``cuts`` aren't above the value, by bisection."""
    if not cuts:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps([c if isinstance(c, (int, float, str)) else str(c) for c in cuts])), f"array<{kind}>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= value, at + step).otherwise(at))


def with_next(docs: DataFrame, **derived: Column) -> DataFrame:
    """Add ``next``, the row that follows by doc_id (after the last comes the first).

    Columns ``derived`` are added first, on the way, once for each row. Ids may
    have any type that has an order and a JSON form (numbers, strings, dates).

    Rows are dealt by ranges of doc_id of about as many rows each. The first row
    of each range goes to the range before as well, so every range knows what
    follows it and rows move once. Null ids come last; rows with the same id
    follow each other by their other columns.
    """
    names, spark = docs.columns, docs.sparkSession
    field = docs.schema["doc_id"]
    part, guest, to, at, head = (_free(c, [*names, *derived]) for c in ("part", "guest", "to", "at", "head"))
    cuts = _cuts(docs)
    where = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_range_of(F.col("doc_id"), cuts, field.dataType.simpleString()))
    dealt = docs.select(where.alias(part), F.lit(0).alias(guest), *names)
    # At most MOST_RANGES rows and two.
    firsts = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.min("doc_id")).collect())
    ring = [(before[0], own[0], own[1]) for before, own in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)] if firsts else []
    heads = spark.createDataFrame(ring, StructType([StructField(to, IntegerType()), StructField(at, IntegerType()), StructField(head, field.dataType)]))
    guests = dealt.join(F.broadcast(heads), (F.col(part) == F.col(at)) & F.col("doc_id").eqNullSafe(F.col(head))).select(F.col(to).alias(part), F.lit(1).alias(guest), *names)
    rows = dealt.unionByName(guests).withColumns(derived)
    order = [F.col("doc_id").asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in names if c != "doc_id")]
    in_part = W.Window.partitionBy(part).orderBy(guest, *order)
    return rows.withColumn("next", F.lead(F.struct(*names, *derived)).over(in_part)).filter(F.col(guest) == 0).drop(part, guest)


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the text (rounded down) replaced by as much of the next one's start."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))


def query(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole(F.col("text")).alias("text"))
    marked = with_next(docs, sketch=sketch(F.col("text")))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next.sketch")
    return (
        marked.withColumn("edited", edited_text(F.col("text"), F.col("next.text")))
        .withColumn("edited_sketch", sketch(F.col("edited")))
        .select(
            "doc_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            packed(own).alias("fingerprint"),
            packed(edited).alias("edited_fingerprint"),
            likeness(own, edited).alias("near_edited"),
            likeness(own, following).alias("near_next"),
        )
    )


def edited_query(spark, sf_dir):
    """Every document's length and the hash of its edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole(F.col("text")).alias("text"))
    edited = edited_text(F.col("text"), F.col("next.text"))
    return with_next(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))


EDITED_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(f, 1, n // 2)) AS edited_sha256 FROM x"""
