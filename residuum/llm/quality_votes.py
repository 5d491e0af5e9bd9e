"""Quality rules as weak supervision.

Each rule votes good or bad on a text, or abstains. Expectation-maximisation
estimates from the votes alone how each rule votes on good and on bad texts, and
so how often it is right; the posterior probability of "good" then replaces the demand that all
rules pass. Votes are kept as one number with a base-3 digit for each rule, so
the estimate needs the counts of at most 3 ** 8 vote patterns, whatever the
input's size.

Null and empty texts have no words: they fail the base test and aren't kept.
Very long texts are read whole. Repeated rows and ties are judged alike, rows
stay as many as they were. Columns of the input may have any names: the filter
keeps them apart in a struct. No rows: no rows out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.words import SPACE, WORD, let, whole, words
from residuum.plans.tables import materialize, table

#: Words of a window; a text fails if over 30 % of its words lie in repeated windows.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
#: Expectation-maximisation: rounds; pseudo-counts of (abstains, bad, good) on bad and on good texts; least share; start and bounds of the prior.
ROUNDS = 40
PSEUDO = ((5.0, 4.0, 3.0), (5.0, 0.2, 7.0))
LEAST = 0.002
#: A rule that calls more good texts bad than this would be no rule; more are taken to be bad.
MOST_WRONG = 0.01
PRIOR = (0.5, 0.05, 0.95)
KEEP_FROM = 0.5


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window found twice or more in ``w``.

    Windows are compared by 64-bit hashes. Only a text with equal windows pays
    for the sort that finds where they start; a word counts once.
    """

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twins = F.filter(p, lambda x, k: x["h"].eqNullSafe(F.get(p, k - 1)["h"]) | x["h"].eqNullSafe(F.get(p, k + 1)["h"]))
            return F.sort_array(F.transform(twins, lambda x: x["i"]))

        first = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            let(ordered, starts), first,
            lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(width), s - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def windows(h: Column) -> Column:
        parts = lambda i: [F.get(h, i + k) for k in range(width)]
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*parts(i)))

    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(let(hashed, windows), count)).cast("long")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``quality``: the counts that rules look at."""
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    df = df.withColumn("_text", whole(F.col(text))).withColumn("_words", words(t)).withColumn("_lines", lines)
    w = F.col("_words")
    return df.withColumn(
        "quality",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit(f"!(?={SPACE}|$)")).cast("long").alias("n_shouts"),
        ),
    ).drop("_text", "_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def rules(q: Column) -> list[Rule]:
    """The production rules over the struct that ``with_features`` adds."""
    n, lines = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["n_lines"], F.lit(1))
    chars = F.greatest(q["word_chars"], F.lit(1))
    mean, never = q["word_chars"] / n, F.lit(False)
    return [
        Rule("word_length", (mean < 2) | (mean > 14), mean.between(2.5, 11)),
        Rule("symbols", q["n_symbols"] > 0.25 * n, never),
        Rule("symbol_share", q["n_symbols"] > 0.04 * chars, q["n_symbols"] <= 0.02 * chars),
        Rule("line_copies", (q["n_dup_lines"] > 0.4 * lines), never),
        Rule("repeats", q["n_repeat_words"] > 0.2 * n, never),
        Rule("capitals", q["n_upper"] > 0.4 * chars, never),
        Rule("shouts", q["n_shouts"] > 0.25 * n, never),
        Rule("variety", (q["n_distinct"] < 0.15 * n) & (n >= 50), q["n_distinct"] > 0.3 * n),
    ]


def pattern(q: Column) -> Column:
    """All votes on a text as one number; digits in the order of ``rules``: 0 abstains, 1 bad, 2 good."""
    digits = [F.when(r.bad, F.lit(1)).when(r.good, F.lit(2)).otherwise(F.lit(0)) * 3**k for k, r in enumerate(rules(q))]
    return sum(digits[1:], digits[0])


def votes(code: int, n: int) -> list[int]:
    """The digits of a pattern."""
    return [code // 3**k % 3 for k in range(n)]


@dataclass(frozen=True)
class LabelModel:
    """What expectation-maximisation finds: the share of good texts, and for bad and
    good texts how often each rule abstains, votes bad and votes good. A rule's
    accuracy on either kind is the share of its votes there that are right."""

    prior: float
    votes: tuple[tuple[tuple[float, float, float], ...], ...]

    def weight(self, k: int, vote: int) -> float:
        """Log-odds for "good" that this vote, or abstention, of rule ``k`` adds."""
        return math.log(self.votes[1][k][vote] / self.votes[0][k][vote])

    def accuracy(self, k: int) -> tuple[float, float]:
        """Of rule ``k``'s votes on bad and on good texts, the share that is right."""
        (_, bb, bg), (_, gb, gg) = self.votes[0][k], self.votes[1][k]
        return bb / (bb + bg), gg / (gb + gg)

    def log_odds(self, vote: list[int]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(self.weight(k, v) for k, v in enumerate(vote))


def fit(counts: dict[int, int], n: int) -> LabelModel:
    """Expectation-maximisation over the counts of the vote patterns of ``n`` rules."""

    def shares(seen: list[float], y: int) -> tuple[float, float, float]:
        total = sum(seen) + sum(PSEUDO[y])
        x = [max(a + b, LEAST * total) for a, b in zip(seen, PSEUDO[y], strict=True)]
        if y:
            x[1] = min(x[1], MOST_WRONG * total)
        return tuple(a / sum(x) for a in x)

    model = LabelModel(PRIOR[0], tuple((shares([0, 0, 0], y),) * n for y in (0, 1)))
    cases = [(votes(code, n), m) for code, m in sorted(counts.items())]
    for _ in range(ROUNDS if cases else 0):
        good, total, seen = 0.0, 0, [[[0.0] * 3 for _ in range(n)] for _ in "01"]
        for vote, m in cases:
            p = 1 / (1 + math.exp(-model.log_odds(vote)))
            good, total = good + m * p, total + m
            for k, v in enumerate(vote):
                seen[0][k][v] += m * (1 - p)
                seen[1][k][v] += m * p
        model = LabelModel(min(max(good / total, PRIOR[1]), PRIOR[2]), tuple(tuple(shares(x, y) for x in seen[y]) for y in (0, 1)))
    return model


def fit_votes(features: DataFrame) -> LabelModel:
    """``fit`` on the texts that pass the base test; at most 3 ** 8 counts reach the driver."""
    q = F.col("quality")
    counts = features.filter(~base_failed(q)).groupBy(pattern(q).alias("votes")).count().collect()
    return fit({r[0]: r[1] for r in counts}, len(rules(q)))


def posterior(q: Column, model: LabelModel) -> Column:
    """Probability that the text is good, given all votes."""
    total = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, r in enumerate(rules(q)):
        none, bad, good = (F.lit(model.weight(k, v)) for v in range(3))
        total = total + F.when(r.bad, bad).when(r.good, good).otherwise(none)
    return 1 / (1 + F.exp(-total))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def judge(features: DataFrame, model: LabelModel) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept`` to a frame with ``quality``."""
    q = F.col("quality")
    return (
        features.withColumn("base_failed", base_failed(q))
        .withColumn("p_good", posterior(q, model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all their columns, nothing else.

    Features are computed once and written beside their rows; the votes are
    counted and the rows judged from there. Texts are never shuffled.
    """
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    found = materialize(with_features(held).select("row", "quality"), "features", lent=True)
    return judge(found, fit_votes(found)).filter("kept").select("row.*")


def query(spark, sf_dir):
    """Every document with its base counts, its base test and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(with_features(docs).drop("text"), "quality")
    q, model = F.col("quality"), fit_votes(found)
    base = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judge(found, model).select("doc_id", *base, "base_failed", "p_good", "kept")


def base_query(spark, sf_dir):
    """Every document's base counts and base test."""
    q = F.col("quality")
    found = with_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(q).alias("base_failed"))


BASE_ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 7)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM v) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN c ON w.doc_id = c.doc_id"""
