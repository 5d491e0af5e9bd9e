"""Toxicity by maximum-scoring segments.

Each word has a score: its log-odds between toxic and other texts under
Dirichlet priors. A word's prior leans on its stem (its first letters), the
stem's on the corpus, so that unseen forms of a toxic stem score too. Only words
and stems that are surely more frequent in toxic texts keep a score; all others
share one small negative score, so that ordinary text drifts down (scores of
their own for rare clean words, of which a bounded sample sees few, would break
up passages by chance). A single pass then finds every
maximal segment, the passages whose words score highest together. What such a
segment would score by chance follows an extreme-value law whose rate and scale
come from ordinary texts (Karlin and Altschul). A text's segments are added up
in that scale, and two logistic coefficients turn the sum into a probability.

Null and empty texts, and those without letters, have no segments and the
lowest probability. Repeated rows score alike. Without toxic or without other
labels, every probability is the prior's and no segment is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.plans.tables import materialize, ship, table

#: Bound of the labelled sample: toxic texts, and other texts.
SAMPLE = (3000, 6000)
SEED = 41
#: Stems have so many letters.
STEM = 5
#: Dirichlet priors, in texts: of any word or stem in texts of a kind, and what a stem lends its words.
PRIOR = 0.5
STEM_PRIOR = 2.0
#: Words and stems need so many toxic texts and such a z-score to have a score of their own.
LEAST_TEXTS = 2
LEAST_Z = 3.0
#: Copies in the sample would pass their words off as toxic: of texts that agree in one of so many min-hashes of shingles one stays.
MIN_HASHES = 3
#: The mean of an ordinary word's score, and bounds of a word's.
DRIFT = -0.05
SCORE = (-1.0, 8.0)
#: A segment counts if chance gives one so good less often than this in its text.
E_VALUE = 0.5
PREDICT_FROM = 0.7

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicModel:
    """Scores of words and of stems, of all others, the extreme-value law's rate and
    scale, and the logistic coefficients."""

    words: dict[str, float] = field(repr=False)
    stems: dict[str, float] = field(repr=False)
    other: float
    rate: float
    scale: float
    bias: float
    slope: float


def segments(scores: np.ndarray, at: np.ndarray, other: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of ``n`` words as (first, end, score), in one pass and linear time.

    ``scores`` are those of the words at the places ``at``; all words between
    score ``other`` < 0. A stack holds candidates with the running total before
    and after each; a new one swallows those that it improves. Each knows the
    nearest one below it that starts lower, so candidates that start higher are
    passed over once only.
    """
    lefts: list[float] = []
    rights: list[float] = []
    firsts: list[int] = []
    ends: list[int] = []
    lower: list[int] = []
    total, last = 0.0, -1
    for place, s in zip(at.tolist(), scores.tolist(), strict=True):
        total += other * (place - last - 1)
        last = place
        if s <= 0:
            total += s
            continue
        left, right, first = total, total + s, place
        total = right
        k = len(lefts) - 1
        while True:
            while k >= 0 and lefts[k] >= left:
                k = lower[k]
            if k < 0 or rights[k] >= right:
                break
            # Joined with the candidate that starts lower; what lies between goes with it.
            left, first = lefts[k], firsts[k]
            below = lower[k]
            for column in (lefts, rights, firsts, ends, lower):
                del column[k:]
            k = below
        lefts.append(left)
        rights.append(right)
        firsts.append(first)
        ends.append(place + 1)
        lower.append(k)
    return [(a, b, r - x) for x, r, a, b in zip(lefts, rights, firsts, ends, strict=True)]


def karlin_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(rate * scores)) = 1; the mean must be negative."""
    if not (scores > 0).any() or float(scores @ shares) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    over = lambda r: float(np.exp(np.minimum(r * scores, 700)) @ shares) > 1
    while not over(high) and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def _scored(text: str, model: ToxicModel) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of the text, and place and score of those that have one of their own.

    Scores are about texts that have a word, so a word's k-th time in a text scores 1/k of it.
    """
    found = _WORD.findall(text.lower())
    words, stems = model.words, model.stems
    hits, times = [], Counter()
    for k, w in enumerate(found):
        s = words.get(w)
        if s is None:
            s = stems.get(w[:STEM])
            if s is None:
                continue
        times[w] += 1
        hits.append((k, s / times[w]))
    return len(found), np.array([k for k, _ in hits], dtype=np.int64), np.array([s for _, s in hits], dtype=float)


def _significant(found: list[tuple[int, int, float]], n: int, model: ToxicModel) -> list[tuple[int, int, float]]:
    """Of segments in ``n`` words those that chance rarely gives, with log(1 / E-value) for a score.

    A segment of score s has the E-value scale * n * exp(-rate * s).
    """
    room = math.log(max(model.scale * n, 1e-9))
    return [(a, b, model.rate * s - room) for a, b, s in found if room - model.rate * s < math.log(E_VALUE)]


def evidence(text: str, model: ToxicModel) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Sum over the significant segments in the extreme-value scale, words, and those segments."""
    n, at, s = _scored(text, model)
    good = _significant(segments(s, at, model.other, n), n, model) if len(at) else []
    return sum(x for *_, x in good), n, good


def _probability(x: float, model: ToxicModel) -> float:
    z = model.bias + model.slope * math.log1p(max(x, 0.0))
    return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: SAMPLE at most of each kind, those of the lowest hashes; of copies one."""
    drawn = None
    for toxic, most in zip((1, 0), SAMPLE, strict=True):
        own = labels.filter(F.col("toxic") == toxic).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
        drawn = own if drawn is None else drawn.unionByName(own)
    from residuum.llm.fingerprints import shingle_hashes

    hashes = shingle_hashes(F.col("text"))
    keys = F.struct(*(F.array_min(F.transform(hashes, lambda x, k=k: F.xxhash64(x, F.lit(k)))).alias(f"m{k}") for k in range(MIN_HASHES)))
    picked = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")
    picked = picked.select(F.struct(F.xxhash64("doc_id", F.lit(SEED)).alias("draw"), "doc_id", "text", F.col("toxic").cast("int").alias("toxic"), keys.alias("keys")).alias("row"))
    for k in range(MIN_HASHES):
        picked = picked.groupBy("row.toxic", f"row.keys.m{k}").agg(F.min("row").alias("row")).select("row")
    return picked.select("row.text", "row.toxic")


def _counts(picked: DataFrame) -> DataFrame:
    """kind (0 word, 1 stem), word, tox, rest: toxic and other texts that have it.

    Texts count, not occurrences: a word that one text repeats is no evidence.
    """

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(_WORD.findall(text.lower()))
                seen.update((0, w, toxic) for w in own)
                seen.update((1, w, toxic) for w in {w[:STEM] for w in own})
            kinds, words, toxic = zip(*seen, strict=True) if seen else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["kind", "word", "toxic", "n"],
            )

    counted = picked.mapInArrow(count, "kind int, word string, toxic int, n long")
    of = lambda t: F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0))
    return counted.groupBy("kind", "word").agg(of(1).alias("tox"), of(0).alias("rest"))


def learn(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Word scores, the extreme-value law and the logistic coefficients from labelled texts."""
    ship(docs.sparkSession)
    picked = materialize(_sample(docs, labels), "toxic-sample")
    sizes = picked.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("r")).first()
    n_tox, n_rest = sizes["t"], sizes["r"]
    if not n_tox or not n_rest:
        return ToxicModel({}, {}, DRIFT, 1.0, 1.0, -4.0, 0.0)
    # What is no more frequent in toxic texts stays in the cluster.
    counts = _counts(picked).filter((F.col("tox") >= LEAST_TEXTS) & (F.col("tox") * n_rest > 2 * F.col("rest") * n_tox)).collect()

    def log_odds(tox: float, rest: float) -> tuple[float, float]:
        a, b = tox + PRIOR, rest + PRIOR
        score = math.log(a / (n_tox + 2 * PRIOR)) - math.log(b / (n_rest + 2 * PRIOR))
        return score, score / math.sqrt(1 / a + 1 / b)

    clip = lambda x: min(max(x, SCORE[0]), SCORE[1])
    stems, words = {}, {}
    for r in counts:
        if r["kind"]:
            score, z = log_odds(r["tox"], r["rest"])
            if z >= LEAST_Z:
                stems[r["word"]] = clip(score)
    for r in counts:
        if not r["kind"]:
            # A toxic stem lends its words texts in its own proportion.
            lent = STEM_PRIOR / (1 + math.exp(-stems[r["word"][:STEM]])) if r["word"][:STEM] in stems else 0.0
            score, z = log_odds(r["tox"] + lent, r["rest"] + (STEM_PRIOR - lent if lent else 0.0))
            if z >= LEAST_Z:
                words[r["word"]] = clip(score)
    bare = ToxicModel(words, stems, DRIFT, 1.0, 1.0, 0.0, 0.0)
    return _calibrate(bare, ((r["text"], r["toxic"]) for r in picked.select("text", "toxic").toLocalIterator()))


def _calibrate(bare: ToxicModel, cases: Iterator[tuple[str, int]]) -> ToxicModel:
    """Fit the extreme-value law on the other texts, then the logistic coefficients on all."""
    seen: Counter = Counter()
    n_words, kept = 0, []
    for text, toxic in cases:
        n, at, s = _scored(text, bare)
        found = [x for *_, x in segments(s, at, bare.other, n)]
        kept.append((toxic, n, found))
        if not toxic:
            seen.update(np.round(s, 3).tolist())
            n_words += n
    seen[bare.other] += n_words - sum(seen.values())
    values = np.array(sorted(seen))
    shares = np.array([seen[v] for v in sorted(seen)], dtype=float)
    rate = karlin_rate(values, shares / max(shares.sum(), 1))
    # The best segment of n words exceeds s with probability 1 - exp(-K n exp(-rate s)); the
    # likelihood is highest at K = texts / sum of n exp(-rate s).
    best = [(n, max(found, default=0.0)) for toxic, n, found in kept if not toxic and n]
    scale = len(best) / max(sum(n * math.exp(-rate * s) for n, s in best), 1e-9) if best else 1.0
    model = replace(bare, rate=rate, scale=min(max(scale, 1e-6), 1.0))
    x = np.array([math.log1p(sum(x for *_, x in _significant([(0, 0, s) for s in found], n, model))) for _, n, found in kept])
    bias, slope = _logistic(x, np.array([toxic for toxic, *_ in kept], dtype=float))
    return replace(model, bias=bias, slope=slope)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic fit with a light ridge, by Newton's steps; the slope isn't negative."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.05 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def toxic_passages(text: Column, model: ToxicModel) -> Column:
    """struct(score, n_words, passages): the probability, and each significant passage's
    first word, end and score."""

    @F.arrow_udf("score double, n_words long, passages array<struct<first:int,end:int,score:double>>")
    def score(texts: pa.Array) -> pa.Array:
        p, words, found = [], [], []
        for text in texts:
            x, n, good = evidence(text.as_py() or "", model)
            p.append(_probability(x, model))
            words.append(n)
            found.append([{"first": a, "end": b, "score": s} for a, b, s in good])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(words, pa.int64()), pa.array(found, kind)], names=["score", "n_words", "passages"])

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are only for testing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def query(spark, sf_dir):
    """Every document's toxicity, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = learn(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxic_passages(F.col("text"), model).alias("t"))
    return scored.select(
        "doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= PREDICT_FROM).cast("int").alias("predicted"),
        F.size("t.passages").cast("long").alias("n_passages"), F.col("t.n_words").alias("n_words"),
    )
