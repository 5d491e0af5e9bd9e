"""Quality classifier: ordinal regression on graded ratings.

A text's features are hashed into one space of weights: byte trigrams, word
shapes, and bands of a few ratios. All grades share the weights; thresholds in
rising order cut the score into grades (a cumulative-link model, logistic link).
That gives each text an expected grade and the probability of any grade or
better, by which texts are selected.

Ratings come from labels: 0 for low quality, 1 for good but toxic, 2 for good.
Null and empty texts have no features but "empty" and are judged by it. Without
labels all weights are zero and nothing is selected against. Repeated rows are
judged alike. Very long texts are read whole, in memory that grows with them;
ids may have any type, and other columns any names. No rows in, no rows out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm import text_bytes as tb
from residuum.plans.tables import materialize, ship, table

GRADES = 3
#: A text is kept if a grade of so much or better has such a probability.
KEEP_GRADE = 1
KEEP_FROM = 0.5
#: Bound of the labelled sample: texts for each grade.
SAMPLE = 3000
SEED = 59
BITS = 14
#: Training: passes over the sample, step, and ridge.
PASSES = 60
STEP = 0.5
RIDGE = 1e-4

#: Classes of bytes for word shapes: A capital, a small letter or any non-ASCII byte, 0 digit, space, and signs as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48
_SHAPE[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class GradeModel:
    """Weights of the hashed features, and the thresholds between grades, rising."""

    weights: np.ndarray = field(repr=False)
    thresholds: tuple[float, ...]


def _ratio_features(data: np.ndarray) -> list[int]:
    """Buckets for bands of ratios of one text: how well it packs, capitals, signs, length."""
    n = len(data)
    if not n:
        return [zlib.crc32(b"empty") >> (32 - BITS)]
    shape = _SHAPE[data]
    small, signs = float((shape == 65).mean()), float(((shape != 65) & (shape != 97) & (shape != 48) & (shape != 32)).mean())
    # Short texts pack badly whatever they say, so each length has bands of its own.
    packed = f"{n.bit_length()}:{int(20 * len(zlib.compress(data.tobytes(), 1)) / n)}"
    bands = (("packed", packed), ("capitals", int(small * 20)), ("signs", int(signs * 40)), ("length", n.bit_length() // 2))
    return [zlib.crc32(f"{name}:{band}".encode()) >> (32 - BITS) for name, band in bands]


#: What the ratios weigh next to the mean of the trigrams.
_RATIO_WEIGHT = 0.5


def _shape_buckets(data: np.ndarray) -> np.ndarray:
    return tb.gram_buckets(_SHAPE[data] ^ np.uint8(0x5A), BITS)


def featurise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text: shares of trigrams and of shapes, and the ratios' bands."""
    ids, values = [], []
    for buckets in (tb.gram_buckets(tb.LETTERS[data], BITS), _shape_buckets(data)):
        if len(buckets):
            own, n = np.unique(buckets, return_counts=True)
            ids.append(own)
            values.append(n / np.sqrt(float((n.astype(float) ** 2).sum())))
    extra = _ratio_features(data)
    ids.append(np.array(extra, dtype=np.uint32))
    values.append(np.full(len(extra), _RATIO_WEIGHT))
    return np.concatenate(ids).astype(np.int64), np.concatenate(values)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(
    weights: np.ndarray, cuts: np.ndarray, ids: np.ndarray, values: np.ndarray, row: np.ndarray, grades: np.ndarray, share: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """The ridged negative log-likelihood of the grades, its gradient by the weights and by the thresholds.

    ``ids`` and ``values`` are the features of all rows in a row, ``row`` whose they are, ``share`` the rows' weights.
    """
    n = len(grades)
    score = np.bincount(row, values * weights[ids], minlength=n)
    above = _sigmoid(score[:, None] - cuts)
    # Probabilities of the grade: above its lower cut, not above its upper one.
    p_low = np.concatenate([np.ones((n, 1)), above], 1)[np.arange(n), grades]
    p_high = np.concatenate([above, np.zeros((n, 1))], 1)[np.arange(n), grades]
    gap = np.maximum(p_low - p_high, 1e-9)
    total = -float(share @ np.log(gap)) + RIDGE * float(weights @ weights) / (2 * n)
    # d log(p_low - p_high) / d score = 1 - p_low - p_high, for logistic links.
    grad = -np.bincount(ids, (share * (1 - p_low - p_high))[row] * values, minlength=len(weights)) + RIDGE * weights / n
    own = above * (1 - above) / gap[:, None] * share[:, None]
    cut_grad = np.array([(own[grades == k + 1, k]).sum() - (own[grades == k, k]).sum() for k in range(len(cuts))])
    return total, grad, cut_grad


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> GradeModel:
    """Cumulative-link regression by gradient steps with per-weight scaling.

    P(grade >= k) = sigmoid(w.x - threshold[k-1]). The first threshold is free,
    and each next one lies above it by an amount that can't be negative. Grades
    weigh alike however rare they are.
    """
    size = 1 << BITS
    weights, cuts = np.zeros(size), np.linspace(-0.5, 0.5, GRADES - 1)
    if not len(grades):
        return GradeModel(weights.astype(np.float32), tuple(float(c) - 20.0 for c in cuts))
    ids = np.concatenate([i for i, _ in rows])
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    count = np.bincount(grades, minlength=GRADES)
    share = (len(grades) / (np.count_nonzero(count) * np.maximum(count, 1)))[grades] / len(grades)
    spread, cut_spread = np.full(size, 1e-8), np.full(GRADES - 1, 1e-8)
    for _ in range(PASSES):
        _, grad, cut_grad = loss(weights, cuts, ids, values, row, grades, share)
        spread += grad**2
        cut_spread += cut_grad**2
        weights -= STEP * grad / np.sqrt(spread)
        cuts = np.maximum.accumulate(cuts - STEP * cut_grad / np.sqrt(cut_spread))
    return GradeModel(weights.astype(np.float32), tuple(map(float, cuts)))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id and grade of each labelled document; the lower of two ratings."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def learn(docs: DataFrame, ratings: DataFrame) -> GradeModel:
    """Fit on SAMPLE texts of each grade, those of the lowest hashes of doc_id."""
    ship(docs.sparkSession)
    drawn = None
    for grade in range(GRADES):
        own = ratings.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(SAMPLE)
        drawn = own if drawn is None else drawn.unionByName(own)
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "grade")

    def run(batches):
        for batch in batches:
            ids, values = [], []
            for _, data, offsets in tb.chunks(batch.column(1)):
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    i, v = featurise(data[a:b])
                    ids.append(i)
                    values.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=["doc_id", "grade", "ids", "values"],
            )

    found = materialize(picked.mapInArrow(run, "doc_id string, grade int, ids array<int>, values array<float>"), "grade-sample")
    rows = found.orderBy("doc_id", "grade", F.xxhash64("ids")).toArrow()
    features = [(np.array(i.values.to_numpy(), dtype=np.int64), np.array(v.values.to_numpy(), dtype=float)) for i, v in zip(rows.column("ids"), rows.column("values"), strict=True)]
    return fit(features, rows.column("grade").to_numpy().astype(np.int64))


def grade_scores(text: Column, model: GradeModel) -> Column:
    """struct(score, expected_grade, p_tail): p_tail is the probability of KEEP_GRADE or better."""
    weights, cuts = model.weights.astype(np.float64), np.array(model.thresholds)

    @F.arrow_udf("score double, expected_grade double, p_tail double")
    def judge(texts: pa.Array) -> pa.Array:
        scores = []
        for _, data, offsets in tb.chunks(texts):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                ids, values = featurise(data[a:b])
                scores.append(float(weights[ids] @ values))
        score = np.array(scores)
        above = _sigmoid(score[:, None] - cuts) if len(score) else np.zeros((0, GRADES - 1))
        return pa.StructArray.from_arrays([pa.array(score), pa.array(above.sum(1)), pa.array(above[:, KEEP_GRADE - 1])], names=["score", "expected_grade", "p_tail"])

    return judge(text)


def query(spark, sf_dir):
    """Every document's expected grade, tail probability and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, rated(table(spark, sf_dir, "labels")))
    q = F.col("q")
    return docs.select("doc_id", grade_scores(F.col("text"), model).alias("q")).select(
        "doc_id", q["score"].alias("score"), q["expected_grade"].alias("expected_grade"), q["p_tail"].alias("p_tail"), (q["p_tail"] >= KEEP_FROM).alias("kept")
    )
