import random
import time

import numpy as np
from pyspark.sql import functions as F

from residuum.llm import toxicity as T


def all_maximal(scores):
    """Maximal scoring segments by their recursive definition: the best one, then both sides."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[b] - total[a], a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    _, _, _, a, b = best
    right = [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]
    return [*all_maximal(scores[:a]), (a, b, best[0]), *right]


def test_segments_match_their_definition():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(0, 25)
        scores = np.array([rng.choice([-0.3, -0.3, 1.37, 0.71, -1.13]) + rng.random() * 1e-4 if rng.random() < 0.4 else -0.3 for _ in range(n)])
        at = np.flatnonzero(scores != -0.3)
        found = T.segments(scores[at], at, -0.3, n)
        expected = all_maximal(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in found], [s for *_, s in expected])


def test_segments_take_linear_time():
    n = 100_000
    for scores in (3 / np.arange(1, n + 1), 3 * np.ones(n), np.arange(1, n + 1) / n, np.tile([0.1, 0.2, 5.0], n // 3)):
        start = time.time()
        T.segments(scores, np.arange(len(scores)) * 10, -0.05, 10 * n)
        T.segments(scores, np.arange(len(scores)) * 200, -0.05, 200 * n)
        assert time.time() - start < 2


def test_rate_solves_its_equation():
    scores, shares = np.array([-0.05, 6.0]), np.array([0.999, 0.001])
    rate = T.karlin_rate(scores, shares)
    assert abs(float(np.exp(rate * scores) @ shares) - 1) < 1e-6


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in T.query(spark, "/root/testdata/sf0.01").collect()}
    labels = [x for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if rows[x["doc_id"]]["held_out"]]
    toxic = [rows[x["doc_id"]]["score"] for x in labels if x["toxic"]]
    clean = [rows[x["doc_id"]]["score"] for x in labels if not x["toxic"]]
    auc = np.mean([np.mean([(t > c) + 0.5 * (t == c) for c in clean]) for t in toxic])
    assert auc > 0.85 and sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = T.learn(odd_docs, none)
    out = odd_docs.select(T.toxic_passages(F.col("text"), model).alias("t")).collect()
    assert len(out) == odd_docs.count() and all(0 < r["t"]["score"] < 0.5 and not r["t"]["passages"] for r in out)
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 1), (3, 1, 0), (None, None, None)], "doc_id long, toxic int, quality int")
    T.learn(odd_docs, labels)
    assert T.learn(no_docs, labels).words == {}


def test_passages_are_found():
    model = T.ToxicModel({"vile": 6.0, "scum": 6.0}, {"rotte": 5.0}, -0.05, 1.5, 0.01, -6.0, 3.0)
    calm = "word " * 60
    _, n, found = T.evidence(calm + "you vile scum rotten " + calm + "vile", model)
    assert n == 60 + 4 + 60 + 1
    assert any(a <= 61 and b >= 64 for a, b, _ in found)
    assert T.evidence(calm, model)[2] == []
