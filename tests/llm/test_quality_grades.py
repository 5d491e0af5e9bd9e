import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from residuum.llm import quality_grades as G


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = G.learn(docs, G.rated(labels.filter(~held)))
    rows = docs.join(labels.filter(held), "doc_id").select("doc_id", "quality", G.grade_scores(F.col("text"), model).alias("q")).collect()
    right = sum((r["q"]["p_tail"] >= 0.5) == bool(r["quality"]) for r in rows)
    assert right >= 0.93 * len(rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_thresholds_order_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 400)
    rows = [(np.array([1, 2, 10 + g]), np.array([0.3, rng.random(), 1.0])) for g in grades]
    model = G.fit(rows, grades)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[10] < model.weights[11] < model.weights[12]


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = G.learn(odd_docs, G.rated(none))
    out = odd_docs.select(G.grade_scores(F.col("text"), model).alias("q")).collect()
    assert len(out) == odd_docs.count() and all(r["q"]["p_tail"] > 0.9 for r in out)
    labels = spark.createDataFrame([(1, 0, 1), (6, 0, 0), (3, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    model = G.learn(odd_docs, G.rated(labels))
    assert odd_docs.select(G.grade_scores(F.col("text"), model).alias("q")).count() == odd_docs.count()
    assert G.learn(no_docs, G.rated(labels)).weights.max() == 0


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 25)
    rows = [(rng.integers(0, 9, 6), rng.random(6)) for _ in grades]
    args = (np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(25), 6), grades, rng.random(25))
    weights, cuts, step = rng.normal(size=9), np.array([-0.4, 0.7]), 1e-6
    _, by_weight, by_cut = G.loss(weights, cuts, *args)
    for k in range(9):
        e = np.eye(9)[k] * step
        assert abs((G.loss(weights + e, cuts, *args)[0] - G.loss(weights - e, cuts, *args)[0]) / (2 * step) - by_weight[k]) < 1e-5
    for k in range(2):
        e = np.eye(2)[k] * step
        assert abs((G.loss(weights, cuts + e, *args)[0] - G.loss(weights, cuts - e, *args)[0]) / (2 * step) - by_cut[k]) < 1e-5


def test_fit_nears_the_best_likelihood():
    """Against plain gradient descent with tiny steps, on few features."""
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 300)
    rows = [(np.array([1, 2, 3]), np.array([0.5, rng.normal() + g, rng.normal()])) for g in grades]
    ids, values, row = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(300), 3)
    share = (300 / (3 * np.bincount(grades)))[grades] / 300
    weights, cuts = np.zeros(4), np.linspace(-0.5, 0.5, 2)
    for _ in range(20000):
        best, a, b = G.loss(weights, cuts, ids, values, row, grades, share)
        weights, cuts = weights - 0.3 * a, cuts - 0.3 * b
    found = G.fit(rows, grades)
    own, *_ = G.loss(found.weights[:4].astype(float), np.array(found.thresholds), ids, values, row, grades, share)
    assert best <= own + 1e-9 and own < best + 0.01


def test_query_scores_match_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = G.learn(docs, G.rated(spark.read.parquet(f"{folder}/labels.parquet")))
    found = {r["doc_id"]: r for r in G.query(spark, folder).collect()}
    assert len(found) == docs.count()

    def bucket(a, b, c):
        return (((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> (32 - G.BITS)

    for r in docs.collect():
        data = (r["text"] or "").encode()
        total = 0.0
        for table in ([G.tb.LETTERS[x] for x in data], [G._SHAPE[x] ^ 0x5A for x in data]):
            seen = Counter(bucket(*map(int, table[k : k + 3])) for k in range(len(data) - 2))
            norm = sum(n * n for n in seen.values()) ** 0.5
            total += sum(model.weights[i] * n / norm for i, n in seen.items())
        total += sum(model.weights[i] * G._RATIO_WEIGHT for i in G._ratio_features(np.frombuffer(data, np.uint8)))
        p = [1 / (1 + np.exp(-(total - c))) for c in model.thresholds]
        own = found[r["doc_id"]]
        assert abs(own["score"] - total) < 1e-4 and abs(own["expected_grade"] - sum(p)) < 1e-4 and abs(own["p_tail"] - p[G.KEEP_GRADE - 1]) < 1e-4


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"d{k}", f"text number {k} " * (k + 1), 1) for k in range(9)], "doc_id string, text string, ids int")
    labels = spark.createDataFrame([(f"d{k}", k % 2, k % 2) for k in range(9)], "doc_id string, toxic int, quality int")
    model = G.learn(docs, G.rated(labels))
    assert docs.select("ids", G.grade_scores(F.col("text"), model).alias("q")).count() == 9 and model.weights.any()
