import datetime
import hashlib

import numpy as np
from pyspark.sql import functions as F

from residuum.llm import fingerprints as P
from tests.llm.conftest import words


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_matches_brute_force(spark, data):
    rows = {r["doc_id"]: r for r in P.query(spark, data).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    off, prints = [], {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [r["near_edited"] - jaccard(shingles(text), shingles(edited)), r["near_next"] - jaccard(shingles(text), shingles(after))]
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05 and np.abs(off).max() < 0.2


def test_odd_rows(odd_docs, no_docs, spark):
    docs = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = P.with_next(docs, sketch=P.sketch(F.col("text"))).select("doc_id", "text", P.packed(F.col("sketch")).alias("f"), F.col("next.doc_id").alias("n")).collect()
    assert len(out) == odd_docs.count()
    assert {r["f"] for r in out if not words(r["text"])} == {"0" * 256}
    assert len({r["f"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert sorted(r["n"] or 0 for r in out) == sorted(r["doc_id"] or 0 for r in out)
    assert P.with_next(no_docs.select("doc_id", "text")).count() == 0
    alone = P.with_next(spark.createDataFrame([(5, "x")], "doc_id long, text string")).first()
    assert alone["next"]["doc_id"] == 5
    far = spark.createDataFrame([(k * 10**12, str(k)) for k in range(50)] + [(1, "one")], "doc_id long, text string")
    following = {r["doc_id"]: r["next"]["doc_id"] for r in P.with_next(far).collect()}
    ids = sorted(following)
    assert following == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_next_by_any_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 3)
    wide = [-(2**63), 2**63 - 1, 0, 5, *range(10, 60), 4 * 10**18]
    for kind, ids in (("long", wide), ("string", [f"d{k}" for k in range(40)] + ["", "é"]), ("date", [datetime.date(2020, 1, k) for k in range(1, 29)])):
        df = spark.createDataFrame([(i, "x", 1, 2) for i in ids], f"doc_id {kind}, text string, part int, guest int")
        out = P.with_next(df, head_=F.upper("text"))
        assert out.columns == ["doc_id", "text", "part", "guest", "head_", "next"]
        ordered = sorted(ids, key=lambda i: i.encode() if isinstance(i, str) else i)
        assert {r["doc_id"]: r["next"]["doc_id"] for r in out.collect()} == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_one_far_id_doesnt_fill_a_range(spark):
    df = spark.range(5000).union(spark.createDataFrame([(4 * 10**18,)], "id long")).withColumnRenamed("id", "doc_id")
    cuts = P._cuts(df)
    sizes = [r["count"] for r in df.groupBy(P._range_of(F.col("doc_id"), cuts, "bigint").alias("r")).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 2000 and sum(sizes) == 5001


def test_short_texts_fill_bins_evenly(spark):
    base = [f"w{k}" for k in range(14)]
    rows = [(k, " ".join(base + [f"a{k}"]), " ".join(base + [f"b{k}"])) for k in range(300)]
    near = spark.createDataFrame(rows, "k int, a string, b string").select(P.likeness(P.sketch(F.col("a")), P.sketch(F.col("b")))).collect()
    assert abs(np.mean([r[0] for r in near]) - 10 / 12) < 0.03
