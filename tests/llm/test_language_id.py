import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from residuum.llm import language_id as L
from residuum.llm import text_bytes as tb


def test_query_agrees_with_declarations(spark, data):
    rows = {r["doc_id"]: r for r in L.query(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert sum(rows[d["doc_id"]]["language"] == d["lang"] for d in docs) >= 0.97 * len(docs)


def test_scores_match_a_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.learn_text(docs)
    spaces = int(tb.gram_buckets(np.full(3, 32, np.uint8), L.BITS)[0])
    for r in docs.limit(20).select("text", L.text_scores(F.col("text"), model).alias("s")).collect():
        raw = tb.LETTERS[np.frombuffer(r["text"].encode(), np.uint8)]
        own = [int(tb.gram_buckets(raw[k : k + 3], L.BITS)[0]) for k in range(len(raw) - 2)]
        own = [b for b in own if b != spaces]
        assert r["s"]["letters"] == len(own)
        for w, x in zip(model.weights, r["s"]["ll"], strict=True):
            assert math.isclose(sum(float(w[b]) for b in own), x, rel_tol=1e-4, abs_tol=1e-2)


def test_foreign_and_empty_texts_go_and_clean_ones_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame(
        [(9001, "привет мир, как дела сегодня", "en", "src0", 9), (9002, None, "en", None, 0), (9003, "12 -- 34 !!", "de", "src1", 3)],
        docs.schema,
    )
    kept = L.filter_language(docs.unionByName(more))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not {9001, 9002, 9003} & ids and len(ids) == docs.count()


def test_short_texts_lean_on_their_evidence(spark):
    model = L.TextModel(("de", "en"), np.log(np.full((3, 1 << L.BITS), 1.0 / (1 << L.BITS))).astype(np.float32))
    scored = spark.createDataFrame(
        [(k, (3, [-30.0, -30.0, -31.0]), d, s, h) for k, (d, s, h) in enumerate([("de", None, None), ("en", None, None), (None, "de", None), (None, None, "b.x.de"), (None, None, None)])]
        + [(10 + k, (900, [-900.0, -990.0, -2000.0] if k % 2 else [-990.0, -900.0, -2000.0]), "de" if k % 2 else "en", "de" if k % 2 else "com", "b.x.de" if k % 2 else "a.y.com") for k in range(90)],
        "doc_id long, text_says struct<letters long, ll array<double>>, declared string, suffix string, host string",
    )
    out = {r["doc_id"]: r for r in L.fuse(scored, model, L.learn_evidence(scored, model)).collect()}
    assert [out[k]["language"] for k in (0, 1, 2, 3)] == ["de", "en", "de", "de"]
    assert out[0]["posterior"] > 0.9 > out[4]["posterior"]


def test_odd_rows(odd_docs, no_docs):
    kept = L.filter_language(odd_docs)
    assert kept.columns == odd_docs.columns and not {3, 4, 5} & {r["doc_id"] for r in kept.collect()}
    assert L.filter_language(no_docs).count() == 0
    assert L.filter_language(odd_docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_chunks_cover_all_rows():
    texts = pa.array(["x" * 3_000_000, None, "", "abc"] * 3)[1:]
    seen = [bytes(d[a:b]).decode() for _, d, o in tb.chunks(texts) for a, b in zip(o[:-1], o[1:], strict=True)]
    assert seen == [t or "" for t in texts.to_pylist()]


def test_markup_language_is_read_wherever_it_stands(spark):
    pages = [
        (1, "http://h.com/en/1", f"<!-- {'licence ' * 2000}<html lang='xx'> --><!DOCTYPE html>{' ' * 9000}<html lang='de'><body>x"),
        (2, "http://h.com/en/2", f"<script>var t = \"<html lang='xx'>\";</script>{'<!-- c -->' * 1000}<html class=a lang=fr>"),
        (3, "http://h.com/en/3", f"<html>{'text ' * 50_000}"),
    ]
    found = L.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["doc_id"]: r["page_declared"] for r in found} == {1: "de", 2: "fr", 3: None}


def test_every_declared_language_is_a_class(spark):
    names = [f"{a}{b}" for a in "abcdefghijkl" for b in "mnopqrstuv"]
    rows = [(100 * k + j, f"{c}zq{c} {c}xw{c} {c}kj{c} " * 30 + f"{j}", (c, c.upper(), f" {c}-XX")[j % 3], f"h{j}.com") for k, c in enumerate(names) for j in range(6)]
    docs = spark.createDataFrame([*rows, (99_999, "12 34", "UND", "h.com")], "doc_id long, text string, lang string, source string")
    assert L.learn_text(docs).languages == tuple(sorted(names))
    assert {r["doc_id"] for r in L.filter_language(docs).collect()} == {r[0] for r in rows}


def test_rare_declarations_and_suffixes_share_a_row(spark, monkeypatch):
    monkeypatch.setattr(L, "OWN_COUNTS", 1)
    model = L.TextModel(("de", "en"), np.zeros((3, 1), np.float32))
    rows = [("en", "com", 1)] * 30 + [("de", "com", 0)] * 20 + [(f"x{k}", f"s{k}", 0) for k in range(20)]
    scored = spark.createDataFrame(
        [(k, (900, [-900.0, -990.0, -2000.0] if w == 0 else [-990.0, -900.0, -2000.0]), d, s, None) for k, (d, s, w) in enumerate(rows)]
        + [(90, (3, [-30.0, -30.0, -31.0]), None, "s3", None), (91, (3, [-30.0, -30.0, -31.0]), "x5", None, None), (92, (3, [-30.0, -30.0, -31.0]), None, None, None)],
        "doc_id long, text_says struct<letters long, ll array<double>>, declared string, suffix string, host string",
    )
    evidence = L.learn_evidence(scored, model)
    assert set(evidence.declared) == {"de", "en", L.OTHER} and set(evidence.suffix) == {"com", L.OTHER}
    for k in range(2):
        assert math.isclose(sum(math.exp(r[k]) for r in evidence.declared.values()), 1)
    out = {r["doc_id"]: r for r in L.fuse(scored, model, evidence).collect()}
    assert out[90]["language"] == out[91]["language"] == "de" and min(out[90]["posterior"], out[91]["posterior"]) > 0.9 > out[92]["posterior"]
