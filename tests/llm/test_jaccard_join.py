import random

import numpy as np
import pyarrow as pa
import pytest

from residuum.llm import jaccard_join as J
from residuum.llm import text_bytes as tb
from residuum.llm.components import components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def plain(rows, width, percent):
    """Components by comparing all texts, and sizes."""
    sets = [shingles(t, width) for _, t in rows]
    part = list(range(len(rows)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), doc), doc)
    return sorted((doc, len(sets[k]), least[root(k)]) for k, (doc, _) in enumerate(rows))


def mutated(rng, words, share):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 if rng.random() < share else w for w in words]


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 1024), (5, 80, 3)])
def test_components_match_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "TOGETHER", 2)
    monkeypatch.setattr(J, "FLUSH", 400 * block)
    rng = random.Random(width)
    rows = []
    passage = [f"p{k}" for k in range(40)]
    for group in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 25, 60, 200]))]
        chain = words
        for _ in range(8):
            chain = mutated(rng, chain, 0.02)
            rows.append(" ".join(chain))
            rows.append(" ".join(mutated(rng, words, rng.choice([0.0, 0.01, 0.03, 0.08]))))
        # Texts that share a passage and little else.
        rows += [" ".join(passage + [f"x{rng.randrange(9999)}" for _ in range(rng.randrange(1, 14))]) for _ in range(4)]
    rows += ["", None, " \n", "One", "ONE", "one two", "One Two three four", "one two three four"]
    rows = [(3 * k + 1, t) for k, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in J.join(df, width, percent).collect())
    assert found == plain(rows, width, percent)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in list(range(1, 60)) + [333, 1000]:
        for _ in range(6):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            extra = rng.integers(0, 2**63, n).astype(np.uint64)
            for gone in range(n):
                for new in {0, gone, n // 8}:
                    b = np.concatenate([a[gone:], extra[:new]])
                    if len(b) and 100 * (n - gone) >= 85 * (n + new):
                        assert set(J.signatures(a).tolist()) & set(J.signatures(b).tolist())
                if 100 * (n - gone) < 85 * n:
                    break


def test_counts_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)]))
        assert J._differ(J.bin_counts(a), J.bin_counts(b)) <= len(np.setxor1d(a, b))


def test_words_and_shingles_by_bytes():
    texts = ["", "One two", None, "a\x0bb\x0cc\rd e", "É é  x", "x" * 10, "tail "]
    got = []
    for _, data, offsets in tb.chunks(pa.array(texts)):
        hashes, at = tb.word_hashes(data, offsets)
        assert [int(b - a) for a, b in zip(at[:-1], at[1:], strict=True)] == [len((t or "").encode().split()) for t in texts]
        own, ends = tb.shingle_hashes(hashes, at, 4)
        got = [len(set(own[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [len(shingles(t, 4)) for t in texts]


def test_odd_rows(odd_docs, no_docs):
    rows = J.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[3]["component_id"] == 3 and by[4]["n_shingles"] == 0
    assert by[7]["component_id"] == by[8]["component_id"] == 7
    kept = J.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 3, 4, 5, 6, 7, 9} <= ids and not {2, 8} & ids
    assert J.join(no_docs).count() == 0 and J.first_of_each(no_docs).count() == 0


def test_one_row_of_each_component_stays(spark):
    text, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59))
    rows = [(5, text, "a"), (5, text, "a"), (5, "quite another text of its own", "b"), (7, near, "c"), (None, near, "d"),
            (None, "no other has this text", "e"), (None, "no other has this text", "f"), (None, None, "g"), (None, " ", "h"), (9, "", "i"), (9, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key0 string")
    kept = sorted((r["_key0"] for r in J.first_of_each(docs).collect()))
    assert kept[0:2] == ["a", "b"] and kept[2] in "ef" and kept[3:] == ["g", "h", "i", "i"]


def test_few_elements_are_left_out_safely():
    rng = np.random.default_rng(8)
    for percent in (80, 85):
        for n in (8, 21, 40, 90, 160, 400):
            for _ in range(40):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                gone = int(n * (100 - percent) / 100)
                both = [np.concatenate([a[k:], rng.integers(0, 2**63, max(0, m)).astype(np.uint64)]) for k in (gone, gone // 2) for m in (0, gone // 3)]
                for b in both:
                    same = len(np.intersect1d(a, b))
                    if 100 * same >= percent * (len(a) + len(b) - same):
                        assert set(J.signatures(a, percent).tolist()) & set(J.signatures(b, percent).tolist())


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(201, 200), (200, 201), (300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
