import numpy as np

from residuum.llm import source_mix as M
from tests.llm.conftest import words


def water(sizes):
    """Targets by raising the shares of uncut sources round by round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, cut = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in cut]
        left = total - sum(2 * sizes[s] for s in cut)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over or over == set(free):
            return {s: 2.0 * sizes[s] if s in cut or s in over else share[s] for s in names}
        cut |= over


def test_targets_and_takings(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(n)), s) for k, (n, s) in enumerate(zip(rng.lognormal(3, 1, 900), rng.choice(["b", "a", "z", "\u00e9", ""], 900, p=[0.5, 0.2, 0.1, 0.1, 0.1]), strict=True))]
    rows += [(1000 + k, "x y", None) for k in range(9)] + [(2000, None, "a"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = M.mix(M.sizes(df)).collect()
    assert len(mixed) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target, taken, n = water(sizes), {}, {}
    for r in mixed:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        n[r["source"]] = n.get(r["source"], 0) + 1
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3, (s, taken[s], t)
    again = {(r["doc_id"], r["source"], r["size"], r["taken"]) for r in M.mix(M.sizes(df.repartition(7))).collect()}
    assert again == {(r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixed}


def test_flight_keeps_both_sums_and_means():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 400, 60))[::-1]
    pi = rng.random(60)
    mean = np.zeros(60)
    for _ in range(3000):
        p = M.settle(size, pi, rng.random(61))
        assert abs((p - pi).sum()) < 1e-6 and abs((p - pi) @ size) < 1e-3
        assert ((p > 0) & (p < 1)).sum() <= 2
        mean += p / 3000
    assert np.abs(mean - pi).max() < 0.05


def test_take_repeats_rows(odd_docs, no_docs):
    out = M.take(odd_docs)
    assert out.columns == odd_docs.columns
    chosen = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in M.decide(M.sizes(odd_docs)).collect()}
    expected = sum(chosen[(r["doc_id"], r["source"], len(words(r["text"])))] for r in odd_docs.collect())
    assert out.count() == expected
    assert M.take(no_docs).count() == 0
