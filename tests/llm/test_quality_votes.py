import random
import re
from collections import Counter

from residuum.llm import quality_votes as Q
from tests.llm.conftest import words


def plain(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + d for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for d in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def base(row):
    q = row["quality"]
    return q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(0, 60, 3)]
    texts += ["\n".join(rng.choice(["x y", " ", "", "z # |"]) for _ in range(9)) for _ in range(9)]
    texts += [None, "", "\x0b\x1c \u00a0", "a " * 8, "a " * 9, "\u00e9\U0001f600 ##"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in Q.with_features(df).collect():
        assert base(row) == plain(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_filter_keeps_columns_rows_and_clean_texts(odd_docs, no_docs):
    kept = Q.filter_quality(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids.count(2) == 2 and 1 in ids and not {3, 4, 5, 6, 9} & set(ids)
    assert Q.filter_quality(no_docs).count() == 0


def test_votes_find_the_rules_that_are_right():
    # Rule 0 is right always, rule 1 nearly always, rule 2 votes good on everything.
    code = lambda *v: sum(x * 3**k for k, x in enumerate(v))
    model = Q.fit({code(2, 2, 2): 900, code(1, 1, 2): 90, code(1, 0, 2): 10}, 3)
    assert model.log_odds([2, 2, 2]) > 0 > model.log_odds([1, 1, 2])
    assert model.accuracy(0)[0] > 0.9 and model.accuracy(0)[1] > 0.9
    assert abs(Q.fit({}, 3).log_odds([0, 0, 0])) < 0.1


def test_query_matches_labels(spark, data):
    found = {r["doc_id"]: r for r in Q.query(spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    passed = [x for x in labels if not found[x["doc_id"]]["base_failed"]]
    wrong = sum(bool(x["quality"]) != found[x["doc_id"]]["kept"] for x in passed)
    assert wrong <= 0.05 * len(passed)
