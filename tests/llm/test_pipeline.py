import corpus_pipeline
from residuum.llm import jaccard_join, language_id, quality_votes, source_mix
from tests.llm.test_jaccard_join import plain


def test_stages_follow_their_operators(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "jaccard_join", "source_mix", "sequence_packing"]
    languages, quality, copies, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    one = languages(spark, docs, data)
    assert ids(one) == ids(language_id.query(spark, data).filter("kept"))
    two = quality(spark, docs, data)
    assert ids(two) == ids(quality_votes.query(spark, data).filter("kept"))
    three = copies(spark, two, data).cache()
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert ids(three) == [d for d, _, c in plain(rows, 5, 80) if d == c]
    four = mixing(spark, three, data)
    taken = sum(r["copies"] for r in source_mix.decide(source_mix.sizes(three)).collect())
    assert four.count() == taken and four.columns == docs.columns
    five = packing(spark, four, data)
    assert five.filter("piece = 0").count() == taken
    assert jaccard_join.first_of_each(three, 5, 80).count() == three.count()


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
