"""The corpus pipeline: five stages over documents, each over all that its predecessor kept.

A stage's rows are written before the next one reads them, so each stage first
deletes the files that its predecessors' frames were read from.
"""

from __future__ import annotations

from residuum.llm import jaccard_join, language_id, quality_votes, sequence_packing, source_mix
from residuum.plans.tables import materialize, reclaim, table


def languages(spark, docs, sf_dir):
    """Documents whose text has a language."""
    reclaim(spark, docs)
    return language_id.filter_language(docs)


def quality(spark, docs, sf_dir):
    """Documents that the quality rules' votes keep."""
    reclaim(spark, docs)
    return quality_votes.filter_quality(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, likeness of 80 % or more."""
    reclaim(spark, docs)
    return jaccard_join.first_of_each(docs, width=5, percent=80)


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix to target weights takes them."""
    reclaim(spark, docs)
    return source_mix.take(docs)


def packing(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences."""
    reclaim(spark, docs)
    return sequence_packing.pack_documents(docs)


STAGES = [
    ("language_id", languages),
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("source_mix", mixing),
    ("sequence_packing", packing),
]

#: No SQL: training, the cube method and tokenisation are beyond it.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
