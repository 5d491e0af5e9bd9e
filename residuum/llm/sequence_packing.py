"""Best-fit packing of documents into sequences, by Best-two-fit.

What packing decides depends on lengths alone, and there are no more of them
than a sequence has tokens. So documents are counted by length, the packing of
the counts is worked out once (as fillings, each with how often it repeats),
and every piece then looks up its place by its rank among the pieces of its
length. Neither the number of documents nor of sequences reaches the driver.

A null or empty text is the one token that ends a document. Documents longer
than a sequence are cut into whole sequences; the rest comes first. Rows with
the same doc_id are documents of their own. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from residuum.plans.tables import materialize, ship, table

SEQUENCE = 2048
#: The token that ends each document.
END_ID = 0
#: Pieces of a length that are ranked together, about.
RANK_GROUP = 4096
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Filling:
    """Pieces of these lengths make up a sequence; ``times`` sequences are like that."""

    lengths: tuple[int, ...]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int = SEQUENCE) -> list[Filling]:
    """Pack ``counts[length]`` pieces of each length.

    A sequence is filled greedily: the longest piece that is left, then each
    time the longest that still fits. Then its shortest piece goes back if two
    pieces that are left fill the gap more tightly. A filling repeats as long
    as its pieces last, as each of its choices would be made again.
    """
    left = np.zeros(capacity + 1, dtype=object)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    fillings = []
    # Lengths that are left, rising; exhausted ones are dropped.
    alive = [k for k in range(1, capacity + 1) if left[k]]
    while alive:
        used: dict[int, int] = {}
        gap, top, chosen = capacity, len(alive) - 1, []
        while top >= 0 and gap:
            k = alive[top]
            if k > gap or used.get(k, 0) >= left[k]:
                top -= 1
                continue
            take = min(gap // k, left[k] - used.get(k, 0))
            used[k] = used.get(k, 0) + take
            chosen += [k] * take
            gap -= k * take
        if gap and len(chosen) > 1:
            small = chosen[-1]
            used[small] -= 1
            if pair := _closest_pair(alive, left, used, gap + small, small):
                chosen[-1:] = pair
                for k in pair:
                    used[k] = used.get(k, 0) + 1
            else:
                used[small] += 1
        times = min(left[k] // n for k, n in used.items() if n)
        for k, n in used.items():
            left[k] -= n * times
        fillings.append(Filling(tuple(sorted(chosen, reverse=True)), int(times)))
        if any(not left[k] for k in used):
            alive = [k for k in alive if left[k]]
    return fillings


def _closest_pair(alive: list[int], left, used: dict[int, int], gap: int, over: int) -> tuple[int, int] | None:
    """Two lengths that are left whose sum is nearest below or at ``gap`` and above ``over``."""
    free = [k for k in alive if k < gap and left[k] > used.get(k, 0)]
    best, i, j = None, 0, len(free) - 1
    while i <= j:
        both = free[i] + free[j]
        if both > gap:
            j -= 1
            continue
        if i < j or left[free[i]] - used.get(free[i], 0) >= 2:
            if both > over:
                over, best = both, (free[j], free[i])
                if both == gap:
                    break
        i += 1
    return best


def places(fillings: list[Filling]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ranks rising.

    Pieces from that rank on lie at the offset in the sequences from there on,
    one in each. A few thousand rows in all, whatever is packed.
    """
    rows: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for f in fillings:
        offset = 0
        for k in f.lengths:
            rows.setdefault(k, []).append((seen.get(k, 0), sequence, offset))
            seen[k] = seen.get(k, 0) + f.times
            offset += k
        sequence += f.times
    return {k: np.array(r, dtype=np.int64) for k, r in rows.items()}


def _placer(runs: dict[int, np.ndarray]):
    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(rank), 2), dtype=np.int64)
        for k in np.unique(length):
            own, table = length == k, runs[int(k)]
            at = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
            out[own, 0], out[own, 1] = at[:, 1] + rank[own] - at[:, 0], at[:, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, a materialised frame with ``length``.

    A piece's rank among those of its length is counted within groups that a
    hash of the row makes, so no task gets all pieces of a frequent length.
    """
    ship(pieces.sparkSession)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = places(best_two_fit(counts, capacity))
    others = [c for c in pieces.columns if c != "length"]
    groups = -(-max(counts.values(), default=1) // RANK_GROUP)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*others), F.lit(groups)))
    before = W.Window.partitionBy("length").orderBy("_group").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_group").agg(F.count("*").alias("n")).select(
        "length", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(W.Window.partitionBy("length", "_group").orderBy(*others)) - 1
    return (
        dealt.withColumn("_inside", inside).join(starts, ["length", "_group"])
        .withColumn("_place", _placer(runs)("length", F.col("_start") + F.col("_inside")))
        .select(*pieces.columns, "_place.sequence_id", "_place.offset")
    )


#: Outside of these characters the two tokenizers' tables may differ; such texts go to the slower one.
_PLAIN = re.compile("[^\t-\r -~\u00a1-\u024f]")
_MARK = "<|endoftext|>"


@lru_cache(maxsize=1)
def _whole_tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary file; only texts that need it load it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=1)
def tokenizer(vocabulary: str, ranks: str):
    """A function from a text to its ids, for the vocabulary at these two paths.

    The rank file holds the same vocabulary as the other and is read by a
    faster library. Its ids are the same for texts of Latin letters; special
    tokens and all other texts go through the first file's library.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if _MARK in text or _PLAIN.search(text):
            return np.array(_whole_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def vocabulary_paths() -> tuple[str, str]:
    """Where the production vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


def cut(n: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than a sequence."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, capacity: int = SEQUENCE, paths=vocabulary_paths, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row's text.

    ``paths`` is called where the text is, as each machine has its own copy of
    the vocabulary. ``with_ids`` adds the ids themselves.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(*paths())
        for batch in batches:
            rows, own, ids_of = [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([END_ID], dtype="<u4"))
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    own.append(k)
                    rows.append((piece, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_of.append(part.astype(np.int32))
            piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 4
            columns = [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack(materialize(tokenize(docs), "pieces"))


def query(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
