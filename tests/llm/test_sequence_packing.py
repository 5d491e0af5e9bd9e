import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from residuum.llm import sequence_packing as P

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def one_at_a_time(lengths, capacity):
    """Best-two-fit, sequence by sequence on a plain list."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        filling, gap = [], capacity
        for k in list(left):
            if k <= gap:
                filling.append(k)
                left.remove(k)
                gap -= k
        if gap and len(filling) > 1:
            small = filling.pop()
            room, best = gap + small, None
            for i in range(len(left)):
                for j in range(i):
                    both = left[i] + left[j]
                    if small < both <= room and (best is None or both > sum(best)):
                        best = (left[j], left[i])
            if best:
                left.append(small)
                for k in best:
                    left.remove(k)
                    filling.append(k)
                left.sort(reverse=True)
            else:
                filling.append(small)
        out.append(filling)
    return out


def test_counts_pack_as_single_pieces_do():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        fillings = P.best_two_fit(dict(Counter(lengths)), 40)
        assert sum(f.times for f in fillings) == len(one_at_a_time(lengths, 40))
        own = Counter()
        for f in fillings:
            assert sum(f.lengths) <= 40
            for k in f.lengths:
                own[k] += f.times
        assert own == Counter(lengths)


def test_cuts():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)] and P.cut(2049) == [(0, 1), (1, 2048)]
    assert P.cut(4096) == [(0, 2048), (2048, 2048)]


LATIN = st.text(st.characters(max_codepoint=0x24F), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.one_of(LATIN, st.text(max_size=30), st.sampled_from(["a<|endoftext|>b", "it's  \n\n x", "\u00a0\u2003y", "\x1c\x85z"])))
def test_ids_are_those_of_the_tokenizer(text):
    assert P.tokenizer(*P.vocabulary_paths())(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_documents_are_packed_without_gaps(odd_docs, no_docs):
    rows = P.pack_documents(odd_docs).collect()
    expected = Counter()
    for r in odd_docs.collect():
        ids = [*WHOLE.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(P.cut(len(ids))):
            expected[(r["doc_id"], piece, start, length, zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    assert P.pack_documents(no_docs).count() == 0
    assert P.tokenize(odd_docs, with_ids=True).filter("size(ids) = length").count() == len(rows)
